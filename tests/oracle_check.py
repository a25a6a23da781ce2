"""Run registered queries against their SQL on the same tables and compare."""

from __future__ import annotations

import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/", 2)[0])

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark_df, con, sql: str) -> str:
    """'' when equal, else what differs."""
    a_cols = spark_df.columns
    a = rows_of(a_cols, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    b_cols = [c[0] for c in cur.description]
    b = rows_of(b_cols, cur.fetchall())
    if sorted(a_cols) != sorted(b_cols):
        return f"columns {sorted(a_cols)} != {sorted(b_cols)}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; first {a[:2]} | {b[:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        tol = all(
            all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-6) for p, q in zip(x, y)) for x, y in bad
        )
        return f"{'tiny ' if tol else ''}{len(bad)} of {len(a)} rows differ: {sorted(a_cols)} {str(bad[0][0])[:300]} | {str(bad[0][1])[:300]}"
    types = {type(v) for r in a[:50] for v in r} - {type(v) for r in b[:50] for v in r}
    return f"types {types}" if types - {type(None)} else ""


def main(argv):
    import __spark_entry__ as entry
    from turnloom import build_session

    sf_dir = "/root/testdata/sf0.01"
    spark = build_session(cores="8", shuffle=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    qs, os_ = entry.queries(), entry.oracle_sql()
    pick = [a for a in argv if not a.startswith("-")]
    n_ok = 0
    todo = [q for q in qs if not pick or any(q == p or (p.endswith("*") and q.startswith(p[:-1])) for p in pick)]
    for name in todo:
        t = time.time()
        try:
            df = qs[name](spark, sf_dir)
            if name in os_:
                msg = compare(df, con, os_[name])
            else:
                msg = f"(rows only: {df.count()})"
        except Exception as e:  # noqa: BLE001
            msg = "ERROR " + str(e)[:1500]
        if msg == "" or msg.startswith("(rows"):
            n_ok += 1
        print(f"{'ok ' if msg == '' else '   '}{name:32s} {time.time() - t:6.1f}s {msg}", flush=True)
    print(f"{n_ok} of {len(todo)}")


if __name__ == "__main__":
    main(sys.argv[1:])
