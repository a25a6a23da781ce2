"""Quality rules with adaptive thresholds.

Each text is measured once.  Per (language, source) a mergeable quantile sketch of every measure is built; sketches
are tables of (group, bucket, count), so merging is adding counts: partial sums on the map side, one row per bucket after
the shuffle, and coarser groups (language, everything) come from adding the sketches of finer ones, not from the rows.
Buckets are log-linear (7 significant bits), which bounds the relative error of a quantile by 1/64, whatever the number
of rows, and makes results equal from run to run.

The threshold of a group is the fence ``q50 + reach * max(tail - q50, floor)`` above the median, and the mirrored one below
for two-sided measures.  ``tail`` is an outer quantile of the group's own sketch (RULES), so a group with a wide spread gets a wide
fence; the floor only keeps a group without any spread from losing rows over a single symbol or line.  A fence removes what lies far
outside of its own group and nothing from a homogeneous one, unlike a fixed percentile, which always removes its share.  Symbols take the
quartile, as a tenth of a source may well be markup; repeats, which most documents don't have at all, take the 95th of 100.  Groups with fewer than ``min_rows`` rows take the sketch of their language,
and then that of the whole table.  Thresholds are joined back with salted keys, as one source may hold a third of all rows.

Defined cases: null text counts as no words and fails the base rule; a null language or source is a group of its own; repeated
rows are judged each; an empty table gives an empty result; other columns are carried as they are, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import SPACE, fresh, staged, table, worker_cache

SYMBOLS = b"#*$%&|<>"
MAX_WORDS = 100_000
MEASURES = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_lines:bigint,n_dup_lines:bigint,n_repeat_words:bigint>"


@dataclass(frozen=True)
class QualitySettings:
    min_words: int = 50
    max_repeat_percent: int = 50
    reach: int = 8
    min_rows: int = 100
    salts: int = 32


#: measure, tail quantile, smallest spread counted, lower side judged too.  Integers per 1,000 (word length in hundredths).
RULES = [
    ("word_length", 0.9, 10, True),
    ("symbols", 0.75, 25, False),
    ("dup_lines", 0.95, 45, False),
    ("repeat_words", 0.95, 25, False),
]


def measure_text(raw: bytes | None, ids) -> tuple[int, int, int, int, int, int]:
    """(words, code points in words, symbols, lines with a word, repeated lines, words in repeated 3-word windows)."""
    if not raw:
        return (0, 0, 0, 0, 0, 0)
    words = raw.split()
    n = len(words)
    if not n:
        return (0, 0, len(raw) - len(raw.translate(None, SYMBOLS)), 0, 0, 0)
    solid = raw.translate(None, SPACE)
    # continuation bytes of UTF-8 are 0x80 to 0xBF
    chars = len(solid) if solid.isascii() else len(solid.decode("utf-8", "surrogatepass"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n >= 4:
        w = np.fromiter(map(ids.__getitem__, words), np.int64, n)
        if int(w.max()) >= 1 << 21:
            w = np.unique(w, return_inverse=True)[1]
        if n < 1 << 21:  # three numbers of 21 bits: a window is exact, not a hash
            win = (w[:-2] << 42) | (w[1:-1] << 21) | w[2:]
        else:
            pair = np.unique(w[:-1] * (int(w.max()) + 1) + w[1:], return_inverse=True)[1]
            win = pair[:-1] * (int(w.max()) + 1) + w[2:]
        s = np.sort(win)
        if (again := s[1:][s[1:] == s[:-1]]).size:
            at = np.minimum(np.searchsorted(again, win), again.size - 1)
            twice = again[at] == win
            cover = np.zeros(n, bool)
            cover[:-2] |= twice
            cover[1:-1] |= twice
            cover[2:] |= twice
            repeated = int(cover.sum())
    return (n, chars, symbols, len(lines), len(lines) - len(set(lines)), repeated)


def _measure_arrow(texts: pa.Array) -> pa.Array:
    worker_cache("quality")
    ids = defaultdict(count().__next__)
    rows = []
    for raw in texts:
        raw = raw.as_py()
        rows.append(measure_text(raw, ids))
        if len(ids) > MAX_WORDS:  # numbers need to agree within one text only
            ids = defaultdict(count().__next__)
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    cols = np.array(rows, np.int64).reshape(-1, 6)
    return pa.StructArray.from_arrays([pa.array(cols[:, i]) for i in range(6)], names)


def measures(text: Column) -> Column:
    """Struct of the measures of a text column."""
    return F.arrow_udf(_measure_arrow, MEASURES)(text.cast("binary"))


def base_failed(m: Column, cfg: QualitySettings = QualitySettings()) -> Column:
    return (m["n_words"] < cfg.min_words) | (m["n_repeat_words"] * 100 > m["n_words"] * cfg.max_repeat_percent)


def rates(m: Column) -> list[Column]:
    """The judged measures, in the order of RULES; null for a text without words."""
    some = F.when(m["n_words"] > 0, m["n_words"])
    lines = F.when(m["n_lines"] > 0, m["n_lines"])
    return [
        F.floor(m["word_chars"] * 100 / some).cast("long"),
        F.floor(m["n_symbols"] * 1000 / some).cast("long"),
        F.floor(m["n_dup_lines"] * 1000 / lines).cast("long"),
        F.floor(m["n_repeat_words"] * 1000 / some).cast("long"),
    ]


def bucket(v: Column) -> Column:
    """Lowest value of the log-linear bucket of a non-negative integer: its 7 leading bits."""
    drop = F.greatest(F.length(F.bin(v)) - 7, F.lit(0))
    width = F.pow(F.lit(2), drop).cast("long")
    return v - v % width


def sketch(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Quantile sketches: one row per (keys, measure, bucket) with its count.  Nulls and negative values are not counted."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), v.alias("v")) for n, v in values.items()]))
    long = df.select(*keys, each.alias("x")).select(*keys, "x.measure", F.col("x.v").alias("v")).where("v >= 0")
    return long.groupBy(*keys, "measure", bucket(F.col("v")).alias("bucket")).agg(F.count("*").alias("n"))


def merge_sketches(sk: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups: the counts of the finer ones added."""
    return sk.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sk: DataFrame, keys: list[str], qs: dict[str, float]) -> DataFrame:
    """Per group and measure the row count and the named quantiles (nearest rank, lower end of the bucket).

    A group has at most 64 buckets per power of two, so its buckets are one bounded array.
    """
    packed = sk.groupBy(*keys, "measure").agg(
        F.sum("n").alias("rows"), F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("hist")
    )

    def at(q: float) -> Column:
        need = F.greatest(F.ceil(F.col("rows") * F.lit(q)), F.lit(1))
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("v"))
        return F.aggregate(
            "hist", start,
            lambda acc, x: F.struct(
                (acc["seen"] + x["n"]).alias("seen"),
                F.when(acc["v"].isNotNull(), acc["v"]).when(acc["seen"] + x["n"] >= need, x["bucket"]).alias("v"),
            ),
        )["v"]

    return packed.select(*keys, "measure", "rows", *[at(q).alias(n) for n, q in qs.items()])


def thresholds(measured: DataFrame, m: str, lang: str, source: str, cfg: QualitySettings) -> DataFrame:
    """One row per (lang, source): struct column ``fences`` with ``<measure>_hi`` and, if two-sided, ``<measure>_lo``."""
    ok = measured.where(~base_failed(F.col(m), cfg)).select(
        F.col(lang).alias("lang"), F.col(source).alias("source"), *[r.alias(n) for (n, *_), r in zip(RULES, rates(F.col(m)))]
    )
    fine = sketch(ok, ["lang", "source"], {n: F.col(n) for n, *_ in RULES})
    # the sketches of coarser groups are sums of the finer ones: each bucket counts for its group, its language and all
    none = F.lit(None).cast("string")
    up = F.array(
        F.struct(F.lit(3).alias("level"), "lang", "source"),
        F.struct(F.lit(2).alias("level"), "lang", none.alias("source")),
        F.struct(F.lit(1).alias("level"), none.alias("lang"), none.alias("source")),
    )
    every = merge_sketches(fine.select(F.explode(up).alias("g"), "measure", "bucket", "n").select("g.*", "measure", "bucket", "n"), ["level", "lang", "source"])
    tails = {f"up{round(t * 100)}": t for _, t, _, _ in RULES} | {f"down{round(t * 100)}": round(1 - t, 2) for _, t, _, two in RULES if two}
    q = staged(quantiles(every, ["level", "lang", "source"], {"q50": 0.5, **tails}), "quality-quantiles")
    stat = F.struct("rows", "q50", *tails)
    a = q.where("level = 3").select("lang", "source", "measure", stat.alias("s"))
    b = q.where("level = 2").select(F.col("lang").alias("lang_"), F.col("measure").alias("measure_"), stat.alias("l"))
    c = q.where("level = 1").select("measure", stat.alias("a"))
    j = a.join(b, F.col("lang").eqNullSafe(F.col("lang_")) & (F.col("measure") == F.col("measure_")), "left").join(c, "measure", "left")
    best = F.when(F.col("s.rows") >= cfg.min_rows, F.col("s")).when(F.col("l.rows") >= cfg.min_rows, F.col("l")).otherwise(F.col("a"))
    j = j.select("lang", "source", "measure", best.alias("q"))

    def fence(tail: float, floor: int, side: int) -> Column:
        spread = (F.col(f"q.{'up' if side > 0 else 'down'}{round(tail * 100)}") - F.col("q.q50")) * side
        return F.col("q.q50") + side * cfg.reach * F.greatest(spread, F.lit(floor).cast("long"))

    fences = [F.max(F.when(F.col("measure") == n, fence(t, f, 1))).alias(f"{n}_hi") for n, t, f, _ in RULES]
    fences += [F.max(F.when(F.col("measure") == n, fence(t, f, -1))).alias(f"{n}_lo") for n, t, f, two in RULES if two]
    return j.groupBy("lang", "source").agg(*fences)


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", carry: list[str] | None = None,
          cfg: QualitySettings = QualitySettings()) -> tuple[DataFrame, str, str, str]:
    """(rows with measures and verdicts, and the names of the columns of measures, base verdict and verdict).

    ``carry`` are the columns of ``docs`` kept (all, if None).  Texts are read and measured once; measured rows are
    staged, since the sketches and the filter both read them.
    """
    m, failed, kept, salt, lang_, source_, salt_, fences_ = fresh(docs, "measures", "base_failed", "kept", "salt", "lang_", "source_", "salt_", "fences_")
    carry = list(docs.columns if carry is None else carry)
    keys = [c for c in (lang, source) if c not in carry]
    rows = staged(docs.select(*[F.col(f"`{c}`") for c in carry + keys], measures(F.col(f"`{text}`")).alias(m)), "quality-measures")
    t = thresholds(rows, m, lang, source, cfg)
    t = t.withColumn(salt_, F.explode(F.sequence(F.lit(0), F.lit(cfg.salts - 1))))
    t = t.select(F.col("lang").alias(lang_), F.col("source").alias(source_), salt_, F.struct(*[c for c in t.columns if c.endswith(("_hi", "_lo"))]).alias(fences_))
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(m, *[F.col(f"`{c}`") for c in carry[:1]]), F.lit(cfg.salts)).cast("int"))
    same = (
        F.col(f"`{lang}`").eqNullSafe(F.col(lang_)) & F.col(f"`{source}`").eqNullSafe(F.col(source_)) & (F.col(salt) == F.col(salt_))
    )
    j = salted.join(t, same, "left")
    inside = F.lit(True)
    for (n, _, _, two), r in zip(RULES, rates(F.col(m))):
        inside &= F.coalesce(r <= F.col(f"{fences_}.{n}_hi"), F.lit(True))
        if two:
            inside &= F.coalesce(r >= F.col(f"{fences_}.{n}_lo"), F.lit(True))
    bad = base_failed(F.col(m), cfg)
    out = j.select(*[F.col(f"`{c}`") for c in carry], m, bad.alias(failed), (~bad & inside).alias(kept))
    return out, m, failed, kept


def quality_filter(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", cfg: QualitySettings = QualitySettings()) -> DataFrame:
    """The rows of ``docs`` that pass, with its columns."""
    out, _, _, kept = judge(docs, text, lang, source, None, cfg)
    return out.where(F.col(kept)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_quality(spark, d) -> DataFrame:
    out, m, failed, kept = judge(table(spark, d, "documents"), carry=["doc_id"])
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("doc_id", *[F.col(f"{m}.{c}").alias(c) for c in cols], F.col(failed).alias("base_failed"), F.col(kept).alias("kept"))


#: The same rows by DuckDB: sketches as grouped counts, quantiles by running sums.
OP1_SQL = r"""
WITH w AS MATERIALIZED (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
pos AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
win AS (SELECT doc_id, i, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM pos WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x, y, z) AS c FROM win WHERE z IS NOT NULL) WHERE c > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS i FROM dup, range(3) r(k)) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         CASE WHEN n_words > 0 THEN word_chars * 100 // n_words END AS word_length, CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words END AS symbols,
         CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines END AS dup_lines, CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words END AS repeat_words FROM m),
l AS (
  SELECT lang, source, x.measure AS measure, x.v AS v FROM (
    SELECT lang, source, unnest([{'measure': 'word_length', 'v': word_length}, {'measure': 'symbols', 'v': symbols},
                                 {'measure': 'dup_lines', 'v': dup_lines}, {'measure': 'repeat_words', 'v': repeat_words}]) AS x
    FROM b WHERE NOT base_failed) WHERE x.v >= 0),
sk AS (SELECT lang, source, measure, v - v % (1::BIGINT << greatest(length(bin(v)) - 7, 0)) AS bucket, count(*) AS n FROM l GROUP BY ALL),
sk3 AS (SELECT 3 AS lvl, lang, source, measure, bucket, n FROM sk
  UNION ALL SELECT 2, lang, NULL, measure, bucket, sum(n) FROM sk GROUP BY lang, measure, bucket
  UNION ALL SELECT 1, NULL, NULL, measure, bucket, sum(n) FROM sk GROUP BY measure, bucket),
run AS (SELECT *, sum(n) OVER (PARTITION BY lvl, lang, source, measure ORDER BY bucket) AS seen, sum(n) OVER (PARTITION BY lvl, lang, source, measure) AS total FROM sk3),
q AS (SELECT lvl, lang, source, measure, any_value(total) AS total, min(bucket) FILTER (seen >= greatest(ceil(total * 0.5), 1)) AS q50,
             min(bucket) FILTER (seen >= greatest(ceil(total::DOUBLE * 0.1::DOUBLE), 1)) AS q10, min(bucket) FILTER (seen >= greatest(ceil(total::DOUBLE *
               (CASE measure WHEN 'word_length' THEN 0.9 WHEN 'symbols' THEN 0.75 ELSE 0.95 END)::DOUBLE), 1)) AS tail
      FROM run GROUP BY lvl, lang, source, measure),
pick AS (
  SELECT s.lang, s.source, s.measure, CASE s.measure WHEN 'word_length' THEN 10 WHEN 'dup_lines' THEN 45 ELSE 25 END AS floor,
         CASE WHEN s.total >= 100 THEN s.q10 WHEN g.total >= 100 THEN g.q10 ELSE a.q10 END AS q10,
         CASE WHEN s.total >= 100 THEN s.q50 WHEN g.total >= 100 THEN g.q50 ELSE a.q50 END AS q50,
         CASE WHEN s.total >= 100 THEN s.tail WHEN g.total >= 100 THEN g.tail ELSE a.tail END AS tail
  FROM q s LEFT JOIN q g ON g.lvl = 2 AND g.lang IS NOT DISTINCT FROM s.lang AND g.measure = s.measure
           LEFT JOIN q a ON a.lvl = 1 AND a.measure = s.measure WHERE s.lvl = 3),
fence AS (SELECT lang, source, measure, q50 + 8 * greatest(tail - q50, floor) AS hi, q50 - 8 * greatest(q50 - q10, floor) AS lo FROM pick),
wide AS (SELECT lang, source, max(hi) FILTER (measure = 'word_length') AS wl_hi, max(lo) FILTER (measure = 'word_length') AS wl_lo,
  max(hi) FILTER (measure = 'symbols') AS sy_hi, max(hi) FILTER (measure = 'dup_lines') AS du_hi, max(hi) FILTER (measure = 'repeat_words') AS re_hi
  FROM fence GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(word_length <= wl_hi, true) AND coalesce(word_length >= wl_lo, true) AND coalesce(symbols <= sy_hi, true)
    AND coalesce(dup_lines <= du_hi, true) AND coalesce(repeat_words <= re_hi, true) AS kept
FROM b LEFT JOIN wide ON wide.lang IS NOT DISTINCT FROM b.lang AND wide.source IS NOT DISTINCT FROM b.source
"""
