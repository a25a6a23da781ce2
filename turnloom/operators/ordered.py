"""Ordered work over keys of any size.

A plain ``Window.partitionBy(key)`` puts a whole key into one task.  Here a key
is cut into blocks of bounded size, work runs per (key, block), and one summary
row per block carries the state of earlier blocks forward.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from turnloom.session import checkpointed

BLK = "_blk"


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def with_block(df: DataFrame, order: str, rows: int) -> DataFrame:
    return df.withColumn(BLK, F.floor(F.col(order) / rows).cast("long"))


_MERGE = {
    # kind: (frame aggregate, block aggregate, combine(earlier blocks, this block))
    "sum": (F.sum, F.sum, lambda off, cur: F.coalesce(off, F.lit(0)) + F.coalesce(cur, F.lit(0))),
    "max": (F.max, F.max, lambda off, cur: F.greatest(off, cur)),
    "min": (F.min, F.min, lambda off, cur: F.least(off, cur)),
}


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    aggs: dict[str, tuple[str, Column]],
    inclusive: bool = True,
    block_rows: int = 4096,
    tie: list[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Running aggregates ``{name: (kind, column)}`` per key in ``order``.

    ``order`` is a non-negative integer with few rows per value, so a block of
    ``block_rows`` consecutive values is a bounded group.  Kinds: sum, max,
    min, and ``last`` (last non-null value).  ``limit`` is a proven upper
    bound of ``order``: below one block the plain window is bounded already.
    """
    if limit is not None and limit < block_rows:
        w = Window.partitionBy(*keys).orderBy(order, *(tie or []))
        w = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        for name, (kind, c) in aggs.items():
            if kind == "last":
                c = F.last(c, ignorenulls=True).over(w)
            else:
                c = _MERGE[kind][0](c).over(w)
                c = F.coalesce(c, F.lit(0)) if kind == "sum" else c
            df = df.withColumn(name, c)
        return df
    d = with_block(df, order, block_rows)
    cols = {}
    for name, (kind, c) in aggs.items():
        d = d.withColumn(f"_v_{name}", c)
        if kind == "last":
            d = d.withColumn(f"_v_{name}", F.when(c.isNotNull(), F.struct(F.col(order).alias("o"), c.alias("v"))))
        cols[name] = "max" if kind == "last" else kind
    part = [*keys, BLK]
    w = Window.partitionBy(*part).orderBy(order, *(tie or []))
    w = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    here = d
    for name, kind in cols.items():
        here = here.withColumn(f"_r_{name}", _MERGE[kind][0](f"_v_{name}").over(w))
    blocks = d.groupBy(*part).agg(*[_MERGE[k][1](f"_v_{n}").alias(f"_b_{n}") for n, k in cols.items()])
    before = Window.partitionBy(*keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(*part, *[_MERGE[k][0](f"_b_{n}").over(before).alias(f"_o_{n}") for n, k in cols.items()])
    out = here.join(offsets, part, "left")
    for name, kind in cols.items():
        c = _MERGE[kind][2](F.col(f"_o_{name}"), F.col(f"_r_{name}"))
        out = out.withColumn(name, c["v"] if aggs[name][0] == "last" else c)
    drop = [BLK] + [f"_{p}_{n}" for n in cols for p in ("v", "r", "o")]
    return out.drop(*drop)


def following(
    df: DataFrame, keys: list[str], order: str, cols: dict[str, str], block_rows: int = 4096, limit: int | None = None
) -> DataFrame:
    """The next row's values ``{new: source}`` per key, null at the end."""
    if limit is not None and limit < block_rows:
        w = Window.partitionBy(*keys).orderBy(order)
        return df.select("*", *[F.lead(s).over(w).alias(n) for n, s in cols.items()])
    d = with_block(df, order, block_rows)
    part = [*keys, BLK]
    w = Window.partitionBy(*part).orderBy(order)
    src = F.struct(*[F.col(s).alias(n) for n, s in cols.items()])
    here = d.withColumn("_nx", F.lead(src).over(w))
    heads = d.groupBy(*part).agg(F.min_by(src, F.col(order)).alias("_head"))
    nxt = heads.select(*part, F.lead("_head").over(Window.partitionBy(*keys).orderBy(BLK)).alias("_head"))
    out = here.join(nxt, part, "left").withColumn("_nx", F.coalesce("_nx", "_head"))
    for n in cols:
        out = out.withColumn(n, F.col("_nx")[n])
    return out.drop(BLK, "_nx", "_head")


def framed(
    df: DataFrame, keys: list[str], order: str, back: int, exprs: dict, block_rows: int = 4096, limit: int | None = None
) -> DataFrame:
    """Window expressions over the last ``back`` + 1 rows of a key.

    ``order`` is a dense ordinal.  Each block borrows the last ``back`` rows of
    the one before, so the frame is complete without one task per key.
    ``exprs`` maps a name to a function of the ordered window spec.
    """
    rows = max(block_rows, back, 1)
    if limit is not None and limit < rows:
        w = Window.partitionBy(*keys).orderBy(order)
        return df.select("*", *[make(w).alias(name) for name, make in exprs.items()])
    d = with_block(df, order, rows)
    lent = F.when(F.col(order) % rows >= rows - back, F.array(F.col(BLK), F.col(BLK) + 1)) if back else None
    targets = F.array(F.col(BLK)) if lent is None else F.coalesce(lent, F.array(F.col(BLK)))
    d = d.withColumn("_home", F.col(BLK)).withColumn(BLK, F.explode(targets))
    w = Window.partitionBy(*keys, BLK).orderBy(order)
    for name, make in exprs.items():
        d = d.withColumn(name, make(w))
    return d.where(F.col(BLK) == F.col("_home")).drop(BLK, "_home")


def ranged_running_sum(
    df: DataFrame, keys: list[str], order: list, values: dict[str, Column], parts: int | None = None
) -> DataFrame:
    """Exact running sums in any total order, by one distributed sort.

    Rows are range-partitioned by (keys, order), so a hot key spreads over many ranges, and summed within their range while they stream.  A key
    that goes on from an earlier range can only be a range's first, so what earlier ranges add is one row a range: the rows stay where they are and
    the carries come to them.  The summed layout is checkpointed: rows and carries see the same ranges even when executors are lost.
    Values are whole numbers or doubles; null counts as zero.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [_col(o) for o in order]
    names = df.columns
    d = df.select("*", *[c.alias(f"_v_{name}") for name, c in values.items()])
    whole = [isinstance(d.schema[f"_v_{name}"].dataType, (ty.IntegralType, ty.NullType)) for name in values]
    d = d.select(*[F.col(f"`{c}`") for c in names], *[F.coalesce(F.col(f"_v_{v}"), F.lit(0)).cast("long" if w else "double").alias(f"_v_{v}") for v, w in zip(values, whole)])
    ranged = d.repartitionByRange(n, *[F.col(k) for k in keys], *cols).sortWithinPartitions(*[F.col(k) for k in keys], *cols)

    sums_of = list(values)

    def local(batches):
        mine, done, last, run = TaskContext.get().partitionId(), [0] * len(sums_of), None, 0
        at = 0
        for b in batches:
            if not b.num_rows:
                continue
            starts = np.zeros(b.num_rows, bool)
            for k in keys:
                c = b.column(names.index(k))
                # the row before, over batches
                before = c.slice(0, 1) if last is None else last[k]
                x = pa.concat_arrays([before, c.slice(0, b.num_rows - 1)])
                same = pc.or_(pc.fill_null(pc.equal(x, c), False), pc.and_(pc.is_null(x), pc.is_null(c)))
                starts |= ~same.to_numpy(zero_copy_only=False)
            if last is None:
                starts[0] = False
            last = {k: b.column(names.index(k)).slice(b.num_rows - 1, 1) for k in keys}
            runs = np.cumsum(starts)
            heads = np.flatnonzero(starts)
            sums = []
            for i in range(len(sums_of)):
                v = b.column(len(names) + i).to_numpy(zero_copy_only=False)
                upto = np.cumsum(v)
                # what the batch held before a run's first row is taken off; the first run goes on from the batch before
                off = np.concatenate([[-done[i]], upto[heads] - v[heads]])[runs]
                sums.append(upto - off)
                done[i] = sums[i][-1]
            runs = runs + run
            run, at = int(runs[-1]), at + b.num_rows
            extra = [np.full(b.num_rows, mine, np.int32), runs.astype(np.int64), np.arange(at - b.num_rows, at)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *[pa.array(x) for x in [*sums, *extra]]], [*names, *[f"_r_{v}" for v in sums_of], "_pid", "_run", "_at"])

    new = [ty.StructField(f"_r_{v}", ty.LongType() if w else ty.DoubleType()) for v, w in zip(values, whole)]
    marks = [ty.StructField("_pid", ty.IntegerType()), ty.StructField("_run", ty.LongType()), ty.StructField("_at", ty.LongType())]
    d = checkpointed(ranged.mapInArrow(local, ty.StructType([*d.schema.fields[: len(names)], *new, *marks])))
    # one row a range: its first key, its last key with that key's sums, and whether there is more than one
    key = F.struct(*[F.col(k) for k in keys])
    ends = d.groupBy("_pid").agg(
        F.min_by(key, "_at").alias("head"), F.max_by(key, "_at").alias("tail"), F.max("_run").alias("runs"),
        *[F.max_by(f"_r_{v}", "_at").alias(f"sum_{v}") for v in values],
    )
    w = Window.orderBy("_pid")  # as many rows as there are ranges
    on = F.col("head").eqNullSafe(F.lag("tail").over(w)) & F.lag("_pid").over(w).isNotNull()
    c = ends.withColumn("on", on).withColumn("through", F.col("on") & (F.lag("runs").over(w) == 0))
    c = c.select("_pid", F.sum(F.when(F.col("through"), 0).otherwise(1)).over(w).alias("chain"), *[
        F.when(F.col("on"), F.lag(f"sum_{v}").over(w)).otherwise(0).alias(f"add_{v}") for v in values])
    chain = Window.partitionBy("chain").orderBy("_pid").rowsBetween(Window.unboundedPreceding, 0)
    carry = c.select("_pid", *[F.sum(f"add_{v}").over(chain).alias(f"_o_{v}") for v in values])
    out = d.join(F.broadcast(carry), "_pid")
    total = lambda v: F.col(f"_r_{v}") + F.when(F.col("_run") == 0, F.col(f"_o_{v}")).otherwise(0)
    return out.select(*[F.col(f"`{x}`") for x in names if x not in values], *[total(v).alias(v) for v in values])


def dense_ordinal(df: DataFrame, keys: list[str], order: list, name: str = "ordinal") -> DataFrame:
    """0-based position of each row within its key, for any total order."""
    out = ranged_running_sum(df, keys, order, {name: F.lit(1)})
    return out.withColumn(name, (F.col(name) - 1).cast("long"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per key, never holding a key in one task.

    Equal values collapse to counts first, then a running count finds the two
    order statistics each quantile needs.
    """
    ks = keys or ["_all"]
    d = df if keys else df.withColumn("_all", F.lit(0))
    counts = d.where(F.col(value).isNotNull()).groupBy(*ks, value).agg(F.count("*").alias("_n"))
    cum = ranged_running_sum(counts, ks, [value], {"_cum": F.col("_n")})
    if keys:
        j = cum.join(counts.groupBy(*ks).agg(F.sum("_n").alias("_total")), ks)
    else:
        j = cum.withColumn("_total", counts.agg(F.sum("_n")).scalar())
    j = j.withColumn("_first", F.col("_cum") - F.col("_n"))
    aggs = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("_total") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)

        def at(rank):
            return F.max(F.when((F.col("_first") <= rank) & (rank < F.col("_cum")), F.col(value).cast("double")))

        aggs += [at(lo).alias(f"_lo_{name}"), at(hi).alias(f"_hi_{name}"), F.max(pos - lo).alias(f"_fr_{name}")]
    out = j.groupBy(*ks).agg(*aggs)
    for name in probs:
        lo, hi, fr = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.col(f"_fr_{name}")
        out = out.withColumn(name, lo + (hi - lo) * fr)
    return out.select(*keys, *probs)
