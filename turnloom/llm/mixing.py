"""Mixing of sources to target weights by hash-random keys and distributed prefix sums.

Each row gets a key from a hash of its id.  Rows are sorted by source and key into ranges; running sums of sizes over all ranges, less those at a
source's start, say how much of the source comes before a row.  A source with target t and size s is taken floor(t / s) times as a whole; what is
left of t is cut off its rows in key order, exactly: the row at the cut gives a part of its size.

Targets share the whole size by weight.  A source's target ends at ``limit`` times its size, and what goes beyond is shared anew among the
others.  In rising order of size by weight the sources at their limit come first, so a prefix sum finds where they end and no rounds are needed.

Sources are ranked, and the tables of sources and ranges are handled, in the same distributed way: there may be any number of them.

Defined cases: a null text has size 0; rows of size 0 are taken 0 times; a null source is one source, the last; a null id hashes as an empty
string; rows that repeat an id are taken each (in order of size and text, copies are interchangeable); an empty table or a table without words
gives targets of 0; other columns are carried if named in ``carry``, and a result that has the name of one gets an underscore in front.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import fresh, staged, table
from turnloom.llm.running import running_sums


@dataclass(frozen=True)
class MixSettings:
    #: by rank of the source, repeating
    weights: tuple[int, ...] = (5, 2, 1)
    #: a target is at most this many times its source's size
    limit: int = 3
    seed: str = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cfg: MixSettings = MixSettings()) -> DataFrame:
    """``sizes`` (source, source_size) with the weight, the target in words (double) and whether it is the limit."""
    by_name = [F.col("source").isNull().asc(), F.col("source").asc()]
    ranked, _, (rank,) = running_sums(sizes.withColumn("one", F.lit(1).cast("long")), by_name, ["one"], "mix-ranks")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in cfg.weights]), (F.col(rank) % len(cfg.weights) + 1).cast("int"))
    s = ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * cfg.limit).alias("most"))
    filled, _, (most_before, weight_before) = running_sums(s, [(F.col("most") / F.col("weight")).asc(), *by_name], ["most", "weight"], "mix-targets")
    all_ = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    left, weights = F.lit(all_["size"]) - F.col(most_before), F.lit(all_["weight"]) - F.col(weight_before)
    # products of sums may be beyond a long
    wide = "decimal(38,0)"
    at_limit = F.col("most").cast("decimal(19,0)") * weights.cast("decimal(19,0)") < (left.cast("decimal(19,0)") * F.col("weight").cast("decimal(19,0)")).cast(wide)
    filled = filled.select("source", "source_size", "weight", "most", at_limit.alias("at_limit"), left.alias("left"), weights.alias("weights"))
    # the first source below its limit has what all such sources share
    level = filled.where("not at_limit").agg(F.max_by(F.struct("left", "weights"), "weights").alias("x")).first()["x"]
    share = F.lit(float(level["left"])) * F.col("weight") / F.lit(float(level["weights"])) if level else F.lit(0.0)
    target = F.when(F.col("at_limit"), F.col("most").cast("double")).otherwise(share)
    return filled.select("source", "source_size", "weight", "at_limit", target.alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", size: Column | None = None, carry: tuple[str, ...] = (), cfg: MixSettings = MixSettings()) -> DataFrame:
    """Per row of ``docs``: key, source, size, source_size, target, epochs (times it is taken as a whole), part (more words taken), taken, and ``carry``.

    ``size`` is the number of words of the column ``text`` unless given.
    """
    carried = list(dict.fromkeys([key, source, *carry]))
    size_, source_size, target, epochs, part_, taken = fresh(docs.select(*carried), "size", "source_size", "target", "epochs", "part", "taken")
    draw, tie, row, start, rest, range_, src = (f"{n} of the mix" for n in ("draw", "tie", "row", "start", "rest", "range", "source"))
    tied = F.xxhash64("text") if "text" in docs.columns else F.lit(0).cast("long")
    given = docs.select(
        *[F.col(f"`{c}`") for c in carried],
        (word_count(F.col("text")) if size is None else F.coalesce(size.cast("long"), F.lit(0))).alias(size_),
        F.substring(F.sha2(F.concat(F.lit(f"{cfg.seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256), 1, 16).alias(draw),
        tied.alias(tie),
        # tells copies of a row apart, so that a range may end between them
        F.monotonically_increasing_id().alias(row),
    )
    given = staged(given, "mix-rows")
    s = F.col(f"`{source}`")
    order = [s.isNull().asc(), s.asc(), F.col(draw).asc(), F.col(f"`{key}`").asc(), F.col(size_).asc(), F.col(tie).asc(), F.col(row).asc()]
    rows, part, (before,) = running_sums(given, order, [size_], "mix-sums")

    # a source has at most one row per range here
    pieces = rows.groupBy(s.alias(src), F.col(part).alias(range_)).agg(F.sum(size_).alias("words"), F.min(before).alias("first"))
    pieces = staged(pieces, "mix-pieces")
    sizes = pieces.groupBy(F.col(src).alias("source")).agg(F.sum("words").alias("source_size"))
    targets = staged(source_targets(staged(sizes, "mix-sizes"), cfg), "mix-shares")
    first = pieces.withColumn(start, F.min("first").over(Window.partitionBy(src)))
    budget = F.floor(F.col("target") + 0.5).cast("long")
    some = F.greatest("source_size", F.lit(1))
    per = first.join(targets, F.col(src).eqNullSafe(F.col("source"))).select(
        src, range_, start, F.col("source_size").alias(source_size), F.col("target").alias(target), F.floor(budget / some).cast("long").alias(epochs), (budget % some).alias(rest)
    )
    # the hot source is many keys here, one a range
    j = rows.join(per, s.eqNullSafe(F.col(src)) & (F.col(part) == F.col(range_)))
    n = F.col(size_)
    more = F.greatest(F.lit(0), F.least(n, F.col(rest) - (F.col(before) - F.col(start))))
    return j.select(*[F.col(f"`{c}`") for c in carried], size_, source_size, target, epochs, more.alias(part_), (F.col(epochs) * n + more).alias(taken))


def op11_mixing(spark, d) -> DataFrame:
    return mix(table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: Words before a row by a window; the limit by the same order of sources.
OP11_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    substr(sha256('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 16) AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source),
f AS (SELECT *, (SELECT sum(size) FROM d) - (sum(3 * source_size) OVER up - 3 * source_size) AS r, (SELECT sum(w) FROM s) - (sum(w) OVER up - w) AS rw FROM s
    WINDOW up AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
level AS (SELECT max_by(r, rw) AS r, max(rw) AS rw FROM f WHERE NOT 3 * source_size * rw < r * w),
t AS (SELECT source, source_size, CASE WHEN 3 * source_size * f.rw < f.r * w THEN 3.0 * source_size ELSE level.r::DOUBLE * w / level.rw::DOUBLE END::DOUBLE AS target FROM f, level),
b AS (SELECT *, floor(target + 0.5)::BIGINT AS budget FROM t),
p AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS prev FROM d)
SELECT doc_id, size, source_size, target,
    (budget // greatest(source_size, 1) * size + greatest(0, least(size, budget % greatest(source_size, 1) - prev)))::BIGINT AS taken
FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source
"""
