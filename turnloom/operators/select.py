"""Budgeted selection: skip-fill, last-N, LRU."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.config import Settings
from turnloom.operators.ordered import framed, running

CFG = Settings()


def _cut(cfg: Settings) -> dict:
    return {"block_rows": cfg.block_rows, "limit": cfg.longest}


def skip_fill(items: Column, budget: Column, keep_first: bool = False) -> Column:
    """Greedy fill over an ordered array of structs with ``tokens`` and ``seq``.

    An item that does not fit is skipped and later, smaller ones may still
    enter.  With ``keep_first`` the first item is taken whatever its size.
    Returns struct(used, kept) with ``kept`` the chosen ``seq`` values in order.
    """
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("kept"))

    def step(s, x):
        fits = s.used + x.tokens <= budget
        if keep_first:
            fits = fits | (F.size(s.kept) == 0)
        return F.struct(
            F.when(fits, s.used + x.tokens).otherwise(s.used).alias("used"),
            F.when(fits, F.concat(s.kept, F.array(x.seq.cast("long")))).otherwise(s.kept).alias("kept"),
        )

    return F.aggregate(items, start, step)


def budget_select(df: DataFrame, group: list[str], budget: Column, score: str = "score") -> DataFrame:
    """Choose rows (score, seq, tokens) per group within ``budget``, best score first, ties by ``seq``.

    Groups are candidate sets of one query, bounded by the store size.
    """
    item = F.struct((F.lit(0.0) - F.col(score)).alias("neg"), F.col("seq"), F.col("tokens"))
    g = df.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("items"), F.first(budget).alias("budget"))
    g = g.withColumn("fill", skip_fill(F.col("items"), F.col("budget")))
    return g.select(
        *group, "budget", F.col("fill.used").alias("used_tokens"),
        F.size("fill.kept").alias("chunks_used"), F.col("fill.kept").alias("selected"),
    )


def rolling_window(msgs: DataFrame, cfg: Settings = CFG) -> DataFrame:
    """The unbounded window: messages and tokens in the whole history up to each message."""
    return running(
        msgs, ["conv_id"], "turn", {"n_messages": ("sum", F.lit(1)), "prompt_tokens": ("sum", F.col("tokens"))},
        **_cut(cfg),
    )


def keep_last_n(msgs: DataFrame, n: int, value: Column, order: str = "turn", name: str = "window", cfg: Settings = CFG) -> DataFrame:
    """The last ``n`` values before each message, oldest first."""
    return framed(msgs, ["conv_id"], order, n, {name: lambda w: F.collect_list(value).over(w.rowsBetween(-n, -1))}, **_cut(cfg))


def recent_chunks(chunks: DataFrame, n: int = 3) -> DataFrame:
    """Chunks of the last ``n`` distinct turns of each conversation.

    The newest turns are found from the distinct (conversation, turn) pairs.
    """
    turns = chunks.select("conv_id", "user_turn").distinct()
    rn = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("user_turn")))
    last = turns.withColumn("_rn", rn).where(F.col("_rn") <= n).drop("_rn")
    return chunks.join(last, ["conv_id", "user_turn"], "left_semi")


def _newest(chunks: DataFrame, keep: int) -> DataFrame:
    # each salted share keeps its own newest first, so a huge conversation never meets in one task
    salted = chunks.withColumn("_salt", F.pmod(F.xxhash64("seq"), F.lit(1024)))
    share = Window.partitionBy("conv_id", "_salt").orderBy(F.desc(F.coalesce("last_ref", F.lit(0))), F.desc("seq"))
    chunks = salted.withColumn("_rn", F.row_number().over(share)).where(F.col("_rn") <= keep).drop("_rn", "_salt")
    w = Window.partitionBy("conv_id").orderBy(F.desc(F.coalesce("last_ref", F.lit(0))), F.desc("seq"))
    return chunks.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep).drop("_rn")


def lru_evict(chunks: DataFrame, max_chunks: int = 1000) -> DataFrame:
    """The ``max_chunks`` most recently referenced chunks; on ties the later inserted stay."""
    return _newest(chunks, max_chunks)


def deletion_candidates(chunks: DataFrame, max_chunks: int = 1000) -> DataFrame:
    """What ``lru_evict`` drops: everything older than the oldest kept chunk."""
    key = F.struct(F.coalesce("last_ref", F.lit(0)).alias("r"), F.col("seq").alias("s"))
    slim = chunks.select("conv_id", "last_ref", "seq")
    edge = _newest(slim, max_chunks).groupBy("conv_id").agg(F.min(key).alias("_edge"))
    return chunks.join(edge, "conv_id").where(key < F.col("_edge")).drop("_edge")


def archive_prune(archive: DataFrame, current: DataFrame, max_age: int = 1000, max_records: int = 2000) -> DataFrame:
    """Drop records unreferenced for more than ``max_age`` turns, then the least recent above the cap."""
    live = archive.join(current, "conv_id").where(
        F.coalesce("last_ref", F.lit(0)) >= F.col("current_turn") - F.lit(max_age)
    )
    return _newest(live, max_records).drop("current_turn")
