"""Which chunks a conversation is likely to need next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.config import Settings
from turnloom.functions import fixed as V
from turnloom.functions import routing as R
from turnloom.operators.select import lru_evict

CFG = Settings()


def predictive_preload(chunks: DataFrame, cfg: Settings = CFG, n_queries: int = 3) -> DataFrame:
    """Chunk ids by the pattern of the last queries, each once, in a stable order.

    The store is the newest ``max_chunks`` chunks, so the order is ranked over
    a bounded set per conversation.
    """
    q = chunks.where(F.col("role") == "user")
    rn = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("seq")))
    last = q.withColumn("_rn", rn).where(F.col("_rn") <= n_queries)
    g = last.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", "content"))).alias("qs"))
    g = g.select("conv_id", F.transform("qs", lambda x: x.content).alias("queries"))
    g = g.select("conv_id", "queries", R.query_patterns(F.col("queries")).alias("patterns")).where(F.size("patterns") > 0)
    store = lru_evict(chunks, cfg.max_chunks)
    low = F.lower("content")
    has = lambda p: F.array_contains("patterns", p)
    words = F.filter(F.split(F.lower(F.element_at("queries", -1)), r"\s+"), lambda w: F.length(w) > 4)
    tier = (
        F.when(has("debugging") & R.contains_any(low, V.ERROR_TERMS), 0)
        .when(has("function_exploration") & R.contains_any(low, V.FUNCTION_TERMS), 0)
        .when(has("alternating_topics") & F.exists(words, lambda w: F.contains(low, w)), 1)
    )
    j = store.join(g, "conv_id").withColumn("tier", tier).where(F.col("tier").isNotNull())
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("tier", "seq"))
    return j.select("conv_id", "seq", "chunk_id", "patterns", pos.alias("position"))
