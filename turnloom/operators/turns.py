"""Messages, user turns, exchanges and term history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.config import Settings
from turnloom.functions import text as T
from turnloom.operators.ordered import following, running

CFG = Settings()


def _cut(cfg: Settings) -> dict:
    return {"block_rows": cfg.block_rows, "limit": cfg.longest}


def longest_turn(msgs: DataFrame) -> int:
    """The largest message index of any conversation: one column, one row back."""
    return msgs.agg(F.max("turn")).first()[0] or 0


def with_user_turn(msgs: DataFrame, cfg: Settings = CFG) -> DataFrame:
    """Add ``user_turn``: how many user messages the conversation has up to this row."""
    flag = F.when(F.col("role") == "user", 1).otherwise(0)
    return running(msgs, ["conv_id"], "turn", {"user_turn": ("sum", flag)}, **_cut(cfg))


def user_turns(msgs: DataFrame, cfg: Settings = CFG) -> DataFrame:
    return with_user_turn(msgs, cfg).where(F.col("role") == "user")


def by_role(msgs: DataFrame, role: str) -> DataFrame:
    return msgs.where(F.col("role") == role)


def exchanges(msgs: DataFrame, cfg: Settings = CFG) -> DataFrame:
    """(query, reply) per user turn; blank queries left out, a missing reply is null."""
    nxt = following(msgs, ["conv_id"], "turn", {"next_role": "role", "next_text": "text"}, **_cut(cfg))
    q = nxt.where((F.col("role") == "user") & (F.col("text") != ""))
    return q.select(
        "conv_id", "turn", F.col("text").alias("query"),
        F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("reply"),
    )


def answer_map(msgs: DataFrame, cfg: Settings = CFG) -> DataFrame:
    """First occurrence of each query per conversation with the answer that follows at once."""
    ex = exchanges(msgs, cfg)
    key = F.md5("query")
    first = ex.groupBy("conv_id", key.alias("query_key")).agg(F.min("turn").alias("turn"))
    return first.join(ex, ["conv_id", "turn"]).select("conv_id", "query_key", "turn", "query", F.col("reply").alias("answer"))


def answered_turns(msgs: DataFrame, cfg: Settings = CFG) -> DataFrame:
    """Each user message with the answer its query got the first time."""
    m = answer_map(msgs, cfg).select("conv_id", "query_key", F.col("turn").alias("first_turn"), "answer")
    q = user_turns(msgs, cfg).withColumn("query_key", F.md5("text"))
    return q.join(m, ["conv_id", "query_key"], "left").select(
        "conv_id", "turn", "user_turn", "first_turn", F.col("text").alias("query"), "answer"
    )


def with_facts(turns: DataFrame, terms=T.diagnostic_terms) -> DataFrame:
    return turns.withColumn(
        "facts", F.when(T.text_or_empty(F.col("answer")) != "", T.fact_terms(F.col("query"), F.col("answer"), terms))
    )


def first_seen(rows: DataFrame, terms: Column) -> DataFrame:
    """First message index at which a conversation mentions each term."""
    return (
        rows.select("conv_id", "turn", F.explode(F.array_distinct(terms)).alias("term"))
        .groupBy("conv_id", "term")
        .agg(F.min("turn").alias("first_turn"))
    )


def count_known(turns: DataFrame, terms: Column, seen: DataFrame, name: str) -> DataFrame:
    """Per turn: how many of ``terms`` the conversation had mentioned before.

    Term history is one first-mention row per (conversation, term), not a
    growing set per turn.
    """
    ex = turns.select("conv_id", "turn", F.explode(F.array_distinct(terms)).alias("term"))
    hit = ex.join(seen, ["conv_id", "term"]).where(F.col("first_turn") < F.col("turn"))
    return hit.groupBy("conv_id", "turn").agg(F.count("*").alias(name))


def prior_term_stats(msgs: DataFrame, cfg: Settings = CFG) -> DataFrame:
    """Per user turn: distinct terms said before it, and how many of its own terms were."""
    seen = first_seen(msgs, T.diagnostic_terms(F.col("text")))
    new_per_turn = seen.groupBy("conv_id", F.col("first_turn").alias("turn")).agg(F.count("*").alias("fresh"))
    d = with_user_turn(msgs, cfg).join(new_per_turn, ["conv_id", "turn"], "left")
    d = running(d, ["conv_id"], "turn", {"prior_terms": ("sum", F.coalesce("fresh", F.lit(0)))}, inclusive=False, **_cut(cfg))
    q = d.where(F.col("role") == "user")
    own = T.diagnostic_terms(F.col("text"))
    known = count_known(q, own, seen, "known_terms")
    return q.withColumn("n_terms", F.size(own)).join(known, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "user_turn", "prior_terms", "n_terms", F.coalesce("known_terms", F.lit(0)).alias("known_terms")
    )


def is_retrievable(msgs: DataFrame, cfg: Settings = CFG) -> DataFrame:
    """A turn is retrievable with two or more known query terms, or with no terms at all."""
    s = prior_term_stats(msgs, cfg)
    return s.withColumn("retrievable", (F.col("n_terms") == 0) | (F.col("known_terms") >= 2))


def turns_since_switch(msgs: DataFrame, cfg: Settings = CFG) -> DataFrame:
    """Turns since the last query that shared no term with any earlier query; 99 before the first switch."""
    q = user_turns(msgs, cfg)
    own = T.diagnostic_terms(F.col("text"))
    seen = first_seen(q, own)
    known = count_known(q, own, seen, "known")
    started = q.where(F.size(own) > 0).groupBy("conv_id").agg(F.min("turn").alias("start_turn"))
    d = q.join(known, ["conv_id", "turn"], "left").join(started, "conv_id", "left")
    switch = (F.col("start_turn") < F.col("turn")) & F.col("known").isNull()
    d = running(
        d.withColumn("is_switch", F.coalesce(switch, F.lit(False))),
        ["conv_id"], "user_turn",
        {"last_switch": ("max", F.when(F.col("is_switch"), F.col("user_turn")))}, **_cut(cfg),
    )
    since = F.coalesce(F.col("user_turn") - F.col("last_switch"), F.lit(99))
    return d.select("conv_id", "turn", "user_turn", "is_switch", since.alias("turns_since_switch"))


def stored_chunks(msgs: DataFrame, cfg: Settings = CFG, keep_hedges: bool = False) -> DataFrame:
    """Ingest: sanitise, drop refusals, give ids, and number the stored chunks per conversation.

    Same text in the same turn is one chunk.  ``seq`` is the insertion order.
    """
    d = with_user_turn(msgs, cfg).where((F.col("user_turn") >= 1) & F.col("role").isin("user", "assistant"))
    if not keep_hedges:
        d = d.where((F.col("role") == "user") | ~T.is_hedge(F.col("text")))
    d = d.where((F.col("role") == "user") | (F.col("text") != ""))
    d = d.withColumn("content", T.sanitize_for_storage(F.col("text"), cfg.max_chunk_chars)).drop("text")
    d = d.withColumn("chunk_id", T.chunk_id(F.col("user_turn"), F.col("content")))
    again = F.row_number().over(Window.partitionBy("conv_id", "chunk_id").orderBy("turn"))
    d = d.withColumn("_again", again).where(F.col("_again") == 1).drop("_again")
    d = running(d, ["conv_id"], "turn", {"seq": ("sum", F.lit(1))}, **_cut(cfg))
    return d.select(
        "conv_id", (F.col("seq") - 1).cast("long").alias("seq"), F.col("user_turn").cast("int").alias("user_turn"),
        "turn", "role", "chunk_id", T.fingerprint(F.col("content")).alias("fingerprint"), "content",
        T.estimate_tokens(F.col("content")).alias("tokens"),
        F.col("user_turn").cast("int").alias("last_ref"),
    )


def every_nth(df: DataFrame, order: list, rate: float = 0.1) -> DataFrame:
    """Every ``round(1/rate)``-th row in the given total order, starting with the first."""
    from turnloom.operators.ordered import dense_ordinal

    step = max(1, round(1.0 / rate))
    d = dense_ordinal(df.withColumn("_all", F.lit(0)), ["_all"], order)
    return d.where(F.col("ordinal") % step == 0).drop("_all")


def conversation_split(df: DataFrame, seed: int = 0, share: int = 8) -> DataFrame:
    """Train / held-out by conversation: the md5 of (seed, id) decides."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("conv_id").cast("string"))), 1, 7), 16, 10)
    return df.withColumn("split", F.when(h.cast("long") % 10 < share, "train").otherwise("held_out"))
