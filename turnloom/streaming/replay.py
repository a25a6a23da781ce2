"""Replay as a stream: the same step as the batch walk, state kept per conversation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from turnloom.config import Settings
from turnloom.operators.replay import COLS, Conversation, message_features, out_schema

CFG = Settings()


def replay_stream(exchanges: DataFrame, cfg: Settings = CFG, use_archive: bool = True, idle: str | None = None) -> DataFrame:
    """Stream of exchanges (conv_id, user_turn, query, reply, control) to assembled contexts.

    ``control = 'reset'`` clears a conversation.  A row without a reply only
    assembles and stores the query (curate); a later row with the same turn,
    a null query and the reply stores it (observe).

    A reset may restart the numbering of turns, so rows that carry an
    ``event_no`` are taken in its order; without it the turn number orders a
    batch, which is right only while numbers rise.
    """
    no = F.col("event_no") if "event_no" in exchanges.columns else F.col("user_turn")
    parts = F.array(
        F.struct(F.lit("user").alias("role"), F.col("query").alias("text"), F.lit(0).alias("part")),
        F.struct(F.lit("assistant").alias("role"), F.col("reply").alias("text"), F.lit(1).alias("part")),
    )
    d = exchanges.select("conv_id", "user_turn", "control", no.cast("long").alias("event_no"), F.explode(parts).alias("m"))
    d = d.select("conv_id", "user_turn", "control", "event_no", "m.*")
    # a query is kept even when empty; a missing part is dropped, control rows are carried by the query part
    d = d.where((F.col("part") == 0) | (F.coalesce("text", F.lit("")) != ""))
    d = d.withColumn("given", F.col("text").isNotNull()).withColumn("text", F.coalesce("text", F.lit("")))
    d = d.withColumn("turn", (F.col("user_turn") * 2 + F.col("part")).cast("long"))
    f = message_features(d, cfg, keep=["control", "given", "event_no"])

    def step(key, batches, state):
        conv = Conversation(cfg, use_archive)
        if state.exists:
            conv.load(state.get[0])
        elif state.hasTimedOut:
            state.remove()
            return
        rows = [m for pdf in batches for m in pdf.to_dict("records")]
        rows.sort(key=lambda m: (m["event_no"], m["turn"]))
        out, query, replies = [], None, []
        for m in [*rows, None]:
            if m is None or m["role"] == "user":
                if query is not None:
                    out.append(conv.turn(query, replies))
                query, replies = None, []
                if m is None:
                    break
                if m["control"] == "reset":
                    conv = Conversation(cfg, use_archive)
                if m["given"]:
                    query = m
            elif query is not None:
                replies.append(m)
            elif m["storable"]:
                conv.add(m, int(m["user_turn"]))
        state.update((conv.dump(),))
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=COLS)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return f.groupBy("conv_id").applyInPandasWithState(step, out_schema(f), "blob binary", "append", timeout)

