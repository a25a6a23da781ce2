"""The FIFO window of every message, by a scan over bounded summaries.

An older message of cost c is only taken while every newer one that costs at most c was taken too: the rest never grows, so what is taken
now would have fitted before.  So it stays within reach of later windows just as long as the newer messages of at most its cost, and itself,
fit the window.  The messages within reach (the *stair*) are few, bounded by the budget and not by the history, and a stair is all that later
messages need to know of earlier ones.  Stairs of neighbouring stretches merge into that of both.

A conversation is cut into blocks.  Each block gives its stair, stairs are summed up over groups of blocks, and carried back down; then each
block is walked once from the stair before it.  Rows stream through sorted; a task holds one stair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.config import Settings
from turnloom.session import checkpointed

CFG = Settings()


class Stair:
    """Messages within reach, oldest first: place, cost, and what newer ones of at most that cost sum up to."""

    def __init__(self, window: int):
        self.window = window
        self.seq = self.cost = self.newer = np.empty(0, np.int64)

    def push(self, seq: int, cost: int) -> None:
        newer = self.newer + np.where(self.cost >= cost, cost, 0)
        near = newer + self.cost <= self.window
        new = [cost] if cost <= self.window else []
        self.seq = np.concatenate([self.seq[near], [seq][: len(new)]]).astype(np.int64)
        self.cost = np.concatenate([self.cost[near], new]).astype(np.int64)
        self.newer = np.concatenate([newer[near], [0][: len(new)]]).astype(np.int64)

    def extend(self, seqs, costs) -> Stair:
        for s, c in zip(seqs, costs):
            self.push(int(s), int(c))
        return self

    def fill(self, rest: int) -> tuple[int, list[int]]:
        """(tokens, places) that fit ``rest``, newest first."""
        fits = np.flatnonzero(self.cost <= rest)[::-1]
        used, kept = 0, []
        for s, c in zip(self.seq[fits].tolist(), self.cost[fits].tolist()):
            if used + c <= rest:
                used += c
                kept.append(s)
        return used, kept


def _scan(rows: DataFrame, window: int, emit: str, schema: str) -> DataFrame:
    """Walk (conv_id, key, at, seqs, costs) in the order of ``at``, a new stair for each (conv_id, key); rows with ``at`` below 0 only start it.

    ``emit``: "total" gives each key's stair, "before" the stair before each row, "fill" the window of each row's one message.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def work(batches):
        key, s, kind = None, None, pa.null()
        out = []

        def table():
            cols = list(zip(*out)) or [()] * 4
            types = [kind, pa.int64(), pa.int64() if emit == "fill" else pa.list_(pa.int64()), pa.list_(pa.int64())]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        for b in batches:
            kind = b.schema.field(0).type
            for conv, part, at, seqs, costs in zip(*(c.to_pylist() for c in b.columns)):
                if key != (conv, part):
                    if emit == "total" and key is not None:
                        out.append((*key, s.seq.tolist(), s.cost.tolist()))
                    key, s = (conv, part), Stair(window)
                if at >= 0 and emit == "before":
                    out.append((conv, at, s.seq.tolist(), s.cost.tolist()))
                if at >= 0 and emit == "fill":
                    used, kept = s.fill(window - costs[0])
                    out.append((conv, at, costs[0] + used, [*reversed(kept), at]))
                s.extend(seqs, costs)
                if len(out) >= 1000:
                    yield table()
        if emit == "total" and key is not None:
            out.append((*key, s.seq.tolist(), s.cost.tolist()))
        if out:
            yield table()

    names = [f.name for f in rows.sparkSession.createDataFrame([], schema).schema]
    d = rows.select("conv_id", "key", "at", "seqs", "costs").repartition(n, "conv_id", "key").sortWithinPartitions("conv_id", "key", "at")
    return d.mapInArrow(work, schema)


def fifo_window(msgs: DataFrame, window_tokens: int = 4000, order: str = "turn", cfg: Settings = CFG, fan: int = 256) -> DataFrame:
    """Per message: the newest-first skip-fill over its whole history, newest always kept whatever its size.

    ``msgs`` has (conv_id, <order>, tokens).  ``order`` is a non-negative integer with few gaps, distinct within a conversation.  A null cost
    counts as 0; a message that costs nothing is always kept and never leaves reach.  ``fan`` blocks make a group.
    Returns (conv_id, <order>, used_tokens, kept), the kept positions oldest first.
    """
    seq, cost = F.col(order).cast("long"), F.coalesce(F.col("tokens").cast("long"), F.lit(0).cast("long"))
    m = msgs.select("conv_id", F.floor(seq / cfg.block_rows).cast("long").alias("key"), seq.alias("at"), F.array(seq).alias("seqs"), F.array(cost).alias("costs"))
    kind = m.schema["conv_id"].dataType.simpleString()
    stair = f"conv_id {kind}, key long, seqs array<long>, costs array<long>"
    group = F.floor(F.col("key") / fan).cast("long")
    start = F.lit(-1).cast("long").alias("at")
    # a row a block; read twice below
    blocks = checkpointed(_scan(m, window_tokens, "total", stair)).withColumn("at", F.col("key")).withColumn("key", group)
    groups = _scan(blocks, window_tokens, "total", stair)
    # in the order of groups, one a conversation's ``block_rows * fan`` messages
    carried = _scan(groups.select("conv_id", F.lit(0).cast("long").alias("key"), F.col("key").alias("at"), "seqs", "costs"), window_tokens, "before", stair)
    before = _scan(carried.withColumn("at", start).unionByName(blocks), window_tokens, "before", stair)
    return _scan(before.withColumn("at", start).unionByName(m), window_tokens, "fill", f"conv_id {kind}, `{order}` long, used_tokens long, kept array<long>")
