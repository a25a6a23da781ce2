"""Conversations as event streams: ``curate`` asks for context, ``observe`` brings a reply, ``reset`` starts anew.

State is typed and kept per conversation: a value (epoch, turn, next place in the store, last event), a list (ids stored in the
current turn) and a map (place -> stored chunk, at most ``max_chunks``).  An event only writes what it changes.  With ``idle_ms`` the state of
a conversation that nothing has touched for so long expires; a query that is to end with its input then needs
``spark.sql.streaming.noDataMicroBatches.enabled`` off.

Events of one conversation count in the order of ``event_no``; an event whose number is not above the last one seen is a repetition and is
ignored, so the result doesn't depend on how events are batched, and a source may deliver more than once.  Turn numbers are counted here
and start again at 1 after a reset; ``epoch`` says how many resets came before.

Defined cases: a blank query is rejected and counts no turn; a reply that is blank or a refusal isn't stored; a reply before any query is stored at
turn 0; an unknown kind is ignored; a reset of an unknown conversation is one; rows without an ``event_no`` have no place and are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from turnloom.config import Settings
from turnloom.functions import routing as R
from turnloom.functions import text as T
from turnloom.functions import vectors as X

CFG = Settings()
OUT = (
    "conv_id {}, event_no long, kind string, outcome string, epoch long, turn long, store_chunks long, "
    "route string, budget long, used_tokens long, selected_ids array<string>, top_raw double"
)
PLACE = "epoch long, turn long, next long, event long"
CHUNK = "chunk_id string, turn long, tokens int, has_term boolean, norm double, vec array<double>"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_typed_state(spark: SparkSession) -> None:
    """Typed state needs the RocksDB state store; to be called before the stream starts."""
    spark.conf.set(PROVIDER, ROCKS)


def event_features(events: DataFrame, cfg: Settings = CFG, encoder=None) -> DataFrame:
    """All text work of an event as columns, before the state is met."""
    d = events.where(F.col("event_no").isNotNull()).withColumn("plain", T.strip(T.text_or_empty(F.col("text"))))
    d = d.withColumn("content", T.sanitize_for_storage(F.col("plain"), cfg.max_chunk_chars))
    d = d.withColumn("vec", X.embed_text(F.col("content"), encoder, cfg.embedding_dims))
    return d.select(
        "conv_id", F.col("event_no").cast("long").alias("event_no"), "kind", "content", (F.col("plain") == "").alias("blank"),
        T.is_hedge(F.col("plain")).alias("hedge"), T.estimate_tokens(F.col("content")).cast("int").alias("tokens"),
        T.vocab_matches(F.col("content")).alias("has_term"), F.col("vec").cast("array<double>").alias("vec"),
        X.norm(F.col("vec")).alias("norm"), R.route(F.col("content"))["score"].cast("int").alias("route_score"),
    )


def handed_out(cfg: Settings, query: Row, turn: int, store: dict[int, tuple]) -> dict:
    """The chunks that a query gets: by relevance, fresh ones first, within the budget."""
    chunks = [store[i] for i in sorted(store)]
    turns = [c[1] for c in chunks]
    score = query.route_score + (turn - min(turns, default=turn) > 30)
    route = "escalation" if score >= 3 else "medium" if score >= 2 else "ultra_small"
    raw = np.zeros(0)
    if chunks:
        v = np.array([c[5] for c in chunks])
        raw = (v @ np.array(query.vec)) / (query.norm * np.array([c[4] for c in chunks]) + X.EPS)
        raw = raw + np.where([c[3] for c in chunks], cfg.vocab_boost, 0.0)
        if route == "medium":
            raw = np.full(len(chunks), cfg.medium_score)
    age = turn - np.array(turns)
    eff = raw / cfg.decay_multiplier ** np.minimum(age / 10.0, 3.0)
    eff = np.maximum(0.0, np.where(age > cfg.stale_threshold, eff * 0.5, eff))
    lo, hi = cfg.budget_ranges[route]
    budget = min(int(lo + (hi - lo) * min(int((eff > 0.6).sum()) / 10.0, 1.0)), cfg.max_context - cfg.generation_headroom)
    budget = budget if cfg.fixed_budget is None else cfg.fixed_budget
    used, ids = 0, []
    for i in np.argsort(-eff, kind="stable"):
        if used + chunks[i][2] <= budget:
            used += chunks[i][2]
            ids.append(chunks[i][0])
    return {"route": route, "budget": budget, "used_tokens": used, "selected_ids": ids, "top_raw": float(raw.max()) if len(raw) else 0.0}


NOTHING = {"route": None, "budget": None, "used_tokens": None, "selected_ids": None, "top_raw": None}


class ConversationSession(StatefulProcessor):
    """One conversation's events in order."""

    def __init__(self, cfg: Settings = CFG, idle_ms: int | None = None) -> None:
        self.cfg, self.idle_ms = cfg, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", PLACE, self.idle_ms)
        self.said = handle.getListState("said", "chunk_id string", self.idle_ms)
        self.chunks = handle.getMapState("chunks", "seq long", CHUNK, self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        cfg = self.cfg
        epoch, turn, following, last = self.place.get() if self.place.exists() else (0, 0, 0, None)
        store = {k[0]: tuple(v) for k, v in self.chunks.iterator()} if self.chunks.exists() else {}
        said = [r[0] for r in self.said.get()] if self.said.exists() else []
        touched = False

        def keep(r: Row) -> bool:
            nonlocal following
            chunk_id = hashlib.md5(f"{turn}:{r.content}".encode()).hexdigest()[:12]
            if chunk_id in said:
                return False
            row = (chunk_id, turn, r.tokens, r.has_term, r.norm, list(r.vec))
            said.append(chunk_id)
            self.said.appendValue((chunk_id,))
            self.chunks.updateValue((following,), row)
            store[following] = row
            following += 1
            while len(store) > cfg.max_chunks:
                old = min(store)
                del store[old]
                self.chunks.removeKey((old,))
            return True

        for r in sorted(rows, key=lambda r: r.event_no):
            if last is not None and r.event_no <= last:
                continue
            last, touched = r.event_no, True
            out, outcome = NOTHING, "ignored"
            if r.kind == "reset":
                self.chunks.clear()
                self.said.clear()
                store, said = {}, []
                epoch, turn, following, outcome = epoch + 1, 0, 0, "reset"
            elif r.kind == "curate" and r.blank:
                outcome = "rejected"
            elif r.kind == "curate":
                turn += 1
                self.said.clear()
                said = []
                out, outcome = handed_out(cfg, r, turn, store), "handed out"
                keep(r)
            elif r.kind == "observe":
                outcome = "left out" if r.blank or r.hedge else "stored" if keep(r) else "known"
            yield Row(conv_id=key[0], event_no=r.event_no, kind=r.kind, outcome=outcome, epoch=epoch, turn=turn, store_chunks=len(store), **out)
        if touched:
            self.place.update((epoch, turn, following, last))

    def close(self) -> None:
        pass


def session_stream(events: DataFrame, cfg: Settings = CFG, idle_ms: int | None = None, encoder=None) -> DataFrame:
    """A stream of (conv_id, event_no, kind, text) to one row per event that says what it did and, for ``curate``, what it got."""
    f = event_features(events, cfg, encoder)
    out = OUT.format(events.schema["conv_id"].dataType.simpleString())
    return f.groupBy("conv_id").transformWithState(ConversationSession(cfg, idle_ms), out, "Append", "None" if idle_ms is None else "ProcessingTime")
