"""Stateful replay of conversations, turn by turn.

What one turn refreshes, selects or archives changes later turns, so a
conversation is walked in order.  All text work (ids, vectors, terms, density,
routing signals) is done before, in parallel, as columns; the walk holds only
the bounded store and archive of the conversation at hand.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.config import Settings
from turnloom.functions import routing as R
from turnloom.functions import text as T
from turnloom.functions import vectors as X
from turnloom.operators.candidates import greedy_dedup
from turnloom.operators.turns import with_user_turn
from turnloom.session import checkpointed

CFG = Settings()

OUT_SCHEMA = (
    "conv_id {}, turn int, route string, budget int, used_tokens int, chunks_used int, selected_ids array<string>, "
    "top_raw double, drift_detected boolean, gate_fired boolean, archive_hits int, resurrected int, archived int, "
    "store_chunks int, archive_chunks int"
)
COLS = OUT_SCHEMA.replace(",", "").split(" ")[::2]


def out_schema(df: DataFrame) -> str:
    return OUT_SCHEMA.format(df.schema["conv_id"].dataType.simpleString())


def prepare_replay(msgs: DataFrame, cfg: Settings = CFG, encoder=None) -> DataFrame:
    """Per message everything the walk needs; no text goes along."""
    d = with_user_turn(msgs, cfg).where((F.col("user_turn") >= 1) & F.col("role").isin("user", "assistant"))
    d = d.where((F.col("role") == "user") | (F.col("text") != ""))
    return message_features(d, cfg, encoder)


def message_features(d: DataFrame, cfg: Settings = CFG, encoder=None, keep: list[str] | None = None) -> DataFrame:
    d = d.withColumn("content", T.sanitize_for_storage(F.col("text"), cfg.max_chunk_chars))
    store = (F.col("role") == "user") | ~T.is_hedge(F.col("text"))
    return d.select(
        "conv_id", "turn", F.col("user_turn").cast("int").alias("user_turn"), "role", store.alias("storable"),
        T.chunk_id(F.col("user_turn"), F.col("content")).alias("chunk_id"), T.estimate_tokens(F.col("content")).alias("tokens"),
        X.embed_text(F.col("content"), encoder, cfg.embedding_dims).alias("vec"),
        T.vocab_matches(F.col("content")).alias("has_term"), T.info_density(F.col("content")).alias("density"),
        T.words4(F.col("content")).alias("words"), R.route(F.col("text"))["score"].alias("route_score"),
        T.content_key(F.col("content")).alias("key"), *(keep or []),
    )


class Conversation:
    """Store and archive of one conversation."""

    def __init__(self, cfg: Settings, use_archive: bool, relevant_only: bool = True) -> None:
        self.cfg, self.use_archive, self.relevant_only = cfg, use_archive, relevant_only
        self.store: dict[str, dict] = {}
        self.archive: dict[str, dict] = {}

    # -- store ---------------------------------------------------------------
    def add(self, m, turn: int) -> None:
        prev = self.store.get(m["chunk_id"])
        row = dict(m, turn=turn, last=turn, hist=[], vec=np.asarray(m["vec"], dtype=float), words=frozenset(m["words"]))
        if prev is not None:
            prev.update(row)
        else:
            self.store[m["chunk_id"]] = row
        excess = len(self.store) - self.cfg.max_chunks
        if excess > 0:
            for c in sorted(self.store.values(), key=lambda c: c["last"])[:excess]:
                self._remove(c)

    def _remove(self, c: dict) -> None:
        self.store.pop(c["chunk_id"], None)
        if self.use_archive and (c["hist"] or not self.relevant_only):
            self.archive[c["chunk_id"]] = c
            self._trim()

    def _trim(self) -> None:
        while len(self.archive) > self.cfg.archive_max_records:
            old = min(self.archive.values(), key=lambda c: c["last"])
            self.archive.pop(old["chunk_id"])

    # -- one assembly ----------------------------------------------------------
    def assemble(self, q: dict, turn: int, extras: list[dict]) -> dict:
        cfg = self.cfg
        pool = [*self.store.values(), *extras]
        n_store = len(self.store)
        turns = {c["turn"] for c in self.store.values()}
        score = q["route_score"] + (len(turns) > 30)
        route = "escalation" if score >= 3 else "medium" if score >= 2 else "ultra_small"
        lo, hi = cfg.budget_ranges[route]
        out = {"route": route, "drift": False, "selected": [], "used": 0, "top": 0.0, "top_id": None, "raw": {}}
        if pool:
            V = np.stack([c["vec"] for c in pool])
            norms = np.sqrt((V * V).sum(axis=1))
            qv = np.asarray(q["vec"], dtype=float)
            if route == "medium":
                raw = np.full(len(pool), cfg.medium_score)
            else:
                raw = (V @ qv) / (np.sqrt((qv * qv).sum()) * norms + X.EPS)
                raw = raw + np.where([c["has_term"] for c in pool], cfg.vocab_boost, 0.0)
            t = np.array([c["turn"] for c in pool])
            alive = np.ones(len(pool), dtype=bool)
            if len(pool) > 1:
                den = np.outer(norms, norms)
                dup = (V @ V.T) / np.where(den == 0, 1e-9, den) > cfg.dedup_threshold
                alive, fresh = greedy_dedup(dup, np.array([c["density"] for c in pool]), t)
                for k, v in fresh.items():
                    if k < n_store:
                        pool[k]["last"] = max(pool[k]["last"], v)
            recent_turns = sorted(turns)[-cfg.drift_recent_turns :]
            recent = np.array([i < n_store and c["turn"] in recent_turns for i, c in enumerate(pool)])
            if len(pool) >= 5 and recent.any():
                a, b = V[recent].sum(axis=0), V[: len(pool) // 2].sum(axis=0)
                d = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
                out["drift"] = bool(1.0 - (float(a @ b / d) if d else 0.0) > cfg.drift_threshold)
            age = turn - np.array([c["last"] for c in pool])
            eff = raw / cfg.decay_multiplier ** np.minimum(age / 10.0, 3.0)
            if out["drift"]:
                eff = eff * np.where(recent, 1.0, 0.1)
            eff = np.maximum(0.0, np.where(age > cfg.stale_threshold, eff * 0.5, eff))
            eff[n_store:] = np.maximum(0.0, raw[n_store:])
            high = int((eff[alive] > 0.6).sum())
            best = int(np.argmax(raw))
            out.update(top=float(raw[best]), top_id=pool[best]["chunk_id"])
            out["raw"] = {c["chunk_id"]: float(r) for c, r in zip(pool, raw)}
        else:
            high = 0
        budget = min(int(lo + (hi - lo) * min(high / 10.0, 1.0)), cfg.max_context - cfg.generation_headroom)
        out["budget"] = budget if cfg.fixed_budget is None else cfg.fixed_budget
        if pool:
            order = np.flatnonzero(alive)
            for i in order[np.argsort(-eff[order], kind="stable")]:
                if out["used"] + pool[i]["tokens"] <= out["budget"]:
                    out["selected"].append(pool[i]["chunk_id"])
                    out["used"] += pool[i]["tokens"]
                    if i < n_store:
                        pool[i]["hist"] = [*pool[i]["hist"], (turn, round(float(raw[i]), 3))][-10:]
        return out

    # -- archive -------------------------------------------------------------
    def _gate(self, q: dict, a: dict) -> bool:
        if a["top"] < self.cfg.archive_gate:
            return True
        c = self.store.get(a["top_id"])
        if c is None or c["key"] == q["key"] or not c["words"]:
            return False
        return len(c["words"] & frozenset(q["words"])) / len(c["words"]) >= 0.8

    def _recall(self, q: dict) -> list[dict]:
        words = frozenset(q["words"])
        hits = [(len(c["words"] & words), c["last"], c) for c in self.archive.values()]
        hits = [h for h in hits if h[0] > 0]
        hits.sort(key=lambda h: (h[0], h[1]), reverse=True)
        return [h[2] for h in hits[: self.cfg.archive_top_k]]

    # -- one turn --------------------------------------------------------------
    def turn(self, q: dict, replies: list[dict]) -> tuple:
        cfg, t = self.cfg, int(q["user_turn"])
        a = self.assemble(q, t, [])
        fired, extras, back = False, [], []
        if self.use_archive and self.archive and self._gate(q, a):
            fired = True
            extras = self._recall(q)
            if extras:
                a = self.assemble(q, t, extras)
                ids = {c["chunk_id"] for c in extras}
                back = [i for i in a["selected"] if i in ids]
                for i in back:
                    self.archive[i]["last"] = max(self.archive[i]["last"], t)
        self.add(q, t)
        for r in replies:
            if r["storable"]:
                self.add(r, t)
        moved = 0
        if self.use_archive:
            keep = set(a["selected"])
            for c in list(self.store.values()):
                if c["chunk_id"] in keep and a["raw"].get(c["chunk_id"], 1.0) >= cfg.archive_gate:
                    continue
                if t - c["last"] > cfg.stale_threshold and (c["hist"] or not self.relevant_only):
                    self._remove(c)
                    moved += 1
            cut = t - cfg.archive_max_age
            for i in [i for i, c in self.archive.items() if c["last"] < cut]:
                self.archive.pop(i)
        return (
            q["conv_id"], t, a["route"], a["budget"], a["used"], len(a["selected"]), a["selected"], a["top"], a["drift"],
            fired, len(extras), len(back), moved, len(self.store), len(self.archive),
        )

    # -- state of a stream -------------------------------------------------------
    def dump(self) -> bytes:
        return pickle.dumps((self.store, self.archive))

    def load(self, blob: bytes) -> None:
        self.store, self.archive = pickle.loads(blob)

    def mark(self) -> str:
        """Equal for equal states: ids, ages and histories in order."""
        parts = [[(c["chunk_id"], c["turn"], c["last"], c["hist"]) for c in t.values()] for t in (self.store, self.archive)]
        return hashlib.md5(repr(parts).encode()).hexdigest()


def replay_turns(prepared: DataFrame, cfg: Settings = CFG, use_archive: bool = True, block_turns: int = 4096) -> DataFrame:
    """Replay all conversations in turn order.

    Where the longest conversation is known to fit one block, each is walked
    once; rows stream through, never a whole conversation at once.  Otherwise
    conversations are cut into blocks that run in parallel, see
    ``replay_blocks``.
    """
    if cfg.longest is None or cfg.longest >= block_turns:
        return replay_blocks(prepared, cfg, use_archive, block_turns)

    def walk(batches):
        conv_id, conv, query, replies = None, None, None, []
        for pdf in batches:
            out = []
            for m in pdf.to_dict("records"):
                if m["role"] == "user" or m["conv_id"] != conv_id:
                    if query is not None:
                        out.append(conv.turn(query, replies))
                        query = None
                    if m["conv_id"] != conv_id:
                        conv_id, conv = m["conv_id"], Conversation(cfg, use_archive)
                    query, replies = m, []
                else:
                    replies.append(m)
            yield pd.DataFrame(out, columns=COLS)
        if query is not None:
            yield pd.DataFrame([conv.turn(query, replies)], columns=COLS)

    d = prepared.repartition(_parts(prepared), "conv_id").sortWithinPartitions("conv_id", "turn")
    return d.mapInPandas(walk, out_schema(prepared))


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def replay_blocks(prepared: DataFrame, cfg: Settings = CFG, use_archive: bool = True, block_turns: int = 4096) -> DataFrame:
    """Exact replay with the blocks of a conversation in parallel.

    First every block starts from an empty store.  Then each block whose
    predecessor ended in another state than it started from runs again from
    that state, until all starts and ends agree; that is the sequential
    result.  Stores and archives are bounded and forget, so an early
    difference dies out and few blocks run more than twice.  Only the number
    of open blocks comes to the driver.
    """
    blk = F.floor((F.col("user_turn") - 1) / block_turns).cast("long")
    none = F.lit(None).cast("binary")
    d = checkpointed(prepared.withColumn("blk", blk).withColumn("state", none))
    schema = "blk long, in_mark string, out_mark string, state binary, " + out_schema(prepared)
    cols = ["blk", "in_mark", "out_mark", "state", *COLS]

    def walk(batches):
        key, conv, mark, query, replies = None, None, None, None, []
        blank = [None] * (len(COLS) - 1)

        def row(t):
            return (key[1], None, None, None, *t)

        def end():
            return (key[1], mark, conv.mark(), conv.dump(), key[0], *blank)

        for pdf in batches:
            out = []
            for m in pdf.to_dict("records"):
                if (m["conv_id"], m["blk"]) != key:
                    if query is not None:
                        out.append(row(conv.turn(query, replies)))
                    if key is not None:
                        out.append(end())
                    key, conv, query, replies = (m["conv_id"], m["blk"]), Conversation(cfg, use_archive), None, []
                    if m["state"] is not None:
                        conv.load(m["state"])
                    mark = conv.mark()
                if m["state"] is not None:
                    continue
                if m["role"] == "user":
                    if query is not None:
                        out.append(row(conv.turn(query, replies)))
                    query, replies = m, []
                else:
                    replies.append(m)
            yield pd.DataFrame(out, columns=cols)
        if key is not None:
            last = [row(conv.turn(query, replies))] if query is not None else []
            yield pd.DataFrame([*last, end()], columns=cols)

    keys = ["conv_id", "blk"]
    todo, done = d, None
    while True:
        feed = todo.repartition(_parts(d), *keys).sortWithinPartitions(*keys, F.asc_nulls_first("turn"))
        ran = checkpointed(feed.mapInPandas(walk, schema))
        if done is None:
            done = ran
        else:
            done = checkpointed(done.join(ran.select(*keys).distinct(), keys, "left_anti").unionByName(ran))
        ends = done.where(F.col("out_mark").isNotNull())
        given = ends.select("conv_id", (F.col("blk") + 1).alias("blk"), F.col("out_mark").alias("due"), "state")
        stale = checkpointed(ends.select(*keys, "in_mark").join(given, keys).where(F.col("due") != F.col("in_mark")).select(*keys, "state"))
        if stale.isEmpty():
            break
        again = d.join(stale.select(*keys), keys, "left_semi")
        starts = stale.select(*[F.col(c) if c in (*keys, "state") else F.lit(None).cast(d.schema[c].dataType).alias(c) for c in d.columns])
        todo = again.unionByName(starts)
    return done.where(F.col("out_mark").isNull()).select(*COLS)
