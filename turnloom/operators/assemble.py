"""One-pass context assembly per query turn.

Every query is answered against the raw store of its moment; refreshed ages of
one turn do not flow into the next.  ``operators.replay`` is the stateful twin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.config import Settings
from turnloom.functions import health as H
from turnloom.functions import routing as R
from turnloom.functions import text as T
from turnloom.functions import vectors as X
from turnloom.operators.candidates import BLK, candidates, encode_chunks, lend_blocks, near_facts
from turnloom.operators.select import skip_fill
from turnloom.session import checkpointed

CFG = Settings()


def _queries(enc: DataFrame) -> DataFrame:
    return enc.where(F.col("role") == "user").select(
        "conv_id", F.col("seq").alias("q_seq"), F.col("user_turn").alias("q_turn"), F.col("content").alias("query")
    )


def _pack(cand: DataFrame) -> DataFrame:
    # grouped by (conversation, block, query): the candidate join already clusters by the first two
    # pos orders equal scores: insertion order in the store, retrieval rank among archive hits
    item = F.struct("pos", "seq", "chunk_id", "user_turn", "tokens", "base", "exempt")
    return cand.groupBy("conv_id", BLK, "q_seq").agg(F.array_sort(F.collect_list(item)).alias("items")).drop(BLK)


ARM_DEFAULTS = {
    "dedup": True, "drift": True, "decay": True, "drones": True, "adaptive": True,
    "multiplier": None, "drift_threshold": None,
}


def _arms(cfg: Settings, arms: list[dict] | None) -> list[dict]:
    """Complete the switches of each arm from the defaults and the settings."""
    base = {**ARM_DEFAULTS, "multiplier": cfg.decay_multiplier, "drift_threshold": cfg.drift_threshold}
    return [{"arm": "default", **base, **a} for a in (arms or [{}])]


def _resolve(q: DataFrame, cfg: Settings, arms: list[dict] | None = None, near: bool = True) -> DataFrame:
    """Score, thin, age, budget and fill the packed candidates of each query.

    Several arms share the scan, the candidate join and the duplicate facts:
    each query row is repeated once per arm only here.
    """
    item_t = "array<struct<pos:bigint,seq:bigint,chunk_id:string,user_turn:int,tokens:int,base:double,exempt:boolean>>"
    arms = _arms(cfg, arms)
    d = q.withColumn("items", F.coalesce("items", F.array().cast(item_t)))
    depth = F.coalesce(F.col("q_turn") - F.array_min(F.transform(F.filter("items", lambda x: ~x.exempt), lambda x: x.user_turn)), F.lit(0))
    d = d.withColumn("r", R.route(F.col("query"), depth))
    cells = F.array(*[F.struct(*[F.lit(float(v) if n in ("multiplier", "drift_threshold") else v).alias(n) for n, v in a.items()]) for a in arms])
    d = d.withColumn("a", F.explode(cells) if len(arms) > 1 else F.get(cells, F.lit(0)))
    medium = F.col("r.route_to") == "medium"

    def raw(x):
        return F.when(~F.col("a.drones"), F.lit(0.5)).when(medium, F.lit(cfg.medium_score)).otherwise(x.base)

    d = d.withColumn("items", F.transform("items", lambda x: F.struct(*[x[n].alias(n) for n in ("pos", "seq", "chunk_id", "user_turn", "tokens", "exempt")], raw(x).alias("raw"))))
    best = F.array_min(F.transform("items", lambda x: F.struct((-x.raw).alias("neg"), F.when(x.exempt, 1).otherwise(0), x.pos.alias("pos"), x.seq.alias("seq"), x.chunk_id.alias("chunk_id"))))
    longs, ints = F.array().cast("array<bigint>"), F.array().cast("array<int>")
    if near:
        dropped = F.when(F.col("a.dedup"), F.coalesce("dropped", longs)).otherwise(longs)
        drifted = F.col("a.drift") & (F.coalesce("drift", F.lit(0.0)) > F.col("a.drift_threshold"))
        fresh = F.map_from_arrays(
            F.when(F.col("a.dedup"), F.coalesce("fresh_seq", longs)).otherwise(longs),
            F.when(F.col("a.dedup"), F.coalesce("fresh_turn", ints)).otherwise(ints),
        )
    else:
        dropped, drifted, fresh = longs, F.lit(False), F.map_from_arrays(longs, ints)
    d = d.select("*", best.alias("best"), dropped.alias("_dropped"), drifted.alias("drift_detected"), fresh.alias("_fresh"))
    live = F.filter("items", lambda x: ~F.array_contains(F.col("_dropped"), x.seq))

    def score(x):
        ref = F.greatest(x.user_turn, F.coalesce(F.try_element_at(F.col("_fresh"), x.seq), F.lit(0)))
        old = F.col("drift_detected") & (x.user_turn < F.col("q_turn") - cfg.drift_recent_turns)
        aged = H.decay(
            x.raw, F.col("q_turn") - ref, F.col("a.multiplier"), F.when(old, 0.1).otherwise(1.0), x.exempt, cfg.stale_threshold
        )
        eff = F.when(F.col("a.decay"), aged).otherwise(x.raw)
        return F.struct((F.lit(0.0) - eff).alias("neg"), F.when(x.exempt, 1).otherwise(0).alias("tier"), x.pos.alias("pos"), x.seq.alias("seq"), x.tokens.alias("tokens"), x.chunk_id.alias("chunk_id"))

    d = d.withColumn("ranked", F.array_sort(F.transform(live, score)))
    high = F.when(F.col("a.adaptive"), F.size(F.filter("ranked", lambda x: -x.neg > 0.6))).otherwise(0)
    budget = H.adaptive_budget(F.col("r.route_to"), high, cfg.budget_ranges, cfg.max_context, cfg.generation_headroom)
    d = d.withColumn("budget", budget if cfg.fixed_budget is None else F.lit(cfg.fixed_budget))
    d = d.withColumn("fill", skip_fill(F.col("ranked"), F.col("budget")))
    d = d.withColumn("_ids", F.map_from_entries(F.transform("ranked", lambda x: F.struct(x.seq, x.chunk_id))))
    return d.select(
        "conv_id", "q_seq", "q_turn", F.col("a.arm").alias("arm"), "query", F.col("r.route_to").alias("route"), F.col("r.reason").alias("reason"),
        "budget", F.col("fill.used").cast("int").alias("used_tokens"), F.size("fill.kept").alias("chunks_used"),
        F.col("fill.kept").alias("selected"),
        F.transform("fill.kept", lambda s: F.element_at(F.col("_ids"), s)).alias("selected_ids"),
        F.coalesce(-F.col("best.neg"), F.lit(0.0)).alias("top_raw"), F.col("best.seq").alias("top_seq"),
        F.col("best.chunk_id").alias("top_chunk_id"), "drift_detected",
        F.size("items").alias("n_candidates"), F.size("ranked").alias("n_survivors"),
        F.transform("items", lambda x: F.struct(x.seq.alias("seq"), x.raw.alias("raw"))).alias("raw_scores"),
    )


def assemble(
    chunks: DataFrame,
    cfg: Settings = CFG,
    arms: list[dict] | None = None,
    policy: str = "densest",
    active_age: int | None = None,
    encoded: bool = False,
    encoder=None,
) -> DataFrame:
    """The assembled context (as chunk positions) of every user turn.

    ``encoder`` turns a text column into vectors of any one width; hashed
    words by default.

    ``arms`` are named switch settings (see ``ARM_DEFAULTS``) evaluated side
    by side.  ``active_age`` limits the store to chunks at most that many
    turns old.
    """
    enc = chunks if encoded else encode_chunks(chunks, cfg, encoder)
    cand = candidates(enc, cfg)
    if active_age is not None:
        cand = cand.where(F.col("user_turn") >= F.col("q_turn") - active_age)
    packed = _pack(cand.withColumn("exempt", F.lit(False)).withColumn("pos", F.col("seq")))
    q = _queries(enc).join(packed, ["conv_id", "q_seq"], "left")
    near = any(a["dedup"] or a["drift"] for a in _arms(cfg, arms))
    if near:
        q = q.join(near_facts(enc, cfg, policy, active_age), ["conv_id", "q_seq"], "left")
    return _resolve(q, cfg, arms, near)


def with_content(assembled: DataFrame, chunks: DataFrame) -> DataFrame:
    """Fetch the text of the selected chunks only and join it with blank lines."""
    pos = assembled.select("conv_id", "q_seq", "arm", F.posexplode("selected").alias("pos", "seq"))
    got = pos.join(chunks.select("conv_id", "seq", "content"), ["conv_id", "seq"])
    g = got.groupBy("conv_id", "q_seq", "arm").agg(F.array_sort(F.collect_list(F.struct("pos", "content"))).alias("parts"))
    text = F.concat_ws("\n\n", F.transform("parts", lambda p: p.content))
    return assembled.join(g.select("conv_id", "q_seq", "arm", text.alias("content")), ["conv_id", "q_seq", "arm"], "left").withColumn(
        "content", F.coalesce("content", F.lit(""))
    )


# ------------------------------------------------------------------- archive
def archive_gate(top_raw: Column, echo: Column, threshold: float = 0.85) -> Column:
    return (top_raw < threshold) | echo


def gate_turns(assembled: DataFrame, chunks: DataFrame, cfg: Settings = CFG) -> DataFrame:
    """Turns where the store's best match is weak or only echoes the query."""
    top = chunks.select("conv_id", F.col("seq").alias("top_seq"), F.col("content").alias("top_text"))
    j = assembled.join(top, ["conv_id", "top_seq"], "left")
    echo = F.coalesce(T.is_query_echo(F.col("query"), F.col("top_text")), F.lit(False))
    return j.select(
        "conv_id", "q_seq", "q_turn", "top_raw", echo.alias("echo"),
        archive_gate(F.col("top_raw"), echo, cfg.archive_gate).alias("gate_fires"),
    )


def archive_retrieve(queries: DataFrame, chunks: DataFrame, cfg: Settings = CFG, older_than: int = 20, k: int | None = None) -> DataFrame:
    """Top archived chunks per query by shared words, newest reference first on ties.

    The archive forgets what is older than ``archive_max_age`` turns, so a
    query meets its own block of that many turns and the one before.
    ``queries`` has (conv_id, q_seq, q_turn, query).
    """
    span = cfg.archive_max_age
    qw = T.words4(F.col("query"))
    words = F.when(F.size(qw) > 0, qw).otherwise(F.array(F.lower("query")))
    q = queries.select("conv_id", F.floor(F.col("q_turn") / span).cast("long").alias(BLK), "q_seq", "q_turn", words.alias("q_words"))
    c = lend_blocks(
        chunks.select("conv_id", "seq", "chunk_id", "user_turn", "last_ref", "tokens", T.words4(F.col("content")).alias("c_words")), "user_turn", span
    ).drop("_home")
    age = F.col("q_turn") - F.col("user_turn")
    overlap = F.size(F.array_intersect("q_words", "c_words"))
    hits = q.join(c, ["conv_id", BLK]).where((age > older_than) & (age <= span)).withColumn("overlap", overlap).where(F.col("overlap") > 0)
    w = Window.partitionBy("conv_id", BLK, "q_seq").orderBy(F.desc("overlap"), F.desc("last_ref"), "seq")
    ranked = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= (k or cfg.archive_top_k))
    return ranked.select("conv_id", "q_seq", "q_turn", "seq", "chunk_id", "user_turn", "tokens", "last_ref", "overlap", "rank")


def assemble_with_archive(chunks: DataFrame, cfg: Settings = CFG, encoded: bool = False, encoder=None) -> DataFrame:
    """Assembly over the active store, with archived chunks joining where the gate fires.

    Chunks more than ``stale_threshold`` turns old form the archive.  Only the
    gated turns with archive hits go through the second pass; all others keep
    the first result.
    """
    enc = chunks if encoded else encode_chunks(chunks, cfg, encoder)
    age = cfg.stale_threshold
    # the first pass feeds the gate, the second pass and the result, so it is written once
    first = checkpointed(assemble(enc, cfg, active_age=age, encoded=True))
    gate = checkpointed(gate_turns(first, chunks, cfg))
    gated = first.join(gate.where("gate_fires").select("conv_id", "q_seq"), ["conv_id", "q_seq"], "left_semi")
    hits = checkpointed(archive_retrieve(gated.select("conv_id", "q_seq", "q_turn", "query"), chunks, cfg, older_than=age))
    vecs = enc.select("conv_id", "seq", "vec", "norm", "has_term", T.info_density(F.col("content")).alias("density"))
    extras = hits.join(vecs, ["conv_id", "seq"])
    # the second pass scores the store again with the archive hits beside it
    cand = candidates(enc, cfg).where(F.col("user_turn") >= F.col("q_turn") - age)
    again = cand.join(hits.select("conv_id", "q_seq").distinct(), ["conv_id", "q_seq"], "left_semi")
    qv = enc.select("conv_id", F.col("seq").alias("q_seq"), F.col("vec").alias("q_vec"), F.col("norm").alias("q_norm"))
    cos = X.score_cosine(X.dot_of("q_vec", "vec", cfg.embedding_dims), F.col("q_norm"), F.col("norm"))
    boost = F.when(F.col("has_term"), F.lit(cfg.vocab_boost)).otherwise(F.lit(0.0))
    more = extras.join(qv, ["conv_id", "q_seq"]).withColumn("base", cos + boost)
    cols = ["conv_id", "q_seq", "seq", "chunk_id", "user_turn", "tokens", "base"]
    both = again.select(*cols, F.lit(False).alias("exempt"), F.col("seq").alias("pos")).unionByName(
        more.select(*cols, F.lit(True).alias("exempt"), F.col("rank").cast("long").alias("pos"))
    )
    packed = _pack(both.withColumn(BLK, F.lit(0)))
    q = _queries(enc).join(packed, ["conv_id", "q_seq"])
    q = q.join(near_facts(enc, cfg, active_age=age, extras=extras), ["conv_id", "q_seq"], "left")
    second = _resolve(q, cfg)
    n_hits = hits.groupBy("conv_id", "q_seq").agg(F.collect_set("seq").alias("hit_seqs"))
    kept = first.join(second.select("conv_id", "q_seq"), ["conv_id", "q_seq"], "left_anti")
    out = kept.unionByName(second).join(n_hits, ["conv_id", "q_seq"], "left").join(
        gate.select("conv_id", "q_seq", "gate_fires"), ["conv_id", "q_seq"]
    )
    resurrected = F.size(F.array_intersect("selected", F.coalesce("hit_seqs", F.array().cast("array<bigint>"))))
    return out.withColumn("archive_hits", F.size(F.coalesce("hit_seqs", F.array().cast("array<bigint>")))).withColumn(
        "resurrected", resurrected
    ).drop("hit_seqs")


def touch(archive: DataFrame, used: DataFrame) -> DataFrame:
    """Refresh the last reference of archive records that were selected (conv_id, chunk_id, used_turn)."""
    u = used.groupBy("conv_id", "chunk_id").agg(F.max("used_turn").alias("used_turn"))
    j = archive.join(u, ["conv_id", "chunk_id"], "left")
    return j.withColumn("last_ref", F.greatest(F.coalesce("last_ref", F.lit(0)), "used_turn")).drop("used_turn")


def refresh_apply(chunks: DataFrame, refreshed: DataFrame) -> DataFrame:
    """last_ref = greatest(last_ref, freshest turn)."""
    r = refreshed.groupBy("conv_id", "seq").agg(F.max("fresh_turn").alias("_fresh"))
    j = chunks.join(r, ["conv_id", "seq"], "left")
    return j.withColumn("last_ref", F.greatest(F.coalesce("last_ref", F.lit(0)), "_fresh")).drop("_fresh")


def is_stale(current: Column, last_ref: Column, threshold: int = 20) -> Column:
    return current - last_ref > threshold


def once_curated(history_size: Column, multiplier: Column) -> Column:
    return (history_size > 0) | (F.coalesce(multiplier, F.lit(1.0)) > 1.0)


def relevance_history(assembled: DataFrame, keep: int = 10) -> DataFrame:
    """The last ``keep`` (turn, raw score) entries of each chunk that was ever selected.

    The newest entries are cut out by a row-number limit, so a chunk chosen by
    very many turns stays bounded.
    """
    raw = F.map_from_entries("raw_scores")
    s = assembled.select("conv_id", "q_turn", F.explode(F.transform("selected", lambda x: F.struct(x.alias("seq"), F.element_at(raw, x).alias("raw")))).alias("s"))
    s = s.select("conv_id", "q_turn", F.col("s.seq").alias("seq"), F.col("s.raw").alias("raw"))
    w = Window.partitionBy("conv_id", "seq").orderBy(F.desc("q_turn"))
    s = s.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep)
    return s.groupBy("conv_id", "seq").agg(F.array_sort(F.collect_list(F.struct("q_turn", "raw"))).alias("history"))


def evict_candidates(state: DataFrame, stale: int = 20, floor: float = 0.0) -> DataFrame:
    """Chunks to archive: stale, surplus this turn, and once curated.

    ``state``: conv_id, seq, current_turn, last_ref, selected, raw (null counts
    as 1.0), history_size, multiplier.
    """
    surplus = ~F.col("selected") | (F.coalesce("raw", F.lit(1.0)) < floor)
    return state.where(
        is_stale(F.col("current_turn"), F.col("last_ref"), stale) & surplus
        & once_curated(F.col("history_size"), F.col("multiplier"))
    )


def remembrance(boundary: DataFrame, threshold: float = 0.65) -> DataFrame:
    """Chunks at the eviction boundary with relevance at the threshold are saved, compressed, and decay faster."""
    saved = F.col("relevance") >= threshold
    return boundary.withColumn("saved", saved).withColumn(
        "compressed", F.when(saved, T.compress(F.col("content")))
    ).withColumn(
        "decay_multiplier",
        F.when(saved, F.col("decay_multiplier") * H.decay_factor(F.col("times_saved"))).otherwise(F.col("decay_multiplier")),
    ).withColumn("times_saved", F.when(saved, F.col("times_saved") + 1).otherwise(F.col("times_saved")))


def inspect_turn(assembled: DataFrame, chunks: DataFrame, dropped: int = 20) -> DataFrame:
    """Candidates of each turn by raw score: all selected ones and the first ``dropped`` others, with previews."""
    a = assembled.select("conv_id", "q_turn", "selected", F.explode("raw_scores").alias("c"))
    a = a.select("conv_id", "q_turn", F.col("c.seq").alias("seq"), F.col("c.raw").alias("raw"), F.array_contains("selected", F.col("c.seq")).alias("is_selected"))
    w = Window.partitionBy("conv_id", "q_turn", "is_selected").orderBy(F.desc("raw"), "seq")
    a = a.withColumn("position", F.row_number().over(w)).where(F.col("is_selected") | (F.col("position") <= dropped))
    j = a.join(chunks.select("conv_id", "seq", "chunk_id", "content"), ["conv_id", "seq"], "left")
    preview = F.when(F.col("content").isNull(), "(evicted)").when(
        F.length("content") > 200, F.concat(F.substring("content", 1, 200), F.lit("…"))
    ).otherwise(F.col("content"))
    return j.select("conv_id", "q_turn", "chunk_id", F.round("raw", 3).alias("raw_score"), "is_selected", "position", preview.alias("preview"))
