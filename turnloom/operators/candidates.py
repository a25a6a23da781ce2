"""Query x stored-chunk candidates and similarity facts per query."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.config import Settings
from turnloom.functions import text as T
from turnloom.functions import vectors as X

CFG = Settings()
BLK = "_blk"


def encode_chunks(chunks: DataFrame, cfg: Settings = CFG, encoder=None) -> DataFrame:
    """Add vector, norm, vocabulary hit and density; computed once per chunk."""
    vec = X.embed_text(F.col("content"), encoder, cfg.embedding_dims)
    # the default encoder's width is known, so inner products can be unrolled; a model's width is what its vectors have
    d = chunks.withColumn("vec", vec if encoder is not None else vec.alias("vec", metadata={"width": cfg.embedding_dims}))
    return d.withColumn("norm", X.norm(F.col("vec"))).withColumn("has_term", T.vocab_matches(F.col("content")))


def _dot(df: DataFrame, a: str, b: str = "vec") -> Column:
    """Inner product over the whole width of the vectors, whatever encoder made them."""
    width = df.schema[b].metadata.get("width")
    return X.dot_of(a, b, width) if width else X.checked_dot(F.col(a), F.col(b))


def lend_blocks(chunks: DataFrame, pos: str, rows: int) -> DataFrame:
    """Each chunk in its own block and in the next one, where later queries look back to it."""
    home = F.floor(F.col(pos) / rows).cast("long")
    return chunks.withColumn("_home", home).withColumn(BLK, F.explode(F.array(home, home + 1)))


def candidates(enc: DataFrame, cfg: Settings = CFG, extra: list[str] | None = None) -> DataFrame:
    """Each query against the chunks in the store when it was asked.

    The store holds the last ``max_chunks`` chunks, so a query only meets its
    own block of ``max_chunks`` positions and the one before.  The join is an
    equi-join on (conversation, block): a conversation of any length spreads
    over many tasks, and no group exceeds twice the store size.  Text stays
    out of the join.
    """
    m = cfg.max_chunks
    q = enc.where(F.col("role") == "user").select(
        "conv_id", F.floor(F.col("seq") / m).cast("long").alias(BLK), F.col("seq").alias("q_seq"),
        F.col("user_turn").alias("q_turn"), F.col("vec").alias("q_vec"), F.col("norm").alias("q_norm"),
    )
    c = lend_blocks(
        enc.select("conv_id", "seq", "chunk_id", "user_turn", "role", "tokens", "last_ref", "vec", "norm", "has_term", *(extra or [])),
        "seq", m,
    ).drop("_home")
    in_store = (F.col("seq") < F.col("q_seq")) & (F.col("seq") >= F.col("q_seq") - m)
    j = q.join(c, ["conv_id", BLK]).where(in_store)
    cos = X.score_cosine(_dot(j, "q_vec"), F.col("q_norm"), F.col("norm"))
    boost = F.when(F.col("has_term"), F.lit(cfg.vocab_boost)).otherwise(F.lit(0.0))
    return j.select(
        "conv_id", BLK, "q_seq", "q_turn", "seq", "chunk_id", "user_turn", "role", "tokens", "last_ref",
        cos.alias("cosine"), (cos + boost).alias("base"), *(extra or []),
    )


def greedy_dedup(dup: np.ndarray, rank: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, dict[int, int]]:
    """One greedy pass over duplicate pairs in order.

    Of a pair the higher ``rank`` stays, the earlier on ties.  A row that
    loses goes on removing later rows of its own scan.  Returns the alive mask
    and the freshest turn each winner absorbed.
    """
    n = len(rank)
    alive = np.ones(n, dtype=bool)
    fresh: dict[int, int] = {}
    for i in np.flatnonzero(np.triu(dup, 1).any(axis=1)):
        if not alive[i]:
            continue
        js = i + 1 + np.flatnonzero(dup[i, i + 1 :] & alive[i + 1 :])
        if not len(js):
            continue
        beaten, better = js[rank[js] <= rank[i]], js[rank[js] > rank[i]]
        alive[beaten] = False
        if len(beaten):
            fresh[i] = max(fresh.get(i, 0), int(turn[i]), int(turn[beaten].max()))
        for j in better:
            fresh[j] = max(fresh.get(j, 0), int(turn[i]), int(turn[j]))
        if len(better):
            alive[i] = False
    return alive, fresh


NEAR_SCHEMA = "q_seq long, dropped array<long>, fresh_seq array<long>, fresh_turn array<int>, drift double"


def near_facts(
    enc: DataFrame,
    cfg: Settings = CFG,
    policy: str = "densest",
    active_age: int | None = None,
    extras: DataFrame | None = None,
) -> DataFrame:
    """Per query: duplicates dropped, ages refreshed and the drift score of its store.

    Runs per (conversation, block), at most twice the store size, with the
    similarity matrix of a block computed once.  ``extras`` are archive
    records (conv_id, q_seq, rank, seq, user_turn, vec, density) that join a
    query's candidates after its store chunks.  ``policy`` keeps the densest
    or the most recent copy.
    """
    m, thr, recent_n = cfg.max_chunks, cfg.dedup_threshold, cfg.drift_recent_turns
    cols = ["conv_id", "seq", "user_turn", "vec", "density"]
    base = enc.withColumn("density", T.info_density(F.col("content")))
    c = lend_blocks(base.select(*cols, (F.col("role") == "user").alias("is_query")), "seq", m)
    none = F.lit(None).cast("long")
    c = c.select(*cols, BLK, ((F.col("_home") == F.col(BLK)) & F.col("is_query")).alias("is_query"), none.alias("owner"), none.alias("rank"))
    if extras is not None:
        # only queries that brought records are reworked
        asked = extras.select("conv_id", F.col("q_seq").alias("seq")).distinct().withColumn("_asked", F.lit(True))
        c = c.join(asked, ["conv_id", "seq"], "left").withColumn("is_query", F.col("is_query") & F.coalesce("_asked", F.lit(False))).drop("_asked")
        e = extras.select(
            *cols, F.floor(F.col("q_seq") / m).cast("long").alias(BLK), F.lit(False).alias("is_query"),
            F.col("q_seq").alias("owner"), F.col("rank").cast("long").alias("rank"),
        )
        c = c.unionByName(e)

    n = int(enc.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c = c.repartition(n, "conv_id", BLK).sortWithinPartitions("conv_id", BLK, F.asc_nulls_first("owner"), "rank", "seq")
    # a block above twice the store size does not exist, so a group always fits
    return c.mapInArrow(_near_worker(m, thr, recent_n, policy, active_age), f"conv_id {id_type(enc)}, {NEAR_SCHEMA}")


def id_type(df: DataFrame) -> str:
    """The type of conversation ids: numbers or strings, as the input has them."""
    return df.schema["conv_id"].dataType.simpleString()


def _near_worker(m: int, thr: float, recent_n: int, policy: str, active_age: int | None):
    def group(conv, seq, turn, density, is_query, owner, vec, out):
        queries = seq[is_query]
        if not len(queries):
            return
        n_chunks = int((owner < 0).sum())
        norms = np.sqrt((vec * vec).sum(axis=1))
        den = np.outer(norms, norms)
        dup = (vec @ vec.T) / np.where(den == 0, 1e-9, den) > thr
        rank = turn.astype(float) if policy == "recency" else density
        rows = np.arange(n_chunks)
        any_dup = bool(np.triu(dup, 1).any())
        for s in queries:
            lo, hi = np.searchsorted(seq[:n_chunks], [s - m, s])
            t = turn[hi]
            idx = rows[lo:hi]
            if active_age is not None:
                idx = idx[turn[idx] >= t - active_age]
            n_store = len(idx)
            recent = idx[turn[idx] >= t - recent_n]
            if n_chunks < len(seq):
                idx = np.concatenate([idx, np.flatnonzero(owner == s)])
            drift = None
            if len(idx) >= 5 and len(recent):
                a, b = vec[recent].sum(axis=0), vec[idx[: len(idx) // 2]].sum(axis=0)
                d = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
                drift = 1.0 - (float(a @ b / d) if d else 0.0)
            dropped, keep, fresh = [], [], {}
            if any_dup:
                alive, fresh = greedy_dedup(dup[np.ix_(idx, idx)], rank[idx], turn[idx])
                dropped = seq[idx[~alive]].tolist()
                keep = [k for k in fresh if k < n_store]
            row = (conv, int(s), dropped, [int(seq[idx[k]]) for k in keep], [fresh[k] for k in keep], drift)
            for col, v in zip(out, row):
                col.append(v)

    def work(batches):
        held = None
        names = ["conv_id", *[f.strip().split(" ")[0] for f in NEAR_SCHEMA.split(",")]]
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.float64()]

        def flush(t, last):
            """Work on the complete groups of ``t``; give back the rows of the open one."""
            ids = t.column("conv_id")
            conv, blk = ids.to_numpy(), t.column(BLK).to_numpy()
            cuts = np.flatnonzero((conv[1:] != conv[:-1]) | (blk[1:] != blk[:-1])) + 1
            ends = [*cuts, len(conv)] if last else list(cuts)
            end = int(ends[-1]) if ends else 0
            done = t.slice(0, end).combine_chunks()
            out = [[] for _ in names]
            if end:
                seq, turn, dens = (done.column(x).to_numpy() for x in ("seq", "user_turn", "density"))
                isq = done.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
                own = pc.fill_null(done.column("owner"), -1).to_numpy()
                flat = pc.list_flatten(done.column("vec")).to_numpy().astype(float)
                if len(flat) % end or pc.count_distinct(pc.list_value_length(done.column("vec"))).as_py() != 1:
                    raise ValueError("vectors of different width in one conversation")
                vec = flat.reshape(end, -1)
                start = 0
                for e in ends:
                    g = slice(start, int(e))
                    group(ids[start].as_py(), seq[g], turn[g], dens[g], isq[g], own[g], vec[g], out)
                    start = int(e)
            batch = pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(out, [ids.type, *types])], names)
            return batch, t.slice(end)

        for b in batches:
            t = pa.Table.from_batches([b])
            if held is not None and held.num_rows:
                t = pa.concat_tables([held, t])
            batch, held = flush(t, last=False)
            if batch.num_rows:
                yield batch
        if held is not None and held.num_rows:
            batch, _ = flush(held, last=True)
            yield batch

    return work


def dedup_chunks(enc: DataFrame, cfg: Settings = CFG, policy: str = "densest") -> DataFrame:
    """Survivors and refreshed ages of each query's store."""
    f = near_facts(enc, cfg, policy)
    return f.select(
        "conv_id", "q_seq", F.array_sort("dropped").alias("dropped"),
        F.array_sort(F.arrays_zip("fresh_seq", "fresh_turn")).alias("refreshed"),
    )


def duplicate_pairs(enc: DataFrame, cfg: Settings = CFG) -> DataFrame:
    """Per chunk: how many earlier chunks of its store it repeats, the first of them and the best match.

    One row per chunk with a partner; the pairs themselves are folded inside
    the (conversation, block) task that meets them.
    """
    m = cfg.max_chunks
    j = enc.select(
        "conv_id", F.floor(F.col("seq") / m).cast("long").alias(BLK), "seq",
        F.col("vec").alias("j_vec"), F.col("norm").alias("j_norm"),
    )
    i = lend_blocks(enc.select("conv_id", F.col("seq").alias("i_seq"), "vec", "norm"), "i_seq", m).drop("_home")
    near = (F.col("i_seq") < F.col("seq")) & (F.col("i_seq") >= F.col("seq") - m)
    met = j.join(i, ["conv_id", BLK]).where(near)
    sim = X.dedup_cosine(_dot(met, "j_vec"), F.col("j_norm"), F.col("norm"))
    p = met.withColumn("sim", sim).where(F.col("sim") > cfg.dedup_threshold)
    g = p.groupBy("conv_id", BLK, "seq").agg(
        F.count("*").alias("n_dups"), F.min("i_seq").alias("first_dup_seq"), F.max("sim").alias("max_sim")
    )
    return g.drop(BLK)


def drift_check(enc: DataFrame, cfg: Settings = CFG) -> DataFrame:
    """Drift score of each query's store and whether it asks for a reset; needs five chunks."""
    f = near_facts(enc, cfg)
    score = F.coalesce("drift", F.lit(0.0))
    return f.select("conv_id", "q_seq", score.alias("drift_score"), (score > cfg.drift_threshold).alias("should_reset"))


def escalate_merge(scores: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Replace the scores of uncertain rows (relevance > 0.7, confidence < 0.6) by second-tier ones.

    Only uncertain rows reach the second tier's join.
    """
    unsure = (F.col("relevance") > 0.7) & (F.col("confidence") < 0.6)
    tier2 = second.select(*keys, F.col("relevance").alias("_r2"), F.col("confidence").alias("_c2"))
    j = scores.withColumn("_u", unsure).join(tier2, keys, "left")
    use = F.col("_u") & F.col("_r2").isNotNull()
    pick = lambda a, b: F.when(use, F.col(b)).otherwise(F.col(a)).alias(a)
    rest = [c for c in scores.columns if c not in ("relevance", "confidence", "source")]
    return j.select(
        *rest, pick("relevance", "_r2"), pick("confidence", "_c2"),
        F.when(use, "medium_validated").otherwise("ultra_small").alias("source"),
    )


def is_uncertain(relevance: Column, confidence: Column) -> Column:
    return (relevance > 0.7) & (confidence < 0.6)
