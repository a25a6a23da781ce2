"""Batch encoding with a cache, and pair scores of queries against their stores as blocked matrix products."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructField, StructType

from turnloom.config import Settings
from turnloom.functions import text as T
from turnloom.operators.candidates import BLK, lend_blocks

CFG = Settings()
_WORD = re.compile(r"\w+")


@lru_cache(maxsize=200_000)
def _bucket(word: str, dims: int) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:7], 16) % dims


def hashed_words(texts: list[str], dims: int = CFG.embedding_dims) -> np.ndarray:
    """The default encoder for lists of texts: counts of words by hash."""
    out = np.zeros((len(texts), dims))
    for i, t in enumerate(texts):
        np.add.at(out[i], [_bucket(w, dims) for w in _WORD.findall(t.lower())], 1)
    return out


# ------------------------------------------------------------------ batch encoding
def _parts(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Neighbouring rows of bounded total size."""
    lo = size = 0
    for i, n in enumerate(sizes):
        if i > lo and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(sizes):
        yield lo, len(sizes)


def embed_batch(
    rows: DataFrame,
    text: str = "text",
    encode: Callable[[list[str]], np.ndarray] = hashed_words,
    cache: DataFrame | None = None,
    batch_bytes: int = 1 << 20,
    memo_bytes: int = 64 << 20,
) -> DataFrame:
    """``rows`` with ``vec`` and ``cached``: vectors of texts, ``encode`` called once per batch of new texts.

    ``cache`` (key, vec) holds vectors by content key, as ``persist_embeddings`` writes them; its texts are not encoded.  In one pass
    over the rows, batches of at most ``batch_bytes`` of text are cut, each distinct new text of a batch goes to the encoder
    once, and vectors go back to the rows by index, so rows keep their order.  Vectors met before in a task come from a memo of
    at most ``memo_bytes``.  A null text is encoded as an empty one.  Vectors of one call have one width.
    """
    key, vec, hit = "key of the text", "cached vector", "in the cache"
    d = rows.withColumn(key, T.content_key(T.text_or_empty(F.col(f"`{text}`"))))
    if cache is not None:
        known = cache.groupBy(F.col("key").alias(key)).agg(F.first("vec").cast("array<double>").alias(vec), F.lit(True).alias(hit))
        d = d.join(known, key, "left")
    else:
        d = d.withColumn(vec, F.lit(None).cast("array<double>")).withColumn(hit, F.lit(None).cast("boolean"))
    names = rows.columns
    d = d.select(*[F.col(f"`{c}`") for c in names], key, vec, hit)
    schema = StructType([*rows.schema.fields, StructField("vec", ArrayType(DoubleType())), StructField("cached", BooleanType())])

    def run(batches):
        memo: dict[str, np.ndarray] = {}
        size = 0
        for b in batches:
            keys, hits = b.column(key).to_pylist(), b.column(hit).to_pylist()
            texts = b.column(names.index(text))
            sizes = [len(t.as_buffer()) if t.is_valid else 0 for t in texts]
            vectors: list = [None] * b.num_rows
            for lo, hi in _parts(sizes, batch_bytes):
                new = {}
                for i in range(lo, hi):
                    if not hits[i] and keys[i] not in memo and keys[i] not in new:
                        new[keys[i]] = texts[i].as_py() or ""
                got = dict(zip(new, np.asarray(encode(list(new.values())), float))) if new else {}
                for i in range(lo, hi):
                    vectors[i] = b.column(vec)[i].as_py() if hits[i] else got[keys[i]] if keys[i] in got else memo[keys[i]]
                size += sum(v.nbytes + 100 for v in got.values())
                if size > memo_bytes:
                    memo, size = {}, 0
                memo.update(got)
            cols = [*b.columns[: len(names)], pa.array(vectors, pa.list_(pa.float64())), pa.array([bool(h) for h in hits])]
            yield pa.RecordBatch.from_arrays(cols, [*names, "vec", "cached"])

    return d.mapInArrow(run, schema)


# ------------------------------------------------------------------ pair scores
def max_similarity(q: np.ndarray, q_at: np.ndarray, c: np.ndarray, c_at: np.ndarray, rows: int = 512) -> np.ndarray:
    """Per (query, chunk) the mean over the query's tokens of the best inner product with a token of the chunk.

    Token vectors are stacked; ``*_at`` say where each text's begin, with the end at last.  Empty texts score 0.
    """
    nq, nc = len(q_at) - 1, len(c_at) - 1
    best = np.zeros((len(q), nc))
    full = np.flatnonzero(np.diff(c_at))
    if len(full):
        for lo in range(0, len(q), rows):
            # neighbouring non-empty texts: a start is the end of the one before
            best[lo : lo + rows, full] = np.maximum.reduceat(q[lo : lo + rows] @ c.T, c_at[full], axis=1)
    out = np.zeros((nq, nc))
    some = np.flatnonzero(np.diff(q_at))
    if len(some):
        out[some] = np.add.reduceat(best, q_at[some], axis=0) / np.diff(q_at)[some][:, None]
    return out


def pooled_pair(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosine of each query with the sum of itself and each chunk, all from one matrix product; zero vectors give 0."""
    dots = q @ c.T
    qq, cc = (q * q).sum(1)[:, None], (c * c).sum(1)[None, :]
    den = np.sqrt(qq) * np.sqrt(np.maximum(qq + 2 * dots + cc, 0.0))
    return np.where(den == 0, 0.0, (qq + dots) / np.where(den == 0, 1.0, den))


SCORES = "conv_id {}, q_seq long, seq long, chunk_id string, relevance double, max_similarity double, confidence double, source string"


def score_cross(enc: DataFrame, cfg: Settings = CFG, tokens: str | None = None) -> DataFrame:
    """Second-tier scores of each query against the chunks in its store.

    ``relevance`` compares the query with the joint encoding of query and chunk, which for summed vectors is their sum.
    ``max_similarity`` compares token by token: ``tokens`` names a column of token vectors (array of arrays), without it each word
    is the unit vector of its bucket, so the vectors' own counts say it all.  Queries meet their own block of positions and the one before;
    a group is at most three times the store, and a pair becomes a row only with its scores.
    """
    m = cfg.max_chunks
    extra = [tokens] if tokens else []
    q = enc.where(F.col("role") == "user").select("conv_id", F.floor(F.col("seq") / m).cast("long").alias(BLK), F.col("seq").alias("q_seq"), "vec", *extra)
    c = lend_blocks(enc.select("conv_id", "seq", "chunk_id", "vec", *extra), "seq", m).drop("_home")
    # both sides come from one table, so this one gets columns of its own
    c = c.select(*[F.col(x).alias(x) for x in c.columns])

    ids = pa.string() if enc.schema["conv_id"].dataType.simpleString() == "string" else pa.int64()
    none = pa.schema(
        [("conv_id", ids), ("q_seq", pa.int64()), ("seq", pa.int64()), ("chunk_id", pa.string()), ("relevance", pa.float64()), ("max_similarity", pa.float64()),
         ("confidence", pa.float64()), ("source", pa.string())]
    ).empty_table()

    def stacked(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        texts = [np.asarray(t, float) for t in column.to_pylist()]
        full = [t for t in texts if len(t)]
        return (np.concatenate(full) if full else np.zeros((0, 1))), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(int)

    def kernel(qs: pa.Table, cs: pa.Table) -> pa.Table:
        if not (qs.num_rows and cs.num_rows):
            return none
        qv, cv = (np.array(t.column("vec").to_pylist(), float) for t in (qs, cs))
        at, of = np.asarray(qs.column("q_seq")), np.asarray(cs.column("seq"))
        i, j = np.nonzero((of[None, :] < at[:, None]) & (of[None, :] >= at[:, None] - m))
        relevance = pooled_pair(qv, cv)[i, j]
        if tokens:
            (tq, q_at), (tc, c_at) = stacked(qs.column(tokens)), stacked(cs.column(tokens))
            best = max_similarity(tq, q_at, tc, c_at)[i, j]
        else:
            words = qv.sum(1)[:, None]
            best = (qv @ (cv > 0).T / np.where(words == 0, 1.0, words))[i, j]
        return pa.table({
            "conv_id": qs.column("conv_id").take(pa.array(i)), "q_seq": at[i], "seq": of[j], "chunk_id": cs.column("chunk_id").take(pa.array(j)),
            "relevance": relevance, "max_similarity": best, "confidence": np.full(len(i), 0.85), "source": pa.array(["medium"] * len(i), pa.string()),
        })

    out = SCORES.format(enc.schema["conv_id"].dataType.simpleString())
    return q.groupBy("conv_id", BLK).cogroup(c.groupBy("conv_id", BLK)).applyInArrow(kernel, out)
