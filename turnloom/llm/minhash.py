"""Near-duplicates by circulant MinHash, banding and exact verification.

Two permutations make all signature coordinates: the first scatters the hashed shingles over 32 bits, the second is applied after a circular
shift by k for coordinate k, which equals shifting it.  Both are bijections computed in place, so nothing is stored per coordinate.

Texts with equal shingle sets form one class, represented by its smallest id.  Classes that meet in a band are compared on their full sets: a
bucket is cut into blocks of bounded count and bytes, a block is compared in one task by products of 0/1 matrices, and only a star of links per
connected part leaves it, never pairs.  Bands go in two waves; buckets that the first wave has already joined are not compared again.
Buckets of more than one block are finished exactly: members outside of the bucket's most frequent component meet all of its blocks.  Nothing
is capped.  With ``bands`` of ``rows`` coordinates a pair at the threshold s is missed with probability (1 - s^rows)^bands: 2.9e-7 at 0.8.

Defined cases: null or empty texts have an empty set and are linked with nothing; texts of fewer words than a shingle are one shingle of their
own; rows without an id are linked with nothing, have no component and are kept; rows that repeat an id and text are one member; other columns
are carried as they are by ``near_dedup``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import fresh, mix64, staged, table, worker_cache
from turnloom.llm.components import components

MAX_WORDS = 300_000


@dataclass(frozen=True)
class MinHashSettings:
    shingle: int = 5
    percent: int = 80
    bands: int = 21
    rows: int = 3
    first_wave: int = 6
    block_members: int = 512
    block_bytes: int = 32 << 20


class WordHashes:
    """Numbers words and keeps their scrambled 64-bit hashes in one array; bounded."""

    def __init__(self):
        self.ids: dict[bytes, int] = {}
        self.table = np.zeros(1 << 16, np.uint64)

    def of(self, parts: list[bytes]) -> np.ndarray:
        import xxhash

        if len(self.ids) > MAX_WORDS:
            self.ids.clear()
        ids = self.ids
        try:
            return self.table[np.fromiter(map(ids.__getitem__, parts), np.int64, len(parts))]
        except KeyError:
            new = [w for w in dict.fromkeys(parts) if w not in ids]
        first = len(ids)
        ids.update(zip(new, range(first, first + len(new))))
        if len(ids) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros(max(len(self.table), len(new)), np.uint64)])
        self.table[first : len(ids)] = mix64(np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, new)), ">u8"))
        return self.table[np.fromiter(map(ids.__getitem__, parts), np.int64, len(parts))]


def shingle_set(raw: bytes | None, k: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; A-Z lower-cased.  Fewer words make one shingle."""
    parts = raw.lower().split() if raw else []
    if not parts:
        return np.empty(0, np.uint64)
    w = words.of(parts)
    size = min(k, len(w))
    n = len(w) - size + 1
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += w[i : n + i]
    h = mix64(h)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def scatter(x: np.ndarray) -> np.ndarray:
    """The first permutation of 32-bit numbers."""
    x = x * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    x ^= x >> np.uint32(13)
    return x


def permute(x: np.ndarray) -> np.ndarray:
    """The second permutation of 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signature(s: np.ndarray, coordinates: int) -> np.ndarray:
    """Smallest values of the second permutation, circularly shifted by 0, 1, 2, ... places."""
    out = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    shifts = np.arange(coordinates, dtype=np.uint32)[:, None]
    x = scatter((s >> np.uint64(32)).astype(np.uint32))
    for lo in range(0, len(x), 512):
        np.minimum(out, permute(x[None, lo : lo + 512] + shifts).min(1), out=out)
    return out


def band_keys(sig: np.ndarray, cfg: MinHashSettings) -> np.ndarray:
    s = sig.reshape(cfg.bands, cfg.rows).astype(np.uint64)
    h = np.arange(1, cfg.bands + 1, dtype=np.uint64)
    for i in range(cfg.rows):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + s[:, i])
    return h.view(np.int64)


def hashes() -> WordHashes:
    return worker_cache("minhash").setdefault("shingle-words", WordHashes())


def signed(text: Column, cfg: MinHashSettings) -> Column:
    """Struct (n, c1, c2, bands): set size, 128 bits that stand for the set, band keys."""

    def arrow(texts: pa.Array) -> pa.Array:
        words, n, c1, c2, bands = hashes(), [], [], [], []
        for t in texts:
            s = shingle_set(t.as_py(), cfg.shingle, words)
            n.append(len(s))
            c1.append(int(mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)))
            c2.append(int(mix64(s * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64).astype(np.int64)))
            bands.append(band_keys(signature(s, cfg.bands * cfg.rows), cfg) if len(s) else np.empty(0, np.int64))
        cols = [pa.array(n, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
        return pa.StructArray.from_arrays(cols, ["n", "c1", "c2", "bands"])

    return F.arrow_udf(arrow, "struct<n:bigint,c1:bigint,c2:bigint,bands:array<bigint>>")(text.cast("binary"))


def set_bytes(text: Column, cfg: MinHashSettings) -> Column:
    def arrow(texts: pa.Array) -> pa.Array:
        words = hashes()
        return pa.array([shingle_set(t.as_py(), cfg.shingle, words).tobytes() for t in texts], pa.binary())

    return F.arrow_udf(arrow, "binary")(text.cast("binary"))


def _matrix_chunks(sets: list[np.ndarray], step: int = 4096):
    """0/1 matrices (set x element) of the elements that two sets or more have."""
    values = np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(values, kind="stable")
    values, of = values[order], of[order]
    place = np.cumsum(np.concatenate([[0], values[1:] != values[:-1]]))
    shared = np.bincount(place)[place] > 1
    of, place = of[shared], place[shared]
    if not len(place):
        return
    place = np.cumsum(np.concatenate([[0], place[1:] != place[:-1]]))
    for lo in range(0, int(place[-1]) + 1, step):
        i, j = np.searchsorted(place, [lo, lo + step])
        m = np.zeros((len(sets), min(step, int(place[-1]) + 1 - lo)), np.float32)
        m[of[i:j], place[i:j] - lo] = 1
        yield m


def common_counts(a: list[np.ndarray], b: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of all intersections of sets of ``a`` with sets of ``b``, or with each other (the diagonal is of no meaning then)."""
    n = len(a)
    if b is None and n == 2:
        x = len(np.intersect1d(a[0], a[1], assume_unique=True))
        return np.array([[0, x], [x, 0]])
    total = np.zeros((n, n if b is None else len(b)), np.float32)
    for m in _matrix_chunks(a if b is None else [*a, *b]):
        total += m @ m.T if b is None else m[:n] @ m[n:].T
    return total.astype(np.int64)


def linked(a: list[np.ndarray], percent: int, b: list[np.ndarray] | None = None) -> np.ndarray:
    both = common_counts(a, b)
    sizes = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in (a if b is None else b)])[None, :]
    return 100 * both >= percent * (sizes - both)


def stars(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    """The parts that the links nodes[i]-nodes[j] connect, each as links to its smallest node."""
    if not len(i):
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    at = np.arange(len(nodes))
    while True:
        new = at.copy()
        np.minimum.at(new, i, at[j])
        np.minimum.at(new, j, at[i])
        new = new[new]
        if (new == at).all():
            break
        at = new
    low = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(low, at, nodes)
    a = low[at]
    keep = a != nodes
    return pd.DataFrame({"a": a[keep], "b": nodes[keep]})


def _sets(col: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in col]


def links_inside(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within each (key, block); members: key, block, node, shingles.

    Sorted groups are cut out of Arrow batches, as most groups are far smaller than a batch.  A block has a bounded size.
    """

    def links(nodes: np.ndarray, shingles: list[bytes]) -> pd.DataFrame:
        s = [np.frombuffer(x, np.uint64) for x in shingles]
        i, j = np.nonzero(np.triu(linked(s, percent), 1))
        return stars(nodes, i, j)

    def run(batches):
        left: list[pa.RecordBatch] = []
        for b in batches:
            t = pa.Table.from_batches([*left, b]).combine_chunks()
            key, block, nodes = (t.column(c).to_numpy() for c in ("key", "block", "node"))
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
            done = int(cuts[-1]) if len(cuts) else 0
            out, shingles = [], t.column("shingles")
            for lo, hi in zip([0, *cuts[:-1].tolist()], cuts.tolist()):
                out.append(links(nodes[lo:hi], shingles.slice(lo, hi - lo).to_pylist()))
            left = t.slice(done).to_batches()
            if out:
                yield pa.RecordBatch.from_pandas(pd.concat(out), preserve_index=False)
        if left:
            t = pa.Table.from_batches(left)
            yield pa.RecordBatch.from_pandas(links(t.column("node").to_numpy(), t.column("shingles").to_pylist()), preserve_index=False)

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = members.select("key", "block", "node", "shingles").repartition(parts, "key", "block").sortWithinPartitions("key", "block")
    return sorted_.mapInArrow(run, "a long, b long")


def _links_across(percent: int):
    def run(key, some: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(others):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        hit = linked(_sets(some["shingles"]), percent, _sets(others["shingles"]))
        i, j = np.nonzero(hit & (some["label"].to_numpy()[:, None] != others["label"].to_numpy()[None, :]))
        nodes = np.concatenate([some["node"].to_numpy(np.int64), others["node"].to_numpy(np.int64)])
        return stars(nodes, i, j + len(some))

    return run


def classes_of(rows: DataFrame, key: str, sig: str) -> DataFrame:
    """One row per distinct set: node (smallest id), n, c1, c2, bands."""
    g = rows.where(f"{sig}.n > 0").groupBy(F.col(f"{sig}.c1").alias("c1"), F.col(f"{sig}.c2").alias("c2"))
    return g.agg(F.min(f"`{key}`").alias("node"), F.first(f"{sig}.n").alias("n"), F.first(f"{sig}.bands").alias("bands"))


def link_classes(docs: DataFrame, key: str, text: str, classes: DataFrame, cfg: MinHashSettings) -> DataFrame:
    """(node, label) of all classes that have a link."""
    rows = classes.select("node", "n", F.posexplode("bands").alias("band", "key"))
    # buckets with two members or more, one for each set of members
    b = rows.groupBy("key").agg(
        F.count("*").alias("c"), F.sum("n").alias("size"), F.min("band").alias("band"), F.min("node").alias("lo"), F.max("node").alias("hi"),
        F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("h"),
    ).where("c > 1")
    b = b.groupBy("c", "size", "lo", "hi", "h").agg(F.min(F.struct("band", "key")).alias("x"))
    blocks = F.greatest(F.ceil(F.col("c") / cfg.block_members), F.ceil(F.col("size") * 8 / cfg.block_bytes)).cast("int")
    b = b.select("x.band", "x.key", blocks.alias("blocks"))
    members = rows.select("key", "node").join(b, "key")
    members = staged(members.select("key", "band", "node", "blocks", F.pmod(F.xxhash64("node", "key"), "blocks").cast("int").alias("block")), "minhash-members")
    wanted = members.select("node").distinct()
    texts = docs.select(F.col(f"`{key}`").alias("node"), F.col(f"`{text}`").alias("text")).join(
        wanted.hint("merge"), "node", "left_semi"  # candidates grow with the input, so one plan at every size: no broadcast of a small table
    )
    sets = texts.select("node", set_bytes(F.col("text"), cfg).alias("shingles")).dropDuplicates(["node", "shingles"])
    # empty sets go after the write: a filter here would be pushed below the semi-join and make the sets of all documents
    sets = staged(sets, "minhash-sets").where(F.octet_length("shingles") > 0)

    edges, labels = None, None
    for lo, hi in ((0, cfg.first_wave), (cfg.first_wave, cfg.bands)):
        m = members.where(F.col("band").between(lo, hi - 1))
        if labels is not None:
            m = _mixed(m, labels, ["key", "block"])
        part = links_inside(m.select("key", "block", "node").join(sets, "node"), cfg.percent)
        part = staged(part.distinct(), "minhash-links")
        edges = part if edges is None else edges.unionByName(part)
        labels = components(edges)

    # buckets of several blocks: members outside of the most frequent component meet every block
    big = _mixed(members.where("blocks > 1"), labels, ["key"])
    big = staged(big, "minhash-big")
    if big.limit(1).count():
        per = big.groupBy("key", "label").count()
        main = per.groupBy("key").agg(F.max(F.struct("count", "label"))["label"].alias("main"), (F.sum("count") - F.max("count")).alias("rest"))
        big = big.join(main, "key").withColumn("parts", F.ceil(F.col("rest") / cfg.block_members).cast("int")).join(sets, "node")
        some = big.where("label <> main").select(
            "key", F.pmod(F.xxhash64("node", "label", "key"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "node", "label", "shingles"
        )
        # both sides come from one table, so the second gets columns of its own
        second = big.select(*[F.col(c).alias(c) for c in ("key", "parts", "block", "node", "label", "shingles")])
        others = second.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "block", "node", "label", "shingles")
        by = ["key", "part", "block"]
        part = some.groupBy(*by).cogroup(others.groupBy(*by)).applyInPandas(_links_across(cfg.percent), "a long, b long")
        edges = edges.unionByName(staged(part.distinct(), "minhash-links"))
        labels = components(edges)
    return labels


def _mixed(members: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    """The members, with labels, of the groups that still hold two components or more."""
    m = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_ = m.groupBy(*by).agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l < h").select(*by)
    return m.join(open_, by, "left_semi")


def _judged(docs: DataFrame, key: str, text: str, cfg: MinHashSettings) -> DataFrame:
    """key, n_shingles, component_id, kept and a hash of the text: per row of ``docs``."""
    sig, row = fresh(docs.select(key), "sig", "text_hash")
    rows = staged(
        docs.select(F.col(f"`{key}`").cast("long").alias(key), signed(F.col(f"`{text}`"), cfg).alias(sig), F.xxhash64(F.col(f"`{text}`")).alias(row)), "minhash-signed"
    )
    known = rows.where(F.col(key).isNotNull())
    classes = staged(classes_of(known, key, sig), "minhash-classes")
    labels = link_classes(docs, key, text, classes, cfg)
    low = classes.select("c1", "c2", "node").join(labels, "node", "left").select("c1", "c2", F.coalesce("label", "node").alias("low"))
    flat = rows.select(key, row, F.col(f"{sig}.n").alias("n_shingles"), F.when(F.col(f"{sig}.n") > 0, F.col(f"{sig}.c1")).alias("c1"), F.col(f"{sig}.c2").alias("c2"))
    got = flat.join(low, ["c1", "c2"], "left").withColumn("component_id", F.when(F.col(key).isNotNull(), F.coalesce("low", key)))
    return got.select(key, "n_shingles", "component_id", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)).alias("kept"), F.col(row).alias("text_hash"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", cfg: MinHashSettings = MinHashSettings()) -> DataFrame:
    """key, n_shingles, component_id, kept: per row of ``docs``."""
    return _judged(docs, key, text, cfg).drop("text_hash")


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", cfg: MinHashSettings = MinHashSettings()) -> DataFrame:
    """``docs`` without the rows that are a near copy of one with a smaller id, link by link.

    Rows go by id and text: of rows that share an id, one with a text of its own stays.
    """
    id_, hash_ = fresh(docs, "gone id", "gone text")
    gone = _judged(docs, key, text, cfg).where("not kept").select(F.col(key).alias(id_), F.col("text_hash").alias(hash_)).distinct()
    same = (F.col(f"`{key}`") == F.col(f"`{id_}`")) & (F.xxhash64(F.col(f"`{text}`")) == F.col(f"`{hash_}`"))
    return docs.join(gone.hint("merge"), same, "left_anti")


def op8_minhash(spark, d) -> DataFrame:
    return near_duplicates(table(spark, d, "documents"), cfg=MinHashSettings(shingle=4))


#: Every pair that shares a shingle is counted; components by repeated minima.
OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE [array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)] END) AS x FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
u AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS v, doc_id AS l FROM documents UNION SELECT u.b, r.l FROM r JOIN u ON u.a = r.v),
c AS (SELECT v, min(l) AS l FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.l AS component_id, d.doc_id = c.l AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.v = d.doc_id
"""
