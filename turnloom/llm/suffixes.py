"""Removal of long repeats with a logarithmic family of sparse suffix arrays.

Of all suffixes only those at sampled positions are kept: the position of the smallest hashed ``prefix``-byte string of each ``length``-byte
window (the leftmost of equals).  The choice depends on the window's bytes alone, so two equal windows choose the same place and every repeat of
``length`` bytes is met.  Neighbouring windows that choose the same position form one entry: (m, s, id, where).  m orders the suffix (its
first 4 bytes, then a fingerprint of its first ``prefix`` bytes), s is a fingerprint of all bytes of the entry's windows.

Documents come in batches of rising ids.  A batch gets its sorted array, is merge-scanned against the arrays of all levels (sorted tables in equal
buckets of m, so these are sort-merge joins without a shuffle), and becomes a level; two levels of equal size merge into one of twice the size,
so there are at most log2(batches) of them.  Entries with an s that a smaller id has are repeats as a whole.  Entries that share m but not s
touch the edge of a repeat: those are extended in a last pass, which compares their single windows.  So the result is exact but
for collisions of 128-bit (entries) and 64-bit (edge windows) fingerprints.

Before any shuffle, equal entries of one Arrow batch are reduced to those of its smallest id; what a hot passage or a large group of copies sends
is a row per batch of rows.  The rows of one m with different surroundings are sorted and streamed, with no state but one row.

Defined cases: null text counts as empty; texts shorter than ``length`` have no repeat; rows without an id neither remove nor lose anything; rows with
one id don't match each other; an empty table gives an empty result; other columns are carried as they are.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.llm.common import fresh, mix64, staged, table, worker_cache

PIECE = 1 << 19  # bytes of text handled at once
GROUP = 4 << 20  # bytes of text whose entries are reduced together
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@dataclass(frozen=True)
class SuffixSettings:
    length: int = 50
    prefix: int = 20
    batches: int = 4
    buckets: int | None = None  # default: the session's shuffle partitions


class Rolling:
    """Fingerprints of any substring of a buffer from one running sum."""

    def __init__(self, size: int):
        one = np.ones(1, np.uint64)
        self.up = np.concatenate([one, np.cumprod(np.full(size, _BASE, np.uint64))])
        self.down = np.concatenate([one, np.cumprod(np.full(size, _INVERSE, np.uint64))])
        self.code = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.code[x] * self.up[: len(x)])])

    def of(self, sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64((sums[b] - sums[a]) * self.down[a])


def rolling() -> Rolling:
    cache = worker_cache("suffixes")
    if "rolling" not in cache:
        cache["rolling"] = Rolling(PIECE + 256)
    return cache["rolling"]


def smallest_places(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` hashes the place of the smallest, the leftmost of equals."""
    v = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    m, span = v, 1
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if width > span:
        m = np.minimum(m[: len(v) - width + 1], m[width - span : len(v) - span + 1])
    return (m & np.uint64(0xFFFFFFFF)).astype(np.int64)


def entries(raw: bytes, cfg: SuffixSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(m, s, first window, number of windows) of one text.  Long texts are cut into overlapping pieces, so memory is bounded."""
    out = []
    step = PIECE
    for lo in range(0, max(1, len(raw) - cfg.length + 1), step):
        part = raw[lo : lo + step + cfg.length - 1]
        if len(part) < cfg.length:
            break
        r, x = rolling(), np.frombuffer(part, np.uint8)
        sums = r.sums(x)
        n = len(x) - cfg.prefix + 1
        h = mix64((sums[cfg.prefix :] - sums[:n]) * r.down[:n])
        place = smallest_places(h, cfg.length - cfg.prefix + 1)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        count = np.diff(np.concatenate([first, [len(place)]]))
        at = place[first]
        lead = np.zeros(len(at), np.uint64)
        for i in range(4):
            lead = (lead << np.uint64(8)) | x[at + i].astype(np.uint64)
        m = (lead << np.uint64(32)) | (h[at] & np.uint64(0xFFFFFFFF))
        s = r.of(sums, first, first + count + cfg.length - 1)
        # an entry holds at most length - prefix + 1 windows, which fits a byte
        out.append((m.view(np.int64), s.view(np.int64), first + lo, count))
    if not out:
        z = np.empty(0, np.int64)
        return z, z, z, z
    return tuple(np.concatenate(c) for c in zip(*out))


def _local_first(keys: list[np.ndarray], doc: np.ndarray) -> np.ndarray:
    """Rows whose key a smaller id of this batch has."""
    order = np.lexsort([doc, *keys])
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    later = np.zeros(len(order), bool)
    later[order] = doc[order] > doc[order][start]
    return later


ROW = "m long, s long, doc long, w long, covered boolean"


def _groups(keys, texts, limit: int):
    """(key, bytes) lists of bounded total size."""
    part, size = [], 0
    for k, t in zip(keys, texts):
        raw = t.as_py()
        if k is None or not raw:
            continue
        part.append((k, raw))
        size += len(raw)
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def scan_batch(docs: DataFrame, key: str, text: str, cfg: SuffixSettings) -> DataFrame:
    """The entries of ``docs``.  Rows that a smaller id of the same Arrow batch covers are marked, and spread by a key of their own."""

    def run(batches):
        for b in batches:
            for part in _groups(b.column(0).to_pylist(), b.column(1), GROUP):
                cols = [entries(raw, cfg) for _, raw in part]
                doc = np.repeat(np.array([k for k, _ in part], np.int64), [len(c[0]) for c in cols])
                m, s, first, count = (np.concatenate([c[i] for c in cols]) for i in range(4))
                w = (first << 8) | count
                later = _local_first([m, s], doc)
                spread = mix64(doc.view(np.uint64) * np.uint64(_BASE) ^ w.view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.where(later, spread, m)), pa.array(np.where(later, 0, s)), pa.array(doc), pa.array(w), pa.array(later)], ["m", "s", "doc", "w", "covered"]
                )

    return docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").cast("binary").alias("t")).mapInArrow(run, ROW)


class SuffixLevels:
    """Sorted, bucketed arrays; level i holds 2^i batches or nothing."""

    def __init__(self, spark: SparkSession, cfg: SuffixSettings = SuffixSettings()):
        self.spark, self.cfg = spark, cfg
        self.buckets = cfg.buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[str | None] = []

    def save(self, df: DataFrame) -> str:
        name = f"suffixes_{uuid.uuid4().hex}"
        df.write.format("parquet").bucketBy(self.buckets, "m").sortBy(*[c for c in ("m", "s") if c in df.columns]).saveAsTable(name)
        return name

    def drop(self, *names: str) -> None:
        for n in names:
            self.spark.sql(f"DROP TABLE {n}")
        # shuffle files of finished batches go when the driver forgets them
        self.spark.sparkContext._jvm.System.gc()

    def add(self, docs: DataFrame, key: str, text: str, keep: bool = True) -> tuple[DataFrame, DataFrame]:
        """Scan a batch of larger ids than all before: (doc, w) of repeats as a whole, and (doc, w) of entries at edges.  w is first window * 256 + windows.

        ``keep`` false: the batch is not put into the family (the last one of a bulk run).
        """
        rows = scan_batch(docs, key, text, self.cfg).repartition(self.buckets, "m")
        # rows stream through the sorted key; the first one leads it and is the only one that later batches have to meet
        order = Window.partitionBy("m", "s").orderBy("doc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        place = Window.partitionBy("m", "s").orderBy("doc")
        own = self.save(rows.withColumn("lead", F.row_number().over(place) == 1).withColumn("covered", F.col("covered") | (F.first("doc").over(order) < F.col("doc"))))
        t = self.spark.table(own).where("not covered").drop("covered")
        seen = [self.spark.table(n) for n in self.levels if n]
        mark = F.lit(False)
        for i, level in enumerate(seen):
            t = t.join(level.where("lead").select("m", "s", F.lit(True).alias(f"in{i}")), ["m", "s"], "left")
            mark = mark | F.coalesce(F.col(f"in{i}"), F.lit(False))
        first_name = self.save(t.select("m", "s", "doc", "w", "lead", mark.alias("covered")))
        new = self.spark.table(first_name)
        whole = self.spark.table(own).where("covered").select("doc", "w").union(new.where("covered").select("doc", "w"))
        new = new.where("not covered").drop("covered")
        # m of two documents or more of the batch, or of one of a level; which rows say so, and how often, makes no difference
        keys = new.groupBy("m").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("m")
        for level in seen:
            keys = keys.union(new.select("m").join(level.select("m"), "m", "left_semi"))
        edges = []
        # written once, as each array is scanned for them
        shared_name = self.save(keys.repartition(self.buckets, "m"))
        shared = self.spark.table(shared_name)
        for df in [new, *seen]:
            edges.append(df.join(shared.hint("merge"), "m", "left_semi").select("doc", "w"))
        out = edges[0]
        for e in edges[1:]:
            out = out.union(e)
        whole, out = staged(whole, "suffix-whole"), staged(out, "suffix-edges")
        if keep:
            self.insert(self.save(new))
        self.drop(own, first_name, shared_name)
        return whole, out

    def insert(self, name: str) -> None:
        """A carry as in a binary counter: while the place is taken, both arrays merge and move up."""
        i = 0
        while i < len(self.levels) and self.levels[i]:
            merged = self.save(self.spark.table(self.levels[i]).union(self.spark.table(name)).repartition(self.buckets, "m"))
            self.drop(self.levels[i], name)
            self.levels[i], name, i = None, merged, i + 1
        self.levels[i : i + 1] = [name]

    def close(self) -> None:
        self.drop(*[n for n in self.levels if n])
        self.levels = []


def edge_windows(docs: DataFrame, key: str, text: str, edges: DataFrame, cfg: SuffixSettings) -> DataFrame:
    """(doc, w) of the single windows of edge entries that a smaller id has too."""
    per = edges.distinct().groupBy("doc").agg(F.collect_list("w").alias("ws"))  # at most one per sampled position of the text
    asked = docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").cast("binary").alias("t")).join(per, "doc")

    def run(batches):
        for b in batches:
            wanted = dict(zip(b.column("doc").to_pylist(), b.column("ws")))
            for part in _groups(b.column("doc").to_pylist(), b.column("t"), GROUP):
                fs, docs_, at = [], [], []
                for k, raw in part:
                    w = np.asarray(wanted[k].values)
                    w = w[(w >> 8) + (w & 255) + cfg.length - 1 <= len(raw)]  # rows that repeat an id may be shorter
                    starts, n = w >> 8, w & 255
                    p = np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    for lo in range(0, len(raw), PIECE):
                        piece = raw[lo : lo + PIECE + cfg.length - 1]
                        q = p[(p >= lo) & (p < lo + PIECE)] - lo
                        r = rolling()
                        fs.append(r.of(r.sums(np.frombuffer(piece, np.uint8)), q, q + cfg.length).view(np.int64))
                        at.append(q + lo)
                        docs_.append(np.full(len(q), k, np.int64))
                f, doc, pos = np.concatenate(fs), np.concatenate(docs_), np.concatenate(at)
                later = _local_first([f], doc)
                spread = mix64(doc.view(np.uint64) * np.uint64(_BASE) ^ pos.view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.where(later, spread, f)), pa.array(doc), pa.array((pos << 8) | 1), pa.array(later)], ["f", "doc", "w", "covered"])

    rows = asked.mapInArrow(run, "f long, doc long, w long, covered boolean")
    # one row per Arrow batch and id at most shares a fingerprint with others, so its group stays small
    first = F.min("doc").over(Window.partitionBy("f"))
    return rows.withColumn("covered", F.col("covered") | (first < F.col("doc"))).where("covered").select("doc", "w")


def removed_runs(w: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that covered windows cover: (starts, ends)."""
    a = np.sort(w)
    lo, hi = a >> 8, (a >> 8) + (a & 255) + length - 1
    reach = np.maximum.accumulate(hi)
    cut = np.concatenate([[True], lo[1:] > reach[:-1]])
    return lo[cut], reach[np.concatenate([cut[1:], [True]])]


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", cfg: SuffixSettings = SuffixSettings()) -> DataFrame:
    """(doc, ws): per document with repeats the covered windows, packed as in ``SuffixLevels.add``."""
    spark = docs.sparkSession
    known = docs.select(F.col(f"`{key}`").cast("double").alias("k")).where("k is not null")
    # where the batches are cut changes the work alone, not the result
    shares = [i / cfg.batches for i in range(1, cfg.batches)]
    cuts = sorted({int(c) for c in known.approxQuantile("k", shares, 0.01)}) if shares else []
    levels = SuffixLevels(spark, cfg)
    whole, edges = [], []
    k = F.col(f"`{key}`").cast("long")
    # joins on (m, s) may use the buckets of m, and the order within: a bucket is one file, as each write is dealt by m
    confs = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}
    before = {c: spark.conf.get(c) for c in confs}
    for c, v in confs.items():
        spark.conf.set(c, v)
    try:
        for i in range(len(cuts) + 1):
            part = docs.where(k > cuts[i - 1]) if i else docs
            part = part.where(k <= cuts[i]) if i < len(cuts) else part
            a, b = levels.add(part, key, text, keep=i < len(cuts))
            whole.append(a)
            edges.append(b)
    finally:
        levels.close()
        for c, v in before.items():
            spark.conf.set(c, v)
    all_edges, covered = edges[0], whole[0]
    for e, c in zip(edges[1:], whole[1:]):
        all_edges, covered = all_edges.union(e), covered.union(c)
    single = staged(edge_windows(docs, key, text, all_edges, cfg), "suffix-windows")
    return covered.union(single).groupBy("doc").agg(F.collect_list("w").alias("ws"))


KEPT = "struct<n_bytes:bigint,n_removed:bigint,spans:array<struct<start:bigint,stop:bigint>>,kept:{}>"


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", cfg: SuffixSettings = SuffixSettings(), as_text: bool = False) -> tuple[DataFrame, str]:
    """``docs`` and a struct column (its name is returned): bytes, bytes removed, removed runs, and the bytes left; with ``as_text`` these as text, in which
    what a cut has left of a character is dropped.  Both come out of one call, as each further one would be a worker more for every running task.
    """
    ws, out, doc = fresh(docs, "ws", "rest", "doc")
    per = repeats(docs, key, text, cfg).select(F.col("doc").alias(doc), F.col("ws").alias(ws))
    j = docs.join(per, F.col(f"`{key}`") == F.col(doc), "left")

    left_as = (lambda raw: raw.decode("utf-8", "ignore")) if as_text else bytes

    def cut(texts: pa.Array, covered: pa.Array) -> pa.Array:
        worker_cache("suffixes")
        rows = []
        for t, w in zip(texts, covered):
            raw = t.as_py() or b""
            if not w.is_valid:
                rows.append({"n_bytes": len(raw), "n_removed": 0, "spans": [], "kept": left_as(raw)})
                continue
            a, b = removed_runs(np.asarray(w.values), cfg.length)
            b = np.minimum(b, len(raw))
            a, b = a[a < b].tolist(), b[a < b].tolist()
            left = b"".join(raw[x:y] for x, y in zip([0, *b], [*a, len(raw)]))
            rows.append({"n_bytes": len(raw), "n_removed": len(raw) - len(left), "spans": [{"start": x, "stop": y} for x, y in zip(a, b)], "kept": left_as(left)})
        kind = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.string() if as_text else pa.binary())])
        return pa.array(rows, kind)

    # as if not deterministic: else a filter on the result would cut each text once more, below the others' call
    done = F.arrow_udf(cut, KEPT.format("string" if as_text else "binary")).asNondeterministic()(F.col(f"`{text}`").cast("binary"), F.col(ws))
    return j.select(*[F.col(f"`{c}`") for c in docs.columns], done.alias(out)), out


def op2_suffixes(spark, d) -> DataFrame:
    r, out = without_repeats(table(spark, d, "documents").select("doc_id", "text"))
    return r.select("doc_id", f"{out}.n_bytes", f"{out}.n_removed", F.size(f"{out}.spans").cast("long").alias("n_spans"), F.sha2(f"{out}.kept", 256).alias("kept_sha256"))
