"""Alignment of two tokenizers' tokens by interval coalescing.

Tokens are byte intervals.  All intervals of both sides, of many documents laid end to end, are sorted by start; where a start
reaches the largest end so far, a new group begins: these are the places where tokens of both sides end together.  Within the groups, overlaps are
expanded to pairs; pairs that end together are links.

How often a pair of ids is linked is a statistic of the whole corpus.  Documents come in blocks of bounded bytes.  A block's links are numbers in a
dictionary of its pairs, so what is summed, joined and sent back is a row per block and pair, not per link or document; a pair that all
documents have is as many rows as there are blocks, summed before the shuffle.  Blocks and their dictionaries meet by block number.

Both sides break before a run of spaces and line feeds, so no token and no group crosses the units that begin there: a unit's groups and links are found
once and kept in a bounded memo.  Texts with other white space before such a run are one unit.  Tests hold the ids against those of whole texts.

Defined cases: null and empty texts, and texts whose tokens' bytes differ from a space and the text, have no tokens: all counts are 0 and the groups
empty; rows without a key and rows that repeat one are rows of their own, and count in the corpus; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import staged, table, worker_cache

MAX_UNITS = 300_000
LONG_CHARS = 4 << 20  # characters of long units after which the memo starts anew, so that its size is bounded
LONG_UNIT = 200


@dataclass(frozen=True)
class AlignSettings:
    model_a: str | None = None
    model_b: str | None = None
    #: text of one block, whose links share a dictionary
    block_bytes: int = 16 << 20
    #: text whose tokens are aligned at once
    part_bytes: int = 1 << 20
    #: "sha256" or "text": what is kept of the groups
    groups: str = "sha256"


_UNITS = re.compile("[ \n]*[^ \n]+|[ \n]+")
# other white space of side A's pattern before a place to cut: it may go into one token with what follows
_JOINED = re.compile("[\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000][ \n]")


class Encoder:
    """Encodes units as they are inside a text."""

    bytes_of: list[bytes]

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units one after another, and how many each has."""
        raise NotImplementedError

    def differing(self, units: list[str], ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Which units are not what their tokens' bytes say."""
        ends = np.cumsum(counts)
        given = [u.encode("utf-8") for u in units]
        upto = np.concatenate([[0], np.cumsum(self.len_of[ids])])[np.concatenate([[0], ends])]
        whole = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        if whole == b"".join(given) and (np.diff(upto) == [len(x) for x in given]).all():
            return np.zeros(len(units), bool)
        return np.array([whole[lo:hi] != x for lo, hi, x in zip(upto[:-1].tolist(), upto[1:].tolist(), given)])


class ByteLevel(Encoder):
    """Side A: byte-level BPE."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.tok.no_padding()
        self.tok.no_truncation()
        # the alphabet of byte-level vocabularies: printable Latin-1 stands for itself, the others follow from 256 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        names = {i: t for t, i in self.tok.get_vocab(with_added_tokens=False).items()}
        self.bytes_of = [bytes(letters[c] for c in names[i]) if all(c in letters for c in names.get(i, "?")) and i in names else b"" for i in range(self.tok.get_vocab_size())]

        self.len_of = np.array([len(x) for x in self.bytes_of])

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # words with their space stay what they are in a row, so they go to the library as one text; its tokens are cut at the words' ends
        is_word = np.fromiter((u[0] == " " and not u[-1].isspace() and " " not in u[1:] and "\n" not in u for u in units), bool, len(units))
        words = [u for u, w in zip(units, is_word) if w]
        counts = np.zeros(len(units), np.int64)
        in_row = np.asarray(self.tok.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, "<u4") if words else np.zeros(0, "<u4")
        ends = np.cumsum([len(u.encode("utf-8", "surrogatepass")) for u in words]) if words else np.zeros(0, np.int64)
        upto = np.cumsum(self.len_of[in_row])
        cut = np.searchsorted(upto, ends)
        if len(words) and not (upto[-1] == ends[-1] and (upto[cut] == ends).all()):
            is_word[:] = False
        single = [np.asarray(e.ids, "<u4") for e in self.tok.encode_batch_fast([u for u, w in zip(units, is_word) if not w], add_special_tokens=False)]
        counts[~is_word] = [len(x) for x in single]
        if is_word.any():
            counts[is_word] = np.diff(cut + 1, prepend=0)
        out = np.empty(int(counts.sum()), "<u4")
        of_word = np.repeat(is_word, counts)
        if is_word.any():
            out[of_word] = in_row
        out[~of_word] = np.concatenate([np.zeros(0, "<u4"), *single])
        return out, counts


class Pieces(Encoder):
    """Side B: sentence pieces, which add a word mark in front."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of = [
            bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, sp.id_to_piece(i)) for i in range(sp.get_piece_size()))
        ]

        self.len_of = np.array([len(x) for x in self.bytes_of])
        self.feed = next((i for i, x in enumerate(self.bytes_of) if x == b"\n"), -1)

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # a line feed is a token by itself, after the mark that the library adds: what comes between two of them is a unit as it is inside a text
        fed = np.fromiter(("\n" in u for u in units), bool, len(units))
        rest = [u for u in units if "\n" not in u]
        rows = ["\n" + "\n".join(rest[i : i + 500]) for i in range(0, len(rest), 500)]
        ids = np.asarray([x for row in (self.sp.encode(rows, num_threads=1) if rows else []) for x in row[1:]], "<u4")
        own = [x[2:] for x in self.sp.encode(["\n" + u for u in units if "\n" in u], num_threads=1)] if fed.any() else []
        counts = np.zeros(len(units), np.int64)
        counts[fed] = [len(x) for x in own]
        counts[~fed] = np.diff(np.flatnonzero(ids == self.feed), append=len(ids)) - 1
        out = np.empty(int(counts.sum()), "<u4")
        of_fed = np.repeat(fed, counts)
        out[of_fed], out[~of_fed] = [x for ids_ in own for x in ids_], ids[ids != self.feed]
        return out, counts


def encoders(cfg: AlignSettings) -> tuple[ByteLevel, Pieces]:
    import public_tokenizers

    a = cfg.model_a or public_tokenizers.path("byte_bpe_50k.json")
    b = cfg.model_b or public_tokenizers.path("piece_bpe_32k.model")
    cache = worker_cache("alignment")
    if ("pair", a, b) not in cache:
        cache["pair", a, b] = (ByteLevel(a), Pieces(b))
    return cache["pair", a, b]


def coalesced(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by start, number of the group of each interval in that order)."""
    order = np.lexsort((ends, starts))
    s, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.zeros(len(order), np.int64)
    new[1:] = s[1:] >= reach[:-1]
    return order, np.cumsum(new)


def overlaps(sa: np.ndarray, ea: np.ndarray, sb: np.ndarray, eb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (index in A, index in B) of overlapping intervals; both sides are sorted and have no overlaps within."""
    lo, hi = np.searchsorted(eb, sa, "right"), np.searchsorted(sb, ea, "left")
    n = np.maximum(hi - lo, 0)
    i = np.repeat(np.arange(len(sa)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


class Units:
    """Aligned units: counts, groups as text, and links as numbers of id pairs."""

    def __init__(self, cfg: AlignSettings):
        self.a, self.b = encoders(cfg)
        self.pieces = len(self.b.len_of)
        top = max(len(self.a.len_of), self.pieces)
        # an id's text by what follows it: another id of its side, the other side, the next group
        self.names, self.top = [f"{i}{mark}" for mark in ",|;" for i in range(top)], top
        #: id pair (id of A times size of B's vocabulary, plus id of B) -> number
        self.pairs: dict[int, int] = {}
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = np.zeros((0, 5), np.int64)  # tokens of A and B, groups, links, whether bytes differ
        self.links, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def learn(self, units: set[str]) -> None:
        new = list(units.difference(self.index))
        if len(self.index) + len(new) > MAX_UNITS:
            self.clear()
            new = list(units)
        if new:
            groups, counts, links = self.align(new)
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.groups += groups
            self.counts = np.concatenate([self.counts, counts])
            self.links = np.concatenate([self.links, links])
            self.at = np.concatenate([[0], np.cumsum(self.counts[:, 3])])

    def align(self, units: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        a, n_a = self.a.encode_units(units)
        b, n_b = self.b.encode_units(units)
        odd = self.a.differing(units, a, n_a) | self.b.differing(units, b, n_b)
        if odd.any():
            a, b = a[np.repeat(~odd, n_a)], b[np.repeat(~odd, n_b)]
            n_a[odd] = n_b[odd] = 0
        a, b = a.astype(np.int64), b.astype(np.int64)
        # the tokens of both sides lie end to end and fill the same bytes
        ea, eb = np.cumsum(self.a.len_of[a]), np.cumsum(self.b.len_of[b])
        sa, sb = ea - self.a.len_of[a], eb - self.b.len_of[b]
        order, group = coalesced(np.concatenate([sa, sb]), np.concatenate([ea, eb]))
        side = order >= len(a)
        # tokens by group, then side; each side is in order within
        by_group = np.lexsort((order, side, group))
        ids = np.concatenate([a, b])[order][by_group]
        group, side = group[by_group], side[by_group]
        last = np.ones(len(ids), bool)
        last[:-1] = group[1:] != group[:-1]
        turn = np.zeros(len(ids), bool)
        turn[:-1] = side[1:] & ~side[:-1]
        named = list(map(self.names.__getitem__, (ids + self.top * (turn + 2 * last)).tolist()))
        ends = np.concatenate([[0], np.cumsum(n_a + n_b)])
        upto = np.concatenate([[0], np.cumsum(last)])
        i, j = overlaps(sa, ea, sb, eb)
        together = ea[i] == eb[j]
        i, j = i[together], j[together]
        n_links = np.diff(np.searchsorted(i, np.concatenate([[0], np.cumsum(n_a)])))
        codes, where = np.unique(a[i] * self.pieces + b[j], return_inverse=True)
        numbers = np.array([self.pairs.setdefault(c, len(self.pairs)) for c in codes.tolist()], np.int32)
        at = ends.tolist()
        groups = ["".join(named[lo:hi])[:-1] for lo, hi in zip(at, at[1:])]
        return groups, np.stack([n_a, n_b, np.diff(upto[ends]), n_links, odd], 1), numbers[where]

    def documents(self, texts: list[bytes], keep: str = "sha256") -> tuple[list[dict], list[np.ndarray]]:
        """Per text its counts and groups, and the numbers of its links."""
        cut: list[list[str]] = []
        for raw in texts:
            try:
                t = " " + raw.decode("utf-8") if raw else ""
            except UnicodeDecodeError:
                t = ""  # no tokens
            cut.append([t] if _JOINED.search(t) else _UNITS.findall(t))
        met = set(chain.from_iterable(cut))
        self.learn(met)
        out, links = [], []
        for units in cut:
            k = np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))
            n_a, n_b, n_groups, n_links, odd = self.counts[k].sum(0).tolist()
            if odd:
                k, n_a, n_b, n_groups, n_links = k[:0], 0, 0, 0, 0
            n = self.counts[k, 3]
            links.append(self.links[np.arange(n_links) + np.repeat(self.at[k] - (np.cumsum(n) - n), n)])
            groups = ";".join(map(self.groups.__getitem__, k.tolist()))
            out.append({"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups": sha256(groups.encode()).hexdigest() if groups and keep == "sha256" else groups})
        if any(len(u) > LONG_UNIT for u in met):
            if sum(len(u) for u in self.index if len(u) > LONG_UNIT) > LONG_CHARS:
                self.clear()
        return out, links


def squeezed(x: np.ndarray) -> bytes:
    """Small numbers as compressed byte planes."""
    import zstandard

    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unsqueezed(raw: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


ROW = "key long, n_a long, n_b long, n_groups long, n_links long, groups string, block long, links binary, pairs array<long>, counts array<long>"


def aligned_blocks(docs: DataFrame, key: str, text: str, cfg: AlignSettings) -> DataFrame:
    """A row per document, whose links are places in its block's dictionary, and a row per block with that dictionary and its counts."""
    schema = pa.schema(
        [("key", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()), ("block", pa.int64()),
         ("links", pa.binary()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]
    )

    def run(batches):
        cache = worker_cache("alignment")
        units = cache.setdefault(("units", cfg.model_a, cfg.model_b), None) or Units(cfg)
        cache["units", cfg.model_a, cfg.model_b] = units
        number = TaskContext.get().partitionId() << 32
        rows: list[dict] = []
        links: list[np.ndarray] = []
        size = 0

        def close():
            nonlocal rows, links, size, number
            codes = np.fromiter(units.pairs, np.int64, len(units.pairs))
            counts = np.bincount(np.concatenate([np.empty(0, np.int32), *links]), minlength=len(codes))
            # frequent pairs get small numbers; pairs that the block doesn't have are left out
            by_count = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
            rank = np.zeros(len(codes), np.int64)
            rank[by_count] = np.arange(len(by_count))
            for r, x in zip(rows, links):
                r["links"], r["block"] = squeezed(rank[x]), number
            rows.append({"block": number, "pairs": codes[by_count], "counts": counts[by_count]})
            out = pa.RecordBatch.from_pylist(rows, schema)
            rows, links, size, number = [], [], 0, number + 1
            return out

        for b in batches:
            keys, lo = b.column(0).to_pylist(), 0
            texts = b.column(1)
            sizes = [len(t.as_buffer() or b"") if t.is_valid else 0 for t in texts]
            while lo < len(keys):
                hi, part = lo, 0
                while hi < len(keys) and (hi == lo or part + sizes[hi] <= cfg.part_bytes):
                    part += sizes[hi]
                    hi += 1
                got, codes = units.documents([t.as_py() or b"" for t in texts[lo:hi]], cfg.groups)
                rows += [{"key": k, **r} for k, r in zip(keys[lo:hi], got)]
                links += codes
                size, lo = size + part, hi
                if size >= cfg.block_bytes:
                    yield close()
        if rows:
            yield close()

    return docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").cast("binary").alias("t")).mapInArrow(run, ROW)


def pair_counts(blocks: DataFrame, pieces: int) -> DataFrame:
    """(pair, count, best): links of each pair of ids in the corpus, and whether no other pair of its B id has more.  ``pieces``: size of B's vocabulary."""
    each = blocks.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
    counts = staged(each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("count")), "align-counts")
    top = counts.groupBy((F.col("pair") % pieces).alias("b")).agg(F.max("count").alias("top"))
    # one row per id of the vocabulary at most
    return counts.join(F.broadcast(top), F.col("pair") % pieces == F.col("b")).select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def scored(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Sums over the links of a block's documents."""
    if pairs.num_rows:  # a block without links has no dictionary
        at = np.argsort(pairs.column("at").to_numpy())
        count, best = pairs.column("count").to_numpy()[at], pairs.column("best").to_numpy(zero_copy_only=False)[at].astype(np.int64)
    sums, bests = [], []
    for raw in docs.column("links"):
        x = unsqueezed(raw.as_py())
        sums.append(int(count[x].sum()) if len(x) else 0)
        bests.append(int(best[x].sum()) if len(x) else 0)
    keep = docs.select(["key", "n_a", "n_b", "n_groups", "n_links", "groups"])
    return keep.append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", cfg: AlignSettings = AlignSettings()) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, groups (text or hash, by ``cfg.groups``), n_best, count_sum: per row of ``docs``."""
    import sentencepiece
    import public_tokenizers

    pieces = sentencepiece.SentencePieceProcessor(model_file=cfg.model_b or public_tokenizers.path("piece_bpe_32k.model")).get_piece_size()
    blocks = staged(aligned_blocks(docs, key, text, cfg), "align-blocks")
    counts = pair_counts(blocks, pieces)
    wanted = blocks.where("pairs is not null").select("block", F.posexplode("pairs").alias("at", "pair"))
    found = wanted.join(counts, "pair").select("block", "at", "count", "best")
    # both sides come from one table, so this one gets columns of its own
    mine = blocks.where("pairs is null").select(*[F.col(c).alias(c) for c in ("block", "key", "n_a", "n_b", "n_groups", "n_links", "groups", "links")])
    out = "key long, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long"
    return mine.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(scored, out).withColumnRenamed("key", key)


def op13_alignment(spark, d) -> DataFrame:
    r = align(table(spark, d, "documents"))
    return r.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
