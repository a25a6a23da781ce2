"""Best-fit packing of documents into sequences by the sum-of-squares rule.

Documents become token pieces of at most ``capacity`` tokens (only longer documents are cut).  Each piece goes into the
open bin, or a new one, for which the sum over residual gaps of the squared number of open bins becomes smallest: moving a bin
from gap g to gap g - s changes that sum by 2 N(g - s) - 2 N(g) + 2, so one vector of the capacity's length decides.

Pieces are dealt into blocks of about ``block_rows`` by a hash of their key, each block is packed in one task, and the bins that a
block leaves open with a gap above ``slack`` are emptied and packed again in a second round of blocks made of such rests alone.  No
task sees more than one block, whatever the number of documents of one source or key.

Defined cases: null text is an empty document and gives one piece, the end mark alone; an empty table gives none; repeated rows are packed
each; null keys are keys; other columns are not read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import fresh, staged, table, worker_cache

CAPACITY = 2048
BLOCK_ROWS = 1 << 15
MAX_WORDS = 200_000
#: Letters whose lower case is one letter and the same in all libraries, then marks that never join letters.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]{0,3})")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """Word -> its ids as little-endian unsigned 32-bit bytes; bounded.

    New words that are letters and closing marks are encoded in one string, lower-cased letters only: each such run of letters
    gives tokens up to one with a word end, and the closing marks are a part of their own.  All others are encoded one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        size = self.tok.get_vocab_size()
        self.ends = np.array([(self.tok.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.cores: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}

    def ids(self, text: str) -> np.ndarray:
        return np.asarray(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def learn_cores(self, cores: list[str]) -> None:
        for lo in range(0, len(cores), 5_000):
            part = cores[lo : lo + 5_000]
            got = self.ids(" ".join(part))
            cut = np.flatnonzero(self.ends[got]) + 1
            if len(cut) != len(part):
                raise AssertionError("each run of letters ends in one token with a word end")
            raw, at = got.tobytes(), 0
            for w, to in zip(part, (cut * 4).tolist()):
                self.cores[w] = raw[at:to]
                at = to

    def learn(self, words: list[str]) -> None:
        if len(self) > MAX_WORDS:
            self.clear()
        if len(self.cores) > MAX_WORDS:
            self.cores.clear()
        plain: list[tuple[str, str, str]] = []
        for w in dict.fromkeys(words):
            if w in self:
                continue
            if m := _PLAIN.fullmatch(w):
                plain.append((w, m[1].lower(), m[2]))
            else:
                self[w] = self.ids(w).tobytes()
        self.learn_cores([c for c in dict.fromkeys(c for _, c, _ in plain) if c not in self.cores])
        for w, core, mark in plain:
            if mark not in self.marks:
                self.marks[mark] = self.ids(mark).tobytes()
            self[w] = self.cores[core] + self.marks[mark]


def encoder(path: str) -> WordIds:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    cache = worker_cache("packing")
    if ("ids", path) not in cache:
        cache["ids", path] = WordIds(path)
    return cache["ids", path]


def encode(text: str, words: WordIds) -> bytes:
    """Ids of a whole text.  Spaces and line feeds end a word for this tokenizer and leave no token: the parts between stand alone."""
    parts = text.replace("\n", " ").split(" ")
    try:
        return b"".join(map(words.__getitem__, parts))
    except KeyError:
        words.learn(parts)
        return b"".join(map(words.__getitem__, parts))


def token_pieces(text: Column, capacity: int = CAPACITY, end_id: int = 0, model: str | None = None) -> Column:
    """Array of binary columns: the ids (little-endian unsigned 32-bit) of a text and ``end_id``, cut every ``capacity`` ids."""
    model = model or default_model()
    end = np.asarray([end_id], "<u4").tobytes()

    def arrow(texts: pa.Array) -> pa.Array:
        words = encoder(model)
        out, step = [], 4 * capacity
        for t in texts:
            ids = encode(t.as_py() or "", words) + end
            out.append([ids[i : i + step] for i in range(0, len(ids), step)])
        return pa.array(out, pa.list_(pa.binary()))

    return F.arrow_udf(arrow, "array<binary>")(text)


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, model: str | None = None) -> DataFrame:
    """One row per piece: key, piece, start, length, ids (binary)."""
    each = docs.select(F.col(f"`{key}`").alias(key), F.posexplode(token_pieces(F.col(f"`{text}`"), capacity, model=model)).alias("piece", "ids"))
    return each.select(
        key, "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.floor(F.octet_length("ids") / 4).cast("long").alias("length"), "ids"
    )


def sum_of_squares(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset in it) of every piece, and the gap left in every bin.  Larger pieces go first; ties in the given order."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    gaps: list[int] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    n = np.zeros(capacity + 1, np.int64)  # open bins per gap; full bins count as none
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        if not 0 < s <= capacity:
            raise ValueError(f"a piece of {s} does not fit into {capacity}")
        # change of the sum if an open bin of gap g >= s takes the piece
        change = np.where(n[s:] > 0, 2 * (n[: capacity + 1 - s] - n[s:]) + 2, np.iinfo(np.int64).max)
        if n[s]:
            change[0] = 1 - 2 * n[s]  # a full bin is no more counted
        g = int(change.argmin()) + s
        new_bin = 2 * n[capacity - s] + 1 if s < capacity else 0
        if change[g - s] <= new_bin:
            b = stacks[g].pop()
            n[g] -= 1
        else:
            b, g = len(gaps), capacity
            gaps.append(capacity)
        bins[i], offsets[i] = b, capacity - g
        gaps[b] = g - s
        if g > s:
            stacks[g - s].append(b)
            n[g - s] += 1
    return bins, offsets, np.asarray(gaps, np.int64)


def _pack_block(capacity: int, slack: int):
    def run(key, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["length", "tie", "nth"], ascending=[False, True, True], kind="stable")
        bins, offsets, gaps = sum_of_squares(block["length"].to_numpy(np.int64), capacity)
        out = block.drop(columns=["length", "tie"])
        return out.assign(bin=bins, offset=offsets, open=gaps[bins] > slack)

    return run


def pack(lengths: DataFrame, keys: list[str], length: str = "length", capacity: int = CAPACITY, block_rows: int = BLOCK_ROWS,
         slack: int = CAPACITY // 64) -> DataFrame:
    """``lengths`` with ``sequence_id`` and ``offset``: every row in one sequence, gapless from 0.

    ``keys`` name the piece; they and ``length`` are all that is read.  Pieces of just the capacity are a sequence of their own.
    """
    spark = lengths.sparkSession
    nth, seq, off = fresh(lengths, "nth", "sequence_id", "offset")
    rows = staged(lengths.withColumn(nth, F.monotonically_increasing_id()), "pieces")
    hashed = F.xxhash64(*[F.col(f"`{k}`") for k in keys], F.col(nth))
    todo = rows.where(F.col(f"`{length}`") < capacity).select(F.col(nth).alias("nth"), F.col(f"`{length}`").alias("length"), hashed.alias("tie"))
    schema = "nth long, block long, bin long, offset long, open boolean"
    done = []
    for turn in (1, 2):
        blocks = max(1, math.ceil(todo.count() / block_rows))
        got = staged(
            todo.withColumn("block", F.pmod("tie", F.lit(blocks))).groupBy("block").applyInPandas(_pack_block(capacity, slack), schema), "packed"
        )
        placed = got if turn == 2 else got.where("not open")
        # odd numbers for the two rounds' bins, even ones for full pieces: no two alike
        done.append(placed.select("nth", ((F.col("block") * F.lit(block_rows * 8) + F.col("bin")) * 4 + (2 * turn - 1)).alias("seq_"), F.col("offset").alias("off_")))
        if turn == 1:
            todo = got.where("open").select("nth").join(todo, "nth")
    placed = done[0].unionByName(done[1]).withColumnRenamed("nth", nth)
    full = rows.where(F.col(f"`{length}`") >= capacity).withColumns({seq: F.col(nth) * 2, off: F.lit(0).cast("long")})
    rest = rows.where(F.col(f"`{length}`") < capacity).join(placed, nth).withColumnsRenamed({"seq_": seq, "off_": off})
    return full.unionByName(rest).drop(nth)


def op9_packing(spark, d) -> DataFrame:
    p = pieces(table(spark, d, "documents"))
    p = p.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(p, ["doc_id", "piece"])
