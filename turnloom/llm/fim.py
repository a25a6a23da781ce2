"""Fill-in-middle arrangement of documents as piece tables.

A document is a list of descriptors (buffer, start, stop) over two immutable buffers: its bytes and the sentinels.  Cutting splits a descriptor, an
arrangement puts sentinels between the parts and permutes them, and the inverse permutation restores the document.  Text is copied
once, when an output is asked for; hashes take the descriptors one by one.

Cuts lie between tokens ``[A-Za-z]+|[^A-Za-z]``.  Their places and the form come from a hash of the document's key, so a
rerun gives the same.  Token starts are found in pieces of bounded size, so memory beside the text doesn't grow with it.

Defined cases: null text counts as empty; an empty text, and one that holds a sentinel, stays plain, so an output can always be restored; a null key
hashes as an empty string; rows that repeat a key are cut by the same draw; bytes that are no characters belong to the character before; an output
that doesn't have the sentinels of its form restores to null; other columns are carried as they are.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import fresh, table

PIECE = 1 << 20  # bytes scanned for token starts at once


@dataclass(frozen=True)
class FimSettings:
    seed: str = "1"
    #: sentinels of prefix, suffix and middle
    sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>")
    plain_percent: int = 10
    #: of the others, how many have the suffix first
    spm_percent: int = 20


#: Order of (prefix, suffix, middle) as numbers of parts of the document: 0 prefix, 1 middle, 2 suffix.
ORDERS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
TEXT, MARKS = 0, 1


@dataclass
class PieceTable:
    """Descriptors over the text and the sentinels; both buffers stay as they are."""

    text: bytes
    marks: bytes
    rows: list[tuple[int, int, int]] = field(default_factory=list)

    @classmethod
    def of(cls, text: bytes, marks: bytes = b"") -> PieceTable:
        return cls(text, marks, [(TEXT, 0, len(text))])

    def cut(self, at: int) -> None:
        """Split the descriptor of the text that ``at`` lies in.  At an end it gives an empty descriptor, as an empty part is a part."""
        for i, (buffer, start, stop) in enumerate(self.rows):
            if buffer == TEXT and start <= at <= stop and (at < stop or i + 1 == len(self.rows)):
                self.rows[i : i + 1] = [(TEXT, start, at), (TEXT, at, stop)]
                return
        raise IndexError(at)

    def arrange(self, order: tuple[int, ...], sentinels: list[tuple[int, int]] | None = None) -> None:
        """Permute the descriptors; with sentinels, one (start, stop in their buffer) goes before each."""
        rows = [self.rows[i] for i in order]
        self.rows = rows if sentinels is None else [r for s, row in zip(sentinels, rows) for r in ((MARKS, *s), row)]

    def restore(self, order: tuple[int, ...]) -> None:
        """Drop the sentinels and undo ``order``."""
        rows = [r for r in self.rows if r[0] == TEXT]
        self.rows = [rows[order.index(i)] for i in range(len(order))]

    def views(self):
        buffers = (memoryview(self.text), memoryview(self.marks))
        return (buffers[b][i:j] for b, i, j in self.rows)

    def digest(self) -> str:
        h = sha256()
        for v in self.views():
            h.update(v)
        return h.hexdigest()

    def output(self) -> bytes:
        return b"".join(self.views())


def _starts(x: np.ndarray, letter_before: bool) -> np.ndarray:
    """Where tokens begin: at each character but a letter after a letter."""
    letter = ((x | 32) - np.uint8(97)) < 26
    after = np.empty(len(x), bool)
    after[:1], after[1:] = letter_before, letter[:-1]
    return ((x & 0xC0) != 0x80) & ~(letter & after)


class TokenStarts:
    """Number of tokens of a text and the byte where the k-th begins; one count per piece is kept."""

    def __init__(self, text: bytes):
        self.x = np.frombuffer(text, np.uint8)
        counts = [int(np.count_nonzero(self._piece(lo))) for lo in range(0, len(self.x), PIECE)]
        self.upto = np.cumsum([0, *counts])
        self.n = int(self.upto[-1])

    def _piece(self, lo: int) -> np.ndarray:
        before = lo > 0 and chr(self.x[lo - 1]).isascii() and chr(self.x[lo - 1]).isalpha()
        return _starts(self.x[lo : lo + PIECE], before)

    def place(self, k: int) -> int:
        if k >= self.n:
            return len(self.x)
        if k == 0:
            return 0
        i = int(np.searchsorted(self.upto, k, "right")) - 1
        return i * PIECE + int(np.flatnonzero(self._piece(i * PIECE))[k - self.upto[i]])


def characters(text: bytes, start: int, stop: int) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8)[start:stop] & 0xC0) != 0x80))


def draws(key: int | None, seed: str) -> list[int]:
    h = sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def arranged(text: bytes, key: int | None, cfg: FimSettings) -> tuple[PieceTable, int, str, int | None, int | None]:
    """(piece table in output order, number of tokens, form, characters of prefix and middle)."""
    marks = [s.encode() for s in cfg.sentinels]
    t = PieceTable.of(text, b"".join(marks))
    tokens = TokenStarts(text)
    h1, h2, h3, h4 = draws(key, cfg.seed)
    if not text or any(m in text for m in marks) or h3 % 100 >= 100 - cfg.plain_percent:
        return t, tokens.n, "plain", None, None
    form = "spm" if h4 % 100 < cfg.spm_percent else "psm"
    a, b = (tokens.place(k) for k in sorted((h1 % (tokens.n + 1), h2 % (tokens.n + 1))))
    t.cut(a)
    t.cut(b)
    ends = np.cumsum([0, *map(len, marks)]).tolist()
    prefix, suffix, middle = zip(ends, ends[1:])
    t.arrange(ORDERS[form], [{0: prefix, 1: middle, 2: suffix}[i] for i in ORDERS[form]])
    return t, tokens.n, form, characters(text, 0, a), characters(text, a, b)


def restored(output: bytes, form: str, cfg: FimSettings) -> PieceTable | None:
    """The piece table of the document that ``output`` came from, over the output's own bytes."""
    if form == "plain":
        return PieceTable.of(output)
    if form not in ORDERS:
        return None
    prefix, suffix, middle = (s.encode() for s in cfg.sentinels)
    rows, at = [], 0
    found = []
    for mark in ({0: prefix, 1: middle, 2: suffix}[i] for i in ORDERS[form]):
        at = output.find(mark, at)
        if at < 0:
            return None
        found.append((at, at + len(mark)))
        at += len(mark)
    if found[0][0]:
        return None
    for (_, start), (stop, _) in zip(found, [*found[1:], (len(output), 0)]):
        rows.append((TEXT, start, stop))
    t = PieceTable(output, b"", rows)
    t.restore(ORDERS[form])
    return t


ARRANGED = "struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:binary,sha256:string>"


def fim(docs: DataFrame, key: str = "doc_id", text: str = "text", cfg: FimSettings = FimSettings()) -> tuple[DataFrame, str]:
    """``docs`` and a struct column (its name is returned): tokens, form, characters of prefix and middle, output, the output's hash."""
    (out,) = fresh(docs, "fim")

    def arrow(keys: pa.Array, texts: pa.Array) -> pa.Array:
        cols = [[] for _ in range(6)]
        for k, t in zip(keys, texts):
            table_, *facts = arranged(t.as_py() or b"", k.as_py(), cfg)
            for c, v in zip(cols, (*facts, table_.output(), table_.digest())):
                c.append(v)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["n", "form", "prefix_chars", "middle_chars", "output", "sha256"])

    done = F.arrow_udf(arrow, ARRANGED)(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`").cast("binary"))
    # once per row, though several of its fields are asked for
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns], done.alias(out)), out


def unfim(output: Column, form: Column, cfg: FimSettings = FimSettings()) -> Column:
    """Struct (text, sha256) of the document that an output was made from."""

    def arrow(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        texts, hashes = [], []
        for o, f in zip(outputs, forms):
            t = restored(o.as_py() or b"", f.as_py(), cfg)
            texts.append(None if t is None else t.output())
            hashes.append(None if t is None else t.digest())
        return pa.StructArray.from_arrays([pa.array(texts, pa.binary()), pa.array(hashes, pa.string())], ["text", "sha256"])

    return F.arrow_udf(arrow, "struct<text:binary,sha256:string>")(output.cast("binary"), form)


def op12_fim(spark, d) -> DataFrame:
    docs, out = fim(table(spark, d, "documents").select("doc_id", "text"))
    done = docs.select("doc_id", F.col(f"{out}.*")).withColumn("back", unfim(F.col("output"), F.col("form")))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.col("sha256").alias("output_sha256"), F.col("back.sha256").alias("restored_sha256"))


#: Tokens as a list; the parts are joined slices of it.
OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM d),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM p
"""
