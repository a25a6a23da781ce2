"""Token counts by a compiled finite-state transducer.

The byte-fallback BPE vocabulary is turned into a deterministic transducer whose transitions carry the change of the token count.
A state holds, for every piece that could still be completed, how long ago it began and which token ended there; the last token
of a prefix is the one whose pair with the token before it is what BPE itself makes of the two (a sequence of tokens is the
BPE result exactly if each neighbouring pair is).  States are made when first reached; their number is bounded by the vocabulary, and
the table is started anew beyond ``MAX_STATES``.

No piece of such a vocabulary has a word mark after another character, so the transducer is back in a known state at each word
start.  A chunk of text is therefore a map (head, count, tail): characters before its first word start, tokens of the words between, and
the characters of its open last word.  Maps compose associatively, so the chunks of one text are reduced by a parallel prefix scan
(pairs of neighbours, log steps), and chunks of a very long text may be mapped anywhere.

Defined cases: null text counts as empty (0 bytes, 0 tokens); special strings inside a text are ordinary characters; no begin or end
tokens; repeated rows are counted each; other columns are carried as they are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import table, worker_cache

MARK = "▁"
COUNTS = "struct<n_bytes:bigint,n_tokens:bigint>"
MAX_STATES = 300_000
MAX_WORDS = 1_000_000
CHUNK = 1 << 16


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Transducer:
    """Compiled on demand from piece scores."""

    def __init__(self, pieces: dict[str, float]):
        inner = [p for p in pieces if MARK in p.lstrip(MARK)]
        if inner:
            raise ValueError(f"pieces with a word mark inside have no fixed word starts: {inner[:3]}")
        self.pieces = pieces
        self.starts = {p[:i] for p in pieces for i in range(1, len(p))}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.clear()

    @classmethod
    def load(cls, path: str) -> Transducer:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        return cls({sp.id_to_piece(i): sp.get_score(i) for i in ids})

    def clear(self) -> None:
        #: state -> {character: (next state, change of the count)}; a state is ((characters ago, last token there), ...)
        self.moves: list[dict] = []
        self.keys: list[tuple] = []
        self.index: dict[tuple, int] = {}
        self.state(((0, "", ""),))

    def state(self, key: tuple) -> int:
        if (n := self.index.get(key)) is None:
            n = self.index[key] = len(self.keys)
            self.keys.append(key)
            self.moves.append({})
        return n

    def whole(self, text: str) -> list[str]:
        """Plain BPE of a short string: the best-scored neighbours merge first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (self.pieces.get(parts[i] + parts[i + 1], -np.inf), -i))
            if parts[best] + parts[best + 1] not in self.pieces:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def fits(self, a: str, b: str) -> bool:
        if not a:
            return True
        if (ok := self.pairs.get((a, b))) is None:
            if len(self.pairs) > 4 * MAX_STATES:
                self.pairs.clear()
            ok = self.pairs[a, b] = self.whole(a + b) == [a, b]
        return ok

    def move(self, n: int, c: str) -> tuple[int, int]:
        """A transition.  Entries of a state are (text since then, token that ended there, count relative to now)."""
        entries = [(t[1] + c, t[0], t[2]) for t in self.keys[n]]
        # the token that ends here: the one start whose last token fits it; the whole of a single unknown character otherwise
        found = None
        for since, rel, last in entries:
            if (since in self.pieces or len(since) == 1) and self.fits(last, since):
                found = (since, rel + self.cost(since))
                break
        if found is None:
            raise AssertionError("every prefix has one BPE result")
        token, change = found
        key = tuple((rel - change, since, last) for since, rel, last in entries if since in self.starts)
        return self.state((*key, (0, "", token))), change

    def cost(self, token: str) -> int:
        return 1 if token in self.pieces else len(token.encode("utf-8", "surrogatepass"))

    def count(self, word: str) -> int:
        """Tokens of one word: a walk over the transitions."""
        if len(self.keys) > MAX_STATES:
            self.clear()
        moves, n, total = self.moves, 0, 0
        for c in word:
            if (to := moves[n].get(c)) is None:
                to = moves[n][c] = self.move(n, c)
            n = to[0]
            total += to[1]
        return total


class WordCounts(dict):
    """Counts of whole words met before; bounded."""

    def __init__(self, fst: Transducer):
        self.fst = fst

    def __missing__(self, word: str) -> int:
        if len(self) > MAX_WORDS:
            self.clear()
        n = self[word] = self.fst.count(word)
        return n


@dataclass
class ChunkMap:
    """What a chunk does: with no word start inside, all of it is head and tail is None."""

    head: str
    count: int
    tail: str | None


_RUNS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


def words_of(text: str) -> list[str]:
    """Pieces of marked text that BPE never joins: marks with the word after them; line feeds are bytes of their own."""
    if MARK + MARK in text or MARK + "\n" in text:
        return _RUNS.findall(text)
    # each mark begins a word; the space that was there is the place to cut
    return text.replace("\n", " \n ").replace(MARK, " " + MARK).split(" ")


def chunk_map(chunk: str, words: WordCounts) -> ChunkMap:
    """A word starts at a mark that follows no mark; a chunk's own first character is never a known start."""
    at = re.search(f"(?<=[^{MARK}]){MARK}", chunk)
    if at is None:
        return ChunkMap(chunk, 0, None)
    end = last_start(chunk)
    return ChunkMap(chunk[: at.start()], sum(map(words.__getitem__, words_of(chunk[at.start() : end]))), chunk[end:])


def last_start(chunk: str) -> int:
    """Where the last word begins: the first mark of the last run of marks that follows another character."""
    end = len(chunk)
    while (i := chunk.rfind(MARK, 0, end)) >= 0:
        start = i
        while start and chunk[start - 1] == MARK:
            start -= 1
        if start:
            return start
        end = start
    return -1


def compose(a: ChunkMap, b: ChunkMap, words: WordCounts) -> ChunkMap:
    """First a, then b.  Associative."""
    if a.tail is None and b.tail is None:
        return split_open(a.head + b.head, words)
    if a.tail is None:
        x = split_open(a.head + b.head, words)
        return ChunkMap(x.head, b.count, b.tail) if x.tail is None else ChunkMap(x.head, x.count + _total(x.tail, words) + b.count, b.tail)
    if b.tail is None:
        x = split_open(a.tail + b.head, words)
        return ChunkMap(a.head, a.count, x.head) if x.tail is None else ChunkMap(a.head, a.count + _total(x.head, words) + x.count, x.tail)
    return ChunkMap(a.head, a.count + _total(a.tail + b.head, words) + b.count, b.tail)


def split_open(text: str, words: WordCounts) -> ChunkMap:
    """The join of two open pieces may hold a start where they meet."""
    return chunk_map(text, words)


def _total(text: str, words: WordCounts) -> int:
    return sum(map(words.__getitem__, words_of(text)))


def scan(maps: list[ChunkMap], words: WordCounts) -> ChunkMap:
    """Composition of all maps of one text in log steps of neighbouring pairs."""
    while len(maps) > 1:
        maps = [compose(maps[i], maps[i + 1], words) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


def count_tokens(text: str | None, words: WordCounts, chunk: int = CHUNK) -> int:
    if not text:
        return 0
    marked = MARK + text.replace(" ", MARK)
    if len(marked) <= chunk:
        return _total(marked, words)
    m = scan([chunk_map(marked[i : i + chunk], words) for i in range(0, len(marked), chunk)], words)
    return _total(m.head, words) + m.count + (_total(m.tail, words) if m.tail else 0)


def counter(path: str) -> WordCounts:
    cache = worker_cache("tokens")
    if ("fst", path) not in cache:
        cache["fst", path] = WordCounts(Transducer.load(path))
    return cache["fst", path]


def token_counts(text: Column, model: str | None = None, chunk: int = CHUNK) -> Column:
    """Struct (n_bytes, n_tokens) of a text column."""
    model = model or default_model()

    def arrow(texts: pa.Array) -> pa.Array:
        words = counter(model)
        n_bytes, n_tokens = [], []
        for raw in texts:
            raw = raw.as_py() or b""
            n_bytes.append(len(raw))
            n_tokens.append(count_tokens(raw.decode("utf-8", "replace"), words, chunk))
        return pa.StructArray.from_arrays([pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], ["n_bytes", "n_tokens"])

    return F.arrow_udf(arrow, COUNTS)(text.cast("binary"))


def op3_token_counts(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", token_counts(F.col("text")).alias("c"))
    return docs.select("doc_id", "c.n_bytes", "c.n_tokens", (F.col("c.n_tokens") > 4096).alias("over_limit"))
