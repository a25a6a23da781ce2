"""Sampled subword segmentations without replacement, and decoding.

A text's lattice has its characters as nodes and vocabulary pieces as edges; a segmentation's weight is the product of its pieces' weights.
Log sums from each node
to the end give every edge its exact conditional probability, so a partial path's mass is known.  The search is best-first over perturbed masses: the
root has a Gumbel variable; where a node's paths are parted, the part that has the node's maximum keeps it, and the others get Gumbel variables
bounded by it.  Complete paths come out in falling order of their perturbed log-probabilities: an exact sample without replacement.

A popped set of paths runs to its end at once: at each node on the way one edge, drawn by its probability, keeps the maximum, and the paths by all other
edges stay together as one set with one variable, which is parted further only if it is popped itself.  Of the sets on the way only the largest k + 1 can
ever be popped; they are the new frontier.  So a sample takes one random number per character and one for each of the first nodes on its path, and one for all later ones.

The inclusion score of a sample with log-probability p is 1 - exp(-exp(p - t)), t being the (k+1)-th perturbed value, or 1 if there is none.
The random numbers of a row depend on its key and the seed alone.

Words are independent parts of the lattice (no piece has a word mark inside).  A word's lattice is made once and kept in a bounded store; many words' are made
together, by walking the pieces' trie from all their characters in step and summing from the words' ends in step.  A text's lattice is its words' side by side.
Every node's edge is drawn at once, for many texts and all their samples, and the paths of all words are followed in step.  A long text is searched in blocks of
words of bounded size.

Defined cases: null or empty text gives no rows; a text with fewer than k segmentations gives all; characters outside of the vocabulary are their
UTF-8 bytes; rows that repeat a key and a text give the same samples each; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import repeat, tee

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import table, worker_cache
from turnloom.llm.transducer import MARK, default_model, words_of

BLOCK_CHARS = 100_000
#: short texts whose lattices and paths are made together hold this many characters
TOGETHER_CHARS = 50_000
#: new words whose lattices are made together, and words kept, hold about this many characters
LEARN_CHARS, KEEP_CHARS = 20_000, 3_000_000
#: words still on their way are followed one by one when they are as few as this
FEW = 16
#: sets of paths that part within so many nodes get their values one by one, later ones only if one of them can count
NEAR = 64


@dataclass(frozen=True)
class SamplingSettings:
    k: int = 4
    #: exponent of the weights; larger ones prefer frequent pieces more
    alpha: float = 1.0
    seed: int = 17
    model: str | None = None


@dataclass
class Block:
    """Edges by start, longest first: characters, id, conditional log-probability, log odds of the node's other edges against it, probability up to here (above 1
    at a node's last edge); each node's first edge and number of edges; and whether a word begins there."""

    size: np.ndarray
    piece: np.ndarray
    q: np.ndarray
    odds: np.ndarray
    upto: np.ndarray
    first: np.ndarray
    count: np.ndarray
    begins: np.ndarray

    @property
    def p(self) -> np.ndarray:
        return np.exp(self.q)

    @property
    def start(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first)), self.count)

    def part(self, n0: int, n1: int) -> Block:
        """The nodes from n0 up to n1, between which words begin and end."""
        e0, e1 = int(self.first[n0]), int(self.first[n1 - 1] + self.count[n1 - 1])
        own = slice(e0, e1)
        return Block(self.size[own], self.piece[own], self.q[own], self.odds[own], self.upto[own], self.first[n0:n1] - e0, self.count[n0:n1], self.begins[n0:n1])

    def draw(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of random numbers, one a node: one edge of every node, by its probability, and which nodes are on the way from the words' beginnings."""
        k, n = u.shape
        edge = np.tile(self.first, k)
        u = u.reshape(-1)
        at = np.flatnonzero(u >= np.tile(self.upto[self.first], k))
        while len(at):
            edge[at] += 1
            at = at[u[at] >= self.upto[edge[at]]]
        go = self.size[edge]
        begins = np.append(np.tile(self.begins, k), True)
        on = begins[:-1].copy()
        at = np.flatnonzero(on)
        while len(at) > FEW:
            at += go[at]
            at = at[~begins[at]]
            on[at] = True
        stops = np.flatnonzero(begins) if len(at) else None
        for node in at.tolist():
            stop = int(stops[np.searchsorted(stops, node, side="right")])
            steps, i, way = go[node:stop].tolist(), 0, []
            while i < len(steps):
                way.append(node + i)
                i += steps[i]
            on[way] = True
        return edge.reshape(k, n), on.reshape(k, n)


class Grown:
    """An array with room for more."""

    def __init__(self, kind: type):
        self.room, self.n = np.zeros(1 << 10, kind), 0

    def add(self, new: np.ndarray) -> None:
        if self.n + len(new) > len(self.room):
            room = np.empty(max(2 * len(self.room), self.n + len(new)), self.room.dtype)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : self.n + len(new)] = new
        self.n += len(new)


class Numbers(dict):
    """Numbers of words, from 0; ``new`` are those that came last."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        n = self[word] = len(self)
        return n


class Words:
    """The lattices of words, one after the other: per word its characters, first node, edges and first edge; per node its edges; a block's columns per edge."""

    def __init__(self):
        self.number = Numbers()
        self.size, self.node, self.edges, self.edge = (Grown(np.int64) for _ in range(4))
        self.counts = Grown(np.int32)
        #: words that came in more than one block
        self.again = Grown(bool)
        self.columns = [Grown(t) for t in (np.int32, np.int32, float, float, float)]

    @property
    def chars(self) -> int:
        return self.counts.n

    def add(self, words: list[str], block: Block) -> None:
        size = np.fromiter(map(len, words), np.int64, len(words))
        at = np.cumsum(size) - size
        self.size.add(size)
        self.again.add(np.zeros(len(words), bool))
        self.node.add(at + self.counts.n)
        self.edges.add(np.add.reduceat(block.count, at))
        self.edge.add(block.first[at] + self.columns[0].n)
        self.counts.add(block.count)
        for column, new in zip(self.columns, (block.size, block.piece, block.q, block.odds, block.upto)):
            column.add(new)

    def renewed(self) -> Words:
        """The words that came again, the first of them with at most half of the characters to keep."""
        kept = np.flatnonzero(self.again.room[: self.again.n])
        kept = kept[np.cumsum(self.size.room[kept]) <= KEEP_CHARS // 2]
        out = Words()
        if len(kept):
            words = list(self.number)
            words = [words[i] for i in kept.tolist()]
            out.number.update(zip(words, range(len(words))))
            out.add(words, self.block(kept))
        return out

    def block(self, n: np.ndarray) -> Block:
        """The words of these numbers side by side."""
        size = self.size.room[n]
        count = self.counts.room[spans(self.node.room[n], size)].astype(np.int64)
        begins = np.zeros(len(count), bool)
        begins[np.cumsum(size) - size] = True
        own = spans(self.edge.room[n], self.edges.room[n])
        length, piece, *rest = (c.room[own] for c in self.columns)
        return Block(length.astype(np.int64), piece.astype(np.int64), *rest, np.cumsum(count) - count, count, begins)


def spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of ranges, one range after the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Vocabulary:
    """Pieces with weights.  A weight falls with the piece's rank as in Zipf's law: log w = -log(1 - score)."""

    def __init__(self, ids: dict[str, int], scores: dict[str, float], bytes_at: int, alpha: float = 1.0):
        self.ids, self.bytes_at, self.alpha = ids, bytes_at, alpha
        self.weights = {p: -alpha * math.log(1 - min(s, 0.0)) for p, s in scores.items()}
        self.byte_weight = min(self.weights.values(), default=0.0)
        self.text = {i: p for p, i in ids.items()}
        top = max([bytes_at + 255, *ids.values()]) + 1
        self.weight_of = np.zeros(top)
        #: UTF-8 of every id, marks as spaces
        utf8 = [b""] * top
        for p, i in ids.items():
            self.weight_of[i], utf8[i] = self.weights[p], p.replace(MARK, " ").encode("utf-8")
        for i in range(256):
            utf8[bytes_at + i] = bytes([i])
        self.utf8 = np.frombuffer(b"".join(utf8), np.uint8)
        self.utf8_size = np.fromiter(map(len, utf8), np.int64, top)
        self.utf8_first = np.cumsum(self.utf8_size) - self.utf8_size
        self.words = Words()
        # a trie of the pieces: the first step by a table of code points, later ones by sorted (state, code point)
        steps: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for p, i in ids.items():
            at = 0
            for ch in p:
                at = steps.setdefault((at, ord(ch)), len(steps) + 1)
            ends[at] = i
        self.piece_at = np.full(len(steps) + 1, -1, np.int64)
        self.piece_at[list(ends)] = list(ends.values())
        self.root = np.zeros(0x110000, np.int32)
        inner = sorted((f * 0x200000 + c, t) for (f, c), t in steps.items() if f)
        for (f, c), t in steps.items():
            if not f:
                self.root[c] = t
        self.step_keys = np.array([k for k, _ in inner] + [1 << 62], np.int64)
        self.step_to = np.array([t for _, t in inner] + [0], np.int64)

    @classmethod
    def load(cls, path: str, alpha: float) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        own = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        return cls({sp.id_to_piece(i): i for i in own}, {sp.id_to_piece(i): sp.get_score(i) for i in own}, sp.piece_to_id("<0x00>"), alpha)

    def edges(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """(start, end, id, log weight) of all edges of words laid side by side, and each node's end of word.  By start, longest first."""
        text = "".join(words)
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        n = len(chars)
        size = np.fromiter(map(len, words), np.int64, len(words))
        stop = np.repeat(np.cumsum(size), size)
        at, state, length = np.arange(n), self.root[chars].astype(np.int64), 1
        starts, ids = [], []
        known = np.zeros(n, bool)
        while True:
            live = state > 0
            at, state = at[live], state[live]
            if not len(at):
                break
            hit = self.piece_at[state] >= 0
            if length == 1:
                known[at[hit]] = True
            starts.append(at[hit])
            ids.append(self.piece_at[state[hit]])
            more = at + length < stop[at]
            at, state = at[more], state[more]
            key = state * 0x200000 + chars[at + length]
            i = np.searchsorted(self.step_keys, key)
            state = np.where(self.step_keys[i] == key, self.step_to[i], 0)
            length += 1
        # an unknown character's id is its byte's, or -1 - its code point
        odd = np.flatnonzero(~known)
        c = chars[odd]
        starts.append(odd)
        ids.append(np.where(c < 0x80, self.bytes_at + c, -1 - c))
        longest = len(starts) - 1
        # each length has a start once, so edges find their places by counting
        count = np.zeros(n, np.int64)
        for x in starts:
            count[x] += 1
        free = np.cumsum(count) - count
        place = free[odd]
        piece, length = np.empty(int(count.sum()), np.int64), np.ones(int(count.sum()), np.int64)
        for size in range(longest, 0, -1):
            x = starts[size - 1]
            at = free[x]
            piece[at], length[at] = ids[size - 1], size
            free[x] += 1
        piece[place] = ids[-1]
        weight = self.weight_of[np.maximum(piece, 0)]
        weight[place] = self.byte_weight * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))
        a = np.repeat(np.arange(n), count)
        return a, a + length, piece, weight, stop

    def block(self, words: list[str]) -> Block:
        """The lattice of words laid side by side, with conditional probabilities."""
        if self.words.chars > KEEP_CHARS:
            self.words = self.words.renewed()
        known = self.words.number
        before = len(known)
        n = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        self.words.again.room[n[n < before]] = True
        some, size = [], 0
        for w in known.new:
            some.append(w)
            size += len(w)
            if size > LEARN_CHARS:
                self.words.add(some, self.made(some))
                some, size = [], 0
        if some:
            self.words.add(some, self.made(some))
        known.new = []
        return self.words.block(n)

    def made(self, words: list[str]) -> Block:
        """The lattice of words, from their pieces."""
        a, b, piece, weight, stop = self.edges(words)
        n = len(stop)
        count = np.bincount(a, minlength=n)
        first = np.cumsum(count) - count
        b_in = np.where(b < np.repeat(stop, count), b, n)  # the last node is that of all words' ends
        # sums from the words' ends: all nodes with as many characters to go at once
        to_go = stop - np.arange(n)
        nodes = np.argsort(to_go.astype(np.uint16) if to_go.max() < 0x10000 else to_go, kind="stable")
        sizes = count[nodes]
        offset = np.cumsum(sizes) - sizes
        edge = spans(first[nodes], sizes)
        w, to = weight[edge], b_in[edge]
        bounds = np.flatnonzero(np.diff(to_go[nodes], prepend=-1, append=-1)).tolist()
        to_end = np.zeros(n + 1)
        for lo, hi in zip(bounds, bounds[1:]):
            e0, e1 = int(offset[lo]), int(offset[hi - 1] + sizes[hi - 1])
            v = w[e0:e1] + to_end[to[e0:e1]]
            at = offset[lo:hi] - e0
            top = np.maximum.reduceat(v, at)
            v -= np.repeat(top, sizes[lo:hi])
            to_end[nodes[lo:hi]] = top + np.log(np.add.reduceat(np.exp(v, out=v), at))
        q = weight + to_end[b_in] - np.repeat(to_end[:n], count)
        p = np.exp(q)
        total = np.add.reduceat(p, first)
        each = np.repeat(total, count)
        # the mass of a node's other edges; beside an edge with most of the mass they are added up by themselves, as a difference would lose them
        most = p > 0.5 * each
        small = np.add.reduceat(np.where(most, 0.0, p), first)
        with np.errstate(divide="ignore"):
            rest = np.log(np.where(most, np.repeat(small, count), each - p))
        rest[first[count == 1]] = -np.inf
        # probabilities added up within each node, edge after edge
        upto = p / each
        several, r = np.flatnonzero(count > 1), 1
        while len(several):
            e = first[several] + r
            upto[e] += upto[e - 1]
            r += 1
            several = several[count[several] > r]
        upto[first + count - 1] = 2.0
        begins = np.append(True, to_go[:-1] == 1)
        return Block(b - a, piece, q, rest - q, upto, first, count, begins)

    def lattice(self, word: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, id, conditional log-probability) of all edges, by start.  An unknown character's id is its byte's, or -1 - its code point."""
        x = self.block([word])
        return x.start, x.start + x.size, x.piece, x.q

    def expand(self, pieces: np.ndarray) -> np.ndarray:
        """Ids with unknown characters as bytes."""
        odd = np.flatnonzero(pieces < 0)
        if not len(odd):
            return pieces
        c = -1 - pieces[odd]
        raw = c.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace")
        size = np.ones(len(pieces), np.int64)
        size[odd] += np.where((c >= 0xD800) & (c < 0xE000), 0, (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF))
        out = np.repeat(pieces, size)
        out[out < 0] = self.bytes_at + np.frombuffer(raw, np.uint8).astype(np.int64)
        return out

    def decode_utf8(self, *ids: np.ndarray) -> bytes | list[bytes]:
        """The text of a whole segmentation in UTF-8, or a list of several's."""
        every = np.concatenate(ids) if len(ids) > 1 else ids[0]
        size = self.utf8_size[every]
        raw = self.utf8[spans(self.utf8_first[every], size)].tobytes()
        if len(ids) == 1:
            return raw.removeprefix(b" ")
        cuts = [0, *np.add.reduceat(size, np.cumsum([0, *map(len, ids[:-1])])).cumsum().tolist()]
        return [raw[a:b].removeprefix(b" ") for a, b in zip(cuts, cuts[1:])]

    def decode(self, ids: list[int]) -> str:
        """The text of a sequence of ids; byte pieces are joined, the mark that begins every text is dropped."""
        parts, raw = [], bytearray()
        for i in ids:
            if self.bytes_at <= i < self.bytes_at + 256:
                raw.append(i - self.bytes_at)
                continue
            if raw:
                parts.append(raw.decode("utf-8", "replace"))
                raw.clear()
            parts.append(self.text[i])
        if raw:
            parts.append(raw.decode("utf-8", "replace"))
        text = "".join(parts)
        return text.removeprefix(MARK).replace(MARK, " ")


@dataclass
class Lattices:
    vocabulary: Vocabulary


class TextLattice:
    """Blocks of words; a block's lattice is made when the search enters it."""

    def __init__(self, text: str, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.chars = len(text) + 1
        words = list(filter(None, words_of(MARK + text.replace(" ", MARK))))
        self.blocks: list[list[str]] = [[]]
        size = 0
        if len(text) < BLOCK_CHARS:
            self.blocks, words = [words], []
        for w in words:
            # a single giant word is a block of its own
            if size and size + len(w) > BLOCK_CHARS:
                self.blocks.append([])
                size = 0
            self.blocks[-1].append(w)
            size += len(w)
        self._kept: tuple[int, Block] | None = None
        #: the samples' paths drawn beforehand, if the text is one block
        self.drawn: list[Way] | None = None

    def block(self, n: int) -> Block:
        if self._kept is None or self._kept[0] != n:
            self._kept = None
            self._kept = n, self.vocabulary.block(self.blocks[n])
        return self._kept[1]

    def way(self, n: int, at: int, sample: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The edges drawn for a sample in a block, from a node to the end, with their ids and log-probabilities."""
        x = self.block(n)
        if self.drawn is not None:
            way = self.drawn[sample]
        else:
            edge, on = (y[0] for y in x.draw(rng.random((1, len(x.first)))))
            nodes = np.flatnonzero(on)
            way = Way(edge, nodes, own := edge[nodes], x.piece[own], x.q[own])
        if not at:
            return way.edges, way.piece, way.q
        odd = []  # edges of the word that ``at`` is within
        while at < len(way.drawn) and not x.begins[at]:
            odd.append(int(way.drawn[at]))
            at += int(x.size[odd[-1]])
        i = int(way.nodes.searchsorted(at))
        tail = way.edges[i:], way.piece[i:], way.q[i:]
        return tuple(np.concatenate([c[odd] if c is not None else odd, y]) for c, y in zip((None, x.piece, x.q), tail)) if odd else tail


@dataclass
class Way:
    """A drawn edge per node; and of the nodes on the path of all words: number, edge, id, log-probability."""

    drawn: np.ndarray
    nodes: np.ndarray
    edges: np.ndarray
    piece: np.ndarray
    q: np.ndarray


def text_lattices(texts: Iterable[str | None], vocabulary: Vocabulary, rngs: Iterable[np.random.Generator] | None = None,
                  k: int = 0) -> Iterator[TextLattice | None]:
    """A lattice per text, null for empty ones; short texts' are made together, TOGETHER_CHARS characters at a time.

    With a generator for each text, the edges of k samples are drawn as well.
    """
    waiting: list[tuple[TextLattice | None, np.random.Generator | None]] = []
    size = 0

    def ready():
        one = [(x, rng) for x, rng in waiting if x is not None and len(x.blocks) == 1]
        if one:
            block = vocabulary.block([w for x, _ in one for w in x.blocks[0]])
            ends = np.cumsum([x.chars for x, _ in one]).tolist()
            u = np.empty((k, ends[-1]))
            if k:
                for (_, rng), n0, n1 in zip(one, [0, *ends], ends):
                    for row in u:
                        rng.random(out=row[n0:n1])
                edge, on = block.draw(u)
                rows = [np.flatnonzero(y) for y in on]
                ways = [(e, at, own := e[at], block.piece[own], block.q[own], at.searchsorted([0, *ends]).tolist()) for e, at in zip(edge, rows)]
            for i, ((x, _), n0, n1) in enumerate(zip(one, [0, *ends], ends)):
                x._kept = 0, block.part(n0, n1)
                if k:
                    e0, part = block.first[n0], lambda c, cut: c[cut[i] : cut[i + 1]]  # noqa: B023
                    x.drawn = [Way(e[n0:n1] - e0, part(at, cut) - n0, part(own, cut) - e0, part(y, cut), part(q, cut)) for e, at, own, y, q, cut in ways]
        yield from (x for x, _ in waiting)

    for text, rng in zip(texts, repeat(None) if rngs is None else rngs):
        if text and size + len(text) > TOGETHER_CHARS:
            yield from ready()
            waiting, size = [], 0
        waiting.append((TextLattice(text, vocabulary) if text else None, rng))
        size += len(text or "")
    yield from ready()


def below(mass: np.ndarray, bound: float, rng: np.random.Generator) -> np.ndarray:
    """Gumbel variables of log masses, each on condition that it is not above ``bound``."""
    return mass - np.logaddexp(mass - bound, np.log(rng.standard_exponential(len(mass))))


def one_below(mass: float, bound: float, rng: np.random.Generator) -> float:
    """As ``below``, of one log mass."""
    a, b = mass - bound, math.log(max(rng.standard_exponential(), 1e-300))
    return mass - max(a, b) - math.log1p(math.exp(-abs(a - b)))


def parted(x: Block, tail: np.ndarray, q: np.ndarray, logp: float, bound: float, k: int, rng: np.random.Generator) -> tuple[list[tuple[float, float, int]], float]:
    """Of the sets that part from a path, those of the k largest perturbed values: value, log-probability up to there, place on the path.  And the
    log-probability of the whole path.

    Those after the first NEAR places have one maximum, which is drawn first; only if it can be one of the k does it go to one of them, and bounds the others.
    """
    if not len(tail):
        return [], logp
    way = q.cumsum() + logp

    def best(v: np.ndarray, first: int) -> list[tuple[float, float, int]]:
        top = v.argsort()[-k:].tolist()
        return [(float(v[i]), float(way[first + i - 1]) if first + i else logp, first + i) for i in top if v[i] > -math.inf]

    end = float(way[-1])
    near = best(below(way[:NEAR] + x.odds[tail[:NEAR]], bound, rng), 0)
    if len(tail) <= NEAR:
        return near, end
    mass, far = None, float(way[NEAR - 1])
    if end - far > -40:  # else the path itself is no part of the mass that can be told
        mass = way[NEAR:] + x.odds[tail[NEAR:]]
        top = float(mass.max())
        if top == -math.inf:
            return near, end
        far = top + math.log(np.exp(mass - top).sum())
    most = one_below(far, bound, rng)
    if len(near) == k and most < min(near)[0]:
        return near, end
    if mass is None:
        mass = way[NEAR:] + x.odds[tail[NEAR:]]
    p = np.cumsum(np.exp(mass - mass.max()))
    v = below(mass, most, rng)
    v[min(int(np.searchsorted(p, rng.random() * p[-1], side="right")), len(p) - 1)] = most
    return near + best(v, NEAR), end


@dataclass
class Paths:
    """A set of paths not yet parted: those of sample ``parent`` up to the end of ``kept`` edges of a block, with no edge of ``used`` there."""

    value: float
    #: log-probability of the way to the node
    before: float
    parent: int
    block: int
    kept: int
    used: tuple[int, ...]


def search(lat: TextLattice | None, k: int, rng: np.random.Generator) -> tuple[list[tuple[np.ndarray, float, float]], float]:
    """At most k distinct (ids, log-probability, perturbed log-probability), in falling order of the third, and the next perturbed value."""
    if lat is None:
        return [], -math.inf
    samples: list[list[tuple[np.ndarray, np.ndarray]]] = []  # per sample and block: edges and their ids
    frontier = [Paths(float(rng.gumbel()), 0.0, -1, 0, 0, ())]
    out = []
    while frontier and len(out) < k:
        top = frontier.pop(0)
        new = samples[top.parent][: top.block] if top.used else []
        logp, me = top.before, len(samples)
        for n in range(top.block, len(lat.blocks)):
            x = lat.block(n)
            at, begun = 0, 0
            if n == top.block and top.used:
                # one of the edges left at the node keeps the value, the others stay together
                head = samples[top.parent][n][0][: top.kept]
                node = int(x.size[head].sum())
                lo = int(x.first[node])
                left = [e for e in range(lo, lo + int(x.count[node])) if e not in top.used]
                p = [math.exp(q) for q in x.q[left].tolist()]
                u, i = rng.random() * sum(p), 0
                while i < len(p) - 1 and u >= p[i]:
                    u -= p[i]
                    i += 1
                edge, others = left[i], sum(p[:i]) + sum(p[i + 1 :])
                if others > 0:
                    frontier.append(Paths(one_below(logp + math.log(others), top.value, rng), logp, me, n, top.kept, (*top.used, edge)))
                at, logp, begun = node + int(x.size[edge]), logp + float(x.q[edge]), top.kept + 1
            tail, ids, q = lat.way(n, at, me, rng)
            sets, logp = parted(x, tail, q, logp, top.value, k + 1, rng)
            frontier += [Paths(v, before, me, n, begun + j, (int(tail[j]),)) for v, before, j in sets]
            if begun:
                tail, ids = np.concatenate([head, [edge], tail]), np.concatenate([samples[top.parent][n][1][: top.kept], x.piece[[edge]], ids])
            new.append((tail, ids))
        samples.append(new)
        frontier = sorted(frontier, key=lambda f: -f.value)[: k + 1]
        ids = new[0][1] if len(new) == 1 else np.concatenate([y for _, y in new])
        out.append((lat.vocabulary.expand(ids), logp, top.value))
    return out, max((f.value for f in frontier), default=-math.inf)


def sample(text: str, k: int, rng: np.random.Generator, lattices: Lattices) -> list[tuple[list[int], float, float, float]]:
    """At most k distinct (ids, log-probability, perturbed log-probability, inclusion score), in falling order of the third."""
    out, next_value = search(TextLattice(text, lattices.vocabulary) if text else None, k, rng)
    score = lambda p: 1.0 if next_value == -math.inf else -math.expm1(-math.exp(min(p - next_value, 700.0)))
    return [(i.tolist(), p, g, score(p)) for i, p, g in out]


def log_inclusion(p: float, next_value: float) -> float:
    """Logarithm of the inclusion score, which itself is below the smallest number for a text of some hundred tokens."""
    if next_value == -math.inf:
        return 0.0
    x = p - next_value
    return x if x < -36 else math.log(-math.expm1(-math.exp(min(x, 700.0))))


def lattices(path: str, alpha: float) -> Lattices:
    cache = worker_cache("segmentation")
    if ("lattices", path, alpha) not in cache:
        cache["lattices", path, alpha] = Lattices(Vocabulary.load(path, alpha))
    return cache["lattices", path, alpha]


SAMPLES = "array<struct<ids:array<int>,log_prob:double,perturbed:double,inclusion:double>>"


def sampled(text: Column, key: Column, cfg: SamplingSettings = SamplingSettings()) -> Column:
    """Array of samples of a text column; ``key``: a long column that seeds the row."""
    model = cfg.model or default_model()

    def arrow(texts: pa.Array, keys: pa.Array) -> pa.Array:
        lat, rows = lattices(model, cfg.alpha), []
        for t, k in zip(texts.to_pylist(), keys.to_pylist()):
            rng = np.random.Generator(np.random.PCG64([cfg.seed, (k or 0) & 0xFFFFFFFFFFFFFFFF]))
            rows.append([{"ids": i, "log_prob": p, "perturbed": g, "inclusion": s} for i, p, g, s in sample(t or "", cfg.k, rng, lat)])
        one = pa.struct([("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64())])
        return pa.array(rows, pa.list_(one))

    return F.arrow_udf(arrow, SAMPLES)(text, key.cast("long"))


def decoded(ids: Column, cfg: SamplingSettings = SamplingSettings()) -> Column:
    """The text of an array of ids."""
    model = cfg.model or default_model()

    def arrow(values: pa.Array) -> pa.Array:
        v = lattices(model, cfg.alpha).vocabulary
        return pa.array([None if i is None else v.decode(i) for i in values.to_pylist()], pa.string())

    return F.arrow_udf(arrow, "string")(ids)


def segmentations(rows: DataFrame, keys: list[str], text: str = "text", cfg: SamplingSettings = SamplingSettings()) -> DataFrame:
    """keys, sample (from 1), ids, log_prob, perturbed, inclusion."""
    seed = F.xxhash64(*[F.col(f"`{k}`") for k in keys])
    x = rows.select(*[F.col(f"`{k}`").alias(k) for k in keys], F.posexplode(sampled(F.col(f"`{text}`"), seed, cfg)).alias("pos_", "s_"))
    return x.select(*keys, (F.col("pos_") + 1).alias("sample"), "s_.ids", "s_.log_prob", "s_.perturbed", "s_.inclusion")


DIGESTS = "array<struct<n_tokens:bigint,ids_sha256:string,log_prob:double,perturbed:double,log_inclusion:double,decoded_sha256:string>>"


def digested(text: Column, key: Column, cfg: SamplingSettings = SamplingSettings()) -> Column:
    """As ``sampled``, with digests of the ids (as little-endian 32-bit numbers) and of the text that they decode to, which stay in the worker."""
    model = cfg.model or default_model()

    def arrow(texts: pa.Array, keys: pa.Array) -> pa.Array:
        lat, rows = lattices(model, cfg.alpha), []
        rngs, again = tee(np.random.Generator(np.random.PCG64([cfg.seed, (k.as_py() or 0) & 0xFFFFFFFFFFFFFFFF])) for k in keys)
        for x, rng in zip(text_lattices((t.as_py() for t in texts), lat.vocabulary, rngs, cfg.k), again):
            row = []
            out, next_value = search(x, cfg.k, rng)
            backs = lat.vocabulary.decode_utf8(*[ids for ids, _, _ in out]) if len(out) > 1 else [lat.vocabulary.decode_utf8(ids) for ids, _, _ in out]
            for (ids, p, g), back in zip(out, backs):
                row.append({"n_tokens": len(ids), "ids_sha256": sha256(ids.astype("<i4").tobytes()).hexdigest(), "log_prob": p, "perturbed": g,
                            "log_inclusion": log_inclusion(p, next_value), "decoded_sha256": sha256(back).hexdigest()})
            rows.append(row)
        one = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("log_prob", pa.float64()), ("perturbed", pa.float64()),
                         ("log_inclusion", pa.float64()), ("decoded_sha256", pa.string())])
        return pa.array(rows, pa.list_(one))

    return F.arrow_udf(arrow, DIGESTS)(text, key.cast("long"))


def op5_segmentations(spark, d) -> DataFrame:
    """Samples of every whole document: numbers of tokens, log-probabilities, and digests of the ids and of the text that they decode to."""
    docs = table(spark, d, "documents")
    x = docs.select("doc_id", F.posexplode(digested(F.col("text"), F.xxhash64("doc_id"))).alias("pos_", "s_"))
    return x.select("doc_id", (F.col("pos_") + 1).alias("sample"), "s_.*")
