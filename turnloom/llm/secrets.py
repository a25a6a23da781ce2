"""Secret scan: fixed patterns, and sliding-window Shannon entropy per character class over candidate strings.

Candidates are maximal runs of key characters of at least ``window`` characters.  For each class (hex, base 64) that holds a part of a run, a
window slides over that part: one count goes up, one goes down, and the sum of c log2 c changes by two table look-ups, so a step costs
the same for any window.  Windows at or above the class's threshold are joined to spans.  An allow-list suppresses what only looks random:
UUIDs, version-control object names and checksums named as such, paths, sequences like the alphabet, sample values, and windows whose
letters are words (pieces of one case pattern made of common letter pairs) or that have no letters.  No count of digits is asked for.

Spans of the fixed patterns always stay; entropy adds spans of kind ``entropy`` in what the fixed ones leave of a run.

Defined cases: null text counts as empty and gives no span; repeated rows are scanned each; other columns are carried as they are.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import fresh, table, worker_cache

KINDS = ["assign", "access", "hex", "entropy"]
SPANS = "array<struct<kind:string,start:bigint,stop:bigint>>"

# Fixed patterns, on UTF-8 bytes, so that "either case" means the ASCII letters alone.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
#: Every run of at least 24; shorter runs are dropped by the rule anyway, and runs never touch.
HEX = re.compile(rb"[0-9a-f]{24,}")
#: Candidates: a run of key characters.  The minimum is the window's.
RUN = rb"[A-Za-z0-9+/_=-]{%d,}"

# Class name, characters, threshold in bits per character.
CLASSES = [
    ("hex", b"0123456789abcdefABCDEF", 2.9),
    ("base64", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 3.8),
]
# Fixed patterns of the allow-list.
ALLOWED = [
    rb"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    rb"(?i:.*(example|sample|placeholder|changeme|dummy|xxxx|redacted).*)",
    rb"(?i:.*(abcdefgh|01234567|12345678|qwerty).*)",
    rb"(/[A-Za-z_-]+){2,}/?[A-Za-z0-9_-]*",
]
#: Words before a value that say it is a checksum, not a secret.
NAMED = re.compile(rb"(?i:sha-?(1|224|256|384|512)|md5|crc32|checksum|digest|commit|etag|integrity)[\"']?\x20*[:= -]\x20*[\"']?$")

# Fixed parts of words: letters at one case, and for each letter those that often follow it in English, French, German and Spanish.
TOKEN = re.compile(rb"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
FOLLOWS = {
    "a": "bcdgilmnprstuvy", "b": "aeiloru", "c": "aehikloqtu", "d": "aeiorsu", "e": "abcdegilmnprstuvx", "f": "aefiloru", "g": "aehiru", "h": "aeiortu",
    "i": "acdefglmnoprstvxz", "j": "aou", "k": "es", "l": "adeilostuy", "m": "abeiopu", "n": "acdegiklnostuvz", "o": "cdfiklmnoprstuvw", "p": "aefilorstu",
    "q": "u", "r": "acdegikmnorstuy", "s": "acehioptsu", "t": "aehiorstuyz", "u": "acdelmnprstx", "v": "aeio", "w": "aehio", "x": "pt", "y": "e", "z": "aeu",
}
PAIRS = frozenset((a + b).encode() for a, after in FOLLOWS.items() for b in after)


@dataclass(frozen=True)
class SecretSettings:
    window: int = 24
    allow: tuple[bytes, ...] = tuple(ALLOWED)


def fixed_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind number, stop) in bytes."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= 6] if b"=" in raw or b":" in raw else []
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(raw)]
    return out


def _terms(window: int) -> list[float]:
    return [0.0] + [c * math.log2(c) for c in range(1, window + 1)]


class Words:
    """Which windows of a run are made of words.  A token of 3 letters or more is a word if 3 in 5 of its letter pairs are common."""

    def __init__(self, run: bytes):
        letters, words = bytearray(len(run)), bytearray(len(run))
        for m in TOKEN.finditer(run):
            lo, hi = m.span()
            letters[lo:hi] = b"\1" * (hi - lo)
            t = m.group().lower()
            if hi - lo >= 3 and 5 * sum(t[i : i + 2] in PAIRS for i in range(len(t) - 1)) >= 3 * (len(t) - 1):
                words[lo:hi] = letters[lo:hi]
        self.letters, self.words = [0, *accumulate(letters)], [0, *accumulate(words)]

    def __call__(self, lo: int, hi: int) -> bool:
        """7 in 10 letters are in words, or there are no letters."""
        return 10 * (self.words[hi] - self.words[lo]) >= 7 * (self.letters[hi] - self.letters[lo])


def entropy_windows(part: bytes, window: int, threshold: float, terms: list[float], plain=None) -> list[tuple[int, int]]:
    """Joined spans of the windows of ``part`` whose entropy is at least ``threshold`` and that ``plain(lo, hi)``, if given, doesn't hold for."""
    if len(part) < window:
        return []
    n, counts, total = window, [0] * 256, 0.0
    most = (math.log2(n) - threshold) * n + 1e-9  # entropy = log2 n - sum(c log2 c) / n
    spans: list[tuple[int, int]] = []
    for i, new in enumerate(part):
        c = counts[new]
        counts[new] = c + 1
        total += terms[c + 1] - terms[c]
        if i >= n:
            old = part[i - n]
            c = counts[old]
            counts[old] = c - 1
            total += terms[c - 1] - terms[c]
        if i >= n - 1 and total <= most:
            lo = i - n + 1
            if plain is not None and plain(lo, i + 1):
                continue
            if spans and lo <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((lo, i + 1))
    return spans


class Scanner:
    def __init__(self, cfg: SecretSettings = SecretSettings()):
        self.cfg = cfg
        self.run = re.compile(RUN % cfg.window)
        self.allow = [re.compile(p) for p in cfg.allow]
        # a window may hold one count above its length for a moment, before the old character leaves
        self.terms = _terms(cfg.window + 1)
        self.classes = [(re.compile(b"[" + re.escape(chars) + b"]{%d,}" % cfg.window), t) for _, chars, t in CLASSES]

    def free(self, lo: int, hi: int, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
        """The parts of a run that no fixed span covers."""
        out = []
        for a, _, b in sorted(taken):
            if a < hi and lo < b:
                out.append((lo, a))
                lo = b
        return [(a, b) for a, b in [*out, (lo, hi)] if b - a >= self.cfg.window]

    def entropy_spans(self, raw: bytes, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        out = []
        for m in self.run.finditer(raw):
            for lo, hi in self.free(*m.span(), taken):
                run = raw[lo:hi]
                if any(p.fullmatch(run) for p in self.allow) or NAMED.search(raw[max(0, lo - 24) : lo]):
                    continue
                words, found = Words(run), []
                for chars, threshold in self.classes:
                    for part in chars.finditer(run):
                        at = part.start()
                        plain = lambda a, b, at=at: words(at + a, at + b)
                        found += [(at + a, at + b) for a, b in entropy_windows(part.group(), self.cfg.window, threshold, self.terms, plain)]
                if found:
                    out.append((lo + min(a for a, _ in found), 3, lo + max(b for _, b in found)))
        return out

    def spans(self, raw: bytes | None) -> list[tuple[int, int, int]]:
        """All spans, by start and then kind, in code points."""
        if not raw:
            return []
        got = fixed_spans(raw)
        got = sorted(got + self.entropy_spans(raw, got))
        if raw.isascii():
            return got
        out, at, chars = [], 0, 0
        where: dict[int, int] = {}
        for b in sorted({p for a, _, z in got for p in (a, z)}):
            chars += len(raw[at:b].decode("utf-8", "replace"))
            at = b
            where[b] = chars
        return [(where[a], k, where[z]) for a, k, z in got]


def secret_spans(text: Column, cfg: SecretSettings = SecretSettings()) -> Column:
    """Array of (kind, start, stop) of a text column."""

    def arrow(texts: pa.Array) -> pa.Array:
        worker_cache("secrets")
        scan = Scanner(cfg)
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])
        return pa.array([[{"kind": KINDS[k], "start": a, "stop": z} for a, k, z in scan.spans(t.as_py())] for t in texts], pa.list_(kind))

    return F.arrow_udf(arrow, SPANS)(text.cast("binary"))


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]", cfg: SecretSettings = SecretSettings()) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mask``; overlapping spans become one."""

    def arrow(texts: pa.Array) -> pa.Array:
        worker_cache("secrets")
        scan, out = Scanner(cfg), []
        for t in texts:
            s = t.as_py()
            if s is not None and (spans := scan.spans(s.encode("utf-8", "surrogatepass"))):
                parts, at = [], 0
                for a, _, z in spans:
                    if a >= at:
                        parts += [s[at:a], mask]
                    at = max(at, z)
                s = "".join(parts) + s[at:]
            out.append(s)
        return pa.array(out, pa.string())

    new = F.arrow_udf(arrow, "string")(F.col(f"`{text}`"))
    return docs.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op7_secrets(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    (s,) = fresh(docs, "spans")
    found = docs.select("doc_id", secret_spans(F.col("text")).alias(s))
    of = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter(s, lambda x: x["kind"] != "entropy")
    return found.select(
        "doc_id", of("assign"), of("access"), of("hex"), F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col(s)).alias("spans"), of("entropy")
    )
