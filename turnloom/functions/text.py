"""Text functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom.functions import fixed as V

WORD4, GATE_WORD, DIAG_WORD, WORD, CODE_FENCE, SENTENCE_GAP = V.WORD4, V.GATE_WORD, V.DIAG_WORD, V.WORD, V.CODE_FENCE, V.SENTENCE_GAP


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def string_list(words) -> Column:
    # folds to one literal array
    return F.split(F.lit("\x01".join(words)), "\x01")


def bind(c: Column, use) -> Column:
    """Evaluate ``c`` once and hand it to ``use``, also where ``use`` names it inside a lambda."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def escape(term: str) -> str:
    """Escape a literal for a pattern that Java and RE2 both read."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", term)


# --------------------------------------------------------------- tokens, ids
def estimate_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.shiftright(F.length(text_or_empty(c)), 2))


def count_tokens(c: Column, tokenizer=None) -> Column:
    """Exact count through ``tokenizer`` (a Column function, e.g. a pandas_udf), else the estimate."""
    return tokenizer(c) if tokenizer is not None else estimate_tokens(c)


def content_key(c: Column) -> Column:
    return F.md5(c)


def fingerprint(c: Column) -> Column:
    return F.substring(F.md5(c), 1, 12)


def chunk_id(turn: Column, content: Column) -> Column:
    return fingerprint(F.concat(turn.cast("string"), F.lit(":"), content))


# ------------------------------------------------------------------- hygiene
def contraction_expand(c: Column) -> Column:
    for short, long in V.CONTRACTIONS:
        c = F.replace(c, F.lit(short), F.lit(long))
    return c


def is_hedge(c: Column) -> Column:
    t = F.lower(strip(text_or_empty(c)))
    lead = F.substring(contraction_expand(t), 1, V.REFUSAL_WINDOW)
    return (t == "") | lead.rlike("|".join(V.REFUSAL_MARKERS))


def is_injection(c: Column) -> Column:
    hit = F.lit(False)
    for p in V.INJECTION_PATTERNS:
        hit = hit | c.rlike(p)
    return hit


def sanitize_context(c: Column) -> Column:
    for p in V.INJECTION_PATTERNS:
        c = F.regexp_replace(c, p, "[neutralized]")
    c = F.replace(c, F.lit(V.DATA_OPEN), F.lit("[open-marker]"))
    c = F.replace(c, F.lit(V.DATA_CLOSE), F.lit("[close-marker]"))
    return F.concat(F.lit(V.DATA_OPEN + "\n"), c, F.lit("\n" + V.DATA_CLOSE))


def sanitize_for_storage(c: Column, max_chars: int = 4000) -> Column:
    for p, r in V.SECRET_RULES:
        c = F.regexp_replace(c, p, r)
    c = F.regexp_replace(c, V.BASE64_BLOB, V.BASE64_MARK)
    cut = F.concat(F.substring(c, 1, max_chars), F.lit(V.TRUNCATION_MARK))
    return F.when(F.length(c) > max_chars, cut).otherwise(c)


def redact_text(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, V.TOKEN_LIKE, V.REDACTED), V.LONG_HEX, V.REDACTED)


def redact_payload(m: Column) -> Column:
    """Redact a ``map<string,string>``: values under secret keys, token-like text elsewhere."""
    return F.transform_values(
        m, lambda k, v: F.when(F.lower(k).isin(V.REDACT_KEYS), F.lit(V.REDACTED)).otherwise(redact_text(v))
    )


def redact_json(c: Column) -> Column:
    """Redact scalar values under secret keys at any depth of a JSON string, then token-like text."""
    keys = "|".join(V.REDACT_KEYS)
    c = F.regexp_replace(
        c, rf'(?i)("(?:{keys})"\s*:\s*)("(?:[^"\\]|\\.)*"|[^,}}\]\s"{{\[]+)', rf'$1"{V.REDACTED}"'
    )
    return redact_text(c)


# --------------------------------------------------------------------- terms
def words4(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(WORD4), F.lit(0)))


def gate_words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(GATE_WORD), F.lit(0)))


def gate_terms(c: Column) -> Column:
    return F.array_except(gate_words(c), string_list(V.GATE_STOPWORDS))


def diagnostic_words(c: Column) -> Column:
    plain = F.lower(F.regexp_replace(text_or_empty(c), CODE_FENCE, " "))
    return F.regexp_extract_all(plain, F.lit(DIAG_WORD), F.lit(0))


def diagnostic_terms(c: Column) -> Column:
    return F.array_except(diagnostic_words(c), string_list(V.DIAGNOSTIC_STOPWORDS))


def fact_terms(query: Column, answer: Column, terms=diagnostic_terms) -> Column:
    return F.array_except(terms(answer), terms(query))


def word_list(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def term_share(part: Column, whole: Column) -> Column:
    """|part ∩ whole| / |whole|; null for an empty whole."""
    return F.when(F.size(whole) > 0, F.size(F.array_intersect(part, whole)) / F.size(whole))


def fact_hit(facts: Column, terms: Column) -> Column:
    """Share of facts present and whether all are."""
    share = F.coalesce(term_share(terms, facts), F.lit(0.0))
    full = (F.size(facts) > 0) & (F.size(F.array_except(facts, terms)) == 0)
    return F.struct(share.alias("hit_ratio"), full.alias("full"))


def half_presence(facts: Column, terms: Column) -> Column:
    need = F.greatest(F.lit(1), F.floor(F.size(facts) * 0.5))
    return (F.size(facts) > 0) & (F.size(F.array_intersect(facts, terms)) >= need)


def full_presence(facts: Column, terms: Column) -> Column:
    return F.size(F.array_except(facts, terms)) == 0


def fidelity(reply: Column, context: Column) -> Column:
    return F.coalesce(term_share(diagnostic_terms(context), diagnostic_terms(reply)), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


# ----------------------------------------------------------------- sentences
def sentence_split(c: Column) -> Column:
    return F.split(c, SENTENCE_GAP)


def diagnostic_sentences(c: Column) -> Column:
    parts = F.split(text_or_empty(c), SENTENCE_GAP + r"|\n+")
    return F.filter(parts, lambda s: strip(s) != "")


def turn_precision(query: Column, context: Column) -> Column:
    def share(x):
        # the query's terms have no stopwords, so those of a sentence need not be taken out
        hits = F.size(F.filter(x.sents, lambda s: F.arrays_overlap(diagnostic_words(s), x.q)))
        return F.when((F.size(x.q) > 0) & (F.size(x.sents) > 0), hits / F.size(x.sents))

    # once a text, not once a sentence
    return bind(F.struct(diagnostic_terms(query).alias("q"), diagnostic_sentences(context).alias("sents")), share)


def subchunk(c: Column, max_len: int = 600) -> Column:
    """Sentences merged into units of about ``max_len`` characters."""
    parts = F.filter(
        F.transform(F.split(text_or_empty(c), SENTENCE_GAP + r"|\n+"), strip), lambda p: p != ""
    )
    start = F.struct(F.array().cast("array<string>").alias("units"), F.lit("").alias("buf"))

    def step(s, p):
        full = (s.buf != "") & (F.length(s.buf) + F.length(p) > max_len)
        units = F.when(full, F.concat(s.units, F.array(s.buf))).otherwise(s.units)
        buf = F.when(full | (s.buf == ""), p).otherwise(strip(F.concat(s.buf, F.lit(" "), p)))
        return F.struct(units.alias("units"), buf.alias("buf"))

    return F.aggregate(
        parts,
        start,
        step,
        lambda s: F.when(s.buf != "", F.concat(s.units, F.array(s.buf))).otherwise(s.units),
    )


# ---------------------------------------------------------------- vocabulary
def vocabulary_terms(*names: str, tables: dict | None = None) -> list[str]:
    """Lower-cased distinct terms of the named vocabularies, longest first."""
    tables = V.VOCABULARIES if tables is None else tables
    terms: set[str] = set()
    for name in names:
        if name not in tables:
            raise FileNotFoundError(f"vocabulary not found: {name}")
        for value in tables[name].values():
            items = value if isinstance(value, (list, tuple)) else [value]
            terms.update(str(v).strip().lower() for v in items if str(v).strip())
    return sorted(terms, key=lambda t: (-len(t), t))


def vocabulary_pattern(terms: list[str]) -> str:
    """Plain alternation, longest term first."""
    return "(?i)" + "|".join(escape(t) for t in terms)


def prefix_pattern(terms: list[str]) -> str:
    """The same matches as ``vocabulary_pattern`` with shared prefixes factored out.

    One branch per next letter instead of one per term; longer continuations
    come first, so the longest term at a place still wins.
    """

    def grow(tails: list[str]) -> str:
        heads: dict[str, list[str]] = {}
        for t in tails:
            if t:
                heads.setdefault(t[0], []).append(t[1:])
        branches = [escape(h) + grow(ts) for h, ts in heads.items()]
        if not branches:
            return ""
        end = "" in tails
        if len(branches) == 1 and not end:
            return branches[0]
        return "(?:" + "|".join(branches) + (")?" if end else ")")

    return "(?i)" + grow(list(terms))


DEFAULT_VOCAB = vocabulary_terms("code", "general")


def vocab_matches(c: Column, vocab: list[str] = DEFAULT_VOCAB) -> Column:
    """Any term as a substring; plain searches are far cheaper than one big alternation."""
    return bind(F.lower(c), lambda low: F.exists(string_list(vocab), lambda t: F.contains(low, t)))


def matched_terms(c: Column, vocab: list[str] = DEFAULT_VOCAB) -> Column:
    """Distinct hits as written, longest term first at each place."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(prefix_pattern(vocab)), F.lit(0)))


def vocab_boost(c: Column, boost: float = 0.15, vocab: list[str] = DEFAULT_VOCAB) -> Column:
    return F.when(vocab_matches(c, vocab), F.lit(boost)).otherwise(F.lit(0.0))


def info_density(c: Column, vocab: list[str] = DEFAULT_VOCAB) -> Column:
    """(distinct vocabulary terms / words) x mean words per sentence."""
    n_words = F.regexp_count(c, F.lit(WORD))
    sents = sentence_split(strip(c))
    sent_words = F.aggregate(sents, F.lit(0), lambda a, s: a + F.regexp_count(s, F.lit(WORD)))
    share = F.size(matched_terms(c, vocab)) / F.greatest(n_words, F.lit(1))
    return share * (sent_words / F.greatest(F.size(sents), F.lit(1)))


def compress(c: Column, vocab: list[str] = DEFAULT_VOCAB) -> Column:
    """Drop filler until nothing changes, then keep the sentences with vocabulary terms (else all)."""

    def one_pass(acc, _):
        t = acc["now"]
        for p in V.FILLER_PATTERNS:
            t = F.regexp_replace(t, p, "")
        # once a pass has changed nothing, the rest of the sequence costs a comparison each
        return F.when(acc["now"] == acc["before"], acc).otherwise(F.struct(t.alias("now"), acc["now"].alias("before")))

    # every changing pass takes two characters or more, so this many passes reach the fixed point
    passes = F.sequence(F.lit(0), F.floor(F.length(c) / 2).cast("int") + 1)
    start = F.struct(c.alias("now"), F.lit(None).cast("string").alias("before"))
    cleaned = F.aggregate(passes, start, one_pass)["now"]
    kept = F.filter(sentence_split(cleaned), lambda s: vocab_matches(s, vocab))
    return F.when(F.size(kept) > 0, F.concat_ws(" ", kept)).otherwise(cleaned)


# --------------------------------------------------------------- predicates
def is_degenerate_query(c: Column) -> Column:
    """``how does X fit with X``, perhaps with a question mark, ends the text; X is within a line, its case is free.

    The two X are compared as slices: Java's back-reference in ``(?i)`` reads beyond a group with characters
    outside the BMP, so it finds them unequal or fails.
    """
    # character by character: lower() alone makes two of İ, and of Σ what its neighbours ask for
    line = F.lower(F.translate(F.substring_index(F.regexp_replace(c, r"\n\z", ""), "\n", -1), "İΣ", "iσ"))

    def twice(rest):
        def fits(x):
            both = F.concat(x, F.lit(" fit with "), x)
            return (x != "") & ((rest == both) | (rest == F.concat(both, F.lit("?"))))

        return bind(F.substring(rest, F.lit(1), F.shiftright(F.length(rest) - 10, 1)), fits)

    def any_twice(parts):
        n = F.size(parts)
        return F.exists(F.sequence(F.lit(1), n), lambda k: bind(F.array_join(F.slice(parts, k + 1, n), "how does "), twice))

    return bind(F.split(line, "how does "), any_twice)


def is_query_echo(query: Column, top: Column) -> Column:
    cw, qw = words4(top), words4(query)
    share = F.size(F.array_intersect(cw, qw)) / F.size(cw)
    return F.coalesce((top != query) & (F.size(cw) > 0) & (share >= 0.8), F.lit(False))


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


# ------------------------------------------------------------- judge replies
JUDGE_SCHEMA = (
    "sufficient boolean, used_pieces array<string>, missing array<string>, score int, relevant boolean"
)


def parse_judge_json(c: Column, schema: str = JUDGE_SCHEMA) -> Column:
    """Parse a judge reply: fences off, direct parse, else the outermost ``{...}``; null if neither parses."""
    t = strip(c)
    bare = F.regexp_replace(F.regexp_replace(t, V.FENCE_OPEN, ""), V.FENCE_CLOSE, "")
    t = F.when(t.startswith("```"), strip(bare)).otherwise(t)

    def parsed(x):
        ok = F.get_json_object(x, "$").startswith("{")
        return F.when(ok, F.from_json(x, schema))

    block = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    return F.coalesce(parsed(F.when(t.startswith("{"), t)), parsed(F.when(block != "", block)))


def judge_label(parsed: Column) -> Column:
    """1 relevant, 2 not relevant, 3 undecided."""
    return F.when(parsed.isNull(), 3).when(F.coalesce(parsed["relevant"], F.lit(False)), 1).otherwise(2)


def map_used_chunks(ids: Column, used: Column) -> Column:
    low = F.array_distinct(F.transform(F.coalesce(used, F.array().cast("array<string>")), F.lower))
    hit = F.transform(
        ids, lambda i: (F.size(low) == 0) | F.exists(low, lambda u: F.contains(F.lower(i), u))
    )
    return F.map_from_arrays(ids, hit)


def merge_maps(base: Column, over: Column) -> Column:
    """Overrides win, null overrides are ignored."""
    live = F.map_filter(over, lambda k, v: v.isNotNull())
    kept = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(live), k))
    return F.map_concat(kept, live)


def pad_tokens(ids: Column, length: int = 128, pad: int = 0) -> Column:
    head = F.slice(ids, 1, length)
    return F.concat(head, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(length) - F.size(head))))
