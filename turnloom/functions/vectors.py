"""Vector functions and the default text encoder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom.functions.text import word_list

EPS = 1e-9


def word_bucket(word: Column, dims: int = 64) -> Column:
    return F.conv(F.substring(F.md5(word), 1, 7), 16, 10).cast("int") % dims


def hashed_embedding(c: Column, dims: int = 64) -> Column:
    """Hashed bag of words: word counts per md5 bucket, as ``array<int>``.

    Each word becomes one character for its bucket; a count is then how much
    the string shrinks without that character.  Cost is linear in the text and
    stays in generated code, with no shuffle.
    """
    if not 1 <= dims <= 192:
        raise ValueError("hashed_embedding supports 1..192 dimensions")
    marks = F.array_join(F.transform(word_list(c), lambda w: F.char(F.lit(32) + word_bucket(w, dims))), "")

    def counts(m):
        n = F.length(m)
        return F.array(*[n - F.length(F.replace(m, F.lit(chr(32 + i)), F.lit(""))) for i in range(dims)])

    # a one-element transform binds ``marks`` so it is built once, not once per bucket
    return F.get(F.transform(F.array(marks), counts), F.lit(0))


def embed_text(c: Column, encoder: Callable[[Column], Column] | None = None, dims: int = 64) -> Column:
    """Text to vector through ``encoder`` (for example an iterator ``pandas_udf``), hashed words by default."""
    return encoder(c) if encoder is not None else hashed_embedding(c, dims)


def dot(a: Column, b: Column) -> Column:
    prods = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda s, x: s + x)


def dot_of(a: str, b: str, dims: int) -> Column:
    """Inner product of two vector columns of known length, unrolled into straight-line generated code."""
    return F.expr(" + ".join(f"{a}[{i}] * {b}[{i}]" for i in range(dims))).cast("double")


def checked_dot(a: Column, b: Column) -> Column:
    """Inner product of vectors of any width; different widths are an error, not a shorter product."""
    wrong = F.raise_error(F.concat(F.lit("vector widths differ: "), F.size(a), F.lit(" and "), F.size(b)))
    return F.when(F.size(a) == F.size(b), dot(a, b)).otherwise(wrong.cast("double"))


def norm(a: Column) -> Column:
    squares = F.transform(a, lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def score_cosine(d: Column, na: Column, nb: Column) -> Column:
    """Relevance: a tiny term in the denominator keeps zero vectors at 0."""
    return d / (na * nb + F.lit(EPS))


def dedup_cosine(d: Column, na: Column, nb: Column) -> Column:
    """Duplicate test: only an exact zero denominator is replaced."""
    den = na * nb
    return d / F.when(den == 0, F.lit(EPS)).otherwise(den)


def drift_cosine(d: Column, na: Column, nb: Column) -> Column:
    """Drift and second-tier scoring: zero vectors give 0."""
    den = na * nb
    return F.when(den == 0, F.lit(0.0)).otherwise(d / F.when(den == 0, F.lit(1.0)).otherwise(den))


def cosine(a: Column, b: Column, rule=score_cosine) -> Column:
    return rule(dot(a, b), norm(a), norm(b))


def truncate_embedding(a: Column, dims: int) -> Column:
    return F.slice(a, 1, dims)


def confidence(passes: Column) -> Column:
    """``passes`` is an array of vectors; 1 - mean per-dimension deviation / 0.1, within 0..1."""
    k = F.size(passes)
    dims = F.sequence(F.lit(0), F.size(F.get(passes, F.lit(0))) - 1)

    def deviation(i):
        xs = F.transform(passes, lambda p: F.get(p, i).cast("double"))
        mean = F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / k
        var = F.aggregate(xs, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / k
        return F.sqrt(var)

    devs = F.transform(dims, deviation)
    mean_dev = F.aggregate(devs, F.lit(0.0), lambda s, x: s + x) / F.size(devs)
    clipped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(1.0) - mean_dev / 0.1))
    return F.when(k <= 1, F.lit(1.0)).otherwise(clipped)


def confidence_margin(score: Column) -> Column:
    return F.lit(1.0) - F.least(F.abs(score - 0.5) / 0.2, F.lit(1.0))
