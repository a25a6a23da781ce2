"""Routing, topics and query patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom.functions import fixed as V
from turnloom.functions import text as T


def _safe(pattern: str) -> str:
    # a dot that never matches a line feed, for Java and RE2 alike
    return pattern.replace(".+", r"[^\n]+")


def code_blocks(query: Column) -> Column:
    gone = F.replace(query, F.lit("```"), F.lit(""))
    return ((F.length(query) - F.length(gone)) / 3).cast("int")


def route(query: Column, depth: Column | None = None) -> Column:
    """struct(route_to, confidence, reason, score) of a query seen after ``depth`` earlier turns."""
    q = F.lower(query)
    depth = F.lit(0) if depth is None else depth
    blocks = code_blocks(query)
    # plain columns over one lower-cased text, which Spark makes once
    signals = [(q.contains(k), 1, F.lit(f"keyword:{k}")) for k in V.ROUTE_KEYWORDS]
    signals += [(q.rlike(_safe(p)), 1, F.lit(f"pattern:{p}")) for p in V.ROUTE_PATTERNS]
    signals += [
        (blocks >= 3, 2, F.concat(F.lit("code_density:"), blocks.cast("string"))),
        (F.length(query) > 500, 1, F.concat(F.lit("length:"), F.length(query).cast("string"))),
        (depth > 30, 1, F.concat(F.lit("depth:"), depth.cast("string"))),
    ]
    score = sum((F.when(hit, F.lit(w)).otherwise(F.lit(0)) for hit, w, _ in signals), F.lit(0))
    reasons = F.concat_ws(",", *[F.when(hit, why) for hit, _, why in signals])
    return F.struct(
        route_for(score).alias("route_to"),
        F.when(score >= 3, 0.8).when(score >= 2, 0.7).otherwise(0.9).alias("confidence"),
        F.coalesce(F.nullif(reasons, F.lit("")), F.lit("default")).alias("reason"),
        score.alias("score"),
    )


def route_for(score: Column, threshold: Column | int = 2) -> Column:
    return F.when(score >= 3, "escalation").when(score >= threshold, "medium").otherwise("ultra_small")


def router_score(reason: Column) -> Column:
    return F.when(T.text_or_empty(reason) == "", 0).otherwise(F.size(F.split(reason, ",")))


FEATURES = [
    "message_length", "keyword_density", "code_block_count",
    "conversation_depth", "avg_chunk_age", "topic_drift_score",
]


def route_features(query: Column, depth: Column, avg_age: Column, drift: Column) -> list[Column]:
    """The six router features, named as in ``FEATURES``."""
    q = F.lower(query)
    hits = sum((q.contains(k).cast("int") for k in V.ROUTE_KEYWORDS), F.lit(0))
    n_words = F.size(F.filter(F.split(q, r"\s+"), lambda w: w != ""))
    values = [
        F.length(query), hits / F.greatest(n_words, F.lit(1)), code_blocks(query), depth, avg_age, drift,
    ]
    return [v.cast("double").alias(n) for v, n in zip(values, FEATURES)]


def topic_weights(topics: dict) -> dict[str, list[tuple[str, int]]]:
    """Terms with weights per topic; an aspect that is also a decision key counts twice."""
    out = {}
    for name, t in topics.items():
        decisions = t.get("decisions", {})
        aspects = t.get("aspects", list(decisions))
        words = t["feature"].split() + list(aspects) + list(decisions) + list(decisions.values())
        terms: dict[str, int] = {}
        for w in words:
            terms[w.lower()] = terms.get(w.lower(), 0) + 1
        out[name] = list(terms.items())
    return out


def topic_of(c: Column, topics: dict | None = None) -> Column:
    """The topic with most term hits, the first on ties, null without a hit."""
    low = F.lower(c)
    scored = []
    for name, terms in topic_weights(V.TOPICS if topics is None else topics).items():
        hits = sum((F.when(low.contains(t), w).otherwise(0) for t, w in terms), F.lit(0))
        scored.append(F.struct(hits.alias("hits"), F.lit(name).alias("name")))
    none = F.struct(F.lit(0).alias("hits"), F.lit(None).cast("string").alias("name"))
    best = F.aggregate(F.array(*scored), none, lambda a, x: F.when(x.hits > a.hits, x).otherwise(a))
    return best["name"]


# ------------------------------------------------------------ query patterns
def contains_any(low: Column, terms: list[str]) -> Column:
    return low.rlike("|".join(T.escape(t) for t in terms))


def query_patterns(queries: Column) -> Column:
    """debugging / function_exploration / alternating_topics over an array of recent queries."""
    joined = F.lower(F.array_join(queries, " "))
    words = F.transform(
        queries,
        lambda q: F.array_except(
            F.filter(F.split(F.lower(q), r"\s+"), lambda w: w != ""), T.string_list(V.PRELOAD_STOPWORDS)
        ),
    )
    n = F.size(queries)
    pairs = F.zip_with(
        F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), T.jaccard
    )
    alternating = (n >= 3) & (F.array_max(pairs) < 0.1)
    return F.array_compact(
        F.array(
            F.when(contains_any(joined, V.ERROR_TERMS), F.lit("debugging")),
            F.when(contains_any(joined, V.FUNCTION_TERMS), F.lit("function_exploration")),
            F.when(alternating, F.lit("alternating_topics")),
        )
    )
