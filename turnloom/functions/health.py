"""Health scores, congestion and degradation as Column math."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom.functions import fixed as V


def _clip(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))


def latency_health(avg_ms: Column) -> Column:
    score = F.lit(100.0) - (avg_ms.cast("double") - F.lit(50.0)) * F.lit(0.67)
    return F.when(avg_ms.isNull(), 0.0).otherwise(_clip(score))


def throughput_health(tps: Column, baseline: Column) -> Column:
    bad = tps.isNull() | baseline.isNull() | (baseline == 0)
    den = F.when(baseline == 0, F.lit(1.0)).otherwise(baseline.cast("double"))
    return F.when(bad, 0.0).otherwise(_clip(tps.cast("double") / den * 100.0))


def context_utilization(used: Column, total: Column) -> Column:
    bad = used.isNull() | total.isNull() | (total == 0)
    u = used.cast("double") / F.when(total == 0, F.lit(1.0)).otherwise(total.cast("double"))
    return (
        F.when(bad, 0.0)
        .when(u < 0.60, u * 100.0)
        .when(u > 0.95, F.lit(100.0) - (u - F.lit(0.95)) * 1000.0)
        .otherwise(100.0)
    )


def pes(
    precision: Column | None = None,
    routing: Column | None = None,
    latency_ms: Column | None = None,
    tps: Column | None = None,
    baseline_tps: Column | None = None,
    used: Column | None = None,
    total: Column | None = None,
) -> Column:
    """Weighted mean of the components that are present; weights of absent ones drop out.

    struct(composite, raw, band, action, breakdown, active); ``raw`` is unrounded.
    """
    null = F.lit(None).cast("double")
    p, r, l, t, b, u, n = (null if x is None else x for x in (precision, routing, latency_ms, tps, baseline_tps, used, total))
    parts = {
        "retrieval_precision": F.when(p.isNotNull(), _clip(p.cast("double"))),
        "routing_accuracy": F.when(r.isNotNull(), _clip(r.cast("double"))),
        "latency_health": F.when(l.isNotNull(), latency_health(l)),
        "throughput_health": F.when(t.isNotNull() & b.isNotNull(), throughput_health(t, b)),
        "context_utilization": F.when(u.isNotNull() & n.isNotNull(), context_utilization(u, n)),
    }
    top = bottom = F.lit(0.0)
    for name, c in parts.items():
        w = F.lit(V.PES_WEIGHTS[name])
        top = top + F.coalesce(w * c, F.lit(0.0))
        bottom = bottom + F.when(c.isNotNull(), w).otherwise(0.0)
    raw = F.when(bottom == 0, 0.0).otherwise(top / F.when(bottom == 0, F.lit(1.0)).otherwise(bottom))
    band, action = interpret(raw)
    breakdown = F.map_filter(
        F.create_map(*[x for n_, c in parts.items() for x in (F.lit(n_), F.lit(V.PES_WEIGHTS[n_]) * c)]),
        lambda k, v: v.isNotNull(),
    )
    return F.struct(
        F.round(raw, 2).alias("composite"),
        raw.alias("raw"),
        band.alias("band"),
        action.alias("action"),
        breakdown.alias("breakdown"),
        F.map_keys(breakdown).alias("active"),
    )


def interpret(score: Column) -> tuple[Column, Column]:
    band = F.lit(V.PES_BANDS[-1][1])
    action = F.lit(V.PES_BANDS[-1][2])
    for cut, name, what in reversed(V.PES_BANDS[:-1]):
        band = F.when(score >= cut, F.lit(name)).otherwise(band)
        action = F.when(score >= cut, F.lit(what)).otherwise(action)
    return band, action


def congestion_level(value: Column, warning: float, critical: float) -> Column:
    return F.when(value > critical, 2).when(value >= warning, 1).otherwise(0)


def congestion(queue_depth: Column, latency_ms: Column, pending: Column) -> Column:
    """struct(severity, queue, latency, backlog, actions) from the three load signals."""
    q = congestion_level(queue_depth, 6, 15)
    l = congestion_level(F.coalesce(latency_ms.cast("double"), F.lit(0.0)), 20.0, 100.0)
    b = congestion_level(pending, 1, 1)
    criticals = sum(((x == 2).cast("int") for x in (q, l, b)), F.lit(0))
    severity = (
        F.when(criticals >= 2, "emergency")
        .when(criticals == 1, "critical")
        .when(F.greatest(q, l, b) >= 1, "warning")
        .otherwise("normal")
    )
    actions = F.array_compact(
        F.array(
            F.when(q >= 1, F.lit("batch_similar_chunks")),
            F.when(q >= 2, F.lit("skip_medium_drone")),
            F.when(l >= 1, F.lit("investigate_gpu_contention")),
            F.when(l >= 1, F.lit("skip_medium_drone_low_confidence")),
            F.when(l >= 2, F.lit("use_cached_embeddings")),
            F.when(b >= 1, F.lit("queue_messages")),
            F.when(b >= 2, F.lit("aggressive_compression")),
            F.when((q == 2) & (b == 2), F.lit("fallback_to_truncation")),
            F.when((q == 2) & (l == 2), F.lit("fallback_to_truncation")),
            F.when((l == 2) & (b == 2), F.lit("fallback_to_truncation")),
        )
    )
    return F.struct(
        severity.alias("severity"), q.alias("queue"), l.alias("latency"), b.alias("backlog"), actions.alias("actions")
    )


def severity_level(severity: Column) -> Column:
    return F.when(severity == "warning", 1).when(severity == "critical", 2).when(severity == "emergency", 3).otherwise(0)


def degrade_flags(level: Column) -> Column:
    return F.struct(
        (level >= 1).alias("skip_medium"),
        (level >= 1).alias("skip_dedup"),
        (level >= 2).alias("skip_remembrance"),
        (level >= 2).alias("cached_only"),
        (level >= 3).alias("fifo"),
    )


def calibrate(predicted: Column, measured: Column) -> Column:
    return F.when(measured.isNull(), predicted).otherwise(predicted + F.lit(0.5) * (measured - predicted))


def reliability(pass_rate: Column, over: Column) -> Column:
    return F.greatest(F.lit(0.0), pass_rate - over)


def decay_factor(times_saved: Column) -> Column:
    return F.lit(1.8) + times_saved * F.lit(0.3)


def decay(raw: Column, age: Column, multiplier: Column, penalty: Column, exempt: Column, stale: int = 20) -> Column:
    """Effective score of a chunk ``age`` turns after its last reference."""
    factor = F.least(age / F.lit(10.0), F.lit(3.0))
    aged = raw / F.pow(multiplier, factor) * penalty * F.when(age > stale, 0.5).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.when(exempt, raw).otherwise(aged))


def adaptive_budget(
    route: Column, high: Column, ranges: dict, max_context: int = 8192, headroom: int = 2048
) -> Column:
    fill = F.least(high / F.lit(10.0), F.lit(1.0))

    def span(lo, hi):
        return F.floor(F.lit(lo) + F.lit(hi - lo) * fill)

    c = span(2000, 4000)
    for name, (lo, hi) in ranges.items():
        c = F.when(route == name, span(lo, hi)).otherwise(c)
    return F.least(c, F.lit(max_context - headroom)).cast("int")


def bucket_label(turn: Column) -> Column:
    return (
        F.when(turn <= 1, "1").when(turn <= 5, "2-5").when(turn <= 10, "6-10")
        .when(turn <= 20, "11-20").when(turn <= 40, "21-40").otherwise("41+")
    )
