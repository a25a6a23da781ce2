"""Event log: validation, summary, rolling health, degradation, rollback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions import health as H
from turnloom.functions import text as T
from turnloom.operators.metrics import one_row_join
from turnloom.operators.ordered import dense_ordinal, exact_quantiles, framed, running

EVENT_SCHEMA = (
    "ts timestamp, component string, event_type string, payload map<string,string>, latency_ms double, "
    "run_id string, conversation_id string, turn_id int"
)


def is_valid(df: DataFrame):
    need = [F.col(c).isNotNull() for c in ("ts", "component", "event_type", "payload", "latency_ms")]
    ok = need[0]
    for c in need[1:]:
        ok = ok & c
    return ok


def valid_events(df: DataFrame) -> DataFrame:
    return df.where(is_valid(df))


def rejects(df: DataFrame) -> DataFrame:
    return df.where(~is_valid(df))


def shape_events(df: DataFrame) -> DataFrame:
    """Redact the payload, round the latency and add the UTC day, ready for the partitioned sink."""
    return df.withColumn("payload", T.redact_payload(F.col("payload"))).withColumn(
        "latency_ms", F.round(F.coalesce("latency_ms", F.lit(0.0)), 2)
    ).withColumn("date", F.to_date("ts"))


def event_counts(df: DataFrame) -> DataFrame:
    """Counts by component, event type and route in one pass over the log."""
    cells = F.array_compact(
        F.array(
            F.struct(F.lit("component").alias("dimension"), F.col("component").alias("value")),
            F.struct(F.lit("event").alias("dimension"), F.col("event_type").alias("value")),
            F.when(
                (F.col("event_type") == "task_classified") & (F.size("payload") > 0),
                F.struct(F.lit("route").alias("dimension"), F.try_element_at("payload", F.lit("routed_to")).alias("value")),
            ),
        )
    )
    return df.select(F.explode(cells).alias("c")).groupBy("c.dimension", "c.value").agg(F.count("*").alias("n"))


def event_summary(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Entries, latency mean and percentiles, PES minimum and mean.

    Percentiles interpolate and are exact; ``approximate`` trades that for one pass.
    """
    pes = F.when(F.col("event_type") == "score_computed", F.try_element_at("payload", F.lit("composite_score")).cast("double"))
    base = df.agg(
        F.count("*").alias("entries"), F.round(F.avg("latency_ms"), 3).alias("latency_avg"),
        F.round(F.min(pes), 2).alias("pes_min"), F.round(F.avg(pes), 2).alias("pes_mean"),
    )
    probs = {"latency_p50": 0.5, "latency_p95": 0.95, "latency_p99": 0.99}
    if approximate:
        q = df.agg(*[F.percentile_approx("latency_ms", p).cast("double").alias(n) for n, p in probs.items()])
    else:
        q = exact_quantiles(df, [], "latency_ms", probs)
    return one_row_join(base, q.select(*[F.round(n, 3).alias(n) for n in probs]))


def rolling_mean(df: DataFrame, keys: list[str], order: list[str], value: str, n: int = 10, name: str = "rolling_mean") -> DataFrame:
    """Mean of the last ``n`` values per key; a busy key is cut into overlapping blocks."""
    d = dense_ordinal(df, keys, order)
    return framed(d, keys, "ordinal", n - 1, {name: lambda w: F.avg(value).over(w.rowsBetween(-(n - 1), 0))})


def rollback_check(df: DataFrame, keys: list[str], order: list[str], pes: str = "pes") -> DataFrame:
    """Roll back when the last 10 are all < 50, the last 25 all < 60, or the slope of the last 50 is < -0.5."""
    d = dense_ordinal(df, keys, order)

    def peak(n):
        return lambda w: F.max(pes).over(w.rowsBetween(-(n - 1), 0))

    d = framed(
        d, keys, "ordinal", 49,
        {
            "peak10": peak(10), "peak25": peak(25),
            "slope50": lambda w: F.regr_slope(F.col(pes), F.col("ordinal").cast("double")).over(w.rowsBetween(-49, 0)),
        },
    )
    n = F.col("ordinal") + 1
    reason = (
        F.when(n < 10, "")
        .when(F.col("peak10") < 50, "PES < 50 for 10 turns")
        .when((n >= 25) & (F.col("peak25") < 60), "PES < 60 for 25 turns")
        .when((n >= 50) & (F.col("slope50") < -0.5), "PES declining trend")
        .otherwise("")
    )
    return d.withColumn("reason", reason).withColumn("should_rollback", F.col("reason") != "")


def degradation_level(df: DataFrame, keys: list[str], order: list[str], severity: str = "severity") -> DataFrame:
    """Level up at once, down one per step.

    Down one per step from any earlier level means: the level is the highest
    of (earlier level - steps since).  That is a running maximum, so no
    sequential walk is needed.
    """
    d = dense_ordinal(df, keys, order)
    up = H.severity_level(F.col(severity)) + F.col("ordinal")
    d = running(d, keys, "ordinal", {"_peak": ("max", up)}, block_rows=65536)
    return d.withColumn("level", (F.col("_peak") - F.col("ordinal")).cast("int")).drop("_peak")


def congestion_monitor(df: DataFrame, keys: list[str], order: list[str], n: int = 10) -> DataFrame:
    """Rolling latency mean and gauges to a severity per row (queue_depth, latency_ms, pending)."""
    d = rolling_mean(df, keys, order, "latency_ms", n, "avg_latency")
    return d.withColumn("c", H.congestion(F.col("queue_depth"), F.col("avg_latency"), F.col("pending")))


def emit_turn_events(turns: DataFrame) -> DataFrame:
    """Per turn a route event, an assembly event, and a congestion event when not normal.

    ``turns``: conv_id, turn, ts, route, used_tokens, chunks_used, budget, level, total_ms, severity.
    """
    s = lambda c: F.col(c).cast("string")

    def ev(component, kind, payload, latency):
        return F.struct(F.lit(component).alias("component"), F.lit(kind).alias("event_type"), payload.alias("payload"), latency.alias("latency_ms"))

    events = F.array_compact(
        F.array(
            ev("router", "task_classified", F.create_map(F.lit("routed_to"), F.coalesce("route", F.lit("fifo"))), F.lit(0.0)),
            ev(
                "assembly", "context_assembled",
                F.create_map(
                    F.lit("total_tokens"), s("used_tokens"), F.lit("chunk_count"), s("chunks_used"), F.lit("budget_used"), s("used_tokens"),
                    F.lit("budget_total"), s("budget"), F.lit("degradation_level"), s("level"),
                ),
                F.col("total_ms"),
            ),
            F.when(
                F.col("severity") != "normal",
                ev("congestion", "congestion_detected", F.create_map(F.lit("severity"), F.col("severity")), F.lit(0.0)),
            ),
        )
    )
    return turns.select("conv_id", "turn", "ts", F.explode(events).alias("e")).select("conv_id", "turn", "ts", "e.*")
