"""Event log, health over time, ground truth, A/B and sessions, all from the ``events`` and ``labels`` tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from turnloom.functions import fixed as V
from turnloom.functions import health as H
from turnloom.operators import events as X
from turnloom.operators import experiments as E
from turnloom.operators import metrics as M
from turnloom.operators import sessions as Z
from turnloom.operators import turns as U
from turnloom.plans.base import O, messages, s_route_for, scratch, settings, table, tidy
from turnloom.session import checkpointed
from turnloom.sources import readers, retention, sinks
from turnloom.sources.framed import write_frames
from turnloom.streaming import events as stream_events

QUERIES, ORACLES = {}, {}


def reg(name, sql=None, **kw):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = O(sql, **kw)
        return fn

    return wrap


# ------------------------------------------------------------------ event log
def _log(s, d):
    """The events table in log shape: clicks classify, views score, the rest keep their type."""
    e = table(s, d, "events")
    kind = F.when(F.col("event_type") == "click", "task_classified").when(F.col("event_type") == "view", "score_computed").otherwise(F.col("event_type"))
    route = F.when(F.col("user_id") % 3 == 0, "medium").otherwise("ultra_small")
    payload = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("routed_to"), route, F.lit("composite_score"), F.get_json_object("props", "$.k"), F.lit("token"), F.lit("abc"))
    return e.select(
        "event_id", "ts", F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")).alias("component"), kind.alias("event_type"), payload.alias("payload"),
        F.when(F.col("event_type") != "signup", F.col("value")).alias("latency_ms"), F.lit("run").alias("run_id"), F.col("user_id").cast("string").alias("conversation_id"), F.lit(None).cast("int").alias("turn_id"),
    )


_LOG = """lg AS (SELECT event_id, ts, 'c' || (user_id % 4) AS component, CASE event_type WHEN 'click' THEN 'task_classified' WHEN 'view' THEN 'score_computed' ELSE event_type END AS event_type,
CASE WHEN user_id % 3 = 0 THEN 'medium' ELSE 'ultra_small' END AS route, json_extract_string(props, '$.k')::DOUBLE AS k, CASE WHEN event_type <> 'signup' THEN value::DOUBLE END AS latency_ms FROM events)"""


@reg("valid_event", f"WITH {_LOG} SELECT latency_ms IS NOT NULL AS valid, count(*) AS n FROM lg GROUP BY 1")
def _valid_event(s, d):
    lg = _log(s, d)
    return tidy(X.valid_events(lg).select(F.lit(True).alias("valid")).unionByName(X.rejects(lg).select(F.lit(False).alias("valid"))).groupBy("valid").agg(F.count("*").alias("n")))


@reg("event_counts", f"""WITH {_LOG} SELECT 'component' AS dimension, component AS value, count(*) AS n FROM lg GROUP BY ALL
UNION ALL SELECT 'event', event_type, count(*) FROM lg GROUP BY ALL UNION ALL SELECT 'route', route, count(*) FROM lg WHERE event_type = 'task_classified' GROUP BY ALL""")
def _event_counts(s, d):
    return tidy(X.event_counts(_log(s, d)))


@reg("event_summary", f"""WITH {_LOG} SELECT count(*) AS entries, round(avg(latency_ms), 3) AS latency_avg, round(min(k) FILTER (event_type = 'score_computed'), 2) AS pes_min,
round(avg(k) FILTER (event_type = 'score_computed'), 2) AS pes_mean, round(quantile_cont(latency_ms, 0.5), 3) AS latency_p50, round(quantile_cont(latency_ms, 0.95), 3) AS latency_p95,
round(quantile_cont(latency_ms, 0.99), 3) AS latency_p99 FROM lg""")
def _event_summary(s, d):
    return tidy(X.event_summary(_log(s, d)))


@reg("write_events", """SELECT strftime(ts, '%Y-%m-%d') AS day, 'c' || (user_id % 4) AS component, count(*) AS n, sum(CASE WHEN event_type = 'signup' THEN 0 ELSE value END) AS latency_sum,
count(*) AS redacted FROM events GROUP BY ALL""", d="latency_sum")
def _write_events(s, d):
    """Through the partitioned log folder and back."""
    path = scratch(s)
    sinks.write_events(_log(s, d).drop("event_id"), path)
    e = readers.read_events(s, path)
    return tidy(e.groupBy(F.date_format("date", "yyyy-MM-dd").alias("day"), "component").agg(
        F.count("*").alias("n"), F.sum("latency_ms").alias("latency_sum"), F.count_if(F.try_element_at("payload", F.lit("token")) == V.REDACTED).alias("redacted")))


QUERIES["read_events"], ORACLES["read_events"] = QUERIES["write_events"], ORACLES["write_events"]


@reg("read_events_by_date", "SELECT 'c' || (user_id % 4) AS component, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11' GROUP BY 1")
def _read_by_date(s, d):
    path = scratch(s)
    sinks.write_events(_log(s, d).drop("event_id"), path)
    return tidy(readers.read_events_by_date(s, path, "2024-01-10").groupBy("component").agg(F.count("*").alias("n")))


def _rotated(s, d, path):
    """A log of all events, of which the days before the 16th were settled."""
    sinks.write_events(_log(s, d).drop("event_id"), path)
    return retention.rotate_events(s, path, path + "_archive", dt.date(2024, 1, 16), max_records=2000)


@reg("rotate_events", """SELECT strftime(ts, '%Y-%m-%d') AS day, ts::DATE < DATE '2024-01-16' AS archived, count(*) AS n, 0::BIGINT AS files_again FROM events GROUP BY ALL""")
def _rotate(s, d):
    """Settled days live in the gzip archive alone, the rest in the log alone; a second run finds nothing to do."""
    path = scratch(s)
    _rotated(s, d, path)
    again = retention.rotate_events(s, path, path + "_archive", dt.date(2024, 1, 16))
    gz = F.col("_metadata.file_path").endswith(".gz")
    live = readers.read_events(s, path).select("date", gz.alias("archived"))
    old = readers.read_events(s, path + "_archive").select("date", gz.alias("archived"))
    return tidy(live.unionByName(old).groupBy(F.date_format("date", "yyyy-MM-dd").alias("day"), "archived").agg(
        F.count("*").alias("n")).withColumn("files_again", F.lit(again.files + again.left_over)))


@reg("prune_events", """SELECT count(*) FILTER (date_diff('day', ts::DATE, DATE '2024-01-16') <= 10) AS kept, count(DISTINCT ts::DATE) FILTER (date_diff('day', ts::DATE, DATE '2024-01-16') <= 10) AS days,
0::BIGINT AS removed_again FROM events""")
def _prune(s, d):
    """The rotated log's archive loses its days over ten days old; the log and later days stay."""
    path = scratch(s)
    _rotated(s, d, path)
    retention.prune_events(s, path + "_archive", dt.date(2024, 1, 16), 10)
    again = retention.prune_events(s, path + "_archive", dt.date(2024, 1, 16), 10)
    e = readers.read_events(s, path, include_archive=True)
    return tidy(e.agg(F.count("*").alias("kept"), F.count_distinct("date").alias("days")).withColumn("removed_again", F.lit(again)))


@reg("event_stream", """SELECT 'c' || (user_id % 4) AS component, count(*) AS n, sum(value) AS latency_sum FROM events WHERE event_type <> 'signup' GROUP BY 1""", d="latency_sum")
def _event_stream(s, d):
    """Structured Streaming from the table folder through the redacting file sink."""
    src, out = scratch(s), scratch(s)
    _log(s, d).drop("event_id").write.parquet(src)
    q = stream_events.event_stream(stream_events.event_source(s, src, "parquet"), out, out + "_ckpt")
    q.awaitTermination()
    return tidy(s.read.schema(X.EVENT_SCHEMA + ", date date").json(out).groupBy("component").agg(F.count("*").alias("n"), F.sum("latency_ms").alias("latency_sum")))


@reg("event_dashboard", f"WITH {_LOG} SELECT strftime(ts, '%Y-%m-%d') AS day, component, count(*) AS n FROM lg GROUP BY ALL")
def _event_dashboard(s, d):
    w = stream_events.event_dashboard(_log(s, d), "1 day")
    return tidy(w.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "component", "n"))


# ------------------------------------------------------------------ rolling health
@reg("rolling_mean", "SELECT event_id, event_type, avg(value::DOUBLE) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS rolling_mean FROM events", d="rolling_mean")
def _rolling_mean(s, d):
    return tidy(X.rolling_mean(table(s, d, "events"), ["event_type"], ["ts", "event_id"], "value").select("event_id", "event_type", "rolling_mean"))


_RB = """r AS (SELECT event_id, user_id, row_number() OVER w AS n, max(value) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS p10, max(value) OVER (w ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS p25,
 value, ts FROM (SELECT event_id, user_id, ts, 30 + value::DOUBLE / 10 AS value FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
sl AS (SELECT *, regr_slope(value, n) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS slope FROM r)"""


@reg("rollback_check", f"""WITH {_RB} SELECT event_id, CASE WHEN n < 10 THEN '' WHEN p10 < 50 THEN 'PES < 50 for 10 turns' WHEN n >= 25 AND p25 < 60 THEN 'PES < 60 for 25 turns'
WHEN n >= 50 AND slope < -0.5 THEN 'PES declining trend' ELSE '' END AS reason FROM sl""")
def _rollback(s, d):
    e = table(s, d, "events").select("event_id", "user_id", "ts", (F.lit(30) + F.col("value") / 10).alias("pes"))
    return tidy(X.rollback_check(e, ["user_id"], ["ts", "event_id"]).select("event_id", "reason"))


_SEV = "CASE WHEN value > 200 THEN 3 WHEN value > 100 THEN 2 WHEN value > 60 THEN 1 ELSE 0 END"


@reg("degradation_level", f"""WITH o AS (SELECT event_id, event_type, {_SEV} AS s, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT event_type, list_reduce(list({{'id': event_id::BIGINT, 's': s::BIGINT}} ORDER BY n), lambda a, x: {{'l': CASE WHEN x.s > a.l THEN x.s WHEN x.s < a.l THEN greatest(a.l - 1, x.s) ELSE a.l END,
 'o': list_append(a.o, {{'id': x.id, 'l': CASE WHEN x.s > a.l THEN x.s WHEN x.s < a.l THEN greatest(a.l - 1, x.s) ELSE a.l END}})}}, {{'l': 0::BIGINT, 'o': []::STRUCT(id BIGINT, l BIGINT)[]}}) AS r FROM o WHERE n <= 1000000 GROUP BY 1),
u AS (SELECT unnest(r.o) AS e FROM f) SELECT e.id AS event_id, e.l AS level FROM u""")
def _degradation(s, d):
    v = F.col("value")
    sev = F.when(v > 200, "emergency").when(v > 100, "critical").when(v > 60, "warning").otherwise("normal")
    e = table(s, d, "events").select("event_id", "event_type", "ts", sev.alias("severity"))
    return tidy(X.degradation_level(e, ["event_type"], ["ts", "event_id"]).select("event_id", "level"))


@reg("congestion_monitor", """WITH a AS (SELECT event_id, user_id, avg(value::DOUBLE) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m FROM events),
l AS (SELECT event_id, m, CASE WHEN event_id % 20 > 15 THEN 2 WHEN event_id % 20 >= 6 THEN 1 ELSE 0 END AS q, CASE WHEN m > 100 THEN 2 WHEN m >= 20 THEN 1 ELSE 0 END AS l, CASE WHEN event_id % 3 > 1 THEN 2 WHEN event_id % 3 >= 1 THEN 1 ELSE 0 END AS b FROM a)
SELECT event_id, m AS avg_latency, CASE WHEN (q = 2)::INT + (l = 2)::INT + (b = 2)::INT >= 2 THEN 'emergency' WHEN (q = 2)::INT + (l = 2)::INT + (b = 2)::INT = 1 THEN 'critical' WHEN greatest(q, l, b) >= 1 THEN 'warning' ELSE 'normal' END AS severity FROM l""", d="avg_latency")
def _congestion_monitor(s, d):
    e = table(s, d, "events").select("event_id", "user_id", "ts", F.col("value").alias("latency_ms"), (F.col("event_id") % 20).alias("queue_depth"), (F.col("event_id") % 3).alias("pending"))
    m = X.congestion_monitor(e, ["user_id"], ["ts", "event_id"])
    return tidy(m.select("event_id", "avg_latency", F.col("c.severity").alias("severity")))


@reg("outlier_turns", "SELECT event_id FROM (SELECT event_id, value, median(value) OVER (PARTITION BY user_id) AS m FROM events) WHERE value <= 5 * m")
def _outlier_turns(s, d):
    from turnloom.operators.ordered import exact_quantiles

    e = table(s, d, "events")
    m = exact_quantiles(e, ["user_id"], "value", {"m": 0.5})
    return tidy(e.join(m, "user_id").where(F.col("value") <= F.col("m") * 5).select("event_id"))


_P1 = """WITH s AS (SELECT user_id, event_id, ts, value::DOUBLE AS gen_ms, (json_extract_string(props, '$.k')::DOUBLE + 1) / (value::DOUBLE / 1000) AS tps FROM events WHERE value > 0),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS o, count(*) OVER (PARTITION BY user_id) AS n FROM (SELECT *, median(gen_ms) OVER (PARTITION BY user_id) AS m, count(*) OVER (PARTITION BY user_id) AS n_all FROM s) WHERE gen_ms <= 5 * m),
g AS (SELECT user_id, n, max(n_all) - n AS dropped, avg(tps) FILTER (o < least(n // 2, 10)) AS e, avg(tps) FILTER (o >= greatest(n // 2, n - 10)) AS l FROM c GROUP BY user_id, n)
SELECT user_id, n, dropped, round(e, 1) AS early_tps, round(l, 1) AS late_tps, abs(l - e) / e AS drift, CASE WHEN n < 6 THEN 'SKIP' WHEN abs(l - e) / e <= 0.1 THEN 'PASS' ELSE 'FAIL' END AS status FROM g"""


def _samples(s, d):
    v = F.col("value").cast("double")
    return table(s, d, "events").where(F.col("value") > 0).select("user_id", "event_id", "ts", v.alias("gen_ms"), ((F.get_json_object("props", "$.k").cast("double") + 1) / (v / 1000)).alias("tps"))


@reg("p1_throughput", _P1, d="drift")
def _p1(s, d):
    return tidy(E.p1_throughput(checkpointed(_samples(s, d)), ["user_id"], ["ts", "event_id"]))


QUERIES["early_late_drift"], ORACLES["early_late_drift"] = QUERIES["p1_throughput"], ORACLES["p1_throughput"]


# ------------------------------------------------------------------ baselines, runs
def _calls(s, d):
    e = table(s, d, "events")
    err = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, "oom").otherwise("http"))
    return e.select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.get_json_object("props", "$.k").cast("long").alias("completion_tokens"),
                    F.col("value").cast("double").alias("latency_ms"), (F.col("event_id") % 5000).alias("prompt_tokens"), err.alias("error"))


_CALLS = """calls AS (SELECT user_id AS conv_id, event_id AS turn, json_extract_string(props, '$.k')::BIGINT AS ct, value::DOUBLE AS ms, event_id % 5000 AS pt, CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'oom' ELSE 'http' END END AS error FROM events),
ru AS (SELECT conv_id, count(*) AS total_turns, coalesce(avg(CASE WHEN ms > 0 THEN ct / (ms / 1000.0) ELSE 0.0 END) FILTER (error IS NULL), 0.0) AS tps, coalesce(avg(ms) FILTER (error IS NULL), 0.0) AS lat,
 coalesce(arg_max(pt, turn) FILTER (error IS NULL), 0) AS last_prompt_tokens, coalesce(max(pt) FILTER (error IS NULL), 0) AS max_prompt_tokens, count(*) FILTER (error = 'oom') AS oom_events, count(*) FILTER (error <> 'oom') AS errors FROM calls GROUP BY 1),
rp AS (SELECT *, greatest(0.0, least(100.0, 100.0 - (lat - 50.0) * 0.67)) AS h1, greatest(0.0, least(100.0, tps / 30.0 * 100.0)) AS h2, max_prompt_tokens / 32768.0 AS u FROM ru),
rr AS (SELECT *, (0.2 * h1 + 0.15 * h2 + 0.15 * (CASE WHEN u < 0.6 THEN u * 100 WHEN u > 0.95 THEN 100 - (u - 0.95) * 1000 ELSE 100 END)) / 0.5 AS p FROM rp)"""


@reg("baseline_rollup", f"""WITH {_CALLS} SELECT conv_id, total_turns, round(tps, 2) AS avg_tokens_per_sec, last_prompt_tokens, max_prompt_tokens, round(least(1.0, u), 3) AS context_utilization, oom_events, errors,
round(lat, 2) AS avg_latency_ms, round(p, 2) AS pes FROM rr""")
def _baseline_rollup(s, d):
    return tidy(E.baseline_rollup(_calls(s, d)))


@reg("baseline_aggregate", f"""WITH {_CALLS} SELECT round(avg(round(tps, 2)), 2) AS avg_tokens_per_sec, round(avg(round(lat, 2)), 2) AS avg_latency_ms, round(avg(round(p, 2)), 2) AS avg_pes, round(avg(round(least(1.0, u), 3)), 2) AS avg_context_utilization,
sum(oom_events) AS total_oom_events, sum(errors) AS total_errors, count(*) FILTER (oom_events > 0) AS with_oom, count(*) AS conversation_count FROM rr""", i="total_oom_events total_errors")
def _baseline_aggregate(s, d):
    return tidy(E.baseline_aggregate(E.baseline_rollup(_calls(s, d))))


@reg("baseline_pes", f"""SELECT event_id, (0.2 * h1 + 0.15 * h2) / (0.2::DOUBLE + 0.15::DOUBLE) AS pes FROM (SELECT event_id, greatest(0.0, least(100.0, 100.0 - (value - 50.0) * 0.67)) AS h1, greatest(0.0, least(100.0, user_id / 30.0 * 100.0)) AS h2 FROM (SELECT event_id, user_id, value::DOUBLE AS value FROM events))""", d="pes")
def _baseline_pes(s, d):
    return tidy(table(s, d, "events").select("event_id", H.pes(latency_ms=F.col("value"), tps=F.col("user_id"), baseline_tps=F.lit(30.0))["raw"].alias("pes")))


def _run_turns(s, d):
    e = table(s, d, "events")
    return e.select(
        F.col("user_id").alias("conv_id"), "event_id", F.get_json_object("props", "$.k").cast("double").alias("pes"), F.col("value").cast("double").alias("total_ms"),
        (F.col("value") * 0.8).alias("generation_ms"), (F.col("event_id") % 900).alias("token_count"), F.lit(1000).alias("budget"), F.get_json_object("props", "$.k").cast("long").alias("completion_tokens"),
        F.when(F.col("event_type") == "error", "fifo_fallback").otherwise("curated").alias("mode"), (F.col("event_id") % 4).alias("level"),
        F.when(F.col("event_type") == "click", F.col("value").cast("double")).alias("ttft_ms"),
    )


@reg("run_aggregate", """SELECT count(*) AS user_turns, count(DISTINCT user_id) AS conversations, round(avg(json_extract_string(props, '$.k')::DOUBLE), 2) AS avg_pes, round(min(json_extract_string(props, '$.k')::DOUBLE), 2) AS min_pes, round(avg(value), 2) AS avg_total_ms,
count(*) FILTER (event_type = 'error') AS fifo_fallbacks, count(*) FILTER (event_id % 4 >= 1) AS degraded_turns FROM events""")
def _run_aggregate(s, d):
    return tidy(E.run_aggregate(_run_turns(s, d)))


@reg("ttft_stats", "SELECT count(*) AS probes, median(value::DOUBLE) AS ttft_median, min(value::DOUBLE) AS ttft_min, max(value::DOUBLE) AS ttft_max FROM events WHERE event_type = 'click'", d="ttft_median ttft_min ttft_max")
def _ttft(s, d):
    return tidy(E.ttft_stats(_run_turns(s, d)))


@reg("throughput_ratio", "SELECT event_type AS engine, sum(json_extract_string(props, '$.k')::BIGINT)::DOUBLE / sum(value::DOUBLE) AS tokens_per_second FROM events GROUP BY 1", d="tokens_per_second")
def _throughput_ratio(s, d):
    e = table(s, d, "events").select(F.col("event_type").alias("engine"), F.get_json_object("props", "$.k").cast("long").alias("tokens"), F.col("value").cast("double").alias("seconds"))
    return tidy(Z.throughput_ratio(e))


@reg("probe_status", """WITH p AS (SELECT event_id, event_type = 'error' AS empty, json_extract_string(props, '$.k')::BIGINT AS t, value::DOUBLE AS v FROM events)
SELECT event_id, CASE WHEN t > 0 THEN round(t / greatest(v, 1e-6), 1) END AS effective_tps, CASE WHEN t > 0 THEN round(t / greatest(v / 2, 1e-6), 1) END AS decode_tps, CASE WHEN empty THEN 'EMPTY' ELSE 'PASS' END AS status, (empty AND t >= 50) AS hit_cap FROM p""", d="effective_tps decode_tps")
def _probe_status(s, d):
    e = table(s, d, "events").select("event_id", F.when(F.col("event_type") == "error", " ").otherwise("ok").alias("reply"), F.get_json_object("props", "$.k").cast("long").alias("completion_tokens"),
                                     F.col("value").cast("double").alias("effective_s"), (F.col("value") / 2).cast("double").alias("decode_s"), F.lit(50).alias("max_tokens"))
    return tidy(Z.probe_status(e).select("event_id", "effective_tps", "decode_tps", "status", "hit_cap"))


# ------------------------------------------------------------------ ground truth
def _labels(s, d):
    l = table(s, d, "labels")
    return l.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 60).alias("turn"), (F.col("quality") == 1).alias("predicted_relevant"), (F.col("toxic") == 0).alias("actually_relevant"), ((F.col("doc_id") % 100) / 100.0).alias("score"))


_LAB = "lab AS (SELECT doc_id AS id, doc_id % 60 AS turn, quality = 1 AS p, toxic = 0 AS a, (doc_id % 100) / 100.0::DOUBLE AS score FROM labels), nl AS (SELECT * FROM lab ORDER BY id DESC LIMIT 100)"
_PCT = "CASE WHEN count(*) FILTER ({d}) > 0 THEN count(*) FILTER ({n})::DOUBLE / count(*) FILTER ({d}) ELSE 0.0 END * 100"


@reg("label_metrics", f"WITH {_LAB} SELECT {_PCT.format(n='p AND a', d='p')} AS retrieval_precision, {_PCT.format(n='p AND a', d='a')} AS retrieval_recall, {_PCT.format(n='NOT p AND a', d='NOT p')} AS false_eviction_rate FROM nl", d="retrieval_precision retrieval_recall false_eviction_rate")
def _label_metrics(s, d):
    return tidy(M.label_metrics(_labels(s, d)))


@reg("label_count", "SELECT count(*) AS n FROM labels")
def _label_count(s, d):
    return tidy(_labels(s, d).agg(F.count("*").alias("n")))


@reg("label_recency", f"WITH {_LAB} SELECT id, turn FROM nl")
def _label_recency(s, d):
    return tidy(M.newest(_labels(s, d), 100).select("id", "turn"))


def _decisions(s, d):
    l = table(s, d, "labels")
    opt = F.when(F.col("toxic") == 1, "escalation").when(F.col("quality") == 1, "medium").otherwise("ultra_small")
    x = l.select(F.col("doc_id").alias("id"), F.lit("route").alias("decision_type"), (F.col("doc_id") % 5).alias("score"), opt.alias("optimal"))
    from turnloom.functions.routing import route_for

    return x.withColumn("outcome", F.when(route_for(F.col("score")) == F.col("optimal"), "correct").otherwise("wrong"))


_DEC = f"dec AS (SELECT doc_id AS id, doc_id % 5 AS score, CASE WHEN toxic = 1 THEN 'escalation' WHEN quality = 1 THEN 'medium' ELSE 'ultra_small' END AS optimal FROM labels), de AS (SELECT *, {s_route_for('score')} = optimal AS ok FROM dec)"


@reg("routing_accuracy", f"WITH {_DEC} SELECT count(*) FILTER (ok)::DOUBLE / count(*) * 100 AS routing_accuracy FROM (SELECT * FROM de ORDER BY id DESC LIMIT 100)", d="routing_accuracy")
def _routing_accuracy(s, d):
    return tidy(M.routing_accuracy(_decisions(s, d)))


@reg("write_ground_truth", f"WITH {_DEC} SELECT CASE WHEN ok THEN 'correct' ELSE 'wrong' END AS outcome, count(*) AS n FROM de GROUP BY 1")
def _write_ground_truth(s, d):
    path = scratch(s)
    sinks.write_ground_truth(path, labels=_labels(s, d), routes=_decisions(s, d).drop("decision_type", "outcome"), versions=_labels(s, d).select(F.col("id").cast("string").alias("version"), F.lit("{}").alias("params_json")))
    return tidy(readers.read_ground_truth(s, path)["decisions"].groupBy("outcome").agg(F.count("*").alias("n")))


QUERIES["read_ground_truth"], ORACLES["read_ground_truth"] = QUERIES["write_ground_truth"], ORACLES["write_ground_truth"]


@reg("replay_decay", f"""WITH {_LAB}, m AS (SELECT unnest({V.DECAY_CANDIDATES}::DOUBLE[]) AS candidate), mx AS (SELECT max(turn) AS mt FROM lab),
r AS (SELECT candidate, score / pow(candidate, least((mt - turn) / 10.0, 3.0)) > 0.6 AS kept, a FROM lab, m, mx),
g AS (SELECT candidate, count(*) AS n, count(*) FILTER (kept) AS k, count(*) FILTER (NOT kept AND a) AS w FROM r GROUP BY 1),
h AS (SELECT candidate, CASE WHEN n - k > 0 THEN w::DOUBLE / (n - k) ELSE 0.0 END AS false_eviction_rate, k::DOUBLE / n AS keep_rate FROM g) SELECT *, false_eviction_rate + 0.3 * keep_rate AS objective FROM h""", d="candidate false_eviction_rate keep_rate objective")
def _replay_decay(s, d):
    return tidy(M.replay_decay(_labels(s, d)))


_SW = f"""WITH {_LAB}, m AS (SELECT unnest({V.DECAY_CANDIDATES}::DOUBLE[]) AS candidate), mx AS (SELECT max(turn) AS mt FROM lab),
r AS (SELECT candidate, score / pow(candidate, least((mt - turn) / 10.0, 3.0)) > 0.6 AS kept, a FROM lab, m, mx),
g AS (SELECT candidate, CASE WHEN count(*) FILTER (NOT kept) > 0 THEN count(*) FILTER (NOT kept AND a)::DOUBLE / count(*) FILTER (NOT kept) ELSE 0.0 END + 0.3 * count(*) FILTER (kept) / count(*) AS objective FROM r GROUP BY 1)"""


@reg("optimize_decay", f"{_SW} SELECT candidate, objective, candidate = (SELECT candidate FROM g ORDER BY objective, candidate LIMIT 1) AS is_best FROM g", d="candidate objective")
def _optimize_decay(s, d):
    return tidy(M.sweep(checkpointed(M.replay_decay(_labels(s, d)))).select("candidate", "objective", "is_best"))


_RO = f"WITH {_DEC}, t AS (SELECT unnest([1, 2, 3, 4, 5])::BIGINT AS candidate), p AS (SELECT candidate, {s_route_for('score', 'candidate')} AS pred, optimal FROM de, t), g AS (SELECT candidate, count(*) FILTER (pred = optimal)::DOUBLE / count(*) AS accuracy, count(*) FILTER (pred = 'medium')::DOUBLE / count(*) AS medium_rate FROM p GROUP BY 1), o AS (SELECT *, accuracy - 0.1 * medium_rate AS objective FROM g)"


@reg("replay_routing", f"{_RO} SELECT * FROM o", d="accuracy medium_rate objective")
def _replay_routing(s, d):
    return tidy(M.replay_routing(_decisions(s, d)))


@reg("optimize_routing", f"{_RO} SELECT candidate, objective, candidate = (SELECT candidate FROM o ORDER BY objective DESC, candidate LIMIT 1) AS is_best FROM o", d="objective")
def _optimize_routing(s, d):
    return tidy(M.sweep(checkpointed(M.replay_routing(_decisions(s, d))), minimize=False).select("candidate", "objective", "is_best"))


@reg("optimize_budget", "WITH v AS (SELECT b::BIGINT AS candidate, avg((length(text) // 4 <= b)::INT) - 0.0001 * b AS objective FROM conversations, (SELECT unnest([50, 100, 200, 400]) AS b) GROUP BY b) SELECT candidate, objective, candidate = (SELECT candidate FROM v ORDER BY objective DESC, candidate LIMIT 1) AS is_best FROM v", d="objective")
def _optimize_budget(s, d):
    """A sweep with a supplied objective: share of messages that fit, less a price per token."""
    tok = F.length("text") / 4
    m = messages(s, d).agg(*[F.avg((F.floor(tok) <= b).cast("double")).alias(f"s{b}") for b in (50, 100, 200, 400)])
    cells = F.array(*[F.struct(F.lit(b).alias("candidate"), (F.col(f"s{b}") - F.lit(0.0001) * b).alias("objective")) for b in (50, 100, 200, 400)])
    return tidy(M.sweep(m.select(F.explode(cells).alias("c")).select("c.*"), minimize=False))


QUERIES["sweep"], ORACLES["sweep"] = QUERIES["optimize_budget"], ORACLES["optimize_budget"]


@reg("p8_routing", "SELECT count(*) AS n, avg((CASE WHEN turn = 0 THEN 1 ELSE 0 END = 0)::INT) AS accuracy, CASE WHEN avg((turn <> 0)::INT) >= 0.85 THEN 'PASS' ELSE 'FAIL' END AS status FROM conversations WHERE role = 'user'", d="accuracy")
def _p8(s, d):
    """Labels that disagree on the first message of each conversation."""
    from turnloom.functions.routing import route

    m = messages(s, d)
    cfg = settings(s, d)
    lab = U.user_turns(m, cfg).select("conv_id", "turn", F.when(F.col("turn") == 0, "other").otherwise(route(F.col("text"))["route_to"]).alias("optimal_route"))
    return tidy(E.p8_routing(lab, m, cfg))


@reg("post_run_pes", f"""WITH {_LAB}, {_DEC}, t AS (SELECT avg(value::DOUBLE) AS ms, avg((event_id % 900) / 1000.0) AS u, sum(json_extract_string(props, '$.k')::BIGINT) AS tk, sum(value::DOUBLE * 0.8) / 1000 AS sec, count(*) AS turns FROM events),
l AS (SELECT {_PCT.format(n='p AND a', d='p')} AS pr FROM nl), r AS (SELECT count(*) FILTER (ok)::DOUBLE / count(*) * 100 AS ra FROM (SELECT * FROM de ORDER BY id DESC LIMIT 100)),
c AS (SELECT *, (0.3 * pr + 0.2 * ra + 0.2 * greatest(0.0, least(100.0, 100 - (ms - 50) * 0.67)) + 0.15 * greatest(0.0, least(100.0, tk / sec / 30 * 100)) + 0.15 * (CASE WHEN u < 0.6 THEN u * 100 WHEN u > 0.95 THEN 100 - (u - 0.95) * 1000 ELSE 100 END)) AS p FROM t, l, r)
SELECT turns, round(p, 2) AS pes, CASE WHEN p >= 80 THEN 'GREEN' WHEN p >= 60 THEN 'YELLOW' WHEN p >= 40 THEN 'RED' ELSE 'CRITICAL' END AS band, round(ms, 1) AS avg_total_ms, round(u * 100, 1) AS avg_context_utilization_pct, round(tk / sec, 1) AS actual_tps, (SELECT count(*) FROM lab) AS n_labels FROM c""")
def _post_run_pes(s, d):
    return tidy(E.post_run_pes(_run_turns(s, d), _labels(s, d), _decisions(s, d)))


@reg("protocol_table", None)
def _protocol(s, d):
    t = E.protocol_table({"P1": E.p1_throughput(checkpointed(_samples(s, d)), ["user_id"], ["ts", "event_id"]), "P8": QUERIES["p8_routing"](s, d)})
    return tidy(t.groupBy("id", "status").agg(F.count("*").alias("n")))


ORACLES["protocol_table"] = f"SELECT 'P1' AS id, status, count(*) AS n FROM ({_P1}) GROUP BY 2 UNION ALL SELECT 'P8', CASE WHEN avg((turn <> 0)::INT) >= 0.85 THEN 'PASS' ELSE 'FAIL' END, 1 FROM conversations WHERE role = 'user'"


# ------------------------------------------------------------------ raters
def _ratings(s, d):
    """Two raters over labelled documents; some items rated twice."""
    l = table(s, d, "labels")
    q = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("How does x"), F.col("doc_id").cast("string"), F.lit(" fit with x"), F.col("doc_id").cast("string"), F.lit("?"))).otherwise("real question")
    items = l.select(F.col("doc_id").cast("string").alias("item_id"), q.alias("query"))
    a = l.select(F.col("doc_id").cast("string").alias("item_id"), F.lit(1).alias("line_no"), (F.lit(2) - F.col("quality")).alias("label")).unionByName(
        l.where(F.col("doc_id") % 5 == 0).select(F.col("doc_id").cast("string").alias("item_id"), F.lit(2).alias("line_no"), F.lit(3).alias("label")))
    b = l.select(F.col("doc_id").cast("string").alias("item_id"), F.lit(1).alias("line_no"), F.when(F.col("doc_id") % 7 == 0, 3).otherwise(F.lit(2) - F.col("quality")).alias("label"))
    return items, M.last_label(a), M.last_label(b)


_RAT = "rat AS (SELECT doc_id::VARCHAR AS item_id, doc_id % 11 = 0 AS degen, CASE WHEN doc_id % 5 = 0 THEN 3 ELSE 2 - quality END AS a, CASE WHEN doc_id % 7 = 0 THEN 3 ELSE 2 - quality END AS b FROM labels)"


@reg("agreement", f"WITH {_RAT} SELECT round(avg((a = b)::INT) FILTER (NOT degen), 4) AS agreement, count(*) FILTER (NOT degen) AS n, count(*) FILTER (NOT degen AND a <> b) AS n_discordant, count(*) FILTER (degen) AS n_degenerate, CASE WHEN avg((a = b)::INT) FILTER (NOT degen) >= 0.9 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM rat")
def _agreement(s, d):
    return tidy(M.agreement(*_ratings(s, d)))


@reg("label_agreement_join", f"WITH {_RAT} SELECT item_id, a AS label_a, b AS label_b FROM rat WHERE NOT degen AND a <> b", i="label_a label_b")
def _label_agreement_join(s, d):
    return tidy(M.discordant(*_ratings(s, d)))


@reg("read_rater_labels", f"WITH {_RAT} SELECT item_id, a AS label FROM rat", i="label")
def _read_rater_labels(s, d):
    path = scratch(s)
    l = table(s, d, "labels")
    first = l.select(F.col("doc_id").cast("string").alias("item_id"), (F.lit(2) - F.col("quality")).alias("label"), F.lit(1).alias("o"))
    later = l.where(F.col("doc_id") % 5 == 0).select(F.col("doc_id").cast("string").alias("item_id"), F.lit(3).alias("label"), F.lit(2).alias("o"))
    first.unionByName(later).repartitionByRange(4, "o", "item_id").sortWithinPartitions("o", "item_id").drop("o").write.json(path)
    return tidy(readers.read_rater_labels(s, path))


# ------------------------------------------------------------------ A/B, shadow, compare
def _arms(s, d):
    e = table(s, d, "events")
    v = F.col("value").cast("double")
    return e.select(F.when(F.col("event_id") % 2 == 0, "A").otherwise("B").alias("arm"), v.alias("latency_ms"), F.when(F.col("event_type") != "view", v / 5).alias("pes"), (v / 6).alias("retrieval_precision"),
                    F.lit(None).cast("double").alias("routing_accuracy"), (v / 500).alias("context_utilization"), (v + F.when((F.col("event_id") % 2 == 0) & (F.col("event_id") % 8 == 0), 5.0).otherwise(0.0)).alias("value"))


@reg("ab_metrics", """SELECT CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS arm, round(avg(value::DOUBLE / 6), 3) AS retrieval_precision, NULL::DOUBLE AS routing_accuracy, round(avg(value::DOUBLE), 3) AS latency_ms,
round(avg(value::DOUBLE / 500), 3) AS context_utilization, round(avg(value::DOUBLE / 5) FILTER (event_type <> 'view'), 3) AS pes FROM events GROUP BY 1""")
def _ab_metrics(s, d):
    return tidy(M.ab_metrics(_arms(s, d)))


@reg("tolerance_winner", "SELECT event_type, CASE WHEN abs(a - b) <= greatest(0.02 * greatest(a, b), 1e-6) THEN 'tie' WHEN a > b THEN 'A' ELSE 'B' END AS winner FROM (SELECT event_type, avg(value::DOUBLE) FILTER (event_id % 2 = 0) AS a, avg(value::DOUBLE) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY 1)")
def _tolerance_winner(s, d):
    g = table(s, d, "events").groupBy("event_type").agg(F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("a"), F.avg(F.when(F.col("event_id") % 2 == 1, F.col("value"))).alias("b"))
    return tidy(g.select("event_type", M.tolerance_winner(F.col("a"), F.col("b")).alias("winner")))


_MW = """WITH v AS (SELECT event_id % 2 = 0 AS a, value::DOUBLE + (CASE WHEN event_id % 8 = 0 THEN 5.0 ELSE 0.0 END) AS x FROM events),
k AS (SELECT x, count(*) AS n, count(*) FILTER (a) AS na, sum(count(*)) OVER (ORDER BY x) AS upto FROM v GROUP BY x),
s AS (SELECT sum(na)::DOUBLE AS na, sum(n - na)::DOUBLE AS nb, sum(na * (upto - n + (n + 1) / 2.0)) AS ra, sum(n::DOUBLE * n * n - n) AS ties FROM k),
u AS (SELECT *, ra - na * (na + 1) / 2 AS u FROM s)
SELECT na::BIGINT AS n_a, nb::BIGINT AS n_b, u, (greatest(u, na * nb - u) - na * nb / 2 - 0.5) / sqrt(na * nb / 12 * ((na + nb + 1) - ties / ((na + nb) * (na + nb - 1)))) AS z, ties > 0 AS has_ties FROM u"""


@reg("mann_whitney", _MW, d="u z")
def _mann_whitney(s, d):
    m = M.mann_whitney(_arms(s, d).select("arm", "value"))
    return tidy(m.select("n_a", "n_b", "u", "z", "has_ties"))


@reg("ab_winner")
def _ab_winner(s, d):
    return tidy(M.ab_winner(M.mann_whitney(_arms(s, d).select("arm", "value"))))


@reg("shadow_eval", """WITH n AS (SELECT value::DOUBLE AS p, json_extract_string(props, '$.k')::DOUBLE AS s FROM events ORDER BY event_id DESC LIMIT 100), a AS (SELECT avg(p) AS pa, avg(s) AS sa, count(*) AS turns FROM n)
SELECT CASE WHEN sa > pa + 0.05 * greatest(pa, 1e-6) THEN 'promote' WHEN sa < pa - 0.05 * greatest(pa, 1e-6) THEN 'discard' ELSE 'continue' END AS recommend, pa AS production_avg, sa AS shadow_avg, sa - pa AS improvement, turns FROM a""", d="production_avg shadow_avg improvement")
def _shadow_eval(s, d):
    e = table(s, d, "events").select(F.col("event_id").alias("turn"), F.col("value").cast("double").alias("production"), F.get_json_object("props", "$.k").cast("double").alias("shadow"))
    return tidy(M.shadow_eval(e))


@reg("shadow_log", "SELECT event_id AS turn, 'production' AS arm, value::DOUBLE AS metric FROM events UNION ALL SELECT event_id, 'shadow', json_extract_string(props, '$.k')::DOUBLE FROM events", d="metric")
def _shadow_log(s, d):
    e = table(s, d, "events").select(F.col("event_id").alias("turn"), F.col("value").cast("double").alias("production"), F.get_json_object("props", "$.k").cast("double").alias("shadow"))
    return tidy(e.select("turn", F.explode(F.create_map(F.lit("production"), F.col("production"), F.lit("shadow"), F.col("shadow"))).alias("arm", "metric")))


def _runs(s, d):
    """One run per day of the events table."""
    return table(s, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("run")).agg(F.avg("value").alias("pes"), F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("recall"))


_RUNS = "runs AS (SELECT strftime(ts, '%Y-%m-%d') AS run, avg(value::DOUBLE) AS pes, avg(value::DOUBLE) FILTER (event_type = 'view') AS recall FROM events GROUP BY 1), b AS (SELECT * FROM runs ORDER BY run LIMIT 1)"


@reg("run_compare", f"""WITH {_RUNS} SELECT r.run, 'pes' AS metric, r.pes AS value, r.pes - b.pes AS delta, coalesce(r.pes - b.pes < -1.0, false) AS regression FROM runs r, b
UNION ALL SELECT r.run, 'recall', r.recall, r.recall - b.recall, coalesce(r.recall - b.recall < -1.0, false) FROM runs r, b""", d="value delta")
def _run_compare(s, d):
    return tidy(M.run_compare(checkpointed(_runs(s, d)), "run", ["pes", "recall"]))


@reg("bench_gate", f"WITH {_RUNS} SELECT r.run, CASE WHEN r.pes - b.pes < -5.0 THEN 'REGRESSION' ELSE 'PASS' END AS verdict FROM runs r, b")
def _bench_gate(s, d):
    r = checkpointed(_runs(s, d))
    base = r.orderBy("run").limit(1).select("pes").scalar()
    return tidy(r.withColumn("base", base).select("run", M.bench_gate(F.col("pes"), F.col("base")).alias("verdict")))


@reg("append_history", "SELECT strftime(ts, '%Y-%m-%d') AS \"runName\", epoch_ms(max(ts))::BIGINT // 1000 AS \"timestamp\" FROM events GROUP BY 1 ORDER BY 2 DESC LIMIT 7")
def _append_history(s, d):
    path = scratch(s)
    h = table(s, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("runName")).agg(F.avg("value").alias("pes"), F.lit(1.0).alias("tokPerSec"), F.unix_timestamp(F.max("ts")).alias("timestamp"))
    h = checkpointed(h.select("pes", "tokPerSec", "runName", "timestamp"))
    last = h.orderBy(F.desc("timestamp")).limit(1)
    sinks.append_history(h.join(last.select("runName"), "runName", "left_anti").select("pes", "tokPerSec", "runName", "timestamp"), last, path, 7)
    return tidy(readers.read_bench_history(s, path).select("runName", "timestamp"))


QUERIES["read_bench_history"], ORACLES["read_bench_history"] = QUERIES["append_history"], ORACLES["append_history"]


@reg("resumable_run", "SELECT event_id FROM events WHERE user_id % 3 <> 0")
def _resumable(s, d):
    e = table(s, d, "events")
    return tidy(sinks.resumable_run(e.select("event_id", "user_id"), e.where(F.col("user_id") % 3 == 0), ["event_id"]).select("event_id"))


QUERIES["resume_anti"], ORACLES["resume_anti"] = QUERIES["resumable_run"], ORACLES["resumable_run"]


# ------------------------------------------------------------------ sessions
TOOLS = ["t0", "t1", "t2", "t3", "idle"]


def _records(s, d):
    """Session records from events: clicks call tools, views are results, purchases and errors end turns."""
    e = table(s, d, "events")
    k = F.get_json_object("props", "$.k")
    typ = F.when(F.col("event_type") == "click", "tool/call").when(F.col("event_type") == "view", "tool/result").when(F.col("event_type") == "signup", "assistant/message").otherwise("turn/end")
    data = (
        F.when(F.col("event_type") == "click", F.concat(F.lit('{"name":"t'), (k.cast("int") % 4).cast("string"), F.lit('"}')))
        .when(F.col("event_type") == "view", F.concat(F.lit('{"isError":'), F.when(k.cast("int") % 3 == 0, F.lit("true")).otherwise(F.lit("false")), F.lit("}")))
        .when(F.col("event_type") == "signup", F.concat(F.lit('{"message":{"content":[{"type":"text","text":"got '), k, F.lit(' <b>"},{"type":"x","text":"no"}]}}')))
        .when(F.col("event_type") == "purchase", F.lit('{"reason":{"kind":"completed"}}')).otherwise(F.lit('{"reason":{"kind":"error","error":"boom"}}'))
    )
    return e.select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), F.col("event_id").alias("line_no"), typ.alias("type"), data.alias("data"))


_REC = "rec AS (SELECT 's' || user_id AS session_id, event_id AS line_no, event_type AS et, json_extract_string(props, '$.k')::BIGINT AS k FROM events)"
_TR = f"""{_REC}, cn AS (SELECT *, count(*) FILTER (et = 'click') OVER (PARTITION BY session_id ORDER BY line_no) AS call_no FROM rec WHERE et IN ('click', 'view')),
tr AS (SELECT session_id, call_no, max('t' || (k % 4)) FILTER (et = 'click') AS tool, coalesce(NOT arg_max(k % 3 = 0, line_no) FILTER (et = 'view'), true) AS success FROM cn WHERE call_no > 0 GROUP BY ALL)"""
_EV = f"""{_TR}, ev AS (SELECT r.session_id, count(*) FILTER (et IN ('purchase', 'error')) AS total_turns, bool_or(et = 'purchase') AS completed, count(*) FILTER (et = 'error') AS n_errors FROM rec r GROUP BY 1),
tc AS (SELECT session_id, count(*) AS tool_calls, avg(success::INT) AS rate, array_to_string(list_sort(list(DISTINCT tool)), ',') AS tools_used FROM tr GROUP BY 1),
es AS (SELECT session_id, total_turns, coalesce(tool_calls, 0) AS tool_calls, coalesce(rate, 0.0) AS tool_success_rate, coalesce(tools_used, '') AS tools_used, completed, n_errors FROM ev LEFT JOIN tc USING (session_id))"""


def _evidence(s, d):
    r = _records(s, d)
    return Z.evidence_per_session(r, Z.tool_traces(r))


@reg("tool_traces", f"WITH {_TR} SELECT * FROM tr")
def _tool_traces(s, d):
    return tidy(Z.tool_traces(_records(s, d), block_rows=512))


@reg("evidence_per_session", f"WITH {_EV} SELECT * FROM es", d="tool_success_rate")
def _evidence_per_session(s, d):
    return tidy(_evidence(s, d))


@reg("evidence_summary", f"WITH {_EV} SELECT count(*) AS sessions, count(*) FILTER (completed) AS completed, sum(total_turns) AS total_turns, sum(tool_calls) AS total_tool_calls, round(avg(tool_success_rate), 3) AS avg_success_rate, count(*) FILTER (n_errors > 0) AS sessions_with_errors FROM es", i="total_turns total_tool_calls")
def _evidence_summary(s, d):
    return tidy(Z.evidence_summary(_evidence(s, d)))


@reg("unused_tools", f"WITH {_EV} SELECT session_id, array_to_string(list_sort(list_filter(['t0', 't1', 't2', 't3', 'idle'], lambda t: NOT list_contains(string_split(tools_used, ','), t))), ',') AS unused_tools FROM es")
def _unused_tools(s, d):
    return tidy(Z.unused_tools(_evidence(s, d), TOOLS))


@reg("tool_review", f"WITH {_TR}, st AS (SELECT tool, count(*) AS calls, round(avg(success::INT), 3) AS success_rate FROM tr WHERE tool <> 't3' GROUP BY 1) SELECT tool, calls, success_rate, 'review' AS verdict FROM st WHERE success_rate < 0.5 UNION ALL SELECT 't3', 0, NULL, 'remove'")
def _tool_review(s, d):
    """The fourth tool's calls are left out, so one tool counts as never called."""
    tr = Z.tool_traces(_records(s, d))
    tools = tr.select("tool").distinct()
    return tidy(Z.tool_review(Z.tool_stats(tr.where(F.col("tool") != "t3")), tools).select("tool", "calls", "success_rate", "verdict"))


@reg("candidate_verdict", "WITH a AS (SELECT round(coalesce(avg((event_type <> 'error')::INT) FILTER (event_id % 2 = 0), 0), 3) AS c, round(coalesce(avg((event_type <> 'error')::INT) FILTER (event_id % 2 = 1), 0), 3) AS b FROM events) SELECT c AS candidate_pass_rate, b AS baseline_pass_rate, CASE WHEN c > b THEN 'candidate-wins' WHEN b > c THEN 'baseline-wins' ELSE 'tie' END AS verdict FROM a")
def _candidate_verdict(s, d):
    return tidy(Z.candidate_verdict(table(s, d, "events").select(F.when(F.col("event_id") % 2 == 0, "candidate").otherwise("baseline").alias("arm"), (F.col("event_type") != "error").alias("ok"))))


_KIND = "CASE et WHEN 'click' THEN 'tool/call' WHEN 'view' THEN 'tool/result' WHEN 'signup' THEN 'assistant/message' ELSE 'turn/end' END"


@reg("activity_summary", f"""WITH {_REC}, g AS (SELECT session_id, line_no // 50 AS batch, array_to_string(list(CASE et WHEN 'click' THEN 't' || (k % 4) ELSE 'tool/result' END ORDER BY line_no) FILTER (et IN ('click', 'view')), ', ') AS tools,
 array_to_string(list({_KIND} ORDER BY line_no), ', ') AS kinds FROM rec GROUP BY ALL)
SELECT session_id, batch, CASE WHEN tools IS NOT NULL THEN 'tools: ' || tools ELSE substr(kinds, 1, 120) END AS summary FROM g""")
def _activity_summary(s, d):
    r = _records(s, d).withColumn("batch", F.floor(F.col("line_no") / 50))
    return tidy(Z.activity_summary(r, ["session_id", "batch"]))


@reg("export_session_transcript", f"WITH {_REC} SELECT session_id, line_no, '**Assistant:** got ' || k || ' &lt;b&gt;' || chr(10) AS line FROM rec WHERE et = 'signup'")
def _export_session(s, d):
    return tidy(Z.export_session_transcript(_records(s, d), "curated-context"))


@reg("prior_transcript", f"WITH {_REC} SELECT session_id, line_no, '(continued)' AS \"user\", 'got ' || k || ' <b>' AS reply FROM rec WHERE et = 'signup' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY line_no DESC) <= 10")
def _prior_transcript(s, d):
    return tidy(Z.prior_transcript(_records(s, d)))


@reg("read_session_logs", f"WITH {_REC} SELECT session_id, count(*) AS n, count(*) FILTER (et = 'click') AS calls FROM rec GROUP BY 1")
def _read_session_logs(s, d):
    """Written as one text folder per session with a broken line each, read back."""
    path = scratch(s)
    r = _records(s, d)
    line = F.concat(F.lit('{"type":"'), F.col("type"), F.lit('","data":'), F.col("data"), F.lit("}"))
    broken = r.groupBy("session_id").agg(F.min("line_no").alias("line_no")).withColumn("line", F.lit("{broken"))
    write_frames(r.select("session_id", "line_no", line.alias("line")).unionByName(broken), path, plain=True)
    x = readers.read_session_logs(s, path)
    return tidy(x.groupBy("session_id").agg(F.count("*").alias("n"), F.count_if(F.col("type") == "tool/call").alias("calls")))


@reg("read_session_frames", f"WITH {_REC} SELECT session_id, count(*) AS n, count(*) FILTER (et = 'click') AS calls, count(DISTINCT k % 4) FILTER (et = 'click') AS tools FROM rec GROUP BY 1")
def _read_session_frames(s, d):
    """Written as zstd logs of many frames, read back a few frames a task."""
    path = scratch(s)
    line = F.concat(F.lit('{"type":"'), F.col("type"), F.lit('","data":'), F.col("data"), F.lit("}"))
    write_frames(_records(s, d).select("session_id", "line_no", line.alias("line")), path, frame_lines=100)
    x = readers.read_session_logs(s, path, part_bytes=1 << 16)
    return tidy(x.groupBy("session_id").agg(F.count("*").alias("n"), F.count_if(F.col("type") == "tool/call").alias("calls"), F.count_distinct(F.when(F.col("type") == "tool/call", F.get_json_object("data", "$.name"))).alias("tools")))
