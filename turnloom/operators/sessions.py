"""Session evidence, transcripts and stored-turn exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.operators.metrics import ratio
from turnloom.operators.ordered import running

BLOCKS = "array<struct<type:string,text:string>>"


def _get(path: str):
    return F.get_json_object("data", path)


def tool_traces(records: DataFrame, line: str = "line_no", block_rows: int = 65536) -> DataFrame:
    """One row per tool call: its tool and whether it succeeded.

    A result belongs to the latest call before it; the last result of a call
    decides, and a call without one counts as a success.
    """
    r = records.where(F.col("type").isin("tool/call", "tool/result"))
    is_call = (F.col("type") == "tool/call").cast("int")
    r = running(r, ["session_id"], line, {"call_no": ("sum", is_call)}, block_rows=block_rows)
    name = F.coalesce(_get("$.name"), _get("$.tool"), F.lit("?"))
    failed = F.coalesce(_get("$.isError") == "true", F.lit(False))
    g = r.where(F.col("call_no") > 0).groupBy("session_id", "call_no").agg(
        F.max(F.when(F.col("type") == "tool/call", name)).alias("tool"),
        F.max_by(F.when(F.col("type") == "tool/result", failed), F.when(F.col("type") == "tool/result", F.col(line))).alias("failed"),
    )
    return g.select("session_id", "call_no", "tool", (~F.coalesce("failed", F.lit(False))).alias("success"))


def evidence_per_session(records: DataFrame, traces: DataFrame) -> DataFrame:
    tools = traces.groupBy("session_id").agg(
        F.count("*").alias("tool_calls"), F.count_if("success").alias("ok"), F.array_sort(F.collect_set("tool")).alias("tools_used")
    )
    reason = _get("$.reason.kind")
    end = F.col("type") == "turn/end"
    turns = records.groupBy("session_id").agg(
        F.count_if(end).alias("total_turns"),
        F.coalesce(F.max(end & (reason == "completed")), F.lit(False)).alias("completed"),
        F.count_if(end & (reason == "error")).alias("n_errors"),
    )
    j = turns.join(tools, "session_id", "left")
    calls = F.coalesce("tool_calls", F.lit(0))
    return j.select(
        "session_id", "total_turns", calls.alias("tool_calls"), ratio(F.col("ok"), F.col("tool_calls")).alias("tool_success_rate"),
        F.coalesce("tools_used", F.array().cast("array<string>")).alias("tools_used"), "completed", "n_errors",
    )


def unused_tools(evidence: DataFrame, all_tools: list[str]) -> DataFrame:
    return evidence.select("session_id", F.array_sort(F.array_except(T.string_list(all_tools), "tools_used")).alias("unused_tools"))


def tool_stats(traces: DataFrame) -> DataFrame:
    return traces.groupBy("tool").agg(F.count("*").alias("calls"), F.round(F.count_if("success") / F.count("*"), 3).alias("success_rate"))


def evidence_summary(evidence: DataFrame) -> DataFrame:
    return evidence.agg(
        F.count("*").alias("sessions"), F.count_if("completed").alias("completed"), F.sum("total_turns").alias("total_turns"),
        F.sum("tool_calls").alias("total_tool_calls"), F.round(F.avg("tool_success_rate"), 3).alias("avg_success_rate"),
        F.count_if(F.col("n_errors") > 0).alias("sessions_with_errors"),
    )


def tool_review(stats: DataFrame, all_tools: DataFrame | None = None) -> DataFrame:
    """Tools to review (success < 0.5) and, given the full list, those never called."""
    d = stats if all_tools is None else all_tools.join(stats, "tool", "left")
    calls = F.coalesce("calls", F.lit(0))
    verdict = F.when(calls == 0, "remove").when(F.col("success_rate") < 0.5, "review")
    return d.withColumn("calls", calls).withColumn("verdict", verdict).where(F.col("verdict").isNotNull())


def candidate_verdict(runs: DataFrame) -> DataFrame:
    """Pass rate of the candidate against the baseline arm (arm, ok)."""
    s = runs.agg(
        *[F.round(F.coalesce(F.avg(F.when(F.col("arm") == a, F.col("ok").cast("double"))), F.lit(0.0)), 3).alias(f"{a}_pass_rate") for a in ("candidate", "baseline")]
    )
    c, b = F.col("candidate_pass_rate"), F.col("baseline_pass_rate")
    return s.withColumn("verdict", F.when(c > b, "candidate-wins").when(b > c, "baseline-wins").otherwise("tie"))


def activity_summary(records: DataFrame, batch: list[str], line: str = "line_no") -> DataFrame:
    """One line per batch of session events: the tool names, else a preview.

    Batches are the notification batches of a client, small by nature.
    """
    shaped = F.when(F.col("type").startswith("tool/"), F.coalesce(_get("$.name"), _get("$.tool"), F.col("type")))
    tools = F.transform(F.array_sort(F.collect_list(F.when(shaped.isNotNull(), F.struct(F.col(line).alias("l"), shaped.alias("t"))))), lambda x: x.t)
    kinds = F.transform(F.array_sort(F.collect_list(F.struct(F.col(line).alias("l"), F.col("type").alias("t")))), lambda x: x.t)
    g = records.groupBy(*batch).agg(tools.alias("tools"), kinds.alias("kinds"))
    preview = F.substring(F.concat_ws(", ", "kinds"), 1, 120)
    return g.select(*batch, F.when(F.size("tools") > 0, F.concat(F.lit("tools: "), F.concat_ws(", ", "tools"))).otherwise(preview).alias("summary"))


def _block_text(path: str):
    blocks = F.from_json(_get(path), BLOCKS)
    return F.array_join(F.transform(F.filter(blocks, lambda b: b.type == "text"), lambda b: F.coalesce(b.text, F.lit(""))), "")


def session_messages(records: DataFrame) -> DataFrame:
    """User and assistant texts of session records."""
    text = F.when(F.col("type") == "user/message", _block_text("$.content")).when(F.col("type") == "assistant/message", _block_text("$.message.content"))
    d = records.withColumn("text", T.strip(text)).where(T.text_or_empty(F.col("text")) != "")
    return d.select("session_id", "line_no", F.split("type", "/")[0].alias("role"), "text")


def export_session_transcript(records: DataFrame, context_mark: str) -> DataFrame:
    """Markdown lines of a session; messages that carry injected context are left out."""
    m = session_messages(records).where((F.col("role") != "user") | ~F.contains("text", F.lit(context_mark)))
    who = F.when(F.col("role") == "user", "**User:** ").otherwise("**Assistant:** ")
    return m.select("session_id", "line_no", F.concat(who, T.html_escape(F.col("text")), F.lit("\n")).alias("line"))


def prior_transcript(records: DataFrame, n: int = 10, cut: int = 400) -> DataFrame:
    """The last ``n`` replies of a session, cut to ``cut`` characters; the asking side reads "(continued)"."""
    m = session_messages(records).where(F.col("role") == "assistant")
    rn = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("line_no")))
    m = m.withColumn("_rn", rn).where(F.col("_rn") <= n)
    return m.select("session_id", "line_no", F.lit("(continued)").alias("user"), F.substring("text", 1, cut).alias("reply"))


def export_transcript(chunks: DataFrame) -> DataFrame:
    """Markdown per turn: the first chunk is the query, the last later one the reply."""
    g = chunks.groupBy("conv_id", "user_turn").agg(
        F.min_by("content", "seq").alias("q"), F.max_by("content", "seq").alias("r"), F.count("*").alias("n")
    )
    reply = F.when((F.col("n") > 1) & (F.col("r") != ""), F.concat(F.lit("\n\n**Assistant:** "), T.html_escape(F.col("r")))).otherwise("")
    md = F.concat(F.lit("## Turn "), F.col("user_turn").cast("string"), F.lit("\n**User:** "), T.html_escape(F.col("q")), reply, F.lit("\n"))
    return g.select("conv_id", "user_turn", md.alias("markdown"))


def store_state(chunks: DataFrame, archived: DataFrame | None = None) -> DataFrame:
    s = chunks.groupBy("conv_id").agg(F.max("user_turn").alias("turn"), F.count("*").alias("live_chunks"), F.sum("tokens").alias("live_tokens"))
    if archived is None:
        return s
    a = archived.groupBy("conv_id").agg(F.count("*").alias("archived_chunks"))
    return s.join(a, "conv_id", "left").withColumn("archived_chunks", F.coalesce("archived_chunks", F.lit(0)))


def probe_status(probes: DataFrame) -> DataFrame:
    """EMPTY / PASS and token rates of recorded model probes (reply, completion_tokens, effective_s, decode_s, max_tokens)."""
    tok = F.col("completion_tokens")
    empty = T.strip(T.text_or_empty(F.col("reply"))) == ""
    return probes.withColumn("effective_tps", F.round(F.when(tok > 0, tok / F.greatest("effective_s", F.lit(1e-6))), 1)).withColumn(
        "decode_tps", F.round(F.when((tok > 0) & F.col("decode_s").isNotNull(), tok / F.greatest("decode_s", F.lit(1e-6))), 1)
    ).withColumn("status", F.when(empty, "EMPTY").otherwise("PASS")).withColumn(
        "hit_cap", empty & (tok >= F.col("max_tokens"))
    )


def throughput_ratio(rows: DataFrame) -> DataFrame:
    return rows.groupBy("engine").agg((F.sum("tokens") / F.sum("seconds")).alias("tokens_per_second"))


def cache_stats(lookups: DataFrame) -> DataFrame:
    return lookups.agg(
        F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"),
        ratio(F.count_if("hit"), F.count("*")).alias("hit_rate"), F.count_distinct("text_md5").alias("size"),
    )


def cache_lookup(texts: DataFrame, cache: DataFrame, encoder=None, dims: int = 64) -> DataFrame:
    """Embed only texts the cache lacks, each distinct text once; ``texts`` has (text)."""
    from turnloom.functions.vectors import embed_text

    keyed = texts.select(T.content_key(F.col("text")).alias("text_md5"), "text")
    new = keyed.join(cache.select("text_md5"), "text_md5", "left_anti").groupBy("text_md5").agg(F.first("text").alias("text"))
    return new.select("text_md5", embed_text(F.col("text"), encoder, dims).alias("embedding"))


