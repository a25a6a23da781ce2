"""Readers.  All take a path (a folder, a file or a glob) and declare their schema."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.functions import fixed as V
from turnloom.functions.text import vocabulary_terms
from turnloom.operators.events import EVENT_SCHEMA
from turnloom.operators.metrics import last_label
from turnloom.sources.framed import read_lines

CONVERSATION_SCHEMA = "conversation_id string, profile string, topic string, turns array<struct<role:string,content:string>>"
RECORD_SCHEMA = (
    "id string, content string, turn int, fingerprint string, timestamp string, decay_multiplier double, times_saved int, "
    "last_referenced_turn int, relevance_history array<array<double>>, embedding array<float>"
)
HISTORY_SCHEMA = "pes double, tokPerSec double, runName string, timestamp long"
TURN = (
    "struct<turn:int,query:string,reply:string,assembled_content:string,mode:string,pes:double,degradation_level:int,"
    "timings:map<string,double>,token_count:int,budget:int,completion_tokens:int,prompt_tokens:int,ttft_probe_ms:double>"
)
REPORT_SCHEMA = (
    "run_id string, mode string, aggregate struct<user_turns:long,conversations:long>, "
    "post_run_pes struct<pes:double,composite:double,band:string>, "
    "retrieval_diagnostic map<string,string>, "
    "protocol array<struct<id:string,title:string,status:string>>, "
    f"conversations array<struct<conversation_id:string,profile:string,turns:array<{TURN}>>>"
)


def read_conversations(spark: SparkSession, path: str, names: str = "*.json") -> DataFrame:
    """Conversations, one or an array of them a file, to one row per message (conv_id, turn, role, text, profile, topic)."""
    d = spark.read.schema(CONVERSATION_SCHEMA).option("pathGlobFilter", names).json(path, multiLine=True)
    m = d.select(
        F.coalesce("conversation_id", F.lit("unknown")).alias("conv_id"), "profile", "topic",
        F.posexplode("turns").alias("turn", "m"),
    )
    return m.select("conv_id", F.col("turn").cast("long").alias("turn"), "m.role", F.col("m.content").alias("text"), "profile", "topic")


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Flat Parquet messages (conv_id, turn, role, text)."""
    return spark.read.parquet(path)


def read_events(spark: SparkSession, log_dir: str, include_archive: bool = False) -> DataFrame:
    """NDJSON event logs, with the gzip archives on request."""
    d = spark.read.schema(EVENT_SCHEMA + ", date date").json(log_dir)
    if include_archive:
        old = spark.read.schema(EVENT_SCHEMA + ", date date").option("pathGlobFilter", "*.gz").json(log_dir.rstrip("/") + "_archive")
        d = d.unionByName(old.select(*d.columns))
    return d


def read_events_by_date(spark: SparkSession, log_dir: str, day: str) -> DataFrame:
    """One day: the ``date`` partition filter prunes the other folders."""
    return read_events(spark, log_dir).where(F.col("date") == F.lit(day).cast("date"))


def read_run_report(spark: SparkSession, path: str) -> DataFrame:
    """Headline fields of nested run reports, one or an array of them a file; missing parts are null."""
    d = spark.read.schema(REPORT_SCHEMA).json(path, multiLine=True)
    rd = F.map_filter("retrieval_diagnostic", lambda k, v: v.rlike(r"^-?[0-9.]+$"))

    def field(suffix):
        hit = F.map_values(F.map_filter(rd, lambda k, v: k.endswith(suffix)))
        return F.get(hit, F.lit(0)).cast("double")

    return d.select(
        F.input_file_name().alias("path"), "run_id", "mode", F.col("aggregate.user_turns").alias("turns"),
        F.col("aggregate.conversations").alias("conversations"), F.col("post_run_pes.pes").alias("pes"),
        F.col("post_run_pes.band").alias("pes_band"), field("retrieval_recall").alias("recall"),
        field("ingestion_rate").alias("ingestion"), field("_ceiling").alias("ceiling"), field("retrieval_precision").alias("precision"),
        F.map_from_entries(F.transform("protocol", lambda p: F.struct(p.id, p.status))).alias("verdicts"),
    )


def read_run_turns(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.schema(REPORT_SCHEMA).json(path, multiLine=True)
    c = d.select("run_id", F.explode("conversations").alias("c"))
    return c.select("run_id", F.col("c.conversation_id").alias("conv_id"), F.explode("c.turns").alias("t")).select("run_id", "conv_id", "t.*")


def run_report_to_conversations(turns: DataFrame) -> DataFrame:
    """Run turns (conv_id, turn, query, reply) to user / assistant messages; blank ones are left out."""
    pair = F.array(
        F.struct(F.lit("user").alias("role"), F.trim("query").alias("text"), F.lit(0).alias("part")),
        F.struct(F.lit("assistant").alias("role"), F.trim("reply").alias("text"), F.lit(1).alias("part")),
    )
    d = turns.select("conv_id", "turn", F.explode(pair).alias("m")).select("conv_id", "turn", "m.*")
    d = d.where(F.coalesce("text", F.lit("")) != "")
    return d.select("conv_id", (F.col("turn") * 2 + F.col("part")).cast("long").alias("turn"), "role", "text")


def read_labels(spark: SparkSession, path: str, schema: str, fallback=None) -> DataFrame:
    """A JSON array of labels, else the rows ``fallback()`` derives."""
    try:
        return spark.read.schema(schema).json(path, multiLine=True)
    except AnalysisException as e:
        if fallback is None or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return fallback()


def read_rater_labels(spark: SparkSession, path: str) -> DataFrame:
    """NDJSON ratings, the last line of an item wins (file order)."""
    d = spark.read.schema("item_id string, label int, query string, chunk string").json(path)
    d = d.withColumn("line_no", F.struct("_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n")))
    return last_label(d)


def read_pairs(spark: SparkSession, path: str, n: int | None = None, order: list[str] | None = None) -> DataFrame:
    d = spark.read.schema("query string, chunk string, relevant boolean").json(path, multiLine=True)
    return d if n is None else d.orderBy(*(order or ["query", "chunk"])).limit(n)


def read_vocab(*names: str, folder: str | None = None, spark: SparkSession | None = None) -> list[str]:
    """Merged, lower-cased, distinct terms; a missing vocabulary is an error.  Small by nature, so a driver list.

    With ``folder`` (which may be on any storage Spark reads) a vocabulary is the file ``<name>.json`` there: one object of names and terms.
    """
    if folder is None:
        return vocabulary_terms(*names, tables=V.VOCABULARIES)
    tables = {}
    for name in names:
        try:
            whole = spark.read.text(f"{folder}/{name}.json", wholetext=True).collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            raise FileNotFoundError(f"vocabulary not found: {name}") from e
        tables[name] = json.loads("".join(r.value for r in whole))
    return vocabulary_terms(*names, tables=tables)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """JSONL archive: malformed lines are skipped, the last record per id wins, missing fields get defaults."""
    d = spark.read.schema(RECORD_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    d = d.where(F.col("id").isNotNull() & F.col("content").isNotNull() & F.col("turn").isNotNull())
    # a file may be split over tasks: its blocks come first, then the line numbers within
    d = d.withColumn("_n", F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))).withColumn("_file", F.col("_metadata.file_path"))
    rn = F.row_number().over(Window.partitionBy("_file", "id").orderBy(F.desc("_n")))
    return with_store_defaults(d.withColumn("_rn", rn).where(F.col("_rn") == 1).drop("_rn", "_n").withColumnRenamed("_file", "archive"))


def with_store_defaults(d: DataFrame) -> DataFrame:
    """Defaults for fields a snapshot may lack."""
    return d.withColumn("fingerprint", F.coalesce("fingerprint", F.lit(""))).withColumn(
        "decay_multiplier", F.coalesce("decay_multiplier", F.lit(1.0))
    ).withColumn("times_saved", F.coalesce("times_saved", F.lit(0)))


def read_ground_truth(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{path}/{t}") for t in ("labels", "decisions", "parameter_versions")}


def read_session_logs(spark: SparkSession, path: str, part_bytes: int = 8 << 20) -> DataFrame:
    """Session logs, one JSON record per line, plain or zstd; malformed lines are skipped.

    A file is read by parts (byte ranges, or the frames of a zstd file), so a large log is many tasks; the parent folder names the session.
    """
    d = read_lines(spark, path, part_bytes).where(F.trim("line") != "")
    d = d.select(F.element_at(F.split("path", "/"), -2).alias("session_id"), "line_no", "line")
    kind = F.get_json_object("line", "$.type")
    return d.select("session_id", "line_no", kind.alias("type"), F.get_json_object("line", "$.data").alias("data")).where(F.col("type").isNotNull())


def read_embedding_cache(spark: SparkSession, path: str, model: str) -> DataFrame:
    """Cached vectors of one model; the ``model`` partition prunes, another model gives no rows."""
    return spark.read.schema("text_md5 string, embedding array<float>, model string").parquet(path).where(F.col("model") == model)


def read_bench_history(spark: SparkSession, path: str) -> DataFrame:
    """The run history; no rows where it is missing or malformed."""
    try:
        d = spark.read.schema(HISTORY_SCHEMA + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path, multiLine=True)
        return d.where(F.col("timestamp").isNotNull()).drop("_bad")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], HISTORY_SCHEMA)


def read_baseline_tps(spark: SparkSession, path: str) -> DataFrame:
    """Measured tokens per second of the rolling baseline, 30.0 where there is none."""
    try:
        d = spark.read.schema("aggregate struct<avg_tokens_per_sec:double>").json(path, multiLine=True)
        v = d.agg(F.first("aggregate.avg_tokens_per_sec", ignorenulls=True).alias("v"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        v = spark.createDataFrame([(None,)], "v double")
    return v.select(F.when(F.coalesce("v", F.lit(0.0)) == 0, V.BASELINE_TPS).otherwise(F.col("v")).alias("baseline_tps"))
