"""Writers."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import routing as R
from turnloom.operators.events import shape_events
from turnloom.operators.metrics import append_history as _append

SAFE_TAG = re.compile(r"^[A-Za-z0-9_.\-]+$")


def write_events(df: DataFrame, log_dir: str, max_records: int = 0) -> None:
    """Redact, stamp, round, and append to one folder per UTC day."""
    w = shape_events(df).write.mode("append").partitionBy("date")
    if max_records:
        w = w.option("maxRecordsPerFile", max_records)
    w.json(log_dir)


def write_baseline_report(per_conv: DataFrame, aggregate: DataFrame, path: str, mode: str, max_context: int = 32768) -> None:
    """Per-conversation rows beside a one-row aggregate document."""
    per_conv.write.mode("overwrite").json(f"{path}/conversations")
    aggregate.withColumn("type", F.lit("baseline")).withColumn("mode", F.lit(mode)).withColumn(
        "max_context", F.lit(max_context)
    ).withColumn("recorded_at", F.current_timestamp()).write.mode("overwrite").json(f"{path}/aggregate")


def write_run_report(blocks: dict[str, DataFrame], path: str) -> None:
    """Each block of a run as its own Parquet table."""
    for name, df in blocks.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def check_tag(tag: str) -> str:
    if not tag or not SAFE_TAG.match(tag):
        raise ValueError(f"unsafe checkpoint tag: {tag!r}")
    return tag


def save_store(chunks: DataFrame, path: str, tag: str) -> None:
    """Snapshot of the chunk state under a tag, spread by conversation."""
    chunks.write.mode("overwrite").parquet(f"{path}/tag={check_tag(tag)}")


def load_store(spark, path: str, tag: str) -> DataFrame:
    d = spark.read.parquet(f"{path}/tag={check_tag(tag)}")
    for name, default in (("decay_multiplier", 1.0), ("times_saved", 0), ("fingerprint", "")):
        d = d.withColumn(name, F.coalesce(name, F.lit(default)) if name in d.columns else F.lit(default))
    return d


def auto_checkpoint(state: DataFrame, path: str, stamp: str, prefix: str = "pes") -> None:
    """Keep only conversations in good health (PES > 80), tagged with the rounded score."""
    tag = F.format_string(f"{check_tag(prefix)}_%.0f_{check_tag(stamp)}", F.col("pes"))
    state.where(F.col("pes") > 80).withColumn("tag", tag).write.mode("append").partitionBy("tag").parquet(path)


def list_checkpoints(spark, path: str) -> DataFrame:
    """The saved tags, read from the partition folders alone."""
    return spark.read.parquet(path).select("tag").distinct().orderBy("tag")


def write_documents(values: DataFrame, path: str, file_chars: int = 4 << 20) -> None:
    """Write JSON documents (column ``value``) as files of one JSON array each, a file per ``file_chars`` characters or a little more.

    The number of files grows with the text, not with the documents.  A document that is itself an array gives its elements.
    """

    def pack(batches):
        held, size = [], 0

        def array():
            return pa.RecordBatch.from_arrays([pa.array(["[" + ",".join(held) + "]"], pa.string())], ["value"])

        for b in batches:
            for v in b.column(0):
                doc = v.as_py()
                doc = doc[1:-1] if doc.startswith("[") else doc
                if doc:
                    held.append(doc)
                    size += len(doc)
                if size >= file_chars:
                    yield array()
                    held, size = [], 0
        if held:
            yield array()

    values.select("value").mapInArrow(pack, "value string").write.option("maxRecordsPerFile", 1).mode("overwrite").text(path)


def write_json_arrays(df: DataFrame, path: str, keys: list[str], order: str, rows: int = 1024) -> None:
    """JSON array files, as label and pair files have them; at most ``rows`` values of ``order`` of a key are put together at once."""
    cells = F.array_sort(F.collect_list(F.struct(order, *[c for c in df.columns if c != order])))
    write_documents(df.groupBy(*keys, F.floor(F.col(order) / rows).alias("_part")).agg(F.to_json(cells).alias("value")), path)


def write_archive(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def flush_archive(records: DataFrame, path: str) -> None:
    """Compaction: one record per id, sorted by id within conversations."""
    records.repartition("conv_id").sortWithinPartitions("conv_id", "chunk_id").write.mode("overwrite").json(path)


def persist_embeddings(vectors: DataFrame, path: str, model: str) -> None:
    """Append (text_md5, embedding) under a folder per model."""
    safe = re.sub(r"[^A-Za-z0-9_.\-]", "_", model or "default")
    vectors.select("text_md5", F.col("embedding").cast("array<float>").alias("embedding"), F.lit(safe).alias("model")).write.mode(
        "append"
    ).partitionBy("model").parquet(path)


def write_ground_truth(path: str, labels: DataFrame | None = None, routes: DataFrame | None = None, versions: DataFrame | None = None) -> None:
    """Append judge labels, route decisions (with outcome) and parameter versions."""
    if labels is not None:
        labels.write.mode("append").parquet(f"{path}/labels")
    if routes is not None:
        out = F.when(R.route_for(F.col("score")) == F.col("optimal"), "correct").otherwise("wrong")
        routes.withColumn("decision_type", F.lit("route")).withColumn("outcome", out).write.mode("append").parquet(f"{path}/decisions")
    if versions is not None:
        versions.write.mode("append").parquet(f"{path}/parameter_versions")


def write_labels(sets: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Each label set as JSON; gives back the row counts."""
    counts = {}
    for name, df in sets.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
        counts[name] = df.sparkSession.read.json(f"{path}/{name}").count()
    return counts


def append_history(history: DataFrame, entry: DataFrame, path: str, keep: int = 30) -> None:
    """The newest ``keep`` runs as one JSON array, the layout ``read_bench_history`` expects."""
    newest = _append(history, entry, keep)
    cells = F.array_sort(F.collect_list(F.struct("timestamp", *[c for c in newest.columns if c != "timestamp"])))
    newest.agg(F.to_json(cells).alias("value")).write.mode("overwrite").text(path)


def resumable_run(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work not yet written: what ``done`` holds is skipped."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def export_text(lines: DataFrame, column: str, path: str) -> None:
    lines.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


