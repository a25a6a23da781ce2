"""A corpus run as stages; each stage reads the Parquet that the one before wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from turnloom.llm.common import shared_folder, table
from turnloom.llm.minhash import near_dedup
from turnloom.llm.packing import pack, pieces
from turnloom.llm.quality import quality_filter
from turnloom.llm.secrets import redact
from turnloom.llm.suffixes import without_repeats


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the adaptive quality rules."""
    return quality_filter(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that near-duplicate links connect: that with the smallest id (five-word shingles, similarity 0.8)."""
    return near_dedup(docs)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 bytes or more that a document with a smaller id has.  Documents that lose all their text go.

    A cut inside a character drops that character.  ``n_chars`` follows the text.
    """
    cut, out = without_repeats(docs, as_text=True)
    changed = F.col(f"{out}.n_removed") > 0
    text = F.when(changed, F.col(f"{out}.kept")).otherwise(F.col("text"))
    gone = changed & (F.col(f"{out}.n_removed") == F.col(f"{out}.n_bytes"))
    return _with_text(cut.where(~gone), docs.columns, text)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each secret replaced by a mask; all documents stay."""
    return _with_text(redact(docs), docs.columns, F.col("text"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and offset."""
    p = pieces(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(p, ["doc_id", "piece"])


def _with_text(df: DataFrame, columns: list[str], text) -> DataFrame:
    """The given columns, with a new text and the length that belongs to it."""
    new = {"text": text, "n_chars": F.when(F.col("n_chars").isNotNull(), F.length(text).cast("long"))}
    return df.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in columns])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("repeats", repeat_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: SQL can't express suffix arrays, minimum hashing and packing; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
