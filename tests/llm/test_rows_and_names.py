"""Rows that share an id, and extra columns named like the operators' own."""

from pyspark.sql import functions as F

from tests.llm.conftest import prose
from turnloom.llm.minhash import near_dedup
from turnloom.llm.quality import quality_filter


def test_near_dedup_drops_rows_not_ids(spark):
    a, b = prose(1, 100), prose(2, 100)
    df = spark.createDataFrame([(1, a, 0), (5, a, 1), (5, b, 2), (7, b, 3)], "doc_id long, text string, n int")
    assert sorted(r["n"] for r in near_dedup(df).collect()) == [0, 2]


def test_columns_named_like_internal_ones(spark):
    df = spark.createDataFrame([(i, prose(i % 3, 100), "en", "s") for i in range(6)], "doc_id long, text string, lang string, source string")
    for n in ("lang_", "source_", "salt_", "fences_", "salt", "kept", "measures", "_gone", "gone id", "gone text", "text_hash", "sig", "low", "node", "c1", "n", "label", "a", "b"):
        df = df.withColumn(n, F.lit(7))
    q = quality_filter(df)
    assert q.columns == df.columns and q.count() == 6 and {r["fences_"] for r in q.collect()} == {7}
    d = near_dedup(df)
    assert d.columns == df.columns and sorted(r["doc_id"] for r in d.collect()) == [0, 1, 2]
