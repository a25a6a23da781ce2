"""Shape of the physical plans."""

import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from turnloom.functions import text as T
from turnloom.operators import labels as L

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["candidates", "assemble", "archive_retrieve", "duplicate_pairs", "paired_arms", "event_summary", "threshold_curve", "replay_decay"])
def test_no_cross_joins(spark, name):
    p = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_candidates_join_on_conversation_and_block(spark):
    p = plan(entry.queries()["candidates"](spark, SF))
    assert "Join [conv_id" in p and "_blk" in p


def test_scan_reads_needed_columns_only(spark):
    p = plan(entry.queries()["is_hedge"](spark, SF))
    assert "role" not in p.split("ReadSchema")[1]


def test_filters_reach_the_scan(spark):
    p = plan(entry.queries()["user_queries"](spark, SF))
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,user)]" in p


def test_a_texts_terms_are_found_once_for_all_its_sentences(spark):
    df = spark.createDataFrame([("alpha beta", "It has alpha. The with this!\nNothing here\n ", 1), ("with this", "alpha.", 2), (None, None, 3)], "q string, c string, k int")
    got = df.select("k", T.turn_precision(F.col("q"), F.col("c")).alias("p"))
    assert {r.k: r.p for r in got.collect()} == {1: 1 / 3, 2: None, 3: None}
    # the query's words and a sentence's, each named once in the plan
    assert got._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") == 2


def test_words_are_drawn_before_the_vocabulary_is_asked(spark):
    d = L.mlm_mask(spark.createDataFrame([(1, "an array of code")], "k long, text string"), "k", targeted=True).select("masked")
    p = d._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < p.index("md5(") < p.index("exists(")


def test_the_reasons_of_a_route_are_found_once(spark):
    p = entry.queries()["router_score"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("how does [") == 1
