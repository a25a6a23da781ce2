"""Running sums in one shuffle; retention of the event log; array files and vocabularies."""

import datetime as dt
import glob
import random

import pytest
from pyspark.sql import functions as F

from turnloom.operators.ordered import dense_ordinal, exact_quantiles, ranged_running_sum
from turnloom.sources import readers, retention, sinks


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_running_sums_equal_a_loop(spark, parts):
    """A hot key over many ranges, keys of one row, null keys and values, ties, negative values."""
    r = random.Random(parts)
    keys = [None, "hot", "hot", "hot", "hot"] + [f"k{i}" for i in range(30)]
    rows = [(r.choice(keys), i, r.choice([None, -3, 0, 2, 9]), r.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o long, v long, x double").repartition(5)
    out = ranged_running_sum(df, ["k"], ["o"], {"s": F.col("v"), "xs": F.col("x")}, parts)
    assert out.columns == ["k", "o", "v", "x", "s", "xs"]
    got = {x.o: (x.s, x.xs) for x in out.collect()}
    sums = {}
    for k, o, v, x in rows:
        a, b = sums.get(k, (0, 0.0))
        sums[k] = a + (v or 0), b + x
        assert got[o][0] == sums[k][0] and abs(got[o][1] - sums[k][1]) < 1e-9
    assert len(got) == len(rows)


def test_running_sums_of_nothing_and_of_one_key(spark):
    df = spark.createDataFrame([], "k string, o long")
    assert ranged_running_sum(df, ["k"], ["o"], {"n": F.lit(1)}).collect() == []
    one = spark.range(500).select(F.lit(0).alias("k"), F.col("id").alias("o"))
    assert [x.ordinal for x in dense_ordinal(one, ["k"], ["o"]).orderBy("o").collect()] == list(range(500))
    assert exact_quantiles(one, [], "o", {"m": 0.5}).collect()[0].m == 249.5


def test_running_sums_shuffle_their_rows_once(spark):
    """The rows' one exchange comes before the checkpoint; after it there is only the one of a row a range."""
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"))
    p = ranged_running_sum(df, ["k"], ["o"], {"n": F.lit(1)})._jdf.queryExecution().sparkPlan().toString()
    rows_side = p.split("BroadcastHashJoin")[1].split("Scan ExistingRDD")[0]
    assert "Window" not in rows_side and "Aggregate" not in rows_side and "SortMergeJoin" not in p



def write_log(spark, path, *days):
    for d in days:
        spark.createDataFrame([(f"c{i}",) for i in range(3)], "component string").withColumn("date", F.lit(f"2024-01-{d:02d}")).coalesce(1).write.mode("append").partitionBy("date").json(path)


def files(path, end):
    return sorted(glob.glob(f"{path}/date=*/**/*{end}", recursive=True))


def test_rotation_moves_settled_and_full_days(spark, tmp_path):
    log, old = str(tmp_path / "log"), str(tmp_path / "log_archive")
    today = dt.date(2024, 1, 5)
    assert retention.rotate_events(spark, log, old, today) == retention.Rotated(0, 0, 0)
    assert retention.prune_events(spark, old, today, 1) == 0
    write_log(spark, log, 1, 2, 2, 5)
    assert retention.rotate_events(spark, log, old, today) == retention.Rotated(3, 2, 0)
    assert len(files(log, ".json")) == 1 and len(files(old, ".gz")) >= 2
    assert retention.rotate_events(spark, log, old, today) == retention.Rotated(0, 0, 0)
    assert readers.read_events(spark, log, include_archive=True).count() == 12
    # today's file is large enough
    assert retention.rotate_events(spark, log, old, today, max_bytes=1).files == 1
    assert files(log, ".json") == [] and readers.read_events(spark, old).count() == 12
    assert retention.prune_events(spark, old, today, 3) == len([1])
    assert retention.prune_events(spark, old, today, 3) == 0
    assert readers.read_events(spark, old).where("date = '2024-01-01'").count() == 0 and readers.read_events(spark, old).count() == 9
    assert glob.glob(f"{old}/_*") == []


def test_what_a_lost_run_archived_is_not_archived_again(spark, tmp_path):
    import shutil

    log, old, copy = (str(tmp_path / x) for x in ("log", "log_archive", "copy"))
    write_log(spark, log, 1)
    shutil.copytree(log, copy)
    retention.rotate_events(spark, log, old, dt.date(2024, 1, 5))
    # as if the run had ended before it removed the files; a late file has come in since
    shutil.copytree(copy, log, dirs_exist_ok=True)
    write_log(spark, log, 1)
    assert retention.rotate_events(spark, log, old, dt.date(2024, 1, 5)) == retention.Rotated(1, 1, 1)
    assert files(log, ".json") == [] and readers.read_events(spark, old).count() == 6


def test_array_files_and_vocabularies(spark, tmp_path):
    df = spark.createDataFrame([(1, i, f"q{i}", "c", i % 2 == 0) for i in range(10)], "k long, o long, query string, chunk string, relevant boolean")
    sinks.write_json_arrays(df, str(tmp_path / "p"), ["k"], "o", 4)
    got = readers.read_pairs(spark, str(tmp_path / "p"))
    assert sorted((r.query, r.relevant) for r in got.collect()) == [(f"q{i}", i % 2 == 0) for i in range(10)]
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "a.json").write_text('{"domain": "Code",\n "terms": ["Loop", "tail call"]}')
    assert readers.read_vocab("a", folder=str(tmp_path / "v"), spark=spark) == ["tail call", "code", "loop"]
    with pytest.raises(FileNotFoundError):
        readers.read_vocab("b", folder=str(tmp_path / "v"), spark=spark)


def test_small_documents_share_array_files(spark, tmp_path):
    df = spark.createDataFrame([(k, o, f"q{k}", f"c{o}", None) for k in range(200) for o in range(3)], "k long, o long, query string, chunk string, relevant boolean")
    sinks.write_json_arrays(df.repartition(8), str(tmp_path / "p"), ["k"], "o", 2)
    # a file a task at most, as all is small; before, a file for each key and part
    assert 0 < len(list((tmp_path / "p").glob("*.txt"))) <= 8
    assert sorted((r.query, r.chunk) for r in readers.read_pairs(spark, str(tmp_path / "p")).collect()) == sorted((r.query, r.chunk) for r in df.collect())
    doc = spark.range(100).select(F.format_string('{"conversation_id":"c%d","turns":[{"role":"user","content":"a\\n[b],"}]}', "id").alias("value"))
    sinks.write_documents(doc.coalesce(1), str(tmp_path / "c"), 1000)
    assert 5 < len(list((tmp_path / "c").glob("*.txt"))) < 20
    got = readers.read_conversations(spark, str(tmp_path / "c"), "*.txt").collect()
    assert {r.conv_id for r in got} == {f"c{i}" for i in range(100)} and {(r.turn, r.text) for r in got} == {(0, "a\n[b],")} and len(got) == 100
    sinks.write_documents(doc.limit(0), str(tmp_path / "none"))
    assert readers.read_conversations(spark, str(tmp_path / "none"), "*.txt").count() == 0
