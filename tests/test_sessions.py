"""Event sessions with typed state: batching, resets, repeated events."""

import uuid

import pytest

from turnloom.config import Settings
from turnloom.streaming.sessions import keep_typed_state, session_stream

EVENTS = [
    ("c", 1, "observe", "an early reply with words"), ("c", 2, "curate", "alpha beta gamma"), ("c", 3, "observe", "alpha beta gamma delta river"),
    ("c", 4, "observe", "alpha beta gamma delta river"), ("c", 5, "curate", "  "), ("c", 6, "curate", "alpha beta gamma?"), ("c", 7, "observe", "I do not have enough information."),
    ("c", 8, "reset", None), ("c", 9, "curate", "alpha beta"), ("c", 10, "observe", None), ("c", 11, "other", "x"), ("c", 12, "curate", "alpha river"),
    ("d", 1, "reset", None), ("d", 2, "curate", "stone"), ("d", 2, "curate", "stone"), ("d", 3, "curate", "stone"),
]


@pytest.fixture(autouse=True, scope="module")
def one_partition(spark):
    """Small batches: one task each, so that many of them don't take long."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def run(spark, tmp_path, lots, **kw):
    keep_typed_state(spark)
    src, name = str(tmp_path / uuid.uuid4().hex), "s" + uuid.uuid4().hex
    schema = "conv_id string, event_no long, kind string, text string"
    for lot in lots:
        spark.createDataFrame(lot, schema).coalesce(1).write.mode("append").json(src)
    st = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(src)
    q = session_stream(st, Settings(fixed_budget=100, max_chunks=3), **kw).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(map(tuple, spark.table(name).collect()), key=lambda r: (r[0], r[1]))


@pytest.fixture(scope="module")
def whole(spark, one_partition, tmp_path_factory):
    return run(spark, tmp_path_factory.mktemp("whole"), [EVENTS[::-1]])


def test_outcomes_epochs_and_turns(whole):
    assert [(r[1], r[3], r[4], r[5], r[6]) for r in whole if r[0] == "c"] == [
        (1, "stored", 0, 0, 1), (2, "handed out", 0, 1, 2), (3, "stored", 0, 1, 3), (4, "known", 0, 1, 3), (5, "rejected", 0, 1, 3), (6, "handed out", 0, 2, 3),
        (7, "left out", 0, 2, 3), (8, "reset", 1, 0, 0), (9, "handed out", 1, 1, 1), (10, "left out", 1, 1, 1), (11, "ignored", 1, 1, 1), (12, "handed out", 1, 2, 2),
    ]
    got = {(r[0], r[1]): r[10] for r in whole}
    # nothing of before a reset is handed out after it
    assert got["c", 9] == [] and len(got["c", 6]) == 3 and len(got["c", 12]) == 1


def test_single_events_a_batch_and_repeated_delivery_give_the_same(spark, tmp_path, whole):
    assert run(spark, tmp_path, [EVENTS[:7], [EVENTS[7]], [EVENTS[8]], EVENTS[5:]]) == whole


def test_idle_state_may_expire(spark, tmp_path, whole):
    # expiry asks for batches without data, which a query that ends with its input doesn't do
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        assert run(spark, tmp_path, [EVENTS], idle_ms=3_600_000) == whole
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_repetition_in_a_batch_keeps_the_first_number_once(whole):
    assert [r[1] for r in whole if r[0] == "d"] == [1, 2, 3]
