"""Files read by parts equal files read as a whole."""

import json
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from turnloom.sources import framed, readers


def logs(seed):
    """Lines of all lengths, with blank ones, long ones, wide characters and one without its end."""
    r = random.Random(seed)
    lines = [json.dumps({"type": r.choice(["a", "b"]), "data": "é€𝄞x"[r.randrange(4)] * r.choice([0, 1, 5, 400])}, ensure_ascii=False) for _ in range(200)]
    lines[5], lines[9], lines[-1] = "", "not json", '{"type": "end", "data": "no line feed"}'
    return "\n".join(lines).encode()


def packed(raw, step):
    """Frames that end anywhere, a frame to skip between them, one with and one without checksum and size."""
    out = []
    for i in range(0, len(raw), step):
        c = zstandard.ZstdCompressor(write_checksum=i % 2 == 0, write_content_size=i % 3 == 0)
        out += [c.compress(raw[i : i + step]), b"\x53\x2a\x4d\x18\x03\x00\x00\x00abc"]
    return b"".join(out)


@pytest.mark.parametrize("part_bytes", [1, 333, 1 << 20])
def test_lines_over_part_ends(spark, tmp_path, part_bytes):
    raw = {"s1": logs(1), "s2": logs(2), "s3": b"", "s4": b"\n\n", "s5": b"x" * 3000}
    for i, (name, b) in enumerate(raw.items()):
        (tmp_path / name).mkdir()
        (tmp_path / name / ("l.jsonl" if name == "s1" else "l.zst")).write_bytes(b[: 900 if part_bytes == 1 else None] if name == "s1" else packed(b, 77 if i == 1 else 999))
    got = {(r.path.rsplit("/", 2)[-2], r.line_no): r.line for r in framed.read_lines(spark, str(tmp_path), part_bytes).collect()}
    want = {}
    for name, b in raw.items():
        b = b[:900] if name == "s1" and part_bytes == 1 else b
        want |= {(name, n): x.decode("utf-8", "replace") for n, x in enumerate(b.split(b"\n")) if x}
    assert got == want


def test_one_log_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "l.zst").write_bytes(packed(logs(3) * 20, 5000))
    parts = framed.file_parts(spark, str(tmp_path), 1).withColumn("before", F.lit(0).cast("long")).repartition(8, "path", "part")
    assert framed.line_pieces(parts).select(F.spark_partition_id().alias("p")).distinct().count() > 4
    log = readers.read_session_logs(spark, str(tmp_path), 1)
    assert log.columns == ["session_id", "line_no", "type", "data"] and {r.session_id for r in log.collect()} == {"s"}


def test_a_cut_file_gives_what_can_be_read(spark, tmp_path):
    for name, b in {"cut": packed(b"one\ntwo\n", 4)[:-13], "more": packed(b"one\ntwo\n", 4) + b"junk after frames"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "l.zst").write_bytes(b)
    assert {(r.path.rsplit("/", 2)[-2], r.line) for r in framed.read_lines(spark, str(tmp_path), 1).collect()} == {(n, x) for n in ("cut", "more") for x in ("one", "two")}


def test_written_frames_are_read_back(spark, tmp_path):
    rows = [(f"s{i % 3}", i // 3, "é" * (i % 50) + str(i)) for i in range(3000)]
    path = str(tmp_path / "logs")
    framed.write_frames(spark.createDataFrame(rows, "session_id string, line_no long, line string").repartition(7), path, frame_lines=10, file_lines=400)
    files = [p for p in (tmp_path / "logs").rglob("*") if p.is_file()]
    assert len(files) == 9 and all(p.suffix == ".zst" for p in files)
    got = [(r.path.rsplit("/", 2)[-2], int(r.path.rsplit("/", 1)[-1].split(".")[0]) * 400 + r.line_no, r.line) for r in framed.read_lines(spark, path, 1).collect()]
    assert sorted(got) == sorted(rows)


def test_folders_are_listed_by_tasks(spark, tmp_path):
    for name in ("a/x.jsonl", "a/b/y.jsonl", "_c/z.jsonl", "a/.h.jsonl", "a/_u.jsonl", "d e/ü%20.jsonl", "top.jsonl"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name + "\n")
    want = {"a/x.jsonl", "a/b/y.jsonl", "d e/ü%20.jsonl", "top.jsonl"}
    got = framed.read_lines(spark, str(tmp_path))
    # before, Spark's driver held the list of files
    assert "binaryFile" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.line for r in got.collect()} == want
    assert {r.line for r in framed.read_lines(spark, f"{tmp_path}/a/*").collect()} == {"a/x.jsonl", "a/b/y.jsonl"}
    assert [r.line for r in framed.read_lines(spark, f"file:{tmp_path}/top.jsonl").collect()] == ["top.jsonl"]


def test_written_logs_are_read_back(spark, tmp_path):
    rows = [(f"s{i % 3}", i // 3, "é" * (i % 50) + str(i)) for i in range(3000)]
    framed.write_frames(spark.createDataFrame(rows, "session_id string, line_no long, line string").repartition(7), str(tmp_path), plain=True)
    assert sorted(p.name for p in tmp_path.rglob("*.*")) == ["0.jsonl"] * 3
    for part_bytes in (1 << 20, 5000):
        assert sorted((r.path.rsplit("/", 2)[-2], r.line_no, r.line) for r in framed.read_lines(spark, str(tmp_path), part_bytes).collect()) == sorted(rows)
