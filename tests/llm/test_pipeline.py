"""The pipeline against a plain version of its five stages, and the entry's guard."""

import math
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.conftest import frame, prose
from tests.llm.test_duplicates import plain_components
from tests.llm.test_quality_packing_tokens import plain_measures
from turnloom.llm import common, packing, quality, secrets

ROOT = Path(__file__).resolve().parents[2]


def plain_quality(rows):
    """All groups are below 100 rows here, so all take the thresholds of the whole table."""
    def rates(m):
        n, chars, sym, lines, dup, rep = m
        return [chars * 100 // n, sym * 1000 // n, dup * 1000 // lines, rep * 1000 // n]

    got = {i: plain_measures(t) for i, t in rows}
    ok = {i: rates(m) for i, m in got.items() if m[0] >= 50 and 100 * m[5] <= 50 * m[0]}
    kept = set(ok)
    for k, (tail, floor, two) in enumerate([(0.9, 10, True), (0.75, 25, False), (0.95, 45, False), (0.95, 25, False)]):
        v = sorted(x[k] - x[k] % (1 << max(0, x[k].bit_length() - 7)) for x in ok.values())
        q = {s: v[max(1, math.ceil(len(v) * s)) - 1] for s in (0.1, 0.5, tail)}
        hi, lo = q[0.5] + 8 * max(q[tail] - q[0.5], floor), q[0.5] - 8 * max(q[0.5] - q[0.1], floor)
        kept = {i for i in kept if ok[i][k] <= hi and (not two or ok[i][k] >= lo)}
    return [(i, t) for i, t in rows if i in kept]


def plain_cut(rows):
    seen, out = {}, []
    for i, t in sorted(rows):
        b = t.encode()
        cover = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if seen.setdefault(b[p : p + 50], i) < i:
                cover[p : p + 50] = True
        left = bytes(np.frombuffer(b, np.uint8)[~cover])
        if left or not cover.any():
            out.append((i, left.decode("utf-8", "ignore")))
    return out


def plain_redacted(t):
    for a, _, z in reversed(merged(secrets.Scanner().spans(t.encode()))):
        t = t[:a] + "[SECRET]" + t[z:]
    return t


def merged(spans):
    out = []
    for a, k, z in spans:
        if out and a < out[-1][2]:
            out[-1] = (out[-1][0], k, max(z, out[-1][2]))
        else:
            out.append((a, k, z))
    return out


def test_pipeline_equals_plain_version(spark, rows, tmp_path):
    mine, seen = [], set()
    for i, t in rows:
        if i is not None and i not in seen:
            seen.add(i)
            mine.append((i, t))
    mine += [(100 + i, prose(300 + i, 90)) for i in range(20)] + [(200, prose(300, 90) + ' secret: "a1b2c3d4e5f6"'), (201, prose(301, 90) + " added words at the end")]
    frame(spark, mine).write.parquet(str(tmp_path / "documents.parquet"))
    want = plain_quality(mine)
    comp = plain_components(want, 5)
    keep = {i for (i, _), c in comp.items() if i == c}
    want = [(i, plain_redacted(t)) for i, t in plain_cut([x for x in want if x[0] in keep])]
    tok, pieces = Tokenizer.from_file(packing.default_model()), set()
    for i, t in want:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        for n in range(0, len(ids), 2048):
            part = ids[n : n + 2048]
            pieces.add((i, n // 2048, n, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == pieces and len(got) == len(pieces)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        ends = np.cumsum([0, *[n for _, n in sorted(parts)]])
        assert [o for o, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= 2048


def test_stages_on_an_empty_table(spark, none):
    docs = none
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0, name


def test_stage_columns(spark, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns, name


def test_a_stage_forgets_what_the_one_before_kept(monkeypatch):
    """One worker goes through all stages; each has words of the last one's no more, and a bounded number of its own."""
    texts, kept = pa.array([b"one two three four", b"five six seven eight"], pa.binary()), common.worker_cache("packing")
    kept["words"] = {str(i): i for i in range(1000)}
    monkeypatch.setattr(quality, "MAX_WORDS", 3)
    rows = quality._measure_arrow(texts).to_pylist()
    assert common.worker_cache("packing") is not kept and not common.worker_cache("packing")
    assert [r["n_words"] for r in rows] == [4, 4]


def test_texts_are_cut_in_one_call(spark, docs):
    """Each further one is one more Python worker for every running task, and each of them stays for the stages after."""
    plan = corpus_pipeline.repeat_stage(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_rest_works_without_these_parts(tmp_path):
    """A copy without this package and the pipeline still imports and has the other queries."""
    for f in ("__spark_entry__.py", "turnloom"):
        src = ROOT / f
        for p in [src] if src.is_file() else src.rglob("*.py"):
            if "llm" not in p.relative_to(ROOT).parts:
                to = tmp_path / p.relative_to(ROOT)
                to.parent.mkdir(parents=True, exist_ok=True)
                to.write_bytes(p.read_bytes())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'assemble' in q and 'pipeline' not in q and 'op1_quality' not in q and 'op10_warc' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
    users = [p for p in (ROOT / "turnloom").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts and re.search(r"turnloom\.llm|corpus_pipeline", p.read_text())]
    assert users == []
