"""Batch encoding, pair scores and the reply gate by blocks against plain versions."""

import os
import random

import numpy as np
from pyspark.sql import functions as F

from turnloom.config import Settings
from turnloom.functions import text as T
from turnloom.functions import vectors as X
from turnloom.operators.candidates import encode_chunks
from turnloom.operators.embedding import embed_batch, hashed_words, max_similarity, pooled_pair, score_cross
from turnloom.operators.gate import digest_gate, walk_block


def counting(path):
    def encode(texts):
        with open(path, "a") as f:
            f.writelines(f"{t!r}\n" for t in texts)
            f.write("--\n")
        return hashed_words(texts)

    return encode


def test_no_text_is_encoded_twice_and_order_is_kept(spark, tmp_path):
    texts = ["a b", None, "", "long " * 300, "a b", "c", "known", "long " * 300, "d e", "known", "a b"] * 3
    rows = spark.createDataFrame(list(enumerate(texts)), "n long, text string").withColumn("key", F.lit("x")).coalesce(1)
    cache = spark.createDataFrame([("known", [9.0] * 64), ("known", [9.0] * 64)], "text string, vec array<double>")
    cache = cache.select(T.content_key(F.col("text")).alias("key"), "vec")
    log = str(tmp_path / "log")
    got = sorted(embed_batch(rows, encode=counting(log), cache=cache, batch_bytes=1000).collect(), key=lambda r: r["n"])
    said = [x for x in open(log).read().splitlines() if x != "--"]
    assert len(said) == len(set(said)) and "'known'" not in said and set(map(eval, said)) == {t or "" for t in texts} - {"known"}
    assert [r["n"] for r in got] == list(range(len(texts)))
    for r, t in zip(got, texts):
        assert r["cached"] == (t == "known") and r["key"] == "x"
        assert r["vec"] == ([9.0] * 64 if t == "known" else hashed_words([t or ""])[0].tolist())


def test_memo_may_be_small(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"w{i % 7}") for i in range(100)], "n long, text string").coalesce(1)
    log = str(tmp_path / "log")
    got = embed_batch(rows, encode=counting(log), batch_bytes=20, memo_bytes=1).collect()
    assert [r["n"] for r in got] == list(range(100))
    assert all(r["vec"] == hashed_words([r["text"]])[0].tolist() for r in got) and os.path.getsize(log)


def test_python_encoder_equals_the_column(spark):
    texts = ["", "Ab ab_1 é日本 ½ x", "don't", "a\nb\tC", "İstanbul ǅ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.embed_text(F.col("t")).alias("v")).collect()
    for r in df[:4]:
        assert [float(x) for x in r["v"]] == hashed_words([r["t"]])[0].tolist()


def test_max_similarity_and_pooled_pair():
    r = np.random.default_rng(1)
    sizes_q, sizes_c = [2, 0, 3], [1, 0, 4, 2, 0]
    q, c = r.normal(size=(5, 4)), r.normal(size=(7, 4))
    qa, ca = np.concatenate([[0], np.cumsum(sizes_q)]), np.concatenate([[0], np.cumsum(sizes_c)])
    got = max_similarity(q, qa, c, ca, rows=2)
    for i in range(3):
        for j in range(5):
            a, b = q[qa[i] : qa[i + 1]], c[ca[j] : ca[j + 1]]
            assert np.isclose(got[i, j], np.mean([max(x @ y for y in b) for x in a]) if len(a) and len(b) else 0)
    p = pooled_pair(q, np.vstack([c, np.zeros(4)]))
    assert np.isclose(p[1, 2], q[1] @ (q[1] + c[2]) / np.linalg.norm(q[1]) / np.linalg.norm(q[1] + c[2])) and np.allclose(p[:, -1], 1)
    assert pooled_pair(np.zeros((1, 4)), c).tolist() == [[0.0] * 7]


def test_token_vectors_of_buckets_give_the_default(spark):
    r = random.Random(2)
    rows = [(c, i, "user" if i % 2 == 0 else "assistant", " ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9)))) for c in (1, 2) for i in range(11)]
    cfg = Settings(max_chunks=3, embedding_dims=8)
    d = spark.createDataFrame(rows, "conv_id long, seq long, role string, content string").withColumn("chunk_id", F.md5("content"))
    d = encode_chunks(d, cfg)
    unit = F.transform("vec", lambda x, i: F.array_repeat(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: (k == i).cast("double")), x.cast("int")))
    d = d.withColumn("toks", F.flatten(unit))
    a = sorted(map(tuple, score_cross(d, cfg).collect()))
    b = sorted(map(tuple, score_cross(d, cfg, "toks").collect()))
    assert len(a) == len(b) > 20
    for x, y in zip(a, b):
        assert x[:4] == y[:4] and np.allclose(x[4:6], y[4:6]) and y[1] - 3 <= y[2] < y[1]


def test_gate_by_blocks_equals_one_walk(spark):
    r = random.Random(5)
    words = [f"fact{i:02d}" for i in range(30)]
    ex = [(c, 2 * t, "what about it", " ".join(r.sample(words[: 6 + t], r.randint(1, 6)))) for c in (1, 2) for t in range(14)]
    ex += [(2, 100, "q", "I do not have access"), (3, 0, "q", None), (3, 2, "q", "")]
    df = spark.createDataFrame(ex, "conv_id long, turn long, query string, reply string").repartition(3)
    got = {n: sorted(map(tuple, digest_gate(df, Settings(block_rows=n)).collect())) for n in (4, 10**6)}
    assert got[4] == got[10**6] and len(got[4]) == 29
    assert {x[2] for x in got[4]} >= {"accept", "reject"} and max(x[5] for x in got[4]) > 6
    d = df.where("reply <> ''").withColumn("hedge", T.is_hedge(F.col("reply"))).withColumn("reply_terms", T.gate_terms(F.col("reply")))
    d = d.withColumn("new_terms", F.array_except("reply_terms", T.gate_terms(F.col("query")))).toPandas()
    want = sorted((int(c), *map(lambda v: v, x)) for c, g in d.groupby("conv_id") for x in walk_block(g, set(), 0))
    assert got[4] == [tuple(None if v is None else v for v in x) for x in want]
