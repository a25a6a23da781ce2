import random
import re
from collections import Counter, defaultdict
from itertools import count

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from turnloom.llm import packing, quality, transducer


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = Counter(windows)
    cover = {j for i, w in enumerate(windows) if twice[w] > 1 for j in range(i, i + 3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(cover))


def test_measures_equal_plain_rule(docs, rows):
    m = quality.measures(F.col("text"))
    got = Counter((r.text, tuple(r.m)) for r in docs.select("text", m.alias("m")).collect())
    assert got == Counter((t, plain_measures(t)) for _, t in rows)


def test_measure_of_many_random_texts():
    r, ids = random.Random(3), defaultdict(count().__next__)
    for _ in range(300):
        t = "".join(r.choice(["a", "b", " ", "\n", "#", "é ", "\t", " "]) for _ in range(r.randrange(60)))
        assert quality.measure_text(t.encode(), ids) == plain_measures(t)


def test_quality_keeps_columns_and_clean_rows(docs, none):
    out = quality.quality_filter(docs)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    assert 4 not in kept and 5 not in kept and 19 not in kept and {0, 1, 10, 21, -3} <= kept
    assert quality.quality_filter(none).count() == 0


def test_fence_rejects_outliers_of_a_group(spark):
    from tests.llm.conftest import frame, prose

    rows = [(i, prose(i, 80)) for i in range(150)] + [(500 + i, "# $ % & " * 20 + prose(i, 60)) for i in range(6)]
    kept = {r.doc_id for r in quality.quality_filter(frame(spark, rows)).collect()}
    assert kept == set(range(150))


def test_sources_of_different_spread_judge_one_text_differently(spark):
    """Even ids: words of 5 letters.  Odd ids: 4 to 9 letters from document to document.  One text of 9-letter words comes from both sources."""
    from tests.llm.conftest import frame

    def words(seed, size, n=60):
        r = random.Random(seed)
        return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(size)) for _ in range(n))

    rows = [(i, words(i, 5 if i % 2 == 0 else 4 + i // 2 % 6)) for i in range(300)]
    same = words(1000, 9)
    kept = {r.doc_id for r in quality.quality_filter(frame(spark, [*rows, (1000, same), (1001, same)])).collect()}
    assert kept == set(range(300)) | {1001}


def test_sketches_merge(spark):
    df = spark.range(10_000).select((F.col("id") % 7).alias("g"), F.lit("x").alias("h"), (F.col("id") * 37 % 9973).alias("v"))
    fine = quality.sketch(df, ["h", "g"], {"v": F.col("v")})
    merged = quality.quantiles(quality.merge_sketches(fine, ["h"]), ["h"], {"q": 0.5}).collect()[0]
    whole = quality.quantiles(quality.sketch(df, ["h"], {"v": F.col("v")}), ["h"], {"q": 0.5}).collect()[0]
    true = int(np.quantile([r.v for r in df.collect()], 0.5, method="inverted_cdf"))
    assert merged.q == whole.q and abs(whole.q - true) <= true / 64 + 1


def test_token_counts_equal_library(docs, rows):
    sp = sentencepiece.SentencePieceProcessor(model_file=transducer.default_model())
    got = Counter((r.text, r.c.n_bytes, r.c.n_tokens) for r in docs.select("text", transducer.token_counts(F.col("text")).alias("c")).collect())
    assert got == Counter((t, len((t or "").encode()), len(sp.encode(t or ""))) for _, t in rows)


def test_chunk_maps_compose():
    words = transducer.WordCounts(transducer.Transducer.load(transducer.default_model()))
    sp = sentencepiece.SentencePieceProcessor(model_file=transducer.default_model())
    r = random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "é", "▁", "日", "🦄", "\t", "<0x41>", "ing", "th", "=", "aaaa", "\x00"]
    for _ in range(400):
        t = "".join(r.choice(parts) for _ in range(r.randrange(30)))
        assert {transducer.count_tokens(t, words, c) for c in (1, 2, 3, 7, 1 << 16)} == {len(sp.encode(t))}, t


def test_pieces_equal_library(docs, rows):
    tok = Tokenizer.from_file(packing.default_model())
    got = defaultdict(list)
    for r in packing.pieces(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect():
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids))
    for i, t in rows:
        if i is not None:
            ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
            raw = np.asarray(ids, "<u4").tobytes()
            want = [(n, n * 2048, min(2048, len(ids) - n * 2048), raw[n * 8192 : (n + 1) * 8192]) for n in range(-(-len(ids) // 2048))]
            assert sorted((p, s, n, bytes(x)) for p, s, n, x in got[i]) == want


def test_packing_is_gapless_and_tight(spark):
    r = random.Random(5)
    sizes = [r.choice([2048, r.randrange(1, 2048), r.randrange(1, 300)]) for _ in range(6000)]
    df = spark.createDataFrame([(i, s, 0, 0) for i, s in enumerate(sizes)], "k long, length long, nth int, offset int")
    packed = packing.pack(df.select("k", "length"), ["k"], block_rows=1500).collect()
    assert len(packed) == len(sizes)
    by = defaultdict(list)
    for x in packed:
        by[x.sequence_id].append((x.offset, x.length))
    for parts in by.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 2048
    assert len(by) <= 1.01 * -(-sum(sizes) // 2048) + 4


def test_sum_of_squares_takes_the_smallest_sum():
    sizes = np.array([7, 6, 5, 5, 4, 3, 3, 2, 2, 1])
    bins, offsets, gaps = packing.sum_of_squares(sizes, 10)
    open_ = []
    for s, b in zip(sizes, bins):
        def total(bs):
            c = Counter(g for g in bs if 0 < g < 10)
            return sum(n * n for n in c.values())
        choices = [total([g - s if i == j else g for i, g in enumerate(open_)]) for j in range(len(open_)) if open_[j] >= s] + [total([*open_, 10 - s])]
        if b == len(open_):
            open_.append(10)
        open_[b] -= s
        assert total(open_) == min(choices)
    assert open_ == gaps.tolist()


def test_empty_tables(none):
    assert packing.pack(packing.pieces(none).drop("ids"), ["doc_id", "piece"]).count() == 0
    assert none.select(transducer.token_counts(F.col("text"))).count() == 0


def test_piece_too_long_is_an_error():
    with pytest.raises(ValueError):
        packing.sum_of_squares(np.array([11]), 10)
