"""Mixing, fill-in-middle and alignment against plain versions."""

import random
from bisect import bisect_right
from collections import Counter
from fractions import Fraction
from hashlib import sha256
import re

import pytest
from pyspark.sql import functions as F

from turnloom.llm import alignment, fim, mixing
from turnloom.llm.running import running_sums


def collected(df, by="doc_id"):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r[by] is None, r[by] or 0, str(sorted(r.items(), key=str))))


# ---- running sums


def test_running_sums_over_ties_and_a_hot_key(spark):
    rows = [(1, 5, i) for i in range(300)] + [(0, 2, i) for i in range(40)] + [(None, 1, 0)]
    df = spark.createDataFrame(rows, "k int, v long, part int").repartition(5)
    got, part, (before,) = running_sums(df, [F.col("k").asc_nulls_last(), F.col("part")], ["v"], "test")
    assert part != "part"
    total = 0
    for r in sorted(got.collect(), key=lambda r: (r["k"] is None, r["k"] or 0, r["part"])):
        assert r[before] == total
        total += r["v"]
    assert got.select(part).distinct().count() > 2


# ---- mixing


def plain_mix(rows, weights=(5, 2, 1), limit=3):
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    per = Counter()
    for (_, _, s), n in zip(rows, sizes):
        per[s] += n
    names = sorted(per, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    left = Fraction(sum(sizes))
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > limit * per[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = Fraction(limit * per[s])
            left -= target[s]
        open_ -= over
    return sizes, per, target


def check_mix(rows, got, per, target):
    assert len(got) == len(rows)
    by = Counter()
    for r in got:
        assert r["taken"] == r["epochs"] * r["size"] + r["part"] and 0 <= r["taken"] <= 3 * r["size"] and r["part"] <= r["size"]
        by[r["source"]] += r["taken"]
    for s in per:
        row = next(r for r in got if r["source"] == s)
        assert row["source_size"] == per[s]
        assert row["target"] == pytest.approx(float(target[s]))
        assert by[s] == int(float(target[s]) + 0.5)
        # at most one row of a source is cut within
        assert sum(0 < r["part"] < r["size"] for r in got if r["source"] == s) <= 1


@pytest.mark.parametrize("seed", range(3))
def test_mix_equals_plain_version(spark, seed):
    r = random.Random(seed)
    names = ["é", "z", "A", "a", None, "𝒳", "", "b"][: 3 + seed * 2]
    rows = [(i if i % 7 else 3, "w " * r.randint(0, 60 if s == names[0] else 9), s) for i in range(400) for s in [r.choice([names[0]] * 6 + names)]]
    rows += [(None, None, names[-1]), (None, "x y", names[0]), (None, "x y", names[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("other")).withColumn("part", F.lit(1)).repartition(4)
    got = collected(mixing.mix(docs))
    _, per, target = plain_mix(rows)
    check_mix(rows, got, per, target)
    again = collected(mixing.mix(docs.repartition(7)))
    assert again == got


def test_mix_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(none).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " \n", None)], "doc_id long, text string, source string")
    assert {(r["target"], r["taken"], r["source_size"]) for r in mixing.mix(blank).collect()} == {(0.0, 0, 0)}


def test_a_hot_source_spreads_over_ranges_and_carries_columns(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("hot").alias("source"), F.lit("a b c").alias("text"), *[F.col("id").alias(c) for c in ("rest", "first", "words", "taken", "one_before")])
    got = mixing.mix(docs, carry=("rest", "first", "words", "taken", "one_before")).collect()
    assert all(r["_taken"] == 3 and r["rest"] == r["taken"] == r["doc_id"] for r in got) and len(got) == 3000


# ---- fill-in-middle


def plain_fim(text, key):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    h = sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


HARD = ["<", "<P", "a<S", ">", "<M", "P>", "<P>x", "é", "日本語 text", "\x00a\nb", "a" * 3000, "ab1cd<<S", "S>M>", "ñ<M"]


@pytest.mark.parametrize("piece", [1, 2, 7, 1 << 20])
def test_fim_equals_plain_rule_at_any_piece_size(monkeypatch, rows, piece):
    monkeypatch.setattr(fim, "PIECE", piece)
    cfg = fim.FimSettings()
    texts = [(k, t) for k, t in rows if len(t or "") < (500 if piece < 100 else 1 << 30)] + [(i, t) for t in HARD if len(t) < 500 or piece > 100 for i in range(30)]
    forms = set()
    for k, t in texts:
        table, *facts = fim.arranged((t or "").encode(), k, cfg)
        want = plain_fim(t, k)
        assert (*facts, table.output().decode()) == want
        assert table.digest() == sha256(want[4].encode()).hexdigest()
        back = fim.restored(table.output(), facts[1], cfg)
        assert back.output() == (t or "").encode() and back.digest() == sha256((t or "").encode()).hexdigest()
        forms.add(facts[1])
    assert forms == {"plain", "psm", "spm"}


def test_fim_of_a_table(spark, docs, rows, none):
    got, out = fim.fim(docs.withColumn("fim", F.lit(1)))
    assert out != "fim" and "kept" in got.columns
    r = got.select("doc_id", "text", f"{out}.*").withColumn("back", fim.unfim(F.col("output"), F.col("form"))).collect()
    assert len(r) == len(rows)
    for x in r:
        n, form, p, m, o = plain_fim(x["text"], x["doc_id"])
        assert (x["n"], x["form"], x["prefix_chars"], x["middle_chars"], bytes(x["output"]).decode()) == (n, form, p, m, o)
        assert bytes(x["back"]["text"]).decode() == (x["text"] or "")
    assert fim.fim(none)[0].count() == 0


def test_outputs_without_their_sentinels_restore_to_null():
    cfg = fim.FimSettings()
    assert fim.restored(b"no marks", "psm", cfg) is None and fim.restored(b"x<P>a<S>b<M>c", "psm", cfg) is None
    assert fim.restored(b"<P>a<S>b<M>c", "psm", cfg).output() == b"acb"
    assert fim.restored(b"x", "other", cfg) is None


def test_piece_table_cuts_and_permutes():
    t = fim.PieceTable.of(b"abcdef", b"12")
    for at in (0, 4, 6):
        t.cut(at)
    assert [t.text[a:b] for _, a, b in t.rows] == [b"", b"abcd", b"ef", b""]
    t.arrange((1, 0, 3, 2), [(0, 1), (1, 2), (0, 0), (0, 2)])
    assert t.output() == b"1abcd212ef"
    t.restore((1, 0, 3, 2))
    assert t.output() == b"abcdef"
    with pytest.raises(IndexError):
        t.cut(7)


# ---- alignment


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def plain_tokens(libraries, text):
    """(ids, bytes) of both sides by whole-text encoding."""
    a, b = libraries
    level = {}
    for x in range(256):
        level[chr(x) if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174 else chr(256 + len([y for y in range(x) if not (33 <= y <= 126 or 161 <= y <= 172 or y >= 174)]))] = x
    ea = a.encode(" " + text, add_special_tokens=False)
    ib = b.encode(text)
    tb = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ib)]
    return ea.ids, [bytes(level[c] for c in t) for t in ea.tokens], ib, tb


def plain_alignment(libraries, rows):
    docs, counts = [], Counter()
    for key, text in rows:
        ia, ta, ib, tb = plain_tokens(libraries, text) if text else ([], [], [], [])
        if text and not b"".join(ta) == b"".join(tb) == (" " + text).encode():
            ia = ta = ib = tb = []
        ea, eb = list(_sums(ta)), list(_sums(tb))
        both = sorted(set(ea) & set(eb))
        ga, gb = [[] for _ in both], [[] for _ in both]
        for ids, ends, g in ((ia, ea, ga), (ib, eb, gb)):
            for i, e in zip(ids, ends):
                g[bisect_right(both, e - 1)].append(str(i))
        links = _links(ia, ea, ib, eb)
        counts.update(links)
        docs.append((key, len(ia), len(ib), len(both), links, ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in zip(ga, gb))))
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return [
        {"doc_id": k, "n_a": a, "n_b": b, "n_groups": g, "n_links": len(x), "n_best": sum(counts[p] == top[p[1]] for p in x), "count_sum": sum(counts[p] for p in x), "groups": t}
        for k, a, b, g, x, t in docs
    ]


def _sums(tokens):
    n = 0
    for t in tokens:
        n += len(t)
        yield n


def _links(ia, ea, ib, eb):
    a, b = dict(zip(ea, ia)), dict(zip(eb, ib))
    return [(a[e], b[e]) for e in sorted(a.keys() & b.keys())]


ODD = ["  two  spaces ", " lead", "trail \n \n", "\n\nx\ty\r\nz", "don't we'll I'M", "a\xa0b c　d\x1ce !\x1cf\x85g", "<|endoftext|><s></s><unk> ▁a▁▁b", "日本語テキスト", "é ﬁ ½", "\x00 nul\x00", "x" * 5000,
       "1234567 3.14 1,000", "🙂🙂 ok", "​   ﻿", "tab\t\tend", "a  \n  b", "#$%&|<>" * 9, "é" * 700 + " " + "q" * 900]


def test_unit_encoding_equals_whole_texts(libraries, rows):
    units = alignment.Units(alignment.AlignSettings())
    r = random.Random(3)
    mixed = ["".join(r.choice([" ", "\n", "a", "'s", "1", "!", "▁", "　", "\x1f", "\t", "é", "Ab", "  "]) for _ in range(r.randint(1, 40))) for _ in range(1500)]
    texts = [t for _, t in rows if t] + ODD + mixed
    got, _ = units.documents([t.encode() for t in texts], "text")
    for t, g in zip(texts, got):
        ia, ta, ib, tb = plain_tokens(libraries, t)
        if not b"".join(ta) == b"".join(tb) == (" " + t).encode():
            ia = ib = []
        sides = [x.split("|") for x in g["groups"].split(";")] if g["groups"] else []
        assert ",".join(s[0] for s in sides) == ",".join(map(str, ia)) and ",".join(s[1] for s in sides) == ",".join(map(str, ib)), repr(t)


@pytest.mark.parametrize("block,part", [(1 << 24, 1 << 20), (3000, 1000), (1, 1)])
def test_alignment_equals_plain_version(spark, libraries, rows, block, part):
    some = [(k, t) for k, t in rows if t is None or len(t) < 50_000] + [(100 + i, t) for i, t in enumerate(ODD)] + [(7, "one two")] * 3
    df = spark.createDataFrame(some, "doc_id long, text string").withColumn("block", F.lit(1)).withColumn("links", F.lit("x")).repartition(3)
    got = collected(alignment.align(df, cfg=alignment.AlignSettings(block_bytes=block, part_bytes=part, groups="text")))
    want = sorted(plain_alignment(libraries, some), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, str(sorted(r.items(), key=str))))
    assert got == want


def test_alignment_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(none).count() == 0
    blank = spark.createDataFrame([(1, None), (2, ""), (None, None)], "doc_id long, text string")
    assert {tuple(r)[1:] for r in alignment.align(blank).collect()} == {(0, 0, 0, 0, "", 0, 0)}


def test_coalesced_intervals():
    import numpy as np

    s, e = np.array([0, 2, 5, 0, 3, 5]), np.array([2, 5, 9, 3, 5, 9])
    order, group = alignment.coalesced(s, e)
    assert group.tolist() == [0, 0, 0, 0, 1, 1] and s[order].tolist() == [0, 0, 2, 3, 5, 5]
    i, j = alignment.overlaps(s[:3], e[:3], s[3:], e[3:])
    assert list(zip(i.tolist(), j.tolist())) == [(0, 0), (1, 0), (1, 1), (2, 2)]
