import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import frame, prose
from turnloom.llm import neighbours, pii, secrets, segmentation, warc


# --- secrets

def plain_secrets(t):
    t = t or ""
    out = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A):
        if len(m[2]) >= 6 and m[1].isascii():
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 24]
    return sorted(out)


def test_fixed_secret_spans_equal_plain_rule(docs, rows):
    got = docs.select("text", secrets.secret_spans(F.col("text")).alias("s")).collect()
    for r in got:
        base = [(x["start"], secrets.KINDS.index(x["kind"]), x["stop"]) for x in r.s if x["kind"] != "entropy"]
        assert base == plain_secrets(r.text)


def test_random_secret_texts():
    r, scan = random.Random(8), secrets.Scanner()
    parts = ["token", "=", " ", '"', "secret:", "abc", "0123456789abcdef", "é", "AKIA", "ABCDEFGHIJ0123456", "\n", "Api_Key = '", "passwd", ".", "deadbeefdeadbeef"]
    for _ in range(2000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(12)))
        assert [x for x in scan.spans(t.encode()) if x[1] < 3] == plain_secrets(t), t


def test_entropy_windows_equal_direct_computation():
    r, terms = random.Random(2), secrets._terms(25)
    for _ in range(200):
        part = bytes(r.choice(b"abcdefghijABCDEFG0123456789"[: r.randrange(2, 27)]) for _ in range(r.randrange(10, 70)))
        hot = set()
        for i in range(len(part) - 23):
            w = part[i : i + 24]
            if -sum(c / 24 * math.log2(c / 24) for c in (w.count(x) for x in set(w))) >= 3.5 - 1e-9:
                hot |= set(range(i, i + 24))
        got = {x for a, b in secrets.entropy_windows(part, 24, 3.5, terms) for x in range(a, b)}
        assert got == hot


def test_entropy_finds_keys_and_leaves_words_alone():
    scan = secrets.Scanner()
    assert [k for _, k, _ in scan.spans(b"key kJ8s7Fh2Kq9LmZx3Vb6Nw1Rt5Yp0 end")] == [3]
    for t in (prose(1, 300), "id 3F2A1C4E-1B2D-4C3A-9E8F-0A1B2C3D4E5F", "z" * 80, "see /usr/lib/python/site-packages/module1234567", "donaudampfschiffahrtsgesellschaft", None):
        assert scan.spans(None if t is None else t.encode()) == []


def test_random_keys_with_few_digits_or_none_are_found():
    r, scan = random.Random(4), secrets.Scanner()
    letters = "abcdefghijklmnopqrstuvwxyz"
    for n, most in ((24, 0.02), (32, 0.01), (40, 0.01)):
        for chars in (letters + letters.upper() + "0123456789+/", letters + letters.upper()):
            keys = ["".join(r.choice(chars) for _ in range(n)) for _ in range(300)]
            assert sum(not scan.spans(b"key %s end" % k.encode()) for k in keys) <= most * 300, (n, chars)
    keys = ["".join(r.choice(letters) for _ in range(40)) for _ in range(300)]
    assert sum(bool(scan.spans(k.encode())) for k in keys) >= 0.9 * 300
    for t in ("getUserAccountManagerFactoryBean", "how_to_write_a_good_custom_parser", "src/main/python/network/handlers", "1029384756574839201928374655", "2024-01-02/2025-03-04/16-59"):
        assert not any(k == 3 for _, k, _ in scan.spans(t.encode())), t


def test_the_rest_of_a_run_beside_a_fixed_span_is_scanned():
    key, scan = "kJsFhKqLmZxVbNwRtYpGcDvTfXzQ", secrets.Scanner()
    t = f"x AKIA{'B' * 16}/{key} y {'deadbeef' * 4}_{key}"
    got = [(secrets.KINDS[k], t[a:z]) for a, k, z in scan.spans(t.encode())]
    assert [x for x, _ in got] == ["access", "entropy", "hex", "entropy"]
    assert key in got[1][1] and key in got[3][1] and "AKIA" not in got[1][1] and "deadbeef" not in got[3][1]


def test_redact_masks_and_keeps_the_rest(docs, none):
    out = secrets.redact(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[22] == '[SECRET]" [SECRET]' + " deadbeef" * 4 and got[4] is None and got[0] == prose(1, 200)
    assert secrets.redact(none).count() == 0


# --- personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_pii(t):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".") if x.isdigit()), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def base_spans(r):
    return [(s["kind"], s["start"], s["stop"]) for s in r.spans if s["kind"] in pii.BASE]


def test_base_spans_equal_plain_rule(docs, rows):
    got = pii.pii_spans(docs.drop("spans")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert base_spans(r) == plain_pii(r.text), r.text


def test_random_personal_texts(spark):
    r = random.Random(6)
    parts = ["a@b.c", "_", "x", "@", ".", "1", "23", "4111 1111-1111 1111", " ", "+49 (0) 30-12", "+", "255.", "1.2.3.4", "é", "日", "-", "\n", "%", "5500005555555559", "(", "999.1.1.1"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randrange(14)))) for i in range(1500)]
    for x in pii.pii_spans(frame(spark, rows).drop("spans")).collect():
        assert base_spans(x) == plain_pii(x.text), x.text


def test_added_kinds_need_checks_and_context(spark):
    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00 ok"), (2, "IBAN DE88 3704 0044 0532 0130 00 ok"), (3, "amex card 378282246310005"), (4, "number 378282246310005"),
            (5, "social security 123-45-6789"), (6, "part 123-45-6789")]
    got = {r.doc_id: [s["kind"] for s in r.spans if s["kind"] in pii.ADDED] for r in pii.pii_spans(frame(spark, rows).drop("spans")).collect()}
    assert got == {1: ["iban"], 2: [], 3: ["short_card"], 4: [], 5: ["ssn"], 6: []}


def test_context_goes_over_neighbours_and_accounts_end_by_country(spark):
    es = "ES91 2100 0418 4502 0005 1332"
    rows = [(1, "SSN 123-45-6789, 321-54-9876"), (2, "amex 378282246310005, 371449635398431"), (3, "card no. 12: 378282246310005"), (4, es + " BIC"),
            (5, f"{es} {es}"), (6, "AT61 1904 3002 3457 3201 2024"), (7, "123-45-6789, 321-54-9876 are ssn"), (8, "ssn " + "x" * 40 + " 123-45-6789")]
    got = {r.doc_id: [(s["kind"], r.text[s["start"] : s["stop"]]) for s in r.spans if s["kind"] in pii.ADDED] for r in pii.pii_spans(frame(spark, rows).drop("spans")).collect()}
    both = [("ssn", "123-45-6789"), ("ssn", "321-54-9876")]
    assert got == {1: both, 2: [("short_card", "378282246310005"), ("short_card", "371449635398431")], 3: [("short_card", "378282246310005")], 4: [("iban", es)],
                   5: [("iban", es)] * 2, 6: [("iban", "AT61 1904 3002 3457 3201")], 7: both, 8: []}


def test_long_runs_use_no_stack(spark):
    rows = [(1, "1" * 200_000), (2, "a." * 100_000), (3, "a@b" + ".c" * 50_000), (4, "1 " * 100_000), (5, "+" * 100_000), (6, "1." * 100_000)]
    got = {r.doc_id: len(r.spans) for r in pii.pii_spans(frame(spark, rows).drop("spans")).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0, 6: 25_000}


def test_no_python_in_the_plan(docs):
    plan = pii.pii_spans(docs.drop("spans"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_pii(none):
    assert pii.pii_spans(none.drop("spans")).count() == 0


# --- archives

def test_archives_round_trip(spark, tmp_path):
    big = "<p>" + "é🦄x" * 30_000
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, None), (4, "u\r\nX: y", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\n" * 9),
            (9, "u", big), (8, "u", "z" * 100), (8, "u", "z" * 100), (10, "u", "z" * 100), (None, "u", big)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    for compression in ("none", "gzip"):
        path = str(tmp_path / compression)
        warc.write_warc(df, path, segment_bytes=5000, records_per_file=7, compression=compression)
        got = warc.read_pages(spark, path).collect()
        assert len(got) == len(rows) and all(r.complete for r in got)
        own = sorted((r.page_id is not None, r.page_id or 0, bytes(r.payload).decode()) for r in got if r.warc_type == "response")
        want = sorted((i is not None, i or 0, h or "") for i, _, h in rows if i not in (2, 9, 10))
        assert own == want
        assert sorted((r.page_id, r.refers_to.split(":")[2]) for r in got if r.warc_type == "revisit") == [(2, "1"), (9, "1"), (10, "8")]


def test_broken_segments_are_found(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_warc(spark.createDataFrame([(1, "u", "x" * 40_000)], "page_id long, url string, html string"), path, segment_bytes=5000)
    recs = warc.read_records(spark, path).cache()
    assert warc.reassemble(recs).collect()[0].complete
    for lost in (4, recs.agg(F.max("segment")).collect()[0][0]):
        r = warc.reassemble(recs.where(f"segment is null or segment <> {lost}")).collect()
        assert len(r) == 1 and not r[0].complete and r[0].block is None


def test_chunked_framing():
    r = random.Random(1)
    for _ in range(100):
        t = "".join(r.choice("aé🦄\r\n0") for _ in range(r.randrange(50))).encode()
        assert warc.unchunked(warc.chunked(t, 4 + r.randrange(9))) == t
    assert warc.unchunked(b"5\r\nab\r\n0\r\n\r\n") is None and warc.unchunked(b"zz\r\n") is None
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nT: 1\r\n\r\n") == b"abc"


# --- neighbours

def test_recall_and_ties(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((2500, 32)), np.tile(rng.standard_normal(32), (300, 1))])
    rows = [(i, [float(v) for v in a], 7) for i, a in enumerate(x)]
    bad = [(9000, None, 7), (9100, [0.0] * 32, 7), (9200, [None] + [1.0] * 31, 7), (9300, [float("nan")] * 32, 7), (9400, [float("inf")] + [1.0] * 31, 7), (9500, [1.0] * 3, 7), (None, [1.0] * 32, 7)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, score int")
    cfg = neighbours.SearchSettings(cell_rows=200, block_queries=10)
    got = {}
    for r in neighbours.nearest(df, F.pmod("vec_id", F.lit(100)) == 0, cfg=cfg).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 2800, 100))
    hits = 0
    for q, found in got.items():
        dist = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(len(x)), dist)) if i != q][:10]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert all(abs(dist[i] - s) < 1e-12 for _, i, s in found)
        hits += len({i for _, i, _ in found} & set(best))
        if q >= 2500:  # the repeated vector: ties go to smaller ids
            assert [i for _, i, _ in found] == best
    assert hits >= 0.95 * 10 * len(got)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 2.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 2.0)]
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0


def test_chi_square_quantile():
    x = np.random.default_rng(1).standard_normal((200_000, 8))
    assert abs(((x * x).sum(1) <= neighbours.chi_square_quantile(0.9, 8)).mean() - 0.9) < 0.01
    with pytest.raises(ValueError):
        neighbours.chi_square_quantile(0.5, 3)


# --- segmentations

@pytest.fixture(scope="module")
def lattices():
    return segmentation.lattices(segmentation.default_model(), 1.0)


def every(v, word):
    a, b, p, q = v.lattice(word)
    out = {}

    def go(n, ids, logp):
        if n == len(word):
            out[tuple(ids)] = math.exp(logp)
        for i in np.flatnonzero(a == n):
            go(b[i], [*ids, int(p[i])], logp + q[i])

    go(0, [], 0.0)
    return out


def test_samples_follow_the_model_without_replacement(lattices):
    p = every(lattices.vocabulary, "▁then")
    assert abs(sum(p.values()) - 1) < 1e-9
    n, first, second, weight = 6000, {}, {}, {}
    for i in range(n):
        got = segmentation.sample("then", 2, np.random.Generator(np.random.PCG64([3, i])), lattices)
        ids = [tuple(x[0]) for x in got]
        assert len(set(ids)) == 2 and got[0][2] >= got[1][2]
        first[ids[0]] = first.get(ids[0], 0) + 1
        second[ids[1]] = second.get(ids[1], 0) + 1
        for x in got:
            weight[tuple(x[0])] = weight.get(tuple(x[0]), 0) + 1 / x[3]
    for s, share in p.items():
        later = sum(p[o] * share / (1 - p[o]) for o in p if o != s)
        for c, want in ((first.get(s, 0), share), (second.get(s, 0), later)):
            assert abs(c - n * want) < 5 * math.sqrt(n * want) + 3
        if share > 0.02:
            assert abs(weight[s] / n - 1) < 0.25  # inclusion scores make the counts unbiased


def test_all_segmentations_of_a_short_text(lattices):
    p = every(lattices.vocabulary, "▁an")
    got = segmentation.sample("an", 50, np.random.Generator(np.random.PCG64([1])), lattices)
    assert {tuple(x[0]) for x in got} == set(p) and all(x[3] == 1.0 for x in got)
    assert all(abs(math.exp(x[1]) - p[tuple(x[0])]) < 1e-9 for x in got)


def test_decoding_and_blocks(docs, lattices, monkeypatch):
    monkeypatch.setattr(segmentation, "BLOCK_CHARS", 50)
    for t in ("a🦄  b\nc", prose(3, 60), "x" * 200, "\x00\t\r\n é日本"):
        got = segmentation.sample(t, 5, np.random.Generator(np.random.PCG64([1])), lattices)
        assert len({tuple(x[0]) for x in got}) == len(got) == (2 if t[0] == "\x00" else 5)
        assert {lattices.vocabulary.decode(x[0]) for x in got} == {t}


def test_lattices_made_together_equal_those_made_alone(lattices, monkeypatch):
    monkeypatch.setattr(segmentation, "TOGETHER_CHARS", 300)
    v = lattices.vocabulary
    texts = ["then", None, "", prose(5, 40), "x" * 400, "a🦄  b\nc", *[prose(i, 9) for i in range(20)], "日本"]
    for t, lat in zip(texts, segmentation.text_lattices(texts, v), strict=True):
        assert (lat is None) == (not t)
        if lat is not None:
            one = segmentation.TextLattice(t, v).block(0)
            assert all(np.array_equal(getattr(one, c), getattr(lat.block(0), c)) for c in one.__dataclass_fields__)
            assert np.allclose(np.add.reduceat(one.p, one.first), 1)
            got, _ = segmentation.search(lat, 3, np.random.default_rng(1))
            assert {v.decode_utf8(ids).decode() for ids, _, _ in got} == {t}
            assert all(v.decode(ids.tolist()) == t for ids, _, _ in got)


def test_a_word_has_its_lattice_made_once(lattices, monkeypatch):
    v = segmentation.Vocabulary.load(segmentation.default_model(), 1.0)
    made, make = [], v.made
    monkeypatch.setattr(v, "made", lambda words: made.extend(words) or make(words))
    t = prose(5, 400)
    for lat in segmentation.text_lattices([t, t, "other", t], v):
        segmentation.search(lat, 2, np.random.default_rng(1))
    assert sorted(made) == sorted({"▁" + w for w in t.split(" ")} | {"▁other"})
    # a full store keeps what came again, and gives the same lattices
    monkeypatch.setattr(segmentation, "KEEP_CHARS", 300)
    texts = [prose(i, 50) + f" é{i}\n" for i in range(20)]
    for text in texts:
        one, other = v.block(segmentation.TextLattice(text, v).blocks[0]), lattices.vocabulary.block(segmentation.TextLattice(text, v).blocks[0])
        assert all(np.array_equal(getattr(one, c), getattr(other, c)) for c in one.__dataclass_fields__)
    assert v.words.chars < 2000 and len(made) > 40


def test_sets_that_part_late_follow_the_model(lattices, monkeypatch):
    p = every(lattices.vocabulary, "▁then")
    monkeypatch.setattr(segmentation, "NEAR", 1)
    n, second = 6000, {}
    for i in range(n):
        got = segmentation.sample("then", 2, np.random.Generator(np.random.PCG64([4, i])), lattices)
        ids = [tuple(x[0]) for x in got]
        assert len(set(ids)) == 2 and got[0][2] >= got[1][2]
        second[ids[1]] = second.get(ids[1], 0) + 1
    for s, share in p.items():
        want = n * sum(p[o] * share / (1 - p[o]) for o in p if o != s)
        assert abs(second.get(s, 0) - want) < 5 * math.sqrt(want) + 3


def test_paths_drawn_together_follow_the_model(lattices):
    """Edges drawn for many texts at once, words of many characters, and words followed one by one."""
    v, n = lattices.vocabulary, 3000
    p, seen = every(v, "▁then"), {}
    rngs = [np.random.Generator(np.random.PCG64([5, i])) for i in range(n)]
    texts = ["then" if i % 3 else "x" * 300 + "é日" * 9 for i in range(n)]
    for t, lat, rng in zip(texts, segmentation.text_lattices(texts, v, rngs, 2), rngs, strict=True):
        got, _ = segmentation.search(lat, 2, rng)
        assert all(v.decode_utf8(ids).decode() == v.decode(ids.tolist()) == t for ids, _, _ in got) and len({tuple(ids) for ids, _, _ in got}) == 2
        if t == "then":
            seen[tuple(got[0][0].tolist())] = seen.get(tuple(got[0][0].tolist()), 0) + 1
    total = sum(seen.values())
    for s, share in p.items():
        assert abs(seen.get(s, 0) - total * share) < 5 * math.sqrt(total * share) + 3


def test_rows_are_seeded_by_key(docs, none):
    short = docs.where("length(text) < 3000")
    a = segmentation.segmentations(short, ["doc_id", "text"]).withColumn("back", segmentation.decoded(F.col("ids")))
    key = lambda df: sorted((str(r.doc_id), str(r.text), r["sample"], tuple(r.ids), r.back) for r in df.collect())
    once = key(a)
    assert once == key(segmentation.segmentations(short.repartition(7), ["doc_id", "text"]).withColumn("back", segmentation.decoded(F.col("ids"))))
    assert all(back == text.replace("▁", " ") for _, text, _, _, back in once)
    assert segmentation.segmentations(none, ["doc_id"]).count() == 0


def test_query_segments_every_whole_document(spark, tmp_path):
    texts = [(1, prose(1, 30)), (2, prose(2, 25_000) + " é🦄"), (3, None), (4, prose(1, 30)), (5, "")]
    assert len(texts[1][1]) > segmentation.BLOCK_CHARS
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    frame(spark, []).selectExpr("doc_id AS conv_id", "text").write.parquet(str(tmp_path / "conversations.parquet"))
    got = segmentation.op5_segmentations(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r["sample"]) for r in got) == [(i, n) for i in (1, 2, 4) for n in range(1, 5)]
    assert len({(r.doc_id, r.ids_sha256) for r in got}) == 12
    for r in got:
        assert r.decoded_sha256 == hashlib.sha256(dict(texts)[r.doc_id].encode()).hexdigest()
        assert -math.inf < r.log_inclusion <= 0 and r.n_tokens > 0


def test_null_text_in_every_scan(docs):
    n = docs.where("text is null").count()
    assert docs.where("text is null").select(F.size(secrets.secret_spans(F.col("text"))).alias("n")).where("n = 0").count() == n
    assert hashlib.sha256(b"").hexdigest() == pii.pii_spans(docs.where("text is null").drop("spans")).select(F.sha2(pii.span_text(F.col("spans")), 256)).first()[0]
