import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import frame, prose
from turnloom.llm import minhash, suffixes
from turnloom.llm.components import components


def plain_repeats(rows, length):
    """doc -> (bytes, removed, runs, hash) of the rule, by a table of all windows."""
    seen, out = {}, {}
    for i, t in sorted((i, t) for i, t in rows if i is not None):
        b = (t or "").encode()
        cover = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen.setdefault(b[p : p + length], i) < i:
                cover[p : p + length] = True
        left = bytes(np.frombuffer(b, np.uint8)[~cover])
        out[i] = (len(b), int(cover.sum()), int((cover & ~np.concatenate([[False], cover[:-1]])).sum()) if len(b) else 0, hashlib.sha256(left).hexdigest())
    return out


def run_repeats(df, cfg):
    r, out = suffixes.without_repeats(df, cfg=cfg)
    return r.select("doc_id", f"{out}.n_bytes", f"{out}.n_removed", F.size(f"{out}.spans"), F.sha2(f"{out}.kept", 256))


def test_repeats_equal_brute_force(docs, rows):
    want = plain_repeats(rows, 50)
    got = run_repeats(docs, suffixes.SuffixSettings(buckets=4)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert tuple(r)[1:] == want[r.doc_id], r.doc_id
        else:
            assert r.n_removed == 0


def test_repeats_of_random_pieces(spark):
    r = random.Random(4)
    pool = [prose(i, 12) for i in range(25)] + ["x" * 90, "ab" * 60]
    rows = [(i, "".join(r.choice(pool)[r.randrange(5) : r.randrange(20, 90)] for _ in range(r.randrange(6)))) for i in range(120)]
    want = plain_repeats(rows, 50)
    for batches in (1, 3, 5):
        got = {x.doc_id: tuple(x)[1:] for x in run_repeats(frame(spark, rows), suffixes.SuffixSettings(buckets=3, batches=batches)).collect()}
        assert got == want, batches


def test_long_texts_are_cut_into_pieces(monkeypatch):
    text = prose(5, 3000).encode()
    whole = suffixes.entries(text, suffixes.SuffixSettings())
    monkeypatch.setattr(suffixes, "PIECE", 1000)
    cut = suffixes.entries(text, suffixes.SuffixSettings())
    assert int(whole[3].sum()) == int(cut[3].sum()) == len(text) - 49
    assert set(whole[0].tolist()) == set(cut[0].tolist())


def test_levels_merge_like_a_counter(spark):
    levels = suffixes.SuffixLevels(spark, suffixes.SuffixSettings(buckets=2))
    sizes = []
    for i in range(4):
        levels.add(frame(spark, [(i, prose(i, 60))]), "doc_id", "text")
        sizes.append([n is not None for n in levels.levels])
    levels.close()
    assert sizes == [[True], [False, True], [True, True], [False, False, True]]


def test_empty_and_single(spark, none):
    assert run_repeats(none, suffixes.SuffixSettings(buckets=2)).count() == 0
    assert run_repeats(frame(spark, [(1, None)]), suffixes.SuffixSettings(buckets=2)).collect()[0].n_removed == 0


def shingles(text, k):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def plain_components(rows, k):
    ids = [(i, shingles(t, k)) for i, t in rows if i is not None]
    label = {i: i for i, _ in ids}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, s in ids:
        for b, t in ids:
            if a < b and s and t and 100 * len(s & t) >= 80 * len(s | t):
                lo, hi = sorted((root(a), root(b)))
                label[hi] = lo
    return {(i, len(s)): root(i) for i, s in ids}


def test_near_duplicates_equal_brute_force(docs, rows):
    for k in (4, 5):
        want = plain_components(rows, k)
        got = minhash.near_duplicates(docs, cfg=minhash.MinHashSettings(shingle=k)).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert r.component_id == want[r.doc_id, r.n_shingles] and r.kept == (r.component_id == r.doc_id)


def test_large_group_of_near_copies_over_several_blocks(spark):
    """Chains of edits: most pairs of the group are below the threshold, the group is one component all the same."""
    r, rows, words = random.Random(2), [], prose(50, 150).split()
    for i in range(150):
        at = r.randrange(len(words))
        words[at] = f"w{r.randrange(9)}"
        rows.append((1000 + i, " ".join(words)))
    rows += [(5000 + i, prose(900 + i, 100)) for i in range(60)]
    want = plain_components(rows, 5)
    got = {(x.doc_id, x.n_shingles): x.component_id for x in minhash.near_duplicates(frame(spark, rows), cfg=minhash.MinHashSettings(block_members=16)).collect()}
    assert got == want


def test_unlinked_members_meet_all_blocks(spark):
    """Copies with few to many edits share buckets; those left outside of the main part are compared with every block."""
    r, rows, words = random.Random(3), [], prose(60, 120).split()
    for i in range(90):
        w = list(words)
        for _ in range(r.choice([0, 1, 2, 3, 4, 5, 6])):
            w[r.randrange(len(w))] = f"v{i}"
        rows.append((i, " ".join(w)))
    want = plain_components(rows, 5)
    got = {(x.doc_id, x.n_shingles): x.component_id for x in minhash.near_duplicates(frame(spark, rows), cfg=minhash.MinHashSettings(block_members=4)).collect()}
    assert got == want and len(set(want.values())) > 3


def test_near_dedup_keeps_one_of_each_and_all_columns(docs, none):
    out = minhash.near_dedup(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert 1 not in ids and 8 not in ids and {0, 4, 5, 6, 7, 12, 15}.issubset(ids) and ids.count(None) == 2
    assert minhash.near_dedup(none).count() == 0


def test_signature_estimates_similarity():
    words, cfg = minhash.WordHashes(), minhash.MinHashSettings(bands=200, rows=5)
    w = prose(3, 400).split()
    a = minhash.shingle_set(" ".join(w).encode(), 5, words)
    b = minhash.shingle_set(" ".join(w[:330] + prose(9, 70).split()).encode(), 5, words)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    got = (minhash.signature(a, 1000) == minhash.signature(b, 1000)).mean()
    assert abs(got - true) < 0.06 and cfg.bands * cfg.rows == 1000


def test_permutations_are_bijections():
    x = np.arange(1 << 16, dtype=np.uint32) * np.uint32(65537)
    assert len(np.unique(minhash.scatter(x))) == len(x) == len(np.unique(minhash.permute(x.copy())))


def test_components_of_a_long_chain(spark):
    e = spark.range(300).selectExpr("id AS a", "id + 1 AS b").union(spark.range(1000, 1003).selectExpr("id AS a", "1000 AS b"))
    got = {r.node: r.label for r in components(e).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000, 1002: 1000}
