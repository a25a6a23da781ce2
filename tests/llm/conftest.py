"""Small documents with every awkward case: nulls, empty and very long texts, ties, repeated rows, clashing column names."""

import random

import pytest

WORDS = [a + b for a in ("th", "re", "on", "ti", "an") for b in ("er", "ing", "ea", "st", "ou")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(text: str, every: int) -> str:
    w = text.split(" ")
    w[::every] = ["zz" + x for x in w[::every]]
    return " ".join(w)


def make_rows() -> list[tuple]:
    base = prose(1, 200)
    shared = prose(77, 30)
    rows = [
        (0, base), (1, base), (2, edited(base, 60)), (3, edited(base, 45)), (4, None), (5, ""), (6, "   \n "), (7, "one two"), (8, "one two"), (9, "one  TWO"),
        (10, prose(2, 120) + " " + shared + " " + prose(3, 80)), (11, prose(4, 90) + "\n" + shared + "\n" + prose(5, 90)), (12, shared),
        (13, "é" * 60 + prose(6, 60)), (14, prose(7, 60) + "é" * 60), (15, prose(8, 20_000)), (16, "a" * 5000), (17, "a" * 5000),
        (18, "# $ % " * 60 + prose(9, 60)), (19, (prose(10, 10) + "\n") * 30), (20, base), (20, base), (21, prose(11, 70)), (None, base), (None, None),
        (22, 'token = "abcdef123456" AKIA' + "B" * 16 + " deadbeef" * 4), (23, "write to a.b@c.de or +49 (30) 1234-5678, card 4111 1111 1111 1111, host 10.0.0.1"),
        (24, "DE89 3704 0044 0532 0130 00 is the account, 日本語 x@y.z_u@v.w 1.2.3.999"), (25, "<|endoftext|> <s> ▁▁x\t\r\n\x00"), (-3, prose(12, 60)), (2**40, prose(13, 60)),
    ]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, spans string, ws int, doc string, measures int, node long, sequence_id int, nth int"


def frame(spark, rows):
    full = [(i, t, "en" if (i or 0) % 2 else None, f"s{(i or 0) % 2}", None if t is None else len(t), None, "x", 1, "d", 2, 3, 4, 5) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])
