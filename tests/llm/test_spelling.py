"""Spelling variants against a plain version that compares every two words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kmerlake.llm import spelling

SCHEMA = "doc_id long, text string, key long, word string, band int, side int, mask long, n string, other string"
LOW = {i: i + 32 for i in range(65, 91)}


def plain_counts(rows, shortest=7, least=2, slips=31):
    n = Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if slips and h % slips == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= shortest
    return {w: k for w, k in n.items() if k >= least}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_forms(n, factor=10):
    near = {w: sorted((-n[v], v) for v in n if one_edit(w, v)) for w in n}
    form = {w: near[w][0][1] if near[w] and -near[w][0][0] >= factor * n[w] else None for w in n}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root(w)) for w in n}


def found(frame):
    rows = [(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(13)
    bases = ["".join(rng.choice("abcdeéøÿz") for _ in range(rng.randrange(6, 11))) for _ in range(25)] + ["aaaaaaaa", "abababab", "×÷ñandúes"]
    rows = []
    for i in range(260):
        out = []
        for _ in range(60):
            w = rng.choice(bases[: rng.randrange(1, len(bases) + 1)])
            for _ in range(rng.choice([0] * 12 + [1, 1, 2])):
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abé") + w[at:], w[:at] + rng.choice("acø") + w[at + 1 :]])
            out.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", "7", "\n", "İ"]).join(out)))
    rows += [(None, "missing identifiers missing identifiers"), (5, None), (6, ""), rows[3], rows[3], (7, "short ones only"), (8, "abcdefgh " * 40_000), (9, "x" * 200_000)]
    return rows


@pytest.fixture(scope="module")
def table(spark, talk):
    return spark.createDataFrame([(*r, 1, "w", 2, 3, 4, "n", "o") for r in talk], SCHEMA).repartition(3)


def test_counts(talk, table):
    assert {r.word: r.n for r in spelling.counted_words(table).collect()} == plain_counts(talk)
    assert {r.word: r.n for r in spelling.counted_words(table, 4, 5, None).collect()} == plain_counts(talk, 4, 5, None)


def test_forms(talk, table):
    want = plain_forms(plain_counts(talk))
    assert sum(r[3] is not None for r in want) > 20 and any(r[5] != r[3] for r in want if r[3])
    assert found(spelling.spelling_forms(table)) == want


def test_short_words_and_other_factor(spark):
    rows = [(i, t) for i, t in enumerate(["a b ab ba abc ac bc aa" * 1, "ab ab abc abc abc b", "cab bac ca", "é è éè"])]
    frame = spark.createDataFrame([(*r, 1, "w", 2, 3, 4, "n", "o") for r in rows], SCHEMA)
    assert found(spelling.spelling_forms(frame, shortest=1, least=1, factor=2, slips=None)) == plain_forms(plain_counts(rows, 1, 1, None), 2)


def test_an_edit_flips_two_bits_at_most_and_meets_once(spark):
    words = spark.createDataFrame([("abcdefg", 1), ("abcdefgh", 1), ("abcxefg", 1), ("abcefg", 1), ("bcdefga", 1)], "word string, n long")
    masks = {r.word: r.m for r in words.select("word", spelling.parity_mask(F.col("word")).alias("m")).collect()}
    assert masks["abcdefg"] == masks["bcdefga"] and (masks["abcdefg"] ^ masks["abcxefg"]).bit_count() == 2 and (masks["abcdefg"] ^ masks["abcefg"]).bit_count() == 1
    pairs = [tuple(sorted((r.word, r.other))) for r in spelling.near_words(words).collect()]
    assert sorted(pairs) == [("abcdefg", "abcdefgh"), ("abcdefg", "abcefg"), ("abcdefg", "abcxefg"), ("abcefg", "abcxefg")]


def test_empty(spark):
    assert spelling.spelling_forms(spark.createDataFrame([], SCHEMA)).collect() == []
