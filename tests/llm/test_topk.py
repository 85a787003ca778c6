"""Exact top-k against scores of every pair."""

import math
import random

import numpy as np
import pytest

from kmerlake.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, v string, qb int, score long, rank int"


def plain(rows, every, k, scale=256):
    kept = []
    for i, e in rows:
        if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            kept.append((i, [math.floor(scale * float(np.float32(x))) for x in e]))
    out = []
    for q, a in kept:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in kept if i != q)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def found(frame):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in frame.collect())


def framed(spark, rows):
    return spark.createDataFrame([(*r, 1, "v", 2, 3, 4) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(12)
    one = lambda: [rng.gauss(0, 0.3) for _ in range(16)]
    centres = [one() for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.02) for x in rng.choice(centres)] if i % 3 else one()) for i in range(900)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # very common
    return rows


def test_all_pairs(spark, vectors):
    assert found(topk.nearest_vectors(framed(spark, vectors), every=50)) == plain(vectors, 50, 5)


def test_blocks_cut_small(spark, vectors):
    v = topk.integer_vectors(framed(spark, vectors), "vec_id", "embedding").cache()
    got = topk.nearest(v, v.where("vec_id % 20 = 0"), k=7, block=150, query_block=11)
    assert found(got) == plain(vectors, 20, 7)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [0.5, None]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (None, [9.0, 9.0]), (5, [0.25, -1.0]), (6, []), (50, [0.0, 0.0]), (7, [1.0, 2.0, 3.0]), (100, [-1.0, -2.0]), (5, [0.25, -1.0]), (8, [1.0, 2.0])]
    assert found(topk.nearest_vectors(framed(spark, rows))) == plain(rows, 50, 5)
    assert topk.nearest_vectors(framed(spark, [(50, [1.0])])).collect() == []
    assert topk.nearest_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_large_values_are_exact_or_an_error(spark):
    rows = [(i, [float(1 << 14) + i, float(i)]) for i in range(60)]
    assert found(topk.nearest_vectors(framed(spark, rows))) == plain(rows, 50, 5)
    with pytest.raises(Exception, match="not exact"):
        topk.nearest_vectors(framed(spark, [(i, [1e18]) for i in range(3)])).collect()


def test_reading_stops_early():
    rng = np.random.default_rng(3)
    near = rng.integers(-3, 4, (40, 32)) + 60
    far = rng.integers(-60, 61, (2000, 32))
    lists = topk.SortedLists(np.concatenate([near, far]), np.arange(2040), 6)
    left = lists.best(np.full(32, 60.0), 6)
    assert len(left) <= 64 and {int(lists.ids[e][0]) for e in left} <= set(range(40))
    scores = 60 * lists.parts[0].sum(axis=0)
    assert set(np.argsort(-scores, kind="stable")[:6]) <= set(left)
