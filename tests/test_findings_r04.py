"""Tests of the fourth round's findings, against plain versions."""

import numpy as np
import pytest

from kmerlake.llm import jaccard


def _texts(n, shared, own, seed=4):
    """Texts of ``own`` words that nobody else has between ``shared`` passages out of a few."""
    rng = np.random.default_rng(seed)
    passages = [" ".join(f"p{i}x{k}" for k in range(8)) for i in range(6)]
    out = []
    for i in range(n):
        parts = [" ".join(f"o{i}x{k}x{j}" for k in range(own // (shared + 1))) for j in range(shared + 1)]
        picked = [passages[p] for p in rng.permutation(6)[:shared]]
        out.append((i, " ".join(x for pair in zip(parts, [*picked, ""]) for x in pair)))
    return out


def test_texts_that_share_passages_do_not_meet(spark):
    """they met under every passage, and each block got the text again."""
    frame = spark.createDataFrame(_texts(400, 2, 240), "doc_id long, text string").repartition(3)
    assert jaccard.shared_keys(frame, 5, 80).count() > 0
    assert jaccard.candidate_blocks(frame, 5, 80).count() == 0


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_links_between_texts_that_share_passages_stay(spark, width, percent):
    data = _texts(60, 2, 240)
    copies = []
    for i in range(0, 60, 4):
        words = data[i][1].split()
        words[30] = f"new{i}"
        copies.append((100 + i, " ".join(words)))
    got = jaccard.jaccard_components(spark.createDataFrame(data + copies, "doc_id long, text string").repartition(3), width, percent).collect()
    assert {r.doc_id: r.component_id for r in got} == {**{i: i for i in range(60)}, **{100 + i: i for i in range(0, 60, 4)}}


def test_what_linked_sets_leave_out_is_never_all_they_share():
    """Even where just the segments they share are the frequent ones."""
    rng = np.random.default_rng(1)
    for percent in (60, 80, 90, 95, 100):
        for n in (1, 2, 5, 10, 19, 33, 120, 700):
            for _ in range(8):
                a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
                most = len(a) * (100 - percent) // percent
                b = np.sort(rng.permutation(a)[rng.integers(0, most + 1) :])
                b = np.unique(np.concatenate([b, rng.integers(0, 2**64, rng.integers(0, most + 1), dtype=np.uint64)]))
                inter = len(np.intersect1d(a, b))
                if not len(b) or 100 * inter < percent * (len(a) + len(b) - inter):
                    continue
                row, key, spare = jaccard.spared_keys([a, b], percent)
                both = np.intersect1d(key[row == 0], key[row == 1])
                kept = [set(), set()]
                for r in (0, 1):
                    for s in np.unique(spare[row == r]):
                        own = sorted(key[(row == r) & (spare == s)].tolist(), key=lambda k: (k in both, k))
                        kept[r] |= set(own[: max(0, len(own) - (int(s) & (1 << 24) - 1))])
                assert kept[0] & kept[1]


def test_a_bin_beyond_its_bound_gives_the_same_keys(spark):
    frame = spark.createDataFrame(_texts(200, 4, 60), "doc_id long, text string").repartition(3)
    told = lambda most: {tuple(r) for r in jaccard.shared_keys(frame, 5, 80, most).collect()}
    assert told(1) == told(1 << 22) != set()
