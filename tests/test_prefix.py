"""Running values over groups that span many tasks."""

import random

import pytest

from kmerlake.operators.prefix import running


@pytest.mark.parametrize("before", [False, True])
def test_running_values(spark, before):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "a", "a", "b", None, f"g{i % 40}"]), i, rng.choice([None, rng.randrange(-50, 50)])) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, at long, x long").repartition(5)
    found = running(df, ["g"], ["at"], {"s": ("sum", "x"), "h": ("xor", "x"), "m": ("max", "x")}, before, parts=7)
    want, state = {}, {}
    for g, at, x in sorted(rows, key=lambda r: r[1]):
        s, h, m = old = state.get(g, (0, 0, None))
        if x is not None:
            s, h, m = s + x, h ^ x, x if m is None else max(m, x)
        state[g] = (s, h, m)
        want[at] = old if before else state[g]
    assert {r.at: (r.s, r.h, r.m) for r in found.collect()} == want


def test_one_group_uses_all_tasks(spark):
    df = spark.range(0, 20_000).selectExpr("1 AS g", "id", "1L AS one")
    found = running(df, ["g"], ["id"], {"n": ("sum", "one")}, parts=6)
    assert found.where("n <> id + 1").count() == 0
    assert found.rdd.getNumPartitions() == 6


def test_empty(spark):
    assert running(spark.createDataFrame([], "g long, x long"), ["g"], ["x"], {"n": ("sum", "x")}).collect() == []
