"""Exact quantiles by passes against Spark's percentile and sorted lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kmerlake.operators.selection import quantiles, ranked_values

AT = {"p10": 0.1, "median": 0.5, "p90": 0.9, "low": 0.0, "high": 1.0, "upper": None}


def plain(values, q):
    v = sorted(values)
    if q is None:
        return v[len(v) // 2]
    place = q * (len(v) - 1)
    a, b = math.floor(place), math.ceil(place)
    return v[a] if a == b else (b - place) * v[a] + (place - a) * v[b]


@pytest.fixture(scope="module")
def values():
    rng = random.Random(5)
    out = [("wide", rng.choice([-1, 1]) * math.exp(rng.uniform(-300, 300))) for _ in range(4000)]
    out += [("same", 7.0)] * 3000 + [("two", float(i % 2)) for i in range(3001)] + [("tail", float(x)) for x in [0] * 2500 + list(range(500))]
    out += [("few", 1.0), ("few", 4.0), (None, 2.0), (None, 8.0), (None, None), ("none", None), ("few", float("nan"))]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("few", [20, 100_000])
def test_quantiles(spark, values, few):
    df = spark.createDataFrame(values, "g string, x double").repartition(4)
    got = {r.g: r for r in quantiles(df, ["g"], "x", AT, few).collect()}
    want = {}
    for g, x in values:
        if x is not None and not math.isnan(x):
            want.setdefault(g, []).append(x)
    assert set(got) == set(want)
    for g, v in want.items():
        assert got[g].n == len(v)
        assert {k: got[g][k] for k in AT} == {k: plain(v, q) for k, q in AT.items()}


def test_many_distinct_values_of_one_group(spark):
    df = spark.range(2_000_000).select((F.xxhash64("id") / 1e15).alias("x"))
    got = quantiles(df, [], "x", {"a": 0.5, "b": 0.9, "c": 0.999}, few=1000).first()
    want = df.agg(F.percentile("x", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.999))).alias("p")).first().p
    assert [got.a, got.b, got.c] == want and got.n == 2_000_000


def test_ranks(spark):
    df = spark.createDataFrame([("a", float(i * i % 101)) for i in range(1000)], "g string, x double")
    wanted = spark.createDataFrame([("a", r) for r in (0, 1, 500, 998, 999)], "g string, rank long")
    v = sorted(float(i * i % 101) for i in range(1000))
    assert {r["rank"]: r.found for r in ranked_values(df, ["g"], "x", wanted, few=10).collect()} == {r: v[r] for r in (0, 1, 500, 998, 999)}


def test_nothing(spark):
    assert quantiles(spark.createDataFrame([], "g string, x double"), ["g"], "x", AT).collect() == []
    assert quantiles(spark.createDataFrame([(None,)], "x double"), [], "x", AT).collect() == []
