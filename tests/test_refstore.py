"""Windows of a reference read from tiles, bins of intervals, and merged ranges, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from kmerlake.operators import annotate as A, insights as I, refstore as R, scan


@pytest.fixture(scope="module")
def sequence():
    return "".join(random.Random(8).choices("ACGT", k=50_000))


def test_windows(spark, sequence):
    store = R.reference_store(spark.createDataFrame([(sequence.lower(),)], "seq string"), width=64, overlap=40)
    assert store.length == 50_000
    rng = random.Random(9)
    asked = [(i, rng.randrange(-50, 50_050), rng.randrange(0, 41)) for i in range(3000)] + [(9000, None, 3), (9001, 5, None), (9002, 0, 41), (9003, 49_999, 41), (9004, 70_000, 2)]
    frame = spark.createDataFrame(asked, "i int, s int, n int")
    got = {r.i: r.w for r in R.with_bases(frame, store, F.col("s"), F.col("n"), "w").collect()}
    assert got == {i: None if s is None or n is None else sequence[max(s, 0) : max(s + n, 0)] for i, s, n in asked}
    with pytest.raises(Exception, match="longer than the reference store"):
        R.with_bases(frame.limit(1), store, F.lit(0), F.lit(42), "w").collect()


def test_a_reference_is_one_sequence(spark):
    for rows in ([], [("A",), ("C",)]):
        with pytest.raises(ValueError, match="one sequence"):
            R.reference_store(spark.createDataFrame(rows, "seq string"))


def test_no_plan_holds_the_sequence(spark, sequence):
    store = R.reference_store(spark.createDataFrame([(sequence,)], "seq string"))
    markers = spark.createDataFrame([(i, 100 + 37 * i, sequence[99 + 37 * i], "T") for i in range(300)], "marker_id int, pos int, ref string, alt string")
    made = scan.diagnostic_kmers(markers, store, 31)
    assert len(made._jdf.queryExecution().toString()) < 40_000
    for r in made.collect():
        left, at = r.left, r.pos - 1
        assert r.ref_kmer == sequence[at - left : at - left + 31] and r.alt_kmer == r.ref_kmer[:left] + "T" + r.ref_kmer[left + 1 :]


def test_changes_on_both_strands(spark, sequence):
    comp = str.maketrans("ACGT", "TGCA")
    genes = [("p", 10_000, 10_900, "+"), ("m", 20_001, 20_601, "-"), ("e", 49_997, 50_000, "+")]
    cases = [(g, at, n) for g, *_ in genes for at in range({"p": 10_000, "m": 20_001, "e": 49_997}[g], {"p": 10_090, "m": 20_090, "e": 50_000}[g]) for n in (1, 2, 7)]
    rows = [(i, g, at, n, "ACGTACG"[:n], *next(x[1:] for x in genes if x[0] == g)) for i, (g, at, n) in enumerate(cases)]
    frame = spark.createDataFrame(rows, "i int, g string, at int, n int, alt string, start int, stop int, strand string")
    got = {r.i: r.aa for r in A.with_amino_change(frame, sequence, *[F.col(c) for c in ("at", "n", "alt", "start", "stop", "strand")]).collect()}
    size, three = len(sequence), lambda c: A._THREE[A.CODONS[c]] if c in A.CODONS else "???"
    for i, g, at, n, alt, start, stop, strand in rows:
        whole, first, begin, end = (sequence, at, start, stop - 1) if strand == "+" else (sequence[::-1].translate(comp), size - at - n, size - stop, size - start - 1)
        bases = alt if strand == "+" else alt[::-1].translate(comp)
        if first < begin:
            assert got[i] is None
            continue
        changed = (whole[:first] + bases + whole[first + n :])[:size]
        want = []
        for c in range((first - begin) // 3, (min(first + n - 1, end) - begin) // 3 + 1):
            a, b = whole[begin + 3 * c : begin + 3 * c + 3], changed[begin + 3 * c : begin + 3 * c + 3]
            if len(a) == 3:
                want.append(f"{three(a)}{c + 1}{three(b)}({a}>{b})" + (" syn" if three(a) == three(b) else ""))
        assert got[i].change == ";".join(want) if want else got[i] is None


def test_an_interval_is_one_row_however_long(spark):
    rng = random.Random(10)
    spans = [(s, s + rng.choice([0, 1, 3, 900, 1100, 70_000, 9_000_000, 3_000_000_000])) for s in (rng.randrange(-5000, 5_000_000) for _ in range(150))]
    hits = [(s, s + rng.choice([0, 1, 40, 5000])) for s in (rng.randrange(-6000, 5_000_000) for _ in range(150))]
    a = spark.createDataFrame([(i, *x) for i, x in enumerate(hits)], "hit int, h_start long, h_end long")
    b = spark.createDataFrame([(i, *x) for i, x in enumerate(spans)], "id int, start long, stop long")
    assert b.withColumn("bin", A.home_bin(F.col("start"), F.col("stop"))).count() == 150
    got = sorted((r.hit, r.id) for r in A.overlapping(a, b).collect())
    assert got == sorted((i, j) for i, h in enumerate(hits) for j, s in enumerate(spans) if h[0] < s[1] and h[1] > s[0])


def test_ranges_of_one_large_group(spark):
    rng = random.Random(11)
    ranges = [("g", s, s + rng.randrange(1, 30)) for s in (rng.randrange(0, 60_000) for _ in range(4000))] + [("h", 0, 5), ("h", 5, 6), ("h", 8, 9), ("n", None, 3), (None, 1, 2), (None, 2, 4)]
    want, last = [], None
    for g, a, b in sorted((r for r in ranges if r[1] is not None), key=lambda r: (str(r[0]), r[1:])):
        if last and last[0] == g and a <= last[2]:
            last[2] = max(last[2], b)
        else:
            last = [g, a, b]
            want.append(last)
    got = A.merged_ranges(spark.createDataFrame(ranges, "g string, start int, stop int"), ["g"], parts=5)
    assert got.dtypes == [("g", "string"), ("start", "int"), ("stop", "int")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want), key=str)


def test_stride_of_one_large_group(spark):
    frame = spark.range(1000).selectExpr("id", "if(id < 900, 'a', if(id < 990, 'b', null)) AS g").repartition(3)
    got = {(r.g, r.id) for r in I.every_nth(frame, "g", ["id"], 50, parts=4).collect()}
    assert got == {("a", i) for i in range(0, 900, 18)} | {("b", i) for i in range(900, 990, 2)} | {(None, i) for i in range(990, 1000)}


def test_mixed_share(spark):
    frame = spark.createDataFrame([(20.0,), (80.0,), (19.9,), (100.0,), (None,), (float("nan"),), (float("inf"),)], "x double")
    assert tuple(I.mixed_share(frame, "x").first()) == (4, 2, 0.5)
    assert tuple(I.mixed_share(frame.where("x is null"), "x").first()) == (0, 0, 0.0)
