"""Cases of the third round's findings."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerlake.functions.kmers import bucket_totals, kmer_profile, kmer_rows, panel_counts
from kmerlake.operators import annotate as A, contain, forest
from kmerlake.plans import QUERIES


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("parts", [3])
def test_equal_ranges_are_merged_whatever_their_order(spark, parts):
    """Of two equal ranges only the first opens an island; the passes must not disagree on which that is."""
    made = [(g, 100 * i, 100 * i + n) for g in (1, 2) for i in range(60) for n in (5, 9, 9, 9, 30)]
    frame = spark.createDataFrame(made, "g int, start int, stop int").repartition(7)
    want = sorted((g, 100 * i, 100 * i + 30) for g in (1, 2) for i in range(60))
    assert rows(A.merged_ranges(frame, ["g"], parts=parts).select("g", "start", "stop")) == want
    cut = rows(A.merged_ranges(frame.where("stop - start < 30"), ["g"], parts=parts).select("g", "start", "stop"))
    assert cut == sorted((g, 100 * i, 100 * i + 9) for g in (1, 2) for i in range(60))


def shuffled_bytes(spark, frame):
    """Bytes that the tasks of a query write for shuffles, as Spark counts them."""
    context = spark.sparkContext._jsc.sc()

    def so_far():
        context.listenerBus().waitUntilEmpty(10_000)
        return context.statusStore().executorSummary("driver").totalShuffleWrite()

    spark.range(8).repartition(2).count()
    time.sleep(0.2)
    before = so_far()
    frame.collect()
    return so_far() - before


@pytest.mark.parametrize("name", ["kmer_explode", "kmer_canonical", "kmer_encode2bit"])
def test_windows_of_a_document_are_not_shuffled(spark, sf_dir, name):
    """each window went through a shuffle, eight bytes and more for a base."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bases = docs.agg(F.sum(F.length("text"))).first()[0]
    assert 0 < shuffled_bytes(spark, QUERIES[name](spark, sf_dir)) < 2 * bases


@pytest.mark.parametrize("form", ["code", "canonical"])
@pytest.mark.parametrize("limit", [3, 50, 1 << 22])
def test_profiles_of_repeated_large_and_null_keys(spark, form, limit):
    random = np.random.default_rng(5)
    letter = lambda n: "".join(random.choice(list("ACGTN"), n, p=[0.24] * 4 + [0.04]))
    made = [(k, letter(int(n))) for k in (1, 2, None, 3, 1, None, 9) for n in random.integers(0, 90, 9)] + [(4, None), (5, "AC"), (6, "é" + "ACGT" * 5)]
    frame = spark.createDataFrame(made, "id int, seq string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = rows(kmer_profile(frame, 5, "id", form=form, limit=limit).select(F.coalesce("id", F.lit(-1)), "n", "n_forward", "n_distinct", "low", "high", "checksum"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    both = kmer_rows(frame, 5, form="text").withColumn("c", F.least("kmer", F.reverse(F.translate("kmer", "ACGT", "TGCA"))))
    code = F.conv(F.translate("c" if form == "canonical" else "kmer", "ACGT", "0123"), 4, 10).cast("long")
    want = both.withColumn("v", code).groupBy("id").agg(F.count("*"), F.count_if(F.col("kmer") == F.col("c")), F.countDistinct("v"), F.min("v"), F.max("v"), F.sum(F.col("v") % 1000003)).withColumn("id", F.coalesce("id", F.lit(-1)))
    assert got == rows(want)


def test_pooled_counts_travel_as_packed_runs(spark):
    """every distinct k-mer of a piece was a row of sixteen bytes."""
    random = np.random.default_rng(6)
    bases = lambda n: "".join(random.choice(list("ACGT"), n))
    frame = spark.createDataFrame([(bases(4000),) for _ in range(200)], "seq string").repartition(4).cache()
    frame.count()
    assert 0 < shuffled_bytes(spark, contain.kmer_counts(frame, 21).agg(F.sum("n"))) < 2.5 * 200 * 4000


@pytest.mark.parametrize("k", [5, 13, 21, 31])
def test_pooled_counts_of_both_strands_gaps_and_copies(spark, k):
    random = np.random.default_rng(7)
    made = ["".join(random.choice(list("ACGTN"), n, p=[0.24] * 4 + [0.04])) for n in random.integers(0, 300, 60)]
    made += [s[::-1].translate(str.maketrans("ACGT", "TGCA")) for s in made[:20]] + made[:5] * 3 + ["A" * 400, "AT" * 100, "é" + "ACGT" * 20, "", None]
    frame = spark.createDataFrame([(s,) for s in made], "seq string").repartition(3)
    want = kmer_rows(frame, k, form="canonical").groupBy("kmer").agg(F.count("*").alias("n"))
    assert rows(contain.kmer_counts(frame, k).select("kmer", "n")) == rows(want)


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_containment_by_either_join(spark, most):
    frame = spark.createDataFrame([("ACGTTGCAACGGTATTTACGG",), ("ACGTTGCAACGGTATT",)], "seq string")
    refs = spark.createDataFrame([(1, "GGTATTTACGG"), (2, "CCCCCCCCCCCC"), (3, "AC")], "ref_id int, seq string")
    got = rows(contain.containment(contain.kmer_counts(frame, 5), refs, 5, most).select("ref_id", "shared", "total"))
    assert got == [(1, 9, 29), (2, 0, 29), (3, 0, 29)]


def broadcasts(frame):
    """The sides that a plan sends to the driver and from there to all tasks."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return [part.split("\n\n")[0] for part in plan.split("BroadcastExchange")[1:]]


@pytest.mark.parametrize("name", ["aa_change", "frameshift"])
def test_variants_are_not_broadcast(spark, sf_dir, name):
    """the variants, a row a bin, went through the driver, as their table looked small."""
    sent = broadcasts(QUERIES[name](spark, sf_dir))
    assert sent and not [x for x in sent if "p_partkey" in x or "Generate" in x]


def test_best_feature_of_many_copies_of_a_stretch(spark):
    """every copy of a stretch met every point over it."""
    points = spark.createDataFrame([(5, 6), (50, 51), (999, 1000)], "h_start int, h_end int")
    copies = spark.range(20_000).select("id", F.lit(0).alias("start"), F.lit(60).alias("stop"), (F.col("id") % 3).cast("int").alias("priority"))
    other = spark.createDataFrame([(30_000, 40, 55, 0), (30_001, 4, 8, 1)], "id long, start int, stop int, priority int")
    found = A.best_feature(points, copies.unionByName(other), "h_start")
    assert rows(found.select("h_start", "best.id", "best.span")) == [(5, 0, 60), (50, 30_000, 15), (999, None, None)]


def test_overlaps_by_either_join(spark):
    hits = spark.createDataFrame([(i, i + 40) for i in range(0, 5000, 37)], "h_start int, h_end int")
    genes = spark.createDataFrame([(i, i + n) for i in range(0, 5000, 91) for n in (3, 900, 2600)], "start int, stop int")
    want = rows(hits.join(genes, (F.col("h_start") < F.col("stop")) & (F.col("h_end") > F.col("start"))))
    assert rows(A.overlapping(hits, genes)) == want
    assert rows(A.overlapping(hits, genes, most=3)) == want


def test_cells_of_a_document_are_not_shuffled(spark, sf_dir):
    """F16: every (document, bucket) went through a shuffle."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bases = docs.agg(F.sum(F.length("text"))).first()[0]
    assert 0 < shuffled_bytes(spark, QUERIES["feature_hash_counts"](spark, sf_dir).agg(F.sum("cnt"))) < 2 * bases


def test_buckets_of_repeated_and_null_keys(spark):
    random = np.random.default_rng(8)
    made = [(k, "".join(random.choice(list("ACGTN"), int(n), p=[0.24] * 4 + [0.04]))) for k in (1, 2, None, 3, 1, None, 9) for n in random.integers(0, 90, 9)] + [(4, None), (5, "AC")]
    frame = spark.createDataFrame(made, "id int, seq string")
    want = kmer_rows(frame, 5, keep=["id"], form="canonical").groupBy(F.coalesce("id", F.lit(-1)), "kmer").agg(F.count("*"))
    for size in (1, 7, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = rows(bucket_totals(frame, 5, "id").select(F.coalesce("id", F.lit(-1)), F.col("bucket").cast("long"), "cnt"))
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == rows(want)


def test_equal_reads_are_read_once(spark):
    """every window of every read was looked up, also of a read seen before in the batch."""
    reads = [(g, s) for g in (1, None, 2) for s in ("ACGTAGG", "TTACGTA", None, "ACGTAGG", "GG") for _ in range(g or 3)]
    frame = spark.createDataFrame(reads, "sample int, seq string").coalesce(1)
    panel = np.array([0b00011011, 0b10110010, 0b11000110])
    got = panel_counts(frame, 4, panel, "sample").groupBy(F.coalesce("sample", F.lit(-1)), "kmer").agg(F.sum("n"))
    every = kmer_rows(frame, 4).where(F.col("kmer").isin(panel.tolist())).groupBy(F.coalesce("sample", F.lit(-1)), "kmer").agg(F.count("*"))
    assert rows(got) == rows(every)


@pytest.mark.parametrize("name", ["lineage_composition", "mixed_infection"])
def test_reads_are_scanned_once(spark, sf_dir, name):
    """each use of the lineage counts scanned the reads again."""
    assert "lineitem" not in QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_a_level_of_a_forest_is_one_job(spark, monkeypatch):
    """Tasks read a part of each node's order, the same splits come of it, and only what is counted is shuffled."""
    rng = np.random.default_rng(3)
    made = [(i, int(b), int(n)) for i in range(120) for b, n in zip(rng.choice(3000, 900, replace=False), rng.integers(1, 5, 900) + 3 * (i % 3 == 0))]
    cells = spark.createDataFrame(made, "seq long, bucket int, cnt long").repartition(3).cache()
    labels = spark.createDataFrame([(i, i % 3) for i in range(120)], "seq long, code int")
    told, level = [], forest._level

    def noted(*args):
        told.append((len(args[3]), max(args[4])))
        return level(*args)

    monkeypatch.setattr(forest, "_level", noted)
    how = {"trees": 4, "depth": 4, "leaf": 3, "most": 50}
    model = rows(forest.train(cells, labels, **how))
    assert told[0][0] == 4 and told[0][1] < 0.05  # 50 of 3,000 buckets, not all cells
    monkeypatch.setattr(forest, "_share", lambda x: 1.0)
    assert rows(forest.train(cells, labels, **how)) == model
    monkeypatch.setattr(forest, "_share", lambda x: x / 1.3 if x < 0.6 else 1.0)  # too short at first: read again
    told.clear()
    assert rows(forest.train(cells, labels, **how)) == model and len(told) > 5


def test_blocks_are_cut_by_cells_and_by_rows(spark):
    sizes = [5, 0, 40, 3, 3, 3, 1, 0, 0, 9]
    cells = spark.createDataFrame([(i, 7 * b, 1 + i) for i, n in enumerate(sizes) for b in range(n)], "seq long, bucket int, cnt long")
    frame = spark.createDataFrame([(i, i % 2, [1, i]) for i in range(10)], "seq long, code int, drawn array<int>").join(forest.packed_cells(cells), "seq", "left").coalesce(1)
    got = forest.blocks(frame, 2, 2, 1, cells=10, most=4).collect()
    opened = [forest._opened(r.block) for r in got]
    assert sum(len(x[0]) for x in opened) == 10 and max(len(x[0]) for x in opened) <= 4
    assert sum(len(x[4]) for x in opened) == sum(sizes) and sum(int(x[6][x[5]].sum()) for x in opened if len(x[4])) == sum(n * (1 + i) for i, n in enumerate(sizes))
    assert all(len(x[4]) <= 10 or len(x[0]) == 1 for x in opened)
    assert np.sum([r.tally for r in got], axis=0).tolist() == [5, 5, 20, 25]
