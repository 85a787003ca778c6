"""Weighted k-mer containment of pooled reads in references."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kmerlake.functions.kmers import kmer_rows, kmer_totals


def kmer_counts(reads: DataFrame, k: int) -> DataFrame:
    """(kmer, n) of the canonical k-mers of all sequences, as 2-bit codes."""
    return kmer_totals(reads, k)


def without_noise(counts: DataFrame, least: int = 2, gate: int = 100_000) -> DataFrame:
    """Drop k-mers seen fewer than ``least`` times, but only when there are more than ``gate`` distinct ones."""
    distinct = counts.agg(F.count("*")).scalar()
    return counts.where((distinct <= gate) | (F.col("n") >= least))


def containment(counts: DataFrame, references: DataFrame, k: int, most: int = 1_000_000) -> DataFrame:
    """(ref_id, shared, total, score) of every reference; ``references`` has ref_id and seq.

    References of ``most`` k-mers or fewer (counted first) go to the tasks; beyond
    that both sides are shuffled by k-mer.
    """
    distinct = kmer_rows(references, k, keep=["ref_id"], form="canonical").select("ref_id", "kmer").distinct()
    if distinct.limit(most + 1).count() <= most:
        distinct = F.broadcast(distinct)
    shared = distinct.join(counts, "kmer").groupBy("ref_id").agg(F.sum("n").alias("shared"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    out = references.select("ref_id").join(shared, "ref_id", "left").withColumn("total", total)
    return out.select("ref_id", F.coalesce("shared", F.lit(0)).alias("shared"), "total", F.when(F.col("total") > 0, F.coalesce("shared", F.lit(0)) / F.col("total")).otherwise(0.0).alias("score"))


def best_reference(scores: DataFrame) -> DataFrame:
    """The reference with the most shared weight; the earliest on ties, also when nothing is shared."""
    return scores.agg(F.min(F.struct((-F.col("shared")).alias("less"), "ref_id", "score")).alias("best")).select("best.ref_id", (-F.col("best.less")).alias("shared"), "best.score")
