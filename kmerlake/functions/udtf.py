"""k-mers as table functions for SQL users; DataFrame users take ``explode_kmers``, which stays in the JVM."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

_TURN = str.maketrans("ACGT", "TGCA")


def _windows(seq: str | None, k: int | None) -> Iterator[tuple[int, str]]:
    if seq and k and k > 0:
        for i in range(len(seq) - k + 1):
            kmer = seq[i : i + k]
            if not kmer.strip("ACGT"):
                yield i, kmer


class Kmers:
    def eval(self, seq: str, k: int) -> Iterator[tuple[int, str]]:
        yield from _windows(seq, k)


class CanonicalKmers:
    def eval(self, seq: str, k: int) -> Iterator[tuple[int, str]]:
        for i, kmer in _windows(seq, k):
            yield i, min(kmer, kmer[::-1].translate(_TURN))


def register(spark: SparkSession) -> None:
    """``kmers(seq, k)`` and ``canonical_kmers(seq, k)``, each giving (pos, kmer)."""
    spark.udtf.register("kmers", udtf(Kmers, returnType="pos int, kmer string"))
    spark.udtf.register("canonical_kmers", udtf(CanonicalKmers, returnType="pos int, kmer string"))
