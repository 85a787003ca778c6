"""Sequences and k-mers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A k-mer of 31 bases takes 62 bits, so it fits a signed long.
MAX_K = 31
BUCKETS = 1 << 20


def check_k(k: int, flank: int = 0) -> int:
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be between 1 and {MAX_K}, not {k}")
    if 2 * flank >= k:
        raise ValueError(f"a flank of {flank} on either side leaves no room in k={k}")
    return k


def normalise(seq: Column) -> Column:
    """Upper case without white space: U is read as T, ``.`` and ``~`` as gaps, IUPAC codes stay, anything else becomes N."""
    return F.regexp_replace(F.translate(F.upper(F.regexp_replace(seq, r"\s", "")), "U.~", "T--"), "[^ACGTNBDHVRYSWKM-]", "N")


def complement(bases: Column) -> Column:
    return F.translate(bases, "ACGT", "TGCA")


def revcomp(seq: Column) -> Column:
    """Reverse complement; anything but A, C, G and T becomes N."""
    return complement(F.reverse(F.regexp_replace(F.translate(seq, "acgt", "ACGT"), "[^ACGT]", "N")))


def clean_revcomp(kmer: Column) -> Column:
    """Reverse complement of a string known to hold A, C, G and T only."""
    return F.reverse(complement(kmer))


def encode(kmer: Column) -> Column:
    """Two bits a base (A 0, C 1, G 2, T 3); null if another character occurs."""
    return F.when(kmer.rlike("^[ACGT]+$"), F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long"))


def decode(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement; string order equals code order."""
    return F.least(kmer, clean_revcomp(kmer))


def bucket(canonical_kmer: Column) -> Column:
    """Low 20 bits of the code: the last ten bases."""
    return encode(F.right(canonical_kmer, F.lit(10))).cast("int")


def parts_of(df: DataFrame) -> int:
    """Into how many parts rows are dealt: a task for every core at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def explode_kmers(df: DataFrame, k: int, seq: str = "seq", keep: list[str] | None = None) -> DataFrame:
    """A row (``pos`` from 0, ``kmer`` as text) for each window without a foreign character."""
    from kmerlake.functions.kmers import kmer_rows

    return kmer_rows(df, k, seq, keep, form="text")


def in_chunks(df: DataFrame, k: int, size: int = 65_536, seq: str = "seq") -> DataFrame:
    """Long sequences as chunks that overlap by k-1 bases, with ``offset``, for callers who want one genome to feed many tasks.

    The k-mer functions need no chunks: they read a sequence of any length in slices.

    Every window of the sequence lies in exactly one chunk.
    """
    step = size - k + 1
    if step < 1:
        raise ValueError("a chunk must hold a k-mer")
    starts = F.sequence(F.lit(0), F.greatest(F.length(seq) - k, F.lit(0)), F.lit(step))
    cut = df.select("*", F.explode(starts).alias("offset"))
    return cut.withColumn(seq, F.substring(F.col(seq), F.col("offset") + 1, F.lit(size)))
