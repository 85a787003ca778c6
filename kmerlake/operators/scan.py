"""Marker panels against reads and assemblies."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kmerlake.functions.kmers import kmer_rows, panel_codes, panel_counts, panel_hits
from kmerlake.functions.seq import check_k, clean_revcomp, decode, encode, revcomp
from kmerlake.operators.refstore import ReferenceStore, stored, with_bases


def diagnostic_kmers(markers: DataFrame, reference: ReferenceStore | str, k: int, min_flank: int = 0) -> DataFrame:
    """Markers with ``left`` flank length, ``ref_kmer`` and ``alt_kmer``.

    A window is centred on the longer allele; near the genome's start the left
    flank is shorter and the right one makes up for it.  Markers whose alleles
    leave too little flank, or whose window leaves the reference, are dropped.
    """
    check_k(k, min_flank)
    store = stored(markers.sparkSession, reference)
    pos0 = F.col("pos") - 1
    size = F.greatest(F.length("ref"), F.length("alt"))
    left = F.least(pos0, F.floor((k - size) / 2).cast("int"))
    after = pos0 + F.length("ref")
    fits = (size < k) & ((size <= k - 2 * min_flank) if min_flank else F.lit(True))
    placed = markers.where(fits).withColumn("left", left)
    need = lambda allele: F.greatest(F.lit(0), k - F.col("left") - F.length(allele))
    most = F.greatest(need("ref"), need("alt"))
    placed = placed.where(after + most <= store.length)
    placed = with_bases(placed, store, pos0 - F.col("left"), F.col("left") + F.length("ref") + most, "_window")
    head, rest = F.substring(F.col("_window"), F.lit(1), F.col("left")), F.col("left") + F.length("ref") + 1
    kmer = lambda allele: F.concat(head, F.col(allele), F.substring(F.col("_window"), rest, need(allele)))
    return placed.withColumns({"ref_kmer": kmer("ref"), "alt_kmer": kmer("alt")}).drop("_window")


def read_index(markers: DataFrame, k: int) -> DataFrame:
    """(kmer, marker_id, is_alt): both alleles on both strands of equal-length markers; nothing is deduplicated."""
    snps = markers.where((F.length("ref") == F.length("alt")) & (F.length("ref") < k))
    rows = F.array(*[F.struct(kmer.alias("kmer"), F.lit(alt).alias("is_alt")) for c, alt in (("ref_kmer", 0), ("alt_kmer", 1)) for kmer in (F.col(c), clean_revcomp(F.col(c)))])
    return snps.select("marker_id", F.explode(rows).alias("r")).select("r.kmer", "marker_id", "r.is_alt")


def _coded(panel: DataFrame, kmer: str) -> DataFrame:
    return panel.withColumn("kmer", encode(F.col(kmer)))


def marker_hits(reads: DataFrame, index: DataFrame, k: int, group: str = "sample") -> DataFrame:
    """(group, marker_id, is_alt, n): occurrences of marker k-mers, some added up already.

    A panel of a million k-mers or fewer goes to the tasks, which look windows up
    before they make rows; a larger one is joined.
    """
    coded = _coded(index, "kmer")
    panel = panel_codes(coded)
    if panel is None:
        found = kmer_rows(reads, k, keep=[group]).select(group, "kmer", F.lit(1).cast("long").alias("n")).join(coded, "kmer")
    else:
        found = panel_counts(reads, k, panel, group).join(F.broadcast(coded), "kmer")
    return found.select(group, "marker_id", "is_alt", "n")


def allele_counts(reads: DataFrame, index: DataFrame, k: int, group: str = "sample") -> DataFrame:
    """(group, marker_id, ref_count, alt_count): occurrences of marker k-mers in the reads."""
    found = marker_hits(reads, index, k, group)
    return found.groupBy(group, "marker_id").agg(F.sum((1 - F.col("is_alt")) * F.col("n")).alias("ref_count"), F.sum(F.col("is_alt") * F.col("n")).alias("alt_count"))


def called_variants(counts: DataFrame, min_depth: int = 10, min_percent: int = 95) -> DataFrame:
    """Counts that reach the depth and the percentage of ALT, tested in single precision; with ``coverage`` and ``alt_percent``."""
    depth = F.col("ref_count") + F.col("alt_count")
    single = ((F.col("alt_count").cast("float") / depth.cast("float")).cast("float") * F.lit(100).cast("float")).cast("float")
    return counts.where(depth >= min_depth).where(single >= F.lit(min_percent).cast("float")).withColumns({"coverage": depth, "alt_percent": F.col("alt_count") * 100.0 / depth})


def assembly_hits(contigs: DataFrame, markers: DataFrame, k: int) -> DataFrame:
    """One row a genome and marker k-mer: the first place by contig, strand and position.

    ``contigs`` has genome, contig (its order) and seq.  Of markers with the same
    ALT k-mer the last one counts.  Hits on the reverse strand have positions on
    the reverse complement.
    """
    last = markers.groupBy("alt_kmer").agg(F.max_by(F.struct("marker_id", "pos", "ref", "alt", "levels", "left"), "marker_id").alias("m"))
    last = _coded(last, "alt_kmer")
    upper = contigs.select("genome", "contig", F.upper("seq").alias("seq"))
    panel = panel_codes(last)
    if panel is None:
        strands = upper.select("genome", "contig", F.posexplode(F.array(F.col("seq"), revcomp(F.col("seq")))).alias("strand", "seq"))
        found = kmer_rows(strands, k).join(last, "kmer")
    else:
        found = panel_hits(upper, k, panel).join(F.broadcast(last), "kmer")
    first = found.groupBy("genome", "kmer").agg(F.min(F.struct("contig", "strand", "pos")).alias("at"), F.first("m").alias("m"))
    return first.select("genome", decode(F.col("kmer"), k).alias("kmer"), (F.col("at.pos") + 1).alias("kmer_pos"), (F.col("at.pos") + F.col("m.left") + 1).alias("genome_pos"), F.col("at.contig").alias("contig"), F.col("at.strand").alias("strand"), "m.marker_id", "m.pos", "m.ref", "m.alt", "m.levels")
