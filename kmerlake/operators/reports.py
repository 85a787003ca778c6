"""The result tables a run gives, with their columns and order, and where genomes get their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kmerlake.operators.annotate import first_gene, with_amino_change
from kmerlake.operators.refstore import ReferenceStore
from kmerlake.operators.scan import assembly_hits
from kmerlake.sources.sinks import four_places, write_per_sample

#: Columns of the reports, fixed values.
DETAIL = ("genome", "k-mer", "k-merPOS", "SNPgenome", "SNPreference", "REF", "ALT", "lineage", "Gene", "Gene_Start", "Gene_End", "AA_Pos", "AA_Change")
PREDICTIONS = ("Header", "Predicted_Lineage", "Confidence", "Confidence_Margin", "Other_Votes")
MATCH = ("Query_Files", "Best_Match_Reference", "Shared_Kmer_Fraction")
IMPORTANCE = ("rank", "bucket", "split_count", "importance_pct", "kmers")
MUTATIONS = ("pos", "ref_allele", "alt_allele", "ref_count", "alt_count", "alt_fraction", "lineage_path")
EXTRA = "extra_annotations..."


def named_contigs(records: DataFrame, mode: str) -> DataFrame:
    """Records (file, ordinal, id, seq) as (genome, contig, seq).

    ``listed``: a genome a file, named by column ``sample``, its records pooled;
    ``records``: a genome a record; ``files``: the same, named ``[file] record``.
    """
    name = F.element_at(F.split("file", "/"), -1)
    genome = {"listed": lambda: F.col("sample"), "records": lambda: F.col("id"), "files": lambda: F.concat(F.lit("["), name, F.lit("] "), F.col("id"))}
    if mode not in genome:
        raise ValueError(f"no such input mode: {mode}")
    return records.select(genome[mode]().alias("genome"), F.col("ordinal").alias("contig"), "seq")


def hit_detail(contigs: DataFrame, markers: DataFrame, genes: DataFrame | None, reference: ReferenceStore | str, k: int) -> DataFrame:
    """``DETAIL`` of every marker found in a genome, and one row of nulls for a genome without any.

    ``markers`` are diagnostic k-mers that may have ``gene`` and ``mutation``,
    ``genes`` have start, stop (0-based, half-open), strand and id.  The bases that
    are translated are those of the genome.  Where a gene lies over the place its
    bounds are given even if nothing can be translated; gene and change then come
    from the marker, the amino-acid position does not.
    """
    own = [c if c in markers.columns else None for c in ("gene", "mutation")]
    told = markers.select("marker_id", "left", *[(F.col(c) if c else F.lit(None).cast("string")).alias(n) for c, n in zip(own, ("m_gene", "m_change"))])
    hits = assembly_hits(contigs, markers, k).drop("contig", "strand").join(told, "marker_id")
    start = F.col("pos") - 1
    hits = hits.withColumns({"hit": F.struct("genome", "kmer"), "h_start": start, "h_end": start + F.length("ref"), "cut": F.substring("kmer", F.col("left") + 1, F.length("alt"))})
    if genes is None:
        placed = hits.withColumns({"gene": F.lit(None).cast("struct<start:int,stop:int,id:string,strand:string>"), "aa": F.lit(None).cast("struct<aa_pos:int,change:string>")})
    else:
        placed = first_gene(hits, genes, "hit")
        gene = lambda c: F.col(f"gene.{c}")
        placed = with_amino_change(placed, reference, F.col("h_start"), F.length("ref"), F.col("cut"), gene("start"), gene("stop"), gene("strand"))
    rows = placed.select(
        "genome", F.col("kmer").alias("k-mer"), F.col("kmer_pos").alias("k-merPOS"), F.col("genome_pos").alias("SNPgenome"), F.col("pos").alias("SNPreference"), F.col("ref").alias("REF"), F.col("alt").alias("ALT"),
        F.array_join("levels", ";").alias("lineage"), F.coalesce("gene.id", "m_gene").alias("Gene"), (F.col("gene.start") + 1).alias("Gene_Start"), F.col("gene.stop").alias("Gene_End"),
        F.col("aa.aa_pos").alias("AA_Pos"), F.coalesce("aa.change", "m_change").alias("AA_Change"),
    )
    return contigs.select("genome").distinct().join(rows, "genome", "left").select(*[F.col(f"`{c}`") for c in DETAIL])


def _in_order(df: DataFrame, names: tuple[str, ...], columns: dict[str, Column]) -> DataFrame:
    return df.select(*[columns[n].alias(n) for n in names])


def prediction_table(summary: DataFrame) -> DataFrame:
    """``PREDICTIONS`` of a vote summary (seq, winner, confidence, margin, others), by name."""
    return _in_order(summary, PREDICTIONS, dict(zip(PREDICTIONS, (F.col("seq").cast("string"), F.col("winner"), four_places(F.col("confidence")), four_places(F.col("margin")), F.col("others"))))).orderBy("Header")


def match_table(best: DataFrame, query_files: list[str]) -> DataFrame:
    """``MATCH`` of the best reference (ref_id, score)."""
    return _in_order(best, MATCH, dict(zip(MATCH, (F.lit(",".join(query_files)), F.col("ref_id").cast("string"), four_places(F.col("score"))))))


def importance_table(ranked: DataFrame, kmers: DataFrame) -> DataFrame:
    """``IMPORTANCE`` by rank, buckets without k-mers with an empty cell."""
    return ranked.join(kmers, "bucket", "left").select("rank", "bucket", "split_count", four_places(F.col("importance_pct")).alias("importance_pct"), F.coalesce("kmers", F.lit("")).alias("kmers")).orderBy("rank")


def coordinate_table(places: DataFrame, ranked: DataFrame, key: str) -> DataFrame:
    """Places of the ranked buckets by rank, sequence and position."""
    return places.join(ranked.select("bucket", "rank", "importance_pct"), "bucket").select(key, "position", "kmer", "bucket", "rank", four_places(F.col("importance_pct")).alias("importance_pct")).orderBy("rank", key, "position")


def mutation_table(calls: DataFrame, group: str = "sample") -> DataFrame:
    """``MUTATIONS`` of the called variants of each group, and its annotations as an array of any length (``notes``)."""
    notes = F.col("notes") if "notes" in calls.columns else F.array().cast("array<string>")
    cells = (F.col("pos"), F.col("ref"), F.col("alt"), F.col("ref_count"), F.col("alt_count"), F.format_string("%.2f", F.col("alt_percent").cast("double")), F.array_join("levels", ";"))
    return calls.select(group, *[c.alias(n) for c, n in zip(cells, MUTATIONS)], notes.alias("notes"))


def mutation_lines(table: DataFrame, group: str = "sample") -> DataFrame:
    """(group, value): the rows of a mutation table as text, each with as many cells as it has annotations."""
    cells = F.array(*[F.col(c).cast("string") for c in MUTATIONS])
    return table.select(group, F.array_join(F.concat(cells, F.coalesce("notes", F.array().cast("array<string>"))), "\t", "").alias("value"))


def write_mutations(table: DataFrame, path: str, samples: DataFrame | None = None, group: str = "sample") -> None:
    """A mutation table as a file for each sample, by position; samples (``group``) without a mutation get the head alone."""
    cells = F.array(*[F.col(c).cast("string") for c in MUTATIONS])
    lines = table.select(group, "pos", F.array_join(F.concat(cells, F.coalesce("notes", F.array().cast("array<string>"))), "\t", "").alias("value"))
    if samples is not None:
        bare = samples.select(group).distinct().join(lines.select(group).distinct(), group, "left_anti")
        lines = lines.unionByName(bare.withColumns({"pos": F.lit(None).cast(dict(lines.dtypes)["pos"]), "value": F.lit(None).cast("string")}))
    write_per_sample(lines, path, ["pos", "value"], name=group, head="\t".join((*MUTATIONS, EXTRA)))
