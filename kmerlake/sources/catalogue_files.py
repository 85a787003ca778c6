"""The inputs of a marker catalogue as DataFrames, ready for ``operators.catalogue``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kmerlake.sources.files import _cells, _lines


def _table(spark: SparkSession, path: str, separator: str, columns: dict[str, str], optional: tuple[str, ...] = ()) -> DataFrame:
    """Named columns of a delimited file with a header, all as text, with their row's place; a column that is not there is an error."""
    rows = spark.read.csv(path, sep=separator, header=True, escape='"', multiLine=False)
    lost = [c for c in columns if c not in rows.columns and c not in optional]
    if lost:
        raise ValueError(f"{path} lacks the columns {', '.join(lost)}")
    cell = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit("")) if c in rows.columns else F.lit("")
    return rows.select(F.monotonically_increasing_id().alias("ordinal"), *[cell(c).alias(n) for c, n in columns.items()])


def variant_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, variant, pos, ref, alt) of a table of variants by genome position; a position that is no number is an error."""
    rows = _table(spark, path, "\t", {"variant": "variant", "position": "pos", "reference_nucleotide": "ref", "alternative_nucleotide": "alt"})
    return rows.withColumn("pos", F.trim("pos").cast("int"))


def variant_grades(spark: SparkSession, path: str) -> DataFrame:
    """(variant, drug, grade) of a master table; rows with an empty cell are left out, of a variant and drug told twice the last grade counts."""
    rows = _table(spark, path, "\t", {"variant": "variant", "drug": "drug", "FINAL CONFIDENCE GRADING": "grade"}, optional=("variant", "drug", "FINAL CONFIDENCE GRADING"))
    trimmed = rows.select("ordinal", *[F.trim(c).alias(c) for c in ("variant", "drug", "grade")]).where("variant <> '' and drug <> '' and grade <> ''")
    return trimmed.groupBy("variant", "drug").agg(F.max_by("grade", "ordinal").alias("grade"))


def listed_mutations(spark: SparkSession, path: str, source: str) -> DataFrame:
    """(ordinal, gene, mutation, drug, confidence) of the rows of one source in a comma-separated list."""
    rows = _table(spark, path, ",", {"source": "source", "Gene": "gene", "Mutation": "mutation", "drug": "drug", "confidence": "confidence"}, optional=("confidence",))
    return rows.where(F.col("source") == source).drop("source")


def gene_places(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, name, gene_id, start, end, strand) of the genes of an annotation, ends from 1 and included, as ``catalogue.gene_of`` takes them.

    Attribute values are taken as written, up to a further ``=``; of one told twice the last counts, one not told is empty.
    """
    c = _cells(F.trim("value"))
    rows = _lines(spark, path).where(~F.startswith("value", F.lit("#"))).withColumn("c", c).where((F.size("c") >= 9) & (F.get("c", F.lit(2)) == "gene"))

    def told(key: str) -> Column:
        own = F.filter(F.split(F.get("c", F.lit(8)), ";"), lambda a: F.startswith(a, F.lit(key + "=")))
        return F.coalesce(F.get(F.split(F.try_element_at(own, F.lit(-1)), "="), F.lit(1)), F.lit(""))

    at = lambda i: F.get("c", F.lit(i))
    return rows.select("ordinal", told("Name").alias("name"), told("gene_id").alias("gene_id"), at(3).cast("int").alias("start"), at(4).cast("int").alias("end"), at(6).alias("strand"))
