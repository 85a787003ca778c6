"""Sequence, marker and annotation files as DataFrames.

All of them are read by Spark's text source, so they may lie in any store Spark
reads and may be compressed; plain files are split between tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _lines(spark: SparkSession, path: str | list[str], separator: str | None = None) -> DataFrame:
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ordinal"))


def fasta(spark: SparkSession, path: str | list[str], shortest: int = 1) -> DataFrame:
    """(file, ordinal, header, id, seq); records shorter than ``shortest`` are left out.

    A record begins at a ``>`` at a line's start; the sequence keeps its case.
    """
    record = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "")
    parts = F.split(record, "\n", 2)
    out = _lines(spark, path, "\n>").select("file", "ordinal", F.trim(parts[0]).alias("header"), F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s", "").alias("seq"))
    return out.where(F.length("seq") >= shortest).select("file", "ordinal", "header", label(F.col("header")).alias("id"), "seq")


def label(header: Column) -> Column:
    """The first token of a header."""
    return F.split(F.trim(header), r"\s+")[0]


def labelled_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return fasta(spark, path).withColumnRenamed("id", "label")


def reference(spark: SparkSession, path: str) -> str:
    """The sequence of a file with exactly one record."""
    rows = fasta(spark, path).limit(2).select("seq").collect()
    if len(rows) != 1:
        raise ValueError(f"{path} must hold one sequence" + (", it holds none" if not rows else ", it holds more"))
    return rows[0].seq.upper()


def slice_of(records: DataFrame, name: str, first: int, last: int, most: int = 50_000) -> DataFrame:
    """(header, first, last, seq): bases ``first`` to ``last`` (from 1) of the record with that id or header, else of the first record.

    Case does not matter, reversed ends are swapped, ends outside are moved in
    and the stretch is cut to ``most`` bases.
    """
    low, high = min(first, last), max(first, last)
    named = (F.lower("id") != name.lower()) & (F.lower("header") != name.lower())
    one = records.orderBy(named, "ordinal").limit(1)
    size = F.length("seq")
    begin = F.least(F.greatest(F.lit(low), F.lit(1)), size)
    end = F.least(F.greatest(F.lit(high), F.lit(1)), size, begin + most - 1)
    return one.select("header", begin.alias("first"), end.alias("last"), F.substring(F.col("seq"), begin, end - begin + 1).alias("seq"))


def unique_ids(records: DataFrame) -> DataFrame:
    """The records, if no file holds an id twice."""
    twice = records.groupBy("file", "id").count().where("count > 1").select("file", "id").first()
    if twice:
        raise ValueError(f"{twice.id} occurs twice in {twice.file}")
    return records


def fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, name, seq) of four-line records.

    The text is cut at the plus lines.  The two lines before one are a header
    and its read; a quality line that begins with ``+`` or ``@`` cannot be taken
    for either, since what stands before it is no header with a read.
    """
    rows = F.split(F.regexp_replace("value", "\r", ""), "\n")
    found = _lines(spark, path, "\n+").select("file", rows.alias("r")).where(F.size("r") >= 2)
    named = found.select("file", F.element_at("r", -2).alias("head"), F.element_at("r", -1).alias("seq"))
    return named.where(F.startswith("head", F.lit("@")) & (F.col("seq") != "")).select("file", label(F.substring("head", 2, 1 << 30)).alias("name"), "seq")


def _cells(value: Column) -> Column:
    return F.split(F.regexp_replace(value, "\r$", ""), "\t")


def _quoted_cells(value: Column) -> Column:
    """Cells of a line in which a cell may stand in double quotes (a doubled one is a quote) and then hold tabs."""
    found = F.regexp_extract_all(F.concat(F.regexp_replace(value, "\r$", ""), F.lit("\t")), F.lit('("(?:[^"]|"")*"[^\\t]*|[^\\t]*)\\t'), F.lit(1))
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, '^"((?:[^"]|"")*)"', "$1"), '""', '"')
    return F.transform(found, lambda c: F.when(F.startswith(c, F.lit('"')), bare(c)).otherwise(c))


def marker_lines(spark: SparkSession, path: str, quoted: bool = False) -> DataFrame:
    """(ordinal, cells) of the lines that are neither empty nor comments.

    ``quoted``: cells may be quoted, as in marker files for assemblies; a quoted
    cell lies within its line.
    """
    cells = _quoted_cells(F.col("value")) if quoted else _cells(F.col("value"))
    return _lines(spark, path).where((F.trim("value") != "") & ~F.startswith(F.trim("value"), F.lit("#"))).select("ordinal", cells.alias("cells"))


def levels_and_notes(cells: Column) -> tuple[Column, Column]:
    """Cells from the fourth up to the first empty one, and the non-empty cells after it."""
    rest = F.transform(F.slice(cells, F.lit(4), F.greatest(F.size(cells) - 3, F.lit(0))), lambda c: F.trim(c))
    gap = F.array_position(rest, "").cast("int")
    levels = F.when(gap > 0, F.slice(rest, F.lit(1), F.greatest(gap - 1, F.lit(0)))).otherwise(rest)
    notes = F.when(gap > 0, F.filter(F.slice(rest, gap + 1, F.greatest(F.size(rest) - gap, F.lit(0))), lambda c: c != "")).otherwise(F.array().cast("array<string>"))
    return levels, notes


def parse_markers(rows: DataFrame) -> DataFrame:
    """(marker_id, pos, ref, alt, levels, notes) from (ordinal, cells), for assemblies.

    Rows with fewer than four cells, a position that is no whole number or an
    empty allele are skipped.  A cell ``L2;L2.2`` is two levels here.
    """
    return _parsed(rows).withColumn("levels", F.flatten(F.transform("levels", lambda c: F.split(c, ";"))))


def _parsed(rows: DataFrame) -> DataFrame:
    levels, notes = levels_and_notes(F.col("cells"))
    cell = lambda i: F.trim(F.get("cells", F.lit(i)))
    out = rows.where(F.size("cells") >= 4).select("ordinal", cell(0).try_cast("int").alias("pos"), F.upper(cell(1)).alias("ref"), F.upper(cell(2)).alias("alt"), levels.alias("levels"), notes.alias("notes"))
    return out.where("pos > 0 and ref <> '' and alt <> ''").withColumnRenamed("ordinal", "marker_id")


def parse_read_markers(rows: DataFrame, strict_header: bool = False) -> DataFrame:
    """The same for reads: variants that change the length are skipped, and so is a header.

    A cell ``L2;L2.2`` is one level here.  The first line counts as a header when it holds ``pos``, ``lineage`` or
    ``ref``; with ``strict_header`` only when its position is no number.
    """
    first = rows.agg(F.min("ordinal")).scalar()
    text = F.lower(F.array_join("cells", "\t"))
    header = F.get("cells", F.lit(0)).try_cast("int").isNull() if strict_header else text.rlike("pos|lineage|ref")
    return _parsed(rows.where(~((F.col("ordinal") == first) & header))).where(F.length("ref") == F.length("alt"))


def gff(spark: SparkSession, path: str) -> DataFrame:
    """(seqid, type, start, stop, strand, phase, attributes) of all features, 0-based and half-open.

    ``attributes`` keeps the file's order as an array of (key, value), values
    URL-decoded and cut at the first comma; reversed ends are swapped.
    """
    c = _cells(F.col("value"))
    pairs = F.filter(F.transform(F.split(c[8], ";"), lambda a: F.struct(F.trim(F.split(a, "=", 2)[0]).alias("key"), F.get(F.split(a, "=", 2), F.lit(1)).alias("raw"))), lambda p: p["raw"].isNotNull())
    values = F.transform(pairs, lambda p: F.struct(p["key"].alias("key"), F.coalesce(F.try_url_decode(F.split(p["raw"], ",")[0]), F.split(p["raw"], ",")[0]).alias("value")))
    rows = _lines(spark, path).where(~F.startswith("value", F.lit("#"))).withColumn("c", c).where(F.size("c") >= 9)
    a, b = c[3].try_cast("int"), c[4].try_cast("int")
    return rows.where(a.isNotNull() & b.isNotNull()).select(c[0].alias("seqid"), c[2].alias("type"), (F.least(a, b) - 1).alias("start"), F.greatest(a, b).alias("stop"), c[6].alias("strand"), c[7].try_cast("int").alias("phase"), values.alias("attributes"))


def attribute(attributes: Column, *keys: str) -> Column:
    """The value of the first attribute, in file order, with one of the keys."""
    hits = F.filter(attributes, lambda p: p["key"].isin(*keys))
    return F.get(hits, F.lit(0))["value"]


def coding_genes(features: DataFrame) -> DataFrame:
    """(start, stop, strand, id) of CDS features: ``gene``, else the first of locus_tag, Name and ID, else Unknown."""
    a = F.col("attributes")
    return features.where("type = 'CDS'").select("start", "stop", "strand", F.coalesce(attribute(a, "gene"), attribute(a, "locus_tag", "Name", "ID"), F.lit("Unknown")).alias("id"))


#: Types of features that a viewer shows and which comes first, fixed values.
TYPE_PRIORITY = {"cds": 0, "gene": 1, "mrna": 2, "transcript": 2, "orf": 3}


def shown_features(features: DataFrame) -> DataFrame:
    """The features of the types in ``TYPE_PRIORITY`` (whatever their case) with their ``priority``, as ``annotate.best_feature`` takes them."""
    table = F.create_map(*[F.lit(x) for pair in TYPE_PRIORITY.items() for x in pair])
    return features.withColumn("priority", F.try_element_at(table, F.lower(F.trim("type")))).where("priority is not null")


def feature_label(attributes: Column, chosen: str = "") -> Column:
    """The label a feature shows: the chosen attribute, else the usual names in turn."""
    order = ([chosen] if chosen else []) + ["locus_tag", "gene", "Name", "product", "ID"]
    return F.coalesce(*[attribute(attributes, k) for k in order], F.lit(""))


def with_annotation(genomes: DataFrame, annotations: DataFrame, shared: str | None = None) -> DataFrame:
    """Genomes (``path``) with the annotation file of the same stem, else the shared one, else null as ``gff``."""
    stem = lambda c: F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"(?<=.)\.[^.]*$", "")
    own = annotations.groupBy(stem(F.col("path")).alias("_stem")).agg(F.min("path").alias("_own"))
    joined = genomes.withColumn("_stem", stem(F.col("path"))).join(own, "_stem", "left")
    return joined.withColumn("gff", F.coalesce("_own", F.lit(shared))).drop("_stem", "_own")


def present(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path, in any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _listed(spark: SparkSession, path: str) -> list[list[str]]:
    """Cells of a small list without comments, empty lines and a header."""
    rows = [[c.strip() for c in r.value.rstrip("\r").split("\t")] for r in spark.read.text(path).collect() if r.value.strip() and not r.value.lstrip().startswith("#")]
    return rows[1:] if rows and rows[0][0].lower() in ("sample", "name", "sample_name", "genome") else rows


def sample_list(spark: SparkSession, path: str, check: bool = False) -> list[tuple[str, list[str]]]:
    """(sample, paths) of a small list: a header line is skipped, a sample named twice is an error, and with ``check`` a missing file."""
    out: dict[str, list[str]] = {}
    for name, *paths in _listed(spark, path):
        if name in out:
            raise ValueError(f"sample {name} is listed twice")
        if not any(paths):
            raise ValueError(f"sample {name} has no file")
        out[name] = [p for p in paths if p]
        for p in out[name] if check else ():
            if not present(spark, p):
                raise FileNotFoundError(f"{p} of sample {name} is not there")
    return list(out.items())


def assembly_list(spark: SparkSession, path: str, shared: str | None = None) -> DataFrame:
    """(sample, path, gff) of a list of assemblies with an optional column of annotation files; without an own one a sample has the shared one.

    Every file must be there.
    """
    rows = []
    for name, paths in sample_list(spark, path, check=True):
        if len(paths) > 2:
            raise ValueError(f"sample {name} has more than a sequence and an annotation")
        rows.append((name, paths[0], paths[1] if len(paths) > 1 else shared))
    return spark.createDataFrame(rows, "sample string, path string, gff string")


def pooled_list(spark: SparkSession, path: str) -> list[str]:
    """All paths of a list of read files in order, each once; names count for nothing, every file must be there."""
    paths = list(dict.fromkeys(p for _, *own in _listed(spark, path) for p in own if p))
    for p in paths:
        if not present(spark, p):
            raise FileNotFoundError(f"{p} is not there")
    return paths


def result_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True)
