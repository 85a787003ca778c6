"""Result tables and masked sequences as text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, Window as W, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from kmerlake.sources.fastq import file_system


def write_tsv(df: DataFrame, path: str, by: str | None = None) -> None:
    """Tab-separated with a header; ``by`` puts each of its values into a folder of its own."""
    flat = df.select(*[F.array_join(F.col(c).cast("array<string>"), ";").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
    writer = flat.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).csv(path, sep="\t", header=True)


def four_places(value: Column) -> Column:
    return F.format_string("%.4f", value.cast("double"))


def fasta_text(records: DataFrame, header: str = "header", seq: str = "seq", width: int = 80) -> DataFrame:
    """One column of text: a header line and lines of ``width`` bases a record."""
    body = F.regexp_replace(F.col(seq), f"(.{{{width}}})(?=.)", "$1\n")
    return records.select(F.concat(F.lit(">"), F.col(header), F.lit("\n"), body).alias("value"))


def write_fasta(records: DataFrame, path: str, **how) -> None:
    fasta_text(records, **how).write.mode("overwrite").text(path)


def maskable(records: DataFrame, reference_length: int, file: str = "file", seq: str = "seq") -> DataFrame:
    """Records of the files in which every record has the reference's length."""
    other = records.where(F.length(seq) != reference_length).select(file).distinct()
    return records.join(other, file, "left_anti")


def safe_name(name: Column) -> Column:
    """A name fit for a file: odd characters become ``_``, dots at the front and ``_`` at the ends go, an empty one is ``sample``."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^A-Za-z0-9._-]", "_"), r"^\.+", "")
    trimmed = F.regexp_replace(plain, "^_+|_+$", "")
    return F.when(trimmed == "", "sample").otherwise(trimmed)


def safe_names(samples: DataFrame, name: str = "sample") -> DataFrame:
    """Samples with ``file_name``; no two samples share one, whatever they are called.

    Of samples with the same safe name the first keeps it, the others get ``_2``,
    ``_3`` and so on, leaving out what another sample's safe name already is.
    """
    safe = samples.select(name).distinct().withColumn("_safe", safe_name(F.col(name)))
    numbered = safe.withColumn("_nth", F.row_number().over(W.partitionBy("_safe").orderBy(name)))
    numbers = r"^(.*)_([2-9]|[1-9][0-9]+)$"
    plain = safe.select("_safe").distinct()
    taken = plain.select(F.regexp_extract("_safe", numbers, 1).alias("_of"), F.regexp_extract("_safe", numbers, 2).alias("_n")).where("_n <> ''")
    held = taken.groupBy(F.col("_of").alias("_safe")).agg(F.array_sort(F.collect_list(F.col("_n").cast("decimal(38,0)"))).alias("_taken"))
    free = F.aggregate(F.coalesce("_taken", F.array().cast("array<decimal(38,0)>")), F.col("_nth").cast("decimal(38,0)"), lambda n, t: F.when(t <= n, n + 1).otherwise(n).cast("decimal(38,0)"))
    met = numbered.join(held, "_safe", "left")
    return met.select(name, F.when(F.col("_nth") == 1, F.col("_safe")).otherwise(F.concat("_safe", F.lit("_"), free.cast("string"))).alias("file_name"))


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: (file name, where it waits)."""

    files: list[tuple[str, str]]


class SampleFilesWriter(DataSourceWriter):
    """Rows (file_name, value), sorted by name, as one file of lines a name.

    Tasks write into a folder of the job beside the results.  Only when all of them
    have ended are the files moved to their names; if one fails, everything that the
    job wrote goes.  Further attempts at a task have folders of their own.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.suffix, self.head, self.overwrite = options["path"], options.get("suffix", ".tsv"), options.get("head"), overwrite
        self.pending = f"_pending-{uuid.uuid4().hex}"

    def _store(self) -> tuple[fs.FileSystem, str]:
        system, plain = file_system(self.path)
        return system, plain.rstrip("/")

    def write(self, iterator: Iterator[Row]) -> Written:
        system, top = self._store()
        own = f"{top}/{self.pending}/{TaskContext.get().taskAttemptId()}"
        out, name, files = None, None, []
        try:
            for row in iterator:
                if row.file_name != name:
                    if out is not None:
                        out.close()
                    name = row.file_name
                    if any(name == n for n, _ in files):
                        raise ValueError(f"rows of {name} are not together")
                    system.create_dir(own, recursive=True)
                    out = system.open_output_stream(f"{own}/{len(files)}")
                    files.append((name, f"{own}/{len(files)}"))
                    if self.head:
                        out.write((self.head + "\n").encode())
                if row.value is not None:
                    out.write((row.value + "\n").encode())
            if out is not None:
                out.close()
        except BaseException:
            if files:
                system.delete_dir(own)
            raise
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, top = self._store()
        files = [f for m in messages if m for f in m.files]
        names = [f"{top}/{n}{self.suffix}" for n, _ in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two tasks wrote the same sample")
        if not self.overwrite and any(x.type != fs.FileType.NotFound for x in system.get_file_info(names)):
            self.abort(messages)
            raise FileExistsError(f"{self.path} already holds files of these samples")
        for (_, at), to in zip(files, names):
            system.move(at, to)
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        system, top = self._store()
        if system.get_file_info(f"{top}/{self.pending}").type == fs.FileType.Directory:
            system.delete_dir(f"{top}/{self.pending}")


class SampleFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sample_files"

    def schema(self) -> str:
        return "file_name string, value string"

    def writer(self, schema, overwrite: bool) -> SampleFilesWriter:
        return SampleFilesWriter(self.options, overwrite)


def write_per_sample(lines: DataFrame, path: str, order: list[str], name: str = "sample", value: str = "value", suffix: str = "_mutations.tsv", head: str | None = None, overwrite: bool = True) -> None:
    """``lines`` as a file for each sample, named safely, in the given order, below a line ``head``; all files or none.

    A sample without lines (one row with a null value) gets a file with the head alone.
    """
    spark = lines.sparkSession
    spark.dataSource.register(SampleFiles)
    named = safe_names(lines, name)
    told = lines.join(named, lines[name].eqNullSafe(named[name])).select("file_name", F.col(value).cast("string").alias("value"), *[lines[o].alias(f"_{i}") for i, o in enumerate(order)])
    keys = [f"_{i}" for i in range(len(order))]
    rows = told.repartition("file_name").sortWithinPartitions("file_name", *keys).select("file_name", "value")
    rows.write.format("sample_files").option("suffix", suffix).options(**({"head": head} if head else {})).mode("overwrite" if overwrite else "append").save(path)
