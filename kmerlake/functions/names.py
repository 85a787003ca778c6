"""File names: read pairs and sample names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Patterns of read-pair names in the order they are tried, and of read suffixes, fixed values; {} stands for the read's number.
PAIRS = (r"^(.+?)_R{}_\d+\.", r"^(.+?)_R{}[._]", r"^(.+?)_{}\.", r"^(.+?)\.{}\.")
_SUFFIX = r"^(.+?)(?:_[Rr][12]_001|_[Rr][12]|_[12]|\.[12]|-[Rr][12]|-[12])$"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def sample_name(path: Column) -> Column:
    """A file's sample: without the read extension, one read suffix and trailing ``_-.``."""
    name = file_name(path)
    bare = F.regexp_replace(name, r"(?i)(?:\.fastq\.gz|\.fq\.gz|\.fastq|\.fq)$", "")
    stripped = F.regexp_extract(bare, _SUFFIX, 1)
    trimmed = F.regexp_replace(F.when(stripped != "", stripped).otherwise(bare), r"[_.-]+$", "")
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return F.when(trimmed != "", trimmed).otherwise(stem)


def read_pairs(paths: DataFrame, path: str = "path") -> DataFrame:
    """(dir, base, sample, paired, files): a sample's first reads, then its second ones; lone files stand alone."""
    name = file_name(F.col(path))
    tries = []
    for p in PAIRS:
        for n in (1, 2):
            found = F.regexp_extract(name, p.format(n), 1)
            tries.append(F.when(found != "", F.struct(found.alias("base"), F.lit(n).alias("read"))))
    seen = paths.select(F.col(path).alias("path"), F.regexp_replace(path, r"/?[^/]*$", "").alias("dir"), F.coalesce(*tries).alias("m"))
    # A file that matches no pattern is a group of its own.
    groups = seen.select("dir", "path", F.coalesce("m.base", "path").alias("base"), F.coalesce("m.read", F.lit(0)).alias("read"))
    out = groups.groupBy("dir", "base").agg(F.array_sort(F.collect_list(F.struct("read", "path"))).alias("f"), (F.max("read") > F.min("read")).alias("paired"))
    files = F.transform("f", lambda x: x["path"])
    return out.select("dir", "base", F.when(F.col("paired"), F.col("base")).otherwise(sample_name(files[0])).alias("sample"), "paired", files.alias("files"))


def forced_pairs(paths: list[str]) -> list[tuple[str, str]]:
    """Files two by two in the order given; an odd number is an error."""
    if len(paths) % 2:
        raise ValueError(f"{len(paths)} files cannot be paired")
    return list(zip(paths[::2], paths[1::2]))


def single_files(paths: DataFrame, path: str = "path") -> DataFrame:
    """(sample, files) of files that are samples of their own; two files of one name are an error."""
    return _distinct(paths.select(sample_name(F.col(path)).alias("sample"), F.array(path).alias("files")))


def forced_samples(paths: DataFrame, path: str = "path", order: str = "ordinal") -> DataFrame:
    """(sample, files, agree) of files two by two in order, named by the first; ``agree`` tells whether both have that name.

    An odd number of files or two pairs of one name are an error.
    """
    if paths.count() % 2:
        raise ValueError("an odd number of files cannot be paired")
    numbered = paths.select(F.col(path).alias("path"), (F.row_number().over(W.orderBy(order)) - 1).alias("n"))  # a list of files, not reads
    pairs = numbered.groupBy(F.floor(F.col("n") / 2).alias("pair")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "path"))), lambda x: x["path"]).alias("files"))
    first, second = sample_name(F.col("files")[0]), sample_name(F.col("files")[1])
    return _distinct(pairs.select(first.alias("sample"), "files", (first == second).alias("agree")))


def _distinct(samples: DataFrame) -> DataFrame:
    twice = samples.groupBy("sample").count().where("count > 1").orderBy("sample").first()
    if twice:
        raise ValueError(f"{twice['count']} inputs are named {twice.sample}; list them with names of their own")
    return samples


def unique_names(names: list[str]) -> list[str]:
    """Names with ``_2``, ``_3`` and so on for those that came before."""
    taken: set[str] = set()
    out = []
    for name in names:
        new, n = name, 1
        while new in taken:
            n += 1
            new = f"{name}_{n}"
        taken.add(new)
        out.append(new)
    return out
