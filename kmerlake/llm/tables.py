"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(docs: DataFrame, megabytes: int = 8, rows: int = 4000) -> DataFrame:
    """The same rows; from now on the session sends texts to Python in batches of a few megabytes.

    Spark's own bound is a number of rows, which long texts make large on either side.
    """
    conf = docs.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", megabytes << 20), ("spark.sql.execution.arrow.maxRecordsPerBatch", rows)):
        now = int(re.sub("[^0-9-]", "", conf.get(key)))
        if now <= 0 or now > most:
            conf.set(key, str(most))
    return docs


def shared_folder(spark: SparkSession) -> None:
    """Make sure that there is a checkpoint folder: the session's ``spark.checkpoint.dir``.

    Only a local session without one gets a temporary folder; on a cluster that
    would be a folder of one machine, so it is an error.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and read them from there.

    The rows are on shared storage then, so Spark may delete the shuffle files
    that made them at once (a setting of Spark's, on for this one plan): a phase
    takes disk for its own shuffles only, whenever garbage is collected.
    """
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        return df.select("*").checkpoint()
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


def small(df: DataFrame, rows: int = 400_000) -> bool:
    """Whether ``df``, which should be cheap to read again, has ``rows`` rows at most, so that it may be broadcast."""
    return df.limit(rows + 1).count() <= rows


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch, bool]]:
    """(key, rows, last) for each run of equal keys in sorted batches.

    A run that goes on in the next batch comes in parts; ``last`` marks its end.
    """
    held: tuple[tuple, pa.RecordBatch] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            key = tuple(c[a].item() for c in columns)
            if held is not None:
                yield held[0], held[1], held[0] != key
            held = key, batch.slice(a, b - a)
    if held is not None:
        yield held[0], held[1], True


def per_piece(function: Callable[[pa.RecordBatch], dict], schema: pa.Schema, text: str = "text", limit: int = 1 << 20):
    """A function for ``mapInArrow`` that gives bounded slices of text to ``function`` and wraps its columns."""
    from kmerlake.llm.bytewords import pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text, limit):
                got = function(piece)
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) if not isinstance(got[f.name], pa.Array) else got[f.name].cast(f.type) for f in schema], schema=schema)

    return run


def near(df: DataFrame, rows: int = 400_000) -> DataFrame:
    """``df`` of few narrow rows, written and marked for broadcasting if it is small, so that the other side's hot keys stay where they are."""
    df = cut(df)
    return broadcast(df) if small(df, rows) else df
