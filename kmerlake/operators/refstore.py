"""Random access into a reference sequence: overlapping tiles in a table.

A tile holds ``width`` bases and the ``overlap`` bases after them, so every window
of at most ``overlap + 1`` bases lies in the tile in which it begins.  Reading a
window is an equi-join on the tile's number and a substring of one tile, whatever
the length of the genome; no plan carries the sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A store of at most so many bases is sent to all tasks; a larger one is joined by a shuffle.
BROADCAST_BASES = 32_000_000


@dataclass(frozen=True)
class ReferenceStore:
    """``tiles`` (tile, bases) of a sequence of ``length`` bases."""

    tiles: DataFrame
    length: int
    width: int
    overlap: int


def tiles_of(sequences: DataFrame, width: int = 1024, overlap: int = 256) -> DataFrame:
    """(keys, tile, bases) of every row's ``seq``; a batch is cut in one pass, and its tiles leave in bounded batches."""
    keys = [c for c in sequences.columns if c != "seq"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                seq = batch.column("seq")[i].as_py() or ""
                own = batch.select(keys).slice(i, 1)
                for first in range(0, len(seq), width * 4096):
                    starts = range(first, min(first + width * 4096, len(seq)), width)
                    repeated = own.take(pa.array([0] * len(starts), pa.int32())).columns if keys else []
                    columns = [*repeated, pa.array([s // width for s in starts], pa.int64()), pa.array([seq[s : s + width + overlap] for s in starts])]
                    yield pa.RecordBatch.from_arrays(columns, [*keys, "tile", "bases"])

    types = dict(sequences.dtypes)
    return sequences.select(*keys, "seq").mapInArrow(cut, ", ".join([f"`{k}` {types[k]}" for k in keys] + ["tile long", "bases string"]))


def reference_store(sequences: DataFrame, width: int = 1024, overlap: int = 256) -> ReferenceStore:
    """The store of the one row of ``sequences`` (seq), in upper case."""
    size = sequences.agg(F.count("*").alias("n"), F.sum(F.length("seq")).alias("size")).first()
    if size.n != 1:
        raise ValueError(f"a reference is one sequence, not {size.n}")
    return ReferenceStore(tiles_of(sequences.select(F.upper("seq").alias("seq")), width, overlap), size["size"] or 0, width, overlap)


def stored(spark: SparkSession, reference: ReferenceStore | str) -> ReferenceStore:
    """A store as it is, or one of a sequence at hand."""
    if isinstance(reference, ReferenceStore):
        return reference
    return reference_store(spark.createDataFrame([(reference,)], "seq string"))


def with_bases(df: DataFrame, reference: ReferenceStore | str, start: Column, length: Column, name: str) -> DataFrame:
    """``df`` with column ``name``: ``length`` bases of the reference from ``start`` (from 0).

    What lies outside the reference is left out, so the bases may be fewer or none;
    null where start or length is null.  A window longer than the store's overlap
    plus one is an error.
    """
    store = stored(df.sparkSession, reference)
    known = start.isNotNull() & length.isNotNull()
    first = F.when(known, F.greatest(start, F.lit(0))).cast("long")
    size = F.when(known, F.greatest(start + length - first, F.lit(0))).cast("int")
    checked = F.when(size > store.overlap + 1, F.raise_error(F.concat(F.lit("a window of "), size.cast("string"), F.lit(" bases is longer than the reference store's overlap"))).cast("int")).otherwise(size)
    asked = df.withColumns({"_store_first": first, "_store_size": checked}).withColumn("_store_tile", F.floor(F.col("_store_first") / store.width))
    tiles = store.tiles.select(F.col("tile").alias("_store_tile"), F.col("bases").alias("_store_bases"))
    if store.length * (store.width + store.overlap) <= BROADCAST_BASES * store.width:
        tiles = F.broadcast(tiles)
    found = F.substring(F.col("_store_bases"), (F.col("_store_first") - F.col("_store_tile") * store.width + 1).cast("int"), F.col("_store_size"))
    return asked.join(tiles, "_store_tile", "left").withColumn(name, F.when(F.col("_store_first").isNotNull(), F.coalesce(found, F.lit("")))).drop("_store_tile", "_store_first", "_store_size", "_store_bases")
