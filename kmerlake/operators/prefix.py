"""Running values along ordered groups, spread over tasks however large a group is.

A window function puts a whole group into one task.  Here rows are dealt by range
of (group, order), so a group spans as many tasks as it fills.  Each task takes
the running values of its own stretch; what a stretch adds up to goes to the
stretches after it (a row for each task, not for each group), and each row adds
what came before its own stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from kmerlake.operators.stage import written

_LEAST = np.iinfo(np.int64).min
#: Operation: (array operation, neutral value, Spark aggregate).
_KINDS = {"sum": (np.add, 0, F.sum), "xor": (np.bitwise_xor, 0, F.bit_xor), "max": (np.maximum, _LEAST, F.max)}


def _within(values: np.ndarray, heads: np.ndarray, operation: np.ufunc) -> np.ndarray:
    """Running ``operation`` over each stretch that begins at a head, by doubling steps."""
    out, place = values.copy(), np.arange(len(values)) - np.maximum.accumulate(np.where(heads, np.arange(len(values)), 0))
    step = 1
    while step <= place.max(initial=0):
        far = np.flatnonzero(place >= step)
        out[far] = operation(out[far], out[far - step])
        step *= 2
    return out


def running(df: DataFrame, group: list[str], order: list[Column | str], values: dict[str, tuple[str, str]], before: bool = False, parts: int | None = None) -> DataFrame:
    """``df`` with running values of long columns inside each group.

    ``values`` maps a new column to (operation, column); operations are sum, xor
    and max, and nulls count for nothing.  ``order`` holds columns or sort
    expressions of plain columns; ties come in any order.  The row itself is
    included, or with ``before`` only the rows before it (sum and xor start at 0,
    max at null).  Null is a group like any other.  Sums must fit a long.
    ``parts`` fixes the number of stretches; else Spark chooses it by size.

    ``df`` is read twice, since Spark samples it for the ranges: give a written
    table where it is dear.  New columns may not be named ``_part``, ``_row``,
    ``_head`` or ``_group``.
    """
    outs = list(values)
    by = [F.col("_group"), *[F.col(g) for g in group], *[F.col(o) if isinstance(o, str) else o for o in order]]
    schema = StructType([*df.schema.fields, StructField("_group", LongType()), StructField("_part", IntegerType()), StructField("_row", LongType()), StructField("_head", BooleanType()), *[StructField(o, LongType()) for o in outs], *[StructField(f"_all_{o}", LongType()) for o in outs]])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, last, first = TaskContext.get().partitionId(), 0, None, None
        so_far = {o: _KINDS[values[o][0]][1] for o in outs}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = batch.column("_group").to_numpy()
            heads = np.concatenate(([True], key[1:] != key[:-1]))
            goes_on = last is not None and key[0] == last
            first = key[0] if first is None else first
            stretch = int(np.flatnonzero(heads)[1]) if heads.sum() > 1 else n  # rows of the batch's first group
            shown, totals = [], []
            for o in outs:
                kind, column = values[o]
                operation, neutral, _ = _KINDS[kind]
                given = batch.column(column).cast(pa.int64())
                run = _within(given.fill_null(neutral).to_numpy(zero_copy_only=False).astype(np.int64), heads, operation)
                if goes_on:
                    run[:stretch] = operation(run[:stretch], so_far[o])
                ahead = np.where(heads, neutral, np.concatenate(([neutral], run[:-1])))
                if goes_on:
                    ahead[0] = so_far[o]
                so_far[o] = run[-1]
                show = ahead if before else run
                shown.append(pa.array(show, pa.int64(), mask=show == _LEAST if kind == "max" else None))
                totals.append(pa.array(run, pa.int64(), mask=run == _LEAST if kind == "max" else None))
            last = key[-1]
            more = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n)), pa.array(key == first), *shown, *totals]
            row += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], schema=pa.schema([*batch.schema, *zip(["_part", "_row", "_head", *outs, *[f"_all_{o}" for o in outs]], [x.type for x in more])]))

    ranged = df.withColumn("_group", F.xxhash64(*group)).repartitionByRange(*([parts] if parts else []), *by).sortWithinPartitions(*by)
    laid = written(ranged.mapInArrow(local, schema))

    # What the last group of each stretch has come to, and where a stretch begins inside a group.
    ends = laid.groupBy("_part").agg(F.max_by(F.struct("_group", *[f"_all_{o}" for o in outs]), "_row").alias("e")).select("_part", F.lit(True).alias("end"), "e.*")
    begins = laid.where("_row = 0").select("_part", F.lit(False).alias("end"), "_group", *[F.lit(None).cast("long").alias(f"_all_{o}") for o in outs])
    along = W.partitionBy("_group").orderBy("_part", "end").rowsBetween(W.unboundedPreceding, W.currentRow)
    carried = ends.unionByName(begins).select("_part", "_group", "end", *[_KINDS[values[o][0]][2](f"_all_{o}").over(along).alias(f"_in_{o}") for o in outs])
    carried = carried.where(~F.col("end") & F.coalesce(*[F.col(f"_in_{o}") for o in outs]).isNotNull()).select("_part", F.lit(True).alias("_head"), *[f"_in_{o}" for o in outs])

    def joined(o: str) -> Column:
        own, far = F.col(o), F.col(f"_in_{o}")
        kind = values[o][0]
        if kind == "max":
            return F.greatest(own, far)
        far = F.coalesce(far, F.lit(0))
        return own + far if kind == "sum" else own.bitwiseXOR(far)

    whole = laid.join(F.broadcast(carried), ["_part", "_head"], "left")  # a row for each task at most
    return whole.select(*df.columns, *[joined(o).alias(o) for o in outs])
