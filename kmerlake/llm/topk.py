"""Exact top-k by inner product without random access (NRA).

The score of a candidate for a query is a sum over dimensions, so each dimension
is a list of candidates sorted by what they add.  The lists are read in step from
the best end.  What has been read bounds every candidate from below (the rest adds
the least that its lists hold) and from above (the rest adds no more than where
the lists are being read).  A candidate whose upper bound is under the k-th best
lower bound is out for good; reading stops when few are left, and only these are
scored in full.

How the work is spread
  * Candidates are dealt into blocks by a hash of their id, and so are queries; a
    task joins one block of queries with one block of candidates and gives k rows
    a query.  It sorts the lists once for all its queries.  Neither side is
    broadcast or collected, and no task holds more than one block of each.
  * Equal vectors in a block are one entry of the lists with its smallest ids, so
    a very common vector costs one entry; only the k + 1 smallest ids can matter.
  * The best of all blocks are ranked per query: k rows for each block.

Vectors become integers, floor(scale * x) in double precision, so scores are exact
longs.  Bounds are exact too (sums of integers below 2^24 in single, 2^53 in double
precision, chosen by the values of the block; larger ones are an error).

Edge cases: vectors that are null, or hold nulls or non-finite numbers, take no
part, nor do rows without an id.  Rows with the query's id are its own and no
candidates.  Repeated rows are candidates each.  Vectors of different lengths are
compared over a common length, the shorter one filled with zeros; an empty vector
scores 0.  A query without candidates gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from kmerlake.llm.tables import cut, runs


class SortedLists:
    """A list for each dimension over distinct vectors, and how to read them.

    ``ids`` has for each vector its smallest ids (``keep`` at most), ascending.
    ``number`` is a floating type in which all sums that can occur are exact.
    """

    #: How far the lists are read before the bounds are looked at.
    DEPTHS = (1 / 2, 3 / 4, 7 / 8, 15 / 16)

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, keep: int, number: type = np.float64):
        order = np.lexsort((ids, *vectors.T[::-1]))
        vectors, ids = vectors[order], ids[order]
        heads = np.ones(len(ids), dtype=bool)
        heads[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
        first = np.flatnonzero(heads)
        self.ids = [ids[a : min(b, a + keep)] for a, b in zip(first, [*first[1:], len(ids)])]
        # Arrays by dimension, so that operations run along the lists.  A list serves
        # queries that are positive there, the one of the negated values the others.
        parts = np.ascontiguousarray(vectors[first].T.astype(number))
        self.parts = np.stack([parts, -parts])
        self.lists = -np.sort(-self.parts, axis=2)
        self.dimensions = np.arange(len(parts))

    def best(self, query: np.ndarray, k: int, hold: int = 64) -> np.ndarray:
        """Entries that include the ``k`` best for the query.

        The lists are read in step from their best ends until ``hold`` entries (or
        k) are left.
        """
        way = (query < 0).astype(np.int8)
        have, lists, weight = self.parts[way, self.dimensions], self.lists[way, self.dimensions], np.abs(query)
        n = have.shape[1]
        alive = np.arange(n)
        for part in self.DEPTHS:
            depth = int(n * part)
            if not depth or len(alive) <= max(hold, k):
                break
            front, least = lists[:, depth - 1], lists[:, -1]
            # What is under the front has not been read: it adds the front at most, the list's end at least.
            ceiling = weight @ np.maximum(have, front[:, None])
            floor = ceiling - (weight * (front - least)) @ (have < front[:, None]).astype(query.dtype)
            kth = np.partition(floor, len(floor) - k)[len(floor) - k]
            stay = np.flatnonzero(ceiling >= kth)
            if len(stay) < len(alive):
                alive, have = alive[stay], np.take(have, stay, axis=1, mode="clip")
        return alive

    def top(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """(score, id) of the ``k`` best candidates but the query's own id, ties to the smaller id."""
        query = query.astype(self.parts.dtype)
        left = self.best(query, k + 1)
        scores = query @ self.parts[0][:, left]
        # The k + 1 best distinct vectors hold the k best ids that are not the query's own.
        least = np.partition(scores, len(scores) - (k + 1))[len(scores) - (k + 1)] if len(scores) > k + 1 else -np.inf
        found = [(int(s), int(i)) for e, s in zip(left[scores >= least].tolist(), scores[scores >= least].tolist()) for i in self.ids[e] if i != own]
        return sorted(found, key=lambda x: (-x[0], x[1]))[:k]


def integer_vectors(rows: DataFrame, id_column: str, vector: str, scale: int = 256) -> DataFrame:
    """(vec_id, v): the vectors that take part, as arrays of long."""
    double = F.transform(F.col(vector), lambda x: x.cast("double"))
    sound = F.forall("d", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.select(F.col(id_column).cast("long").alias("vec_id"), double.alias("d")).where("vec_id is not null and d is not null").where(sound)
    return kept.select("vec_id", F.transform("d", lambda x: F.floor(x * float(scale))).alias("v"))


def _matrix(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def nearest(candidates: DataFrame, queries: DataFrame, k: int = 5, block: int = 8192, query_block: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` candidates of highest inner product for each query.

    Both sides are (vec_id, v) of ``integer_vectors``.  ``block`` and
    ``query_block`` bound the rows that a task holds of either side.
    """
    n, q = candidates.count(), queries.count()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-q // query_block))
    # A hash of id and vector deals repeated ids as well.
    deal = lambda parts: F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    asked = queries.select(deal(query_blocks).alias("qb"), every(blocks).alias("cb"), F.lit(1).alias("asks"), "vec_id", "v")
    given = candidates.select(every(query_blocks).alias("qb"), deal(blocks).alias("cb"), F.lit(0).alias("asks"), "vec_id", "v")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {0: ([], []), 1: ([], [])}
        for key, rows, last in runs(batches, ["qb", "cb"]):
            vectors = rows.column("v")
            at, values = np.asarray(vectors.offsets), vectors.values.to_numpy(zero_copy_only=False)
            for asks, i, a, b in zip(rows.column("asks").to_pylist(), rows.column("vec_id").to_pylist(), at[:-1], at[1:]):
                held[asks][0].append(i)
                held[asks][1].append(values[a:b].copy())
            if not last:
                continue
            (ids, have), (asking, wanted) = held[0], held[1]
            held = {0: ([], []), 1: ([], [])}
            if not ids or not asking:
                continue
            width = max(len(v) for v in (*have, *wanted))
            matrix, query = _matrix(have, width), _matrix(wanted, width)
            largest = 2.0 * width * float(np.abs(matrix).max(initial=0)) * float(np.abs(query).max(initial=0))
            if largest >= 2**53:
                raise ValueError("scores beyond 2^52 are not exact")
            lists = SortedLists(matrix, np.array(ids, dtype=np.int64), k + 1, np.float32 if largest < 2**24 else np.float64)
            out = [(own, i, s) for own, row in zip(asking, query) for s, i in lists.top(row, own, k)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["query_id", "vec_id", "score"])

    keys = ["qb", "cb"]
    met = asked.union(given).repartition(max(1, blocks * query_blocks), *keys).sortWithinPartitions(*keys)
    found = met.mapInArrow(join, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_vectors(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """``nearest`` of the rows whose id is divisible by ``every`` among all rows."""
    vectors = cut(integer_vectors(rows, id_column, vector, scale))
    return nearest(vectors, vectors.where(F.col("vec_id") % every == 0), k)
