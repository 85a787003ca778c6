"""Running totals over arriving reads.

k-mer and allele counts are sums, so a stream ends with the batch's totals.  State
is one row a key; it is kept by Spark's state store and recovered from the query's
checkpoint.  Each trigger writes the keys that it changed, with their new totals,
to a table in shared storage; nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from kmerlake.operators import contain, scan


def kmer_totals(reads: DataFrame, k: int) -> DataFrame:
    """(kmer, n) over a stream of reads with ``seq``."""
    return contain.kmer_counts(reads, k)


def allele_totals(reads: DataFrame, index: DataFrame, k: int, group: str = "sample") -> DataFrame:
    """(group, marker_id, ref_count, alt_count) over a stream; ``index`` is a batch table."""
    return scan.allele_counts(reads, index, k, group)


def run_available(totals: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Work off what is there and stop; ``table`` is a folder that ``latest`` reads.

    A trigger's rows lie in a folder of its number, so one that is repeated after a
    failure replaces what it had written.
    """

    def keep(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{table}/trigger={number}")

    query = totals.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def latest(spark: SparkSession, table: str, keys: list[str]) -> DataFrame:
    """The totals as they stand: of each key the row of its last trigger."""
    rows = spark.read.option("basePath", table).parquet(table)
    values = [c for c in rows.columns if c not in (*keys, "trigger")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col("trigger").cast("long")).alias("_v"))
    return last.select(*keys, "_v.*")


def compact(spark: SparkSession, table: str, into: str, keys: list[str]) -> None:
    """The totals as they stand, written as the first trigger of a new table, for a stream that has ended."""
    latest(spark, table, keys).write.mode("overwrite").parquet(f"{into}/trigger=-1")
