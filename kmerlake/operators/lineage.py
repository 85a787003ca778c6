"""Roll-ups and calls over lineage paths (``L2;L2.2``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kmerlake.operators.stage import written

UNCLASSIFIED = "Unclassified"


def prefixes(levels: Column) -> Column:
    """Every ancestor path of an array of levels, itself included; an empty array has none."""
    return F.when(F.size(levels) > 0, F.transform(F.sequence(F.lit(1), F.size(levels)), lambda n: F.array_join(F.slice(levels, F.lit(1), n), ";"))).otherwise(F.array().cast("array<string>"))


def lineage_counts(hits: DataFrame, group: str, levels: str = "levels") -> DataFrame:
    """(group, path, n): each hit counts for every ancestor of its path."""
    return hits.select(group, F.explode(prefixes(F.col(levels))).alias("path")).groupBy(group, "path").agg(F.count("*").alias("n"))


def major_flat(counts: DataFrame, group: str) -> DataFrame:
    """The most frequent path of each group; ties go to the smaller path."""
    return counts.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("less"), "path")).alias("best")).select(group, F.col("best.path").alias("major"))


def major_nested(counts: DataFrame, group: str) -> DataFrame:
    """The deepest path all of whose ancestors were seen, unless a more frequent path is on another branch.

    The number of paths of a group is bounded by the marker panel, so a group's
    paths are gathered into one set.
    """
    seen = counts.groupBy(group).agg(F.collect_list(F.struct("path", "n")).alias("tally"))
    paths = F.transform("tally", lambda t: t["path"])

    def supported(t: Column) -> Column:
        parts = F.split(t["path"], ";")
        return F.when(F.size(parts) < 2, F.lit(True)).otherwise(F.forall(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_contains(F.col("paths"), F.array_join(F.slice(parts, F.lit(1), n), ";"))))

    key = lambda t: F.struct((-F.size(F.split(t["path"], ";"))).alias("depth"), (-t["n"]).alias("less"), t["path"].alias("path"))
    held = seen.withColumn("paths", paths).select(
        group,
        F.array_min(F.transform(F.filter("tally", supported), key)).alias("deep"),
        F.array_min(F.transform("tally", lambda t: F.struct((-t["n"]).alias("less"), t["path"].alias("path")))).alias("most"),
    )
    deep, most = F.col("deep.path"), F.col("most.path")
    one_branch = (deep == most) | F.startswith(deep, F.concat(most, F.lit(";"))) | F.startswith(most, F.concat(deep, F.lit(";")))
    call = F.when(F.col("deep").isNull() | (~one_branch & (F.col("most.less") < F.col("deep.less"))), most).otherwise(deep)
    return held.select(group, call.alias("major"))


def with_unclassified(groups: DataFrame, calls: DataFrame, group: str) -> DataFrame:
    """Every group, those without a call as unclassified."""
    return groups.select(group).distinct().join(calls, group, "left").withColumn("major", F.coalesce("major", F.lit(UNCLASSIFIED)))


def summary_line(counts: DataFrame, group: str) -> DataFrame:
    """One ``path:count`` list a group, most frequent first, then by path."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), F.col("path").alias("path"))))
    return counts.groupBy(group).agg(F.array_join(F.transform(ordered, lambda t: F.concat_ws(":", t["path"], (-t["less"]).cast("string"))), " ").alias("counts"))


def compatible(a: Column, b: Column) -> Column:
    """Whether one of two arrays of levels begins with the other."""
    n = F.least(F.size(a), F.size(b))
    return (n > 0) & (F.slice(a, F.lit(1), n) == F.slice(b, F.lit(1), n))


def branches(counts: DataFrame, group: str) -> DataFrame:
    """(group, branch, total, specific) of the paths that no other path of the group extends.

    ``total`` adds the counts of all paths on the branch, ``specific`` those of
    paths that lie on no other branch.
    """
    # Read five times below; written, the hits behind the counts are found once.
    merged = written(counts.groupBy(group, "path").agg(F.sum("n").alias("n")))
    longer = merged.select(group, F.col("path").alias("longer"))
    same = merged[group] == longer[group]
    tips = merged.join(longer, same & F.startswith(longer["longer"], F.concat(merged["path"], F.lit(";"))), "left_anti").select(group, F.col("path").alias("branch"))
    pairs = merged.join(tips, group).where(compatible(F.split("path", ";"), F.split("branch", ";")))
    shared = pairs.groupBy(group, "path").agg(F.count("*").alias("n_tips"))
    told = pairs.join(shared, [group, "path"])
    return told.groupBy(group, "branch").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("n_tips") == 1, F.col("n")).otherwise(0)).alias("specific"))


def mixed(branch_table: DataFrame, group: str, least: int = 2) -> DataFrame:
    """(group, n_supported, total_specific, mixed): two branches with evidence of their own, or more."""
    own = F.col("specific") >= least
    return branch_table.groupBy(group).agg(F.count_if(own).alias("n_supported"), F.sum(F.when(own, F.col("specific")).otherwise(0)).alias("total_specific")).withColumn("mixed", F.col("n_supported") >= 2)


def levels_tree(counts: DataFrame, group: str) -> DataFrame:
    """(group, path, depth, n): every node of the tree; inner nodes never named count 0."""
    nodes = counts.select(group, F.explode(prefixes(F.split("path", ";"))).alias("node"), "path", "n")
    return nodes.groupBy(group, F.col("node").alias("path")).agg(F.max(F.when(F.col("node") == F.col("path"), F.col("n")).otherwise(0)).alias("n")).withColumn("depth", F.size(F.split("path", ";")))
