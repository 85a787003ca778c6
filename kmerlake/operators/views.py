"""Figures and top lists told from result tables of any source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kmerlake.operators.insights import unknown
from kmerlake.operators.selection import quantiles
from kmerlake.operators.stage import written


def call_tally(profiles: DataFrame) -> DataFrame:
    """(drug, verdict, samples) of resistance profiles."""
    return profiles.groupBy("drug", "verdict").agg(F.count("*").alias("samples"))


def read_support(calls: DataFrame) -> DataFrame:
    """One row of figures over calls (alt_count, coverage, alt_percent); the medians are exact at any size."""
    calls = written(calls.select("alt_count", "coverage", "alt_percent"))
    median = lambda c: quantiles(calls, [], c, {"m": 0.5}).select("m").scalar()
    told = calls.agg(
        F.sum("alt_count").alias("alt_reads"), (F.sum("alt_count") * 100.0 / F.sum("coverage")).alias("weighted_alt"), F.count_if(F.col("alt_percent") >= 95).alias("fixed_loci"), F.count_if(F.col("coverage") < 10).alias("low_depth")
    )
    return told.select("alt_reads", "weighted_alt", median("alt_percent").alias("median_alt"), "fixed_loci", median("coverage").alias("median_depth"), "low_depth")


def sample_support(calls: DataFrame, group: str = "sample", top: int = 8) -> DataFrame:
    """(group, loci, coverage, weighted_alt, median_alt) of the groups with the highest weighted share of ALT, then the most coverage, then by name."""
    calls = written(calls.select(group, "alt_count", "coverage", "alt_percent"))
    per = calls.groupBy(group).agg(F.count("*").alias("loci"), F.sum("coverage").alias("coverage"), (F.sum("alt_count") * 100.0 / F.sum("coverage")).alias("weighted_alt"))
    best = written(per.orderBy(F.desc("weighted_alt"), F.desc("coverage"), group).limit(top))
    own = calls.join(F.broadcast(best.select(group)), calls[group].eqNullSafe(best[group]), "left_semi")
    medians = quantiles(own, [group], "alt_percent", {"median_alt": 0.5}).select(F.col(group).alias("_group"), "median_alt")
    return best.join(medians, best[group].eqNullSafe(medians["_group"]), "left").select(group, "loci", "coverage", "weighted_alt", "median_alt").orderBy(F.desc("weighted_alt"), F.desc("coverage"), group)


def strongest_markers(calls: DataFrame, top: int = 6) -> DataFrame:
    """The calls with the highest ALT percentage, then the most coverage, then by their other columns."""
    rest = [c for c in calls.columns if c not in ("alt_percent", "coverage")]
    return calls.where("alt_percent is not null").orderBy(F.desc("alt_percent"), F.desc("coverage"), *rest).limit(top)


def _support(counts: DataFrame, group: str) -> DataFrame:
    return counts.groupBy(group).agg((F.max("n") * 100.0 / F.sum("n")).alias("support"), F.count("*").alias("paths"), F.sum("n").alias("evidence"))


def lineage_evidence(counts: DataFrame, group: str = "sample") -> DataFrame:
    """One row over lineage counts: groups, mean support of the strongest path in percent, groups under 60 %, groups with several paths."""
    return _support(counts, group).agg(F.count("*").alias("samples"), F.avg("support").alias("mean_support"), F.count_if(F.col("support") < 60).alias("weak"), F.count_if(F.col("paths") > 1).alias("multi"))


def weakest_groups(counts: DataFrame, group: str = "sample", top: int = 8) -> DataFrame:
    """(group, support, paths, evidence) of the groups whose strongest path has the least support, then the most evidence."""
    return _support(counts, group).orderBy("support", F.desc("evidence"), group).limit(top)


def frequent_paths(counts: DataFrame, top: int = 5) -> DataFrame:
    """(path, n) of the paths with most evidence over all groups, then by name without case."""
    return counts.groupBy("path").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.lower("path"), "path").limit(top)


def confidence_bins(rows: DataFrame, value: Column) -> DataFrame:
    """(bin, n, mean) of confidences; ``mean`` is that of the bin."""
    bin_ = F.when(value < 0.5, "<0.5").when(value < 0.7, "0.5-0.7").when(value < 0.9, "0.7-0.9").otherwise(">=0.9")
    return rows.select(value.alias("v"), bin_.alias("bin")).where("v is not null").groupBy("bin").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))


def match_scores(rows: DataFrame, score: str, ref: str) -> DataFrame:
    """One row: matches, mean and best score and distinct references.  Percentages are scaled, odd values clamped, missing ones 0."""
    v = F.col(score)
    s = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when((v > 1.2) & (v <= 100), v / 100).otherwise(v))), F.lit(0.0))
    return rows.select(ref, s.alias("s")).agg(F.count("*").alias("n"), F.round(F.avg("s"), 9).alias("mean_score"), F.max("s").alias("best_score"), F.countDistinct(ref).alias("refs"))


def quality_summary(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, median, p90, low, high) where at least three values and a fifth of the rows are numbers; quantiles are exact at any size."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    told = written(rows.select(group, v.alias(value)))
    per = told.groupBy(F.col(group).alias("_group")).agg(F.count(value).alias("n"), F.count("*").alias("_all"), F.min(value).alias("low"), F.max(value).alias("high"))
    ranked = quantiles(told, [group], value, {"median": 0.5, "p90": 0.9}).drop("n")
    enough = per.where(F.col("n") >= F.greatest(F.lit(3.0), 0.2 * F.col("_all")))
    return enough.join(ranked, F.col("_group").eqNullSafe(F.col(group))).select(group, "n", "median", "p90", "low", "high")


def facets(rows: DataFrame, column: str, top: int = 5) -> DataFrame:
    """(label, n) of the most frequent values, and ``Unresolved`` with the rows of unknown outcome if there are any."""
    label = F.trim(F.coalesce(F.col(column), F.lit("")))
    counts = rows.groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    first = counts.where("label <> ''").orderBy(F.desc("n"), F.lower("label"), "label").limit(top)
    open_ = counts.where(unknown(F.col("label"))).agg(F.sum("n").alias("n")).where("n > 0").select(F.lit("Unresolved").alias("label"), "n")
    return first.union(open_)


def overview(rows: DataFrame, sample: str, call: str) -> DataFrame:
    """One row: distinct samples, rows with a known call and without, the top call and its share of the known ones."""
    per = rows.groupBy(F.col(call).alias("call")).agg(F.count("*").alias("n"))
    known = ~unknown(F.col("call"))
    whole = per.agg(F.sum(F.when(known, F.col("n")).otherwise(0)).alias("assigned"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("unresolved"), F.min(F.when(known, F.struct((-F.col("n")).alias("less"), "call"))).alias("top"))
    return whole.select(rows.agg(F.countDistinct(sample)).scalar().alias("samples"), "assigned", "unresolved", F.col("top.call").alias("top_call"), (-F.col("top.less") * 100.0 / F.col("assigned")).alias("top_share"))


def gene_segments(rows: DataFrame, gene: str, place: str, strand: str) -> DataFrame:
    """(gene, low, high, n, strand); as many ``+`` as others give ``+``."""
    plus = 2 * F.count_if(F.col(strand) == "+") >= F.count("*")
    return rows.groupBy(F.col(gene).alias("gene")).agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count("*").alias("n"), F.when(plus, "+").otherwise("-").alias("strand"))


def gene_context(rows: DataFrame, gene: str, place: str, modal: tuple[str, ...] = ("strand", "phase")) -> DataFrame:
    """(gene, low, high) and the most frequent value of each of the further columns, the smaller on ties."""
    out = rows.groupBy(gene).agg(F.min(place).alias("low"), F.max(place).alias("high"))
    for column in modal:
        counted = rows.groupBy(gene, column).agg(F.count("*").alias("n"))
        best = counted.groupBy(gene).agg(F.min(F.struct((-F.col("n")).alias("less"), column)).alias("m")).select(gene, F.col(f"m.{column}").alias(column))
        out = out.join(best, gene)
    return out
