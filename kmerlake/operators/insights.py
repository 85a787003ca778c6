"""Profiles, histograms and summaries of result tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from kmerlake.operators.prefix import running
from kmerlake.operators.selection import quantiles
from kmerlake.operators.stage import written

#: Clinical reading order of drug codes, fixed values; AMI is read as AMK.
DRUG_ORDER = ("RIF", "INH", "PZA", "EMB", "FQ", "BDQ", "LZD", "BDQ_CFZ", "CFZ", "DLM", "ETH", "PAS", "AMK", "KAN", "CAP", "STR", "OTHER")
#: Verdicts from the strongest evidence down.
VERDICTS = ("resistant", "uncertain", "ungraded", "not_assoc")
#: Spellings of an outcome that is not known, fixed values.
UNKNOWN = ("", "-", "na", "n/a", "none", "null", "unknown", "unassigned", "unclassified")


def verdict(grade: Column) -> Column:
    """What a confidence grade says: ``N) text`` by its number, other text by its words."""
    n = F.regexp_extract(grade, r"^\s*([1-5])\s*\)", 1)
    low = F.lower(grade)
    return (
        F.when(n.isin("1", "2"), "resistant").when(n == "3", "uncertain").when(n.isin("4", "5"), "not_assoc")
        .when(F.contains(low, F.lit("not assoc")), "not_assoc").when(F.contains(low, F.lit("assoc")), "resistant").when(F.contains(low, F.lit("uncertain")), "uncertain")
        .otherwise("ungraded")
    )


def resistance(path: Column) -> Column:
    """A resistance path as a struct; null unless it has four parts, a drug and a grade."""
    p = F.transform(F.split(path, ";"), lambda x: F.trim(x))
    part = lambda i: F.coalesce(F.try_element_at(p, F.lit(i)), F.lit(""))
    graded = part(4).rlike(r"^[1-5]\s*\)") | part(4).rlike("(?i)^unknown$") | part(4).rlike("(?i)literature")
    code = F.upper(part(1))
    return F.when((F.size(p) >= 4) & (part(1) != "") & graded, F.struct(F.when(code == "AMI", "AMK").otherwise(code).alias("drug"), part(3).alias("marker"), part(4).alias("grade"), verdict(part(4)).alias("verdict"), part(5).alias("gene"), F.coalesce(F.nullif(part(6), F.lit("")), part(3)).alias("mutation")))


def _rank(value: Column, order: tuple[str, ...]) -> Column:
    at = F.array_position(F.array(*[F.lit(x) for x in order]), value)
    return F.when(at > 0, at - 1).otherwise(len(order)).cast("int")


def profile(calls: DataFrame, group: str, path: str = "dr_path") -> DataFrame:
    """(group, drug, drug_rank, verdict, n_mutations, n_resistant, mutations): the strongest evidence for each drug.

    ``calls`` has the path and ``coverage``; mutations are listed strongest
    first, then by coverage, then by name.
    """
    seen = calls.select(group, "coverage", resistance(F.col(path)).alias("r")).where("r is not null").select(group, "coverage", "r.*")
    item = F.struct(_rank(F.col("verdict"), VERDICTS).alias("rank"), (-F.col("coverage")).alias("less"), F.col("mutation").alias("mutation"))
    out = seen.groupBy(group, "drug").agg(F.array_sort(F.collect_list(item)).alias("m"), F.count_if(F.col("verdict") == "resistant").alias("n_resistant"))
    best = F.array(*[F.lit(v) for v in VERDICTS])
    return out.select(group, "drug", _rank(F.col("drug"), DRUG_ORDER).alias("drug_rank"), F.element_at(best, F.col("m")[0]["rank"] + 1).alias("verdict"), F.size("m").cast("long").alias("n_mutations"), "n_resistant", F.array_join(F.transform("m", lambda x: x["mutation"]), ",").alias("mutations"))


def profile_summary(profiles: DataFrame, group: str) -> DataFrame:
    """One line for each group: its resistant drugs, else its uncertain ones."""
    ordered = F.array_sort(F.collect_list(F.struct("drug_rank", "drug", "verdict")))
    names = lambda v: F.array_join(F.transform(F.filter("p", lambda x: x["verdict"] == v), lambda x: x["drug"]), ", ")
    rows = profiles.groupBy(group).agg(ordered.alias("p"))
    text = F.when(names("resistant") != "", F.concat(F.lit("Resistant: "), names("resistant"))).when(names("uncertain") != "", F.concat(F.lit("No resistance markers; uncertain: "), names("uncertain"))).otherwise("No resistance markers")
    return rows.select(group, text.alias("summary"))


def profile_matrix(profiles: DataFrame, group: str) -> DataFrame:
    """Groups by drugs; a cell is the verdict, or null."""
    return profiles.groupBy(group).pivot("drug", [d for d in DRUG_ORDER]).agg(F.first("verdict"))


def is_resistance_panel(paths: DataFrame, path: str = "path") -> DataFrame:
    """One row: how many paths, how many parse, and whether at least half do."""
    told = paths.where(F.col(path).isNotNull() & (F.col(path) != "")).agg(F.count("*").alias("n_paths"), F.count_if(resistance(F.col(path)).isNotNull()).alias("n_resistance"))
    return told.withColumn("is_panel", (F.col("n_paths") > 0) & (F.col("n_resistance") >= F.greatest(F.lit(1), F.ceil(F.col("n_paths") * 0.5))))


def composition(branches: DataFrame, group: str, slots: int = 3) -> DataFrame:
    """(group, slot, specific): specific counts by branch; branches that lead most groups keep their name."""
    own = branches.where("specific > 0")
    lead = own.groupBy(group).agg(F.min(F.struct((-F.col("specific")).alias("s"), (-F.col("total")).alias("t"), "branch")).alias("b")).groupBy(F.col("b.branch").alias("branch")).agg(F.count("*").alias("leads"))
    weight = own.groupBy("branch").agg(F.sum("specific").alias("weight"))
    named = lead.join(weight, "branch").orderBy(F.desc("leads"), F.desc("weight"), "branch").limit(slots).select("branch", F.col("branch").alias("slot"))
    return own.join(F.broadcast(named), "branch", "left").groupBy(group, F.coalesce("slot", F.lit("Other")).alias("slot")).agg(F.sum("specific").alias("specific"))


def _finite(value: str) -> Column:
    return F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf"))


def histogram(values: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """(bin, n) of percentages in equal bins; 100 belongs to the last, what lies outside to the ends."""
    width = 100 / bins
    clamped = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col(value)))
    return values.where(_finite(value)).groupBy(F.least(F.lit(bins - 1), F.floor(clamped / width)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def mixed_share(values: DataFrame, value: str, low: float = 20, high: float = 80) -> DataFrame:
    """One row: how many percentages there are, how many lie from ``low`` to ``high`` (both included), and their share (0 without any)."""
    told = values.where(_finite(value)).agg(F.count("*").alias("n"), F.count_if(F.col(value).between(low, high)).alias("middle"))
    return told.withColumn("share", F.when(F.col("n") > 0, F.col("middle") / F.col("n")).otherwise(0.0))


def depth_fraction(calls: DataFrame, group: str) -> DataFrame:
    """Depth range, upper median and share of fractions in 20-80 of groups with three calls or more; the median is exact at any size."""
    kind = dict(calls.dtypes)["coverage"]
    good = written(calls.where("coverage > 0 and alt_percent is not null").select(group, "coverage", "alt_percent"))
    rows = good.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("n"), F.min("coverage").alias("min_depth"), F.max("coverage").alias("max_depth"), F.count_if(F.col("alt_percent").between(20, 80)).alias("middle")).where("n >= 3")
    medians = quantiles(good, [group], "coverage", {"median_depth": None}).drop("n")
    met = rows.join(medians, F.col("_group").eqNullSafe(F.col(group)))
    return met.select(group, "min_depth", "max_depth", F.col("median_depth").cast(kind).alias("median_depth"), "middle", (F.col("middle") / F.col("n")).alias("middle_ratio"))


def number(text: Column) -> Column:
    """The number a text begins with, comma or point as decimal mark; null if it begins with none."""
    return F.regexp_extract(F.replace(F.trim(text), F.lit(","), F.lit(".")), r"^[+-]?(?:\d+\.?\d*|\.\d+)", 0).try_cast("double")


def unknown(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit("")))).isin(*UNKNOWN)


def majority(rows: DataFrame, genome: str, call: str) -> DataFrame:
    """(call, genomes): each genome counts for its most frequent call, ties to the smaller in lower case."""
    per = rows.groupBy(genome, call).agg(F.count("*").alias("n"))
    best = per.groupBy(genome).agg(F.min(F.struct((-F.col("n")).alias("less"), F.lower(call).alias("low"), F.col(call).alias("call"))).alias("b"))
    return best.groupBy(F.col("b.call").alias("call")).agg(F.count("*").alias("genomes"))


def top_with_other(counts: DataFrame, label: str, n: str, top: int) -> DataFrame:
    """The ``top`` labels by count (ties by label) and all the rest as ``Other``."""
    first = counts.orderBy(F.desc(n), label).limit(top).select(F.col(label).alias("_name"))
    named = counts.join(F.broadcast(first), counts[label] == F.col("_name"), "left")
    return named.groupBy(F.coalesce("_name", F.lit("Other")).alias(label)).agg(F.sum(n).alias(n))


def filter_rows(df: DataFrame, text: str = "", columns: dict[str, str] | None = None) -> DataFrame:
    """Rows that hold ``text`` in any cell and pass each column's filter.

    A column filter is ``=``, ``>``, ``<``, ``>=`` or ``<=`` with a number, or
    text to be contained; case does not matter.
    """
    import re

    out = df
    if text:
        out = out.where(F.contains(F.lower(F.concat_ws("\x01", *[F.col(c).cast("string") for c in df.columns])), F.lit(text.lower())))
    for name, wanted in (columns or {}).items():
        m = re.fullmatch(r"\s*(>=|<=|=|>|<)\s*(-?[0-9]+(?:[.,][0-9]+)?)\s*", wanted)
        cell = F.col(name).cast("string")
        if m:
            x, y = number(cell), float(m[2].replace(",", "."))
            out = out.where({"=": x == y, ">": x > y, "<": x < y, ">=": x >= y, "<=": x <= y}[m[1]])
        elif wanted.strip():
            out = out.where(F.contains(F.lower(cell), F.lit(wanted.strip().lower())))
    return out


def quick_filter(df: DataFrame, column: str, kind: str, value: str = "") -> DataFrame:
    """Rows of one category, of unknown outcome, or of high or low confidence.

    Confidence thresholds are 0.9 and 0.5 when all numbers lie in 0 to 1.1, else
    90 and 50.
    """
    cell = F.col(column).cast("string")
    if kind == "category":
        return df.where(F.lower(F.trim(F.coalesce(cell, F.lit("")))) == value.strip().lower())
    if kind == "unknown":
        return df.where(unknown(cell))
    if kind not in ("high", "low"):
        raise ValueError(f"no such filter: {kind}")
    unit = df.agg((F.min(number(cell)) >= 0) & (F.max(number(cell)) <= 1.1)).scalar()
    scaled = number(cell) * F.when(unit, 100).otherwise(1)
    return df.where(scaled >= 90 if kind == "high" else scaled < 50)


def with_bases(df: DataFrame, ref: str | None, alt: str | None, kmer: str | None) -> DataFrame:
    """``Ref NT`` and ``Mut NT`` columns; without an ALT cell the middle base of the k-mer."""
    tidy = lambda c: F.nullif(F.upper(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))), F.lit(".")) if c else F.lit(None).cast("string")
    middle = F.regexp_extract(F.substring(tidy(kmer), F.floor(F.length(tidy(kmer)) / 2).cast("int") + 1, F.lit(1)), "^[ACGTN]$", 0) if kmer else F.lit("")
    return df.withColumns({"Ref NT": F.coalesce(tidy(ref), F.lit("")), "Mut NT": F.coalesce(F.nullif(tidy(alt), F.lit("")), middle, F.lit(""))})


def lineage_cells(cell: Column) -> Column:
    """A ``path:count`` cell as an array of (path, n); blanks and commas separate, the last colon counts."""
    parts = F.filter(F.split(F.coalesce(cell, F.lit("")), r"[\s,]+"), lambda x: x.rlike(r"^.+:\d+$"))
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, "^(.*):([0-9]+)$", 1).alias("path"), F.regexp_extract(x, "^(.*):([0-9]+)$", 2).cast("long").alias("n")))


def scored_search(df: DataFrame, fields: list[str], query: str, order: list[str], most: int = 2500, positions: tuple[str, ...] = ()) -> DataFrame:
    """Rows by how their fields match the words of a query: 14 points for equal, 8 for a beginning, 4 for a part.

    Where there are ``positions``, a query that is a number asks for the rows with just this position; they have no score.
    """
    if positions and re.fullmatch(r"\s*[+-]?[0-9]+(\.[0-9]*)?\s*", query):
        at = F.floor(F.lit(float(query)) + 0.5)
        here = F.array_contains(F.array(*[F.floor(F.col(p).cast("double") + 0.5) for p in positions]), at)
        return df.withColumn("score", F.lit(None).cast("int")).where(here).orderBy(*order).limit(most)
    low = F.array(*[F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields])
    score = F.lit(0)
    for word in query.lower().split():
        score = score + _points(low, F.lit(word))
    return df.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), *order).limit(most)


def header(name: str | None) -> str:
    """A column's name in lower case with ``_`` for everything but letters and digits."""
    return re.sub("[^a-z0-9]+", "_", (name or "").strip().lower())


def column_of(names: list[str], tokens: list[str], exact_only: bool = False) -> str | None:
    """The first column that is a token or, for tokens of more than three characters, holds it; tokens in order."""
    for token in map(header, tokens):
        found = [n for n in names if header(n) == token]
        if not found and not exact_only and len(token) > 3:
            found = [n for n in names if token in header(n)]
        if found:
            return found[0]
    return None


def _points(fields: Column, word: Column) -> Column:
    begins, holds = F.exists(fields, lambda x: F.startswith(x, word)), F.exists(fields, lambda x: F.contains(x, word))
    return F.when(F.array_contains(fields, word), 14).when(begins, 8).when(holds, 4).otherwise(0)


def every_nth(df: DataFrame, group: str, order: list[str], most: int, parts: int | None = None) -> DataFrame:
    """Rows of each group thinned by an even stride to about ``most``; one group may fill many tasks."""
    df = written(df)
    sizes = df.groupBy(F.col(group).alias("_of")).agg(F.count("*").alias("_n"))
    numbered = running(df.withColumn("_one", F.lit(1).cast("long")), [group], order, {"_i": ("sum", "_one")}, before=True, parts=parts)
    met = numbered.join(sizes, F.col(group).eqNullSafe(F.col("_of")))
    return met.where(F.col("_i") % F.greatest(F.lit(1), F.ceil(F.col("_n") / most)) == 0).select(*df.columns)
