"""Genes over positions, amino-acid changes and masks."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from kmerlake.functions.seq import clean_revcomp, revcomp
from kmerlake.operators.prefix import running
from kmerlake.operators.refstore import ReferenceStore, stored, with_bases
from kmerlake.operators.stage import written

#: The standard genetic code in T, C, A, G order of the three bases, fixed values.
_BASES = "TCAG"
_ONE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
_THREE = {"A": "Ala", "R": "Arg", "N": "Asn", "D": "Asp", "C": "Cys", "Q": "Gln", "E": "Glu", "G": "Gly", "H": "His", "I": "Ile", "L": "Leu", "K": "Lys", "M": "Met", "F": "Phe", "P": "Pro", "S": "Ser", "T": "Thr", "W": "Trp", "Y": "Tyr", "V": "Val", "*": "Stp"}
CODONS = {"".join(c): a for c, a in zip(product(_BASES, repeat=3), _ONE)}


def _lookup(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def amino3(codon: Column) -> Column:
    """Three-letter amino acid of a codon, ``Stp`` for a stop, ``???`` if unknown."""
    return F.coalesce(F.try_element_at(_lookup({c: _THREE[a] for c, a in CODONS.items()}), codon), F.lit("???"))


def amino1(codon: Column) -> Column:
    return F.coalesce(F.try_element_at(_lookup(CODONS), codon), F.lit("X"))


#: Bits of the bins that intervals are put into, by level: 1 kb, 8 kb and so on to 2 Gb.
_LEVELS = tuple(range(10, 32, 3))
_NO_LEVEL = len(_LEVELS)


def _bin(level: int | Column, number: Column) -> Column:
    return F.struct(F.lit(level).cast("int").alias("level"), number.cast("long").alias("number"))


def home_bin(start: Column, end: Column) -> Column:
    """The smallest bin that holds a half-open interval whole; what fits into none has a bin of its own."""
    first, last = start.cast("long"), F.greatest(end.cast("long") - 1, start.cast("long"))
    out = _bin(_NO_LEVEL, F.lit(0))
    for level, bits in reversed(list(enumerate(_LEVELS))):
        out = F.when(F.shiftright(first, bits) == F.shiftright(last, bits), _bin(level, F.shiftright(first, bits))).otherwise(out)
    return out


def met_bins(start: Column, end: Column) -> Column:
    """The bins of all levels that a half-open interval touches."""
    first, last = start.cast("long"), F.greatest(end.cast("long") - 1, start.cast("long"))

    def touched(level: int, bits: int) -> Column:
        return F.transform(F.sequence(F.shiftright(first, bits), F.shiftright(last, bits)), lambda n: _bin(level, n))

    each = [touched(level, bits) for level, bits in enumerate(_LEVELS)]
    return F.concat(*each, F.array(_bin(_NO_LEVEL, F.lit(0))))


def overlapping(hits: DataFrame, intervals: DataFrame, start: str = "start", end: str = "stop", most: int = 200_000) -> DataFrame:
    """Pairs of a hit's half-open stretch (``h_start``, ``h_end``) and an interval that overlap, each once.

    An equi-join on bins instead of a nested loop.  An interval is one row, however
    long: it lies in the smallest bin that holds it.  A hit looks into the bins it
    touches, one a level if it is short; a long hit touches many small ones.  Up to
    ``most`` intervals (counted first) go to the tasks; the hits, each a row for every
    bin, never do, whatever size their table is taken to have.
    """
    placed = intervals.withColumn("_bin", home_bin(F.col(start), F.col(end)))
    placed = F.broadcast(placed) if intervals.limit(most + 1).count() <= most else placed.hint("merge")
    asked = hits.withColumn("_bin", F.explode(met_bins(F.col("h_start"), F.col("h_end"))))
    return asked.join(placed, "_bin").where((F.col("h_start") < F.col(end)) & (F.col("h_end") > F.col(start))).drop("_bin")


def first_gene(hits: DataFrame, genes: DataFrame, key: str) -> DataFrame:
    """Each hit with the first overlapping gene by start, stop and id; null columns without one."""
    met = overlapping(hits, genes).groupBy(key).agg(F.min(F.struct("start", "stop", "id", "strand")).alias("gene"))
    return hits.join(met, key, "left")


def best_feature(points: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Each point (``h_start``) with the feature over it of best priority, then shortest, then first."""
    # Of features over one stretch only the best can win, so copies of it do not meet every point.
    distinct = features.groupBy("start", "stop").agg(F.min(F.struct("priority", "id")).alias("_f")).select("start", "stop", "_f.priority", "_f.id")
    met = overlapping(points, distinct).groupBy(key).agg(F.min(F.struct("priority", (F.col("stop") - F.col("start")).alias("span"), "start", "stop", "id")).alias("best"))
    return points.join(met, key, "left")


def with_amino_change(df: DataFrame, reference: ReferenceStore | str, pos0: Column, ref_len: Column, alt: Column, start: Column, stop: Column, strand: Column, name: str = "aa") -> DataFrame:
    """``df`` with ``name``: ``aa_pos`` and ``change`` of a variant in a gene (0-based, half-open).

    Substitutions list one change a codon; variants that change the length give
    ``frameshift_posN``.  Null before the gene's begin or without a strand.  Only
    the codons in question are read from the reference.
    """
    store = stored(df.sparkSession, reference)
    size = store.length
    forward = strand == "+"
    last = pos0 + ref_len - 1
    # On the reverse strand everything is counted on the reverse complement.
    told = df.withColumns({
        "_at": F.when(forward, pos0).otherwise(size - last - 1),
        "_to": F.when(forward, last).otherwise(size - pos0 - 1),
        "_begin": F.when(forward, start).otherwise(size - stop),
        "_end": F.when(forward, F.greatest(stop, F.lit(1)) - 1).otherwise(size - start - 1),
        "_alt": F.when(forward, alt).otherwise(clean_revcomp(alt)),
        "_good": F.coalesce(strand.isin("+", "-"), F.lit(False)),
        "_same": ref_len == F.length(alt),
    })
    told = told.withColumns({"_lead": F.floor((F.col("_at") - F.col("_begin")) / 3).cast("int"), "_tail": F.floor((F.least("_to", "_end") - F.col("_begin")) / 3).cast("int")})
    good = F.col("_good") & (F.col("_at") >= F.col("_begin"))
    from_, wide = F.col("_begin") + 3 * F.col("_lead"), F.greatest(3 * (F.col("_tail") - F.col("_lead") + 1), F.lit(0))
    told = with_bases(told.withColumn("_window", from_), store, F.when(good & F.col("_same"), F.when(forward, from_).otherwise(size - from_ - wide)), wide, "_bases")
    told = told.withColumn("_bases", F.when(forward, F.col("_bases")).otherwise(revcomp(F.col("_bases"))))

    def change(i: Column) -> Column:
        at = F.col("_begin") + 3 * i
        codon = F.substring(F.col("_bases"), (at - F.col("_window") + 1).cast("int"), F.lit(3))
        base = lambda j: F.when((at + j >= F.col("_at")) & (at + j <= F.col("_to")), F.substring(F.col("_alt"), (at + j - F.col("_at") + 1).cast("int"), F.lit(1))).otherwise(F.substring(codon, j + 1, 1))
        new = F.concat(base(0), base(1), base(2))
        return F.concat(amino3(codon), (i + 1).cast("string"), amino3(new), F.lit("("), codon, F.lit(">"), new, F.lit(")"), F.when(amino3(codon) == amino3(new), " syn").otherwise(""))

    inside = F.filter(F.sequence(F.col("_lead"), F.greatest("_tail", "_lead")), lambda i: (i <= F.col("_tail")) & (F.col("_begin") + 3 * i + 3 <= size))
    first = (F.col("_lead") + 1).alias("aa_pos")
    substitution = F.when(F.size(inside) > 0, F.struct(first, F.array_join(F.transform(inside, change), ";").alias("change")))
    shift = F.struct(first, F.concat(F.lit("frameshift_pos"), (F.col("_lead") + 1).cast("string")).alias("change"))
    return told.withColumn(name, F.when(good, F.when(F.col("_same"), substitution).otherwise(shift))).drop("_at", "_to", "_begin", "_end", "_alt", "_good", "_same", "_lead", "_tail", "_window", "_bases")


def codon_series(genes: DataFrame, reference: ReferenceStore | str) -> DataFrame:
    """(id, strand, codon_start from 1, codon, aa) along each gene, in reading direction, from its phase."""
    plus = F.col("strand") != "-"
    starts = F.when(plus, F.sequence(F.col("g_start") + F.col("phase"), F.greatest(F.col("g_end") - 2, F.col("g_start") + F.col("phase")), F.lit(3))).otherwise(
        F.sequence(F.col("g_end") - F.col("phase") - 2, F.least(F.col("g_start"), F.col("g_end") - F.col("phase") - 2), F.lit(-3))
    )
    rows = genes.select("id", "strand", "g_start", "g_end", F.explode(starts).alias("codon_start")).where("codon_start >= g_start and codon_start + 2 <= g_end")
    rows = with_bases(rows, reference, F.col("codon_start") - 1, F.lit(3), "cut")
    codon = F.when(plus, F.col("cut")).otherwise(clean_revcomp(F.col("cut")))
    return rows.select("id", "strand", "codon_start", codon.alias("codon"), amino1(codon).alias("aa"))


def merged_ranges(ranges: DataFrame, group: list[str], start: str = "start", stop: str = "stop", parts: int | None = None) -> DataFrame:
    """Ranges that overlap or touch, merged, within each group; a null start or stop is no range.

    One group may fill many tasks: where earlier ranges reach, and in which island
    a range lies, are running values (``prefix.running``).
    """
    kinds = dict(ranges.dtypes)
    sound = ranges.where(F.col(start).isNotNull() & F.col(stop).isNotNull()).select(*group, F.col(start).cast("long").alias("_from"), F.col(stop).cast("long").alias("_to"))
    # Of ranges with one start the longest covers the others.  No ties are left, so both passes see one order.
    sound = written(sound.groupBy(*group, "_from").agg(F.max("_to").alias("_to")))
    reached = running(sound, group, ["_from"], {"_reach": ("max", "_to")}, before=True, parts=parts)
    opened = reached.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("_from") > F.col("_reach")), F.col("_from")))
    # Islands lie apart, so the latest start of one tells it from the others.
    placed = running(opened.drop("_reach"), group, ["_from"], {"_island": ("max", "_new")}, parts=parts)
    return placed.groupBy(*group, "_island").agg(F.min("_from").cast(kinds[start]).alias(start), F.max("_to").cast(kinds[stop]).alias(stop)).drop("_island")


def mask(seq: Column, ranges: Column) -> Column:
    """A sequence with N over an array of (start, stop), 0-based and half-open; what lies outside is ignored."""

    def cover(s: Column, r: Column) -> Column:
        a, b = F.greatest(r["start"], F.lit(0)).cast("int"), F.least(r["stop"].cast("int"), F.length(s))
        return F.when(b > a, F.concat(F.substring(s, F.lit(1), a), F.repeat(F.lit("N"), b - a), F.substring(s, b + 1, F.length(s)))).otherwise(s)

    return F.aggregate(ranges, seq, cover)
