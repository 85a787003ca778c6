"""Marker catalogues: grades, composite drug labels, deduplication and coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kmerlake.functions.seq import clean_revcomp, complement
from kmerlake.operators.annotate import _THREE, CODONS, amino1
from kmerlake.operators.refstore import ReferenceStore, with_bases

#: Order of drugs in a composite label, fixed values.
LABEL_ORDER = ("RIF", "INH", "EMB", "PZA", "STR", "FQ", "ETH", "AMI", "KAN", "CAP", "LZD", "BDQ", "CFZ", "DLM")


#: Order of drugs in a written catalogue, fixed values.
CATALOGUE_ORDER = ("RIF", "INH", "EMB", "PZA", "STR", "FQ", "ETH", "AMI", "KAN", "CAP", "LZD", "BDQ", "CFZ", "BDQ_CFZ", "DLM", "OTHER")


def in_frame(markers: DataFrame, reference: ReferenceStore | str) -> DataFrame:
    """Markers (pos, ref, alt) told in the frame of a reference: ``ref`` are its bases there, ``changed`` says where they differ from the marker's.

    At its end there may be fewer; beyond it the marker's own bases stay.  A marker whose
    alternative is what the reference has is no variant there and drops out.
    """
    told = with_bases(markers.withColumn("_own", F.col("ref")).drop("ref"), reference, F.col("pos") - 1, F.length("_own"), "_there")
    ref = F.when((F.col("pos") > 0) & (F.col("_there") != ""), F.col("_there")).otherwise(F.col("_own"))
    framed = told.withColumn("ref", ref).withColumn("changed", F.col("ref") != F.col("_own")).where("ref <> alt")
    return framed.select(*markers.columns, "changed")


def catalogue_rank(drug: Column) -> Column:
    """The place of a drug in a written catalogue; drugs without one come last.  Rows are ordered by it, then by position."""
    place = F.array_position(F.array(*[F.lit(d) for d in CATALOGUE_ORDER]), drug)
    return F.when(place > 0, place - 1).otherwise(999).cast("int")


def catalogue_frames(markers: DataFrame, references: dict[str, ReferenceStore | str]) -> DataFrame:
    """The catalogue in the frame of every reference, with ``frame`` and ``drug_rank``."""
    out = None
    for name, reference in references.items():
        one = in_frame(markers, reference).withColumns({"frame": F.lit(name), "drug_rank": catalogue_rank(F.col("drug"))})
        out = one if out is None else out.union(one)
    return out


def grade_rank(grade: Column) -> Column:
    """0 for ``1)`` to 4 for ``5)``, 9 for anything else."""
    n = F.regexp_extract(grade, r"^([1-5])\)", 1)
    return F.when(n != "", n.cast("int") - 1).otherwise(9)


def collapse(grades: DataFrame) -> DataFrame:
    """(variant, label, grade) from (variant, drug, grade): drugs graded 1 or 2 in one label with the strongest grade.

    LEV and MXF are read as FQ; drugs without a place in ``LABEL_ORDER`` are left out.
    """
    kept = grades.select("variant", F.when(F.col("drug").isin("LEV", "MXF"), "FQ").otherwise(F.col("drug")).alias("drug"), "grade", grade_rank(F.col("grade")).alias("rank")).where("rank <= 1").where(F.col("drug").isin(*LABEL_ORDER))
    at = F.array_position(F.array(*[F.lit(d) for d in LABEL_ORDER]), F.col("drug"))
    item = F.struct(at.alias("at"), F.col("drug").alias("drug"))
    out = kept.groupBy("variant").agg(F.array_sort(F.collect_set(item)).alias("d"), F.min(F.struct("rank", "grade")).alias("g"))
    return out.select("variant", F.array_join(F.transform("d", lambda x: x["drug"]), "_").alias("label"), F.col("g.grade").alias("grade"))


def strongest_of_each(markers: DataFrame) -> DataFrame:
    """One marker for each (pos, ref, alt): the strongest grade, the first ordinal on ties."""
    rest = [c for c in markers.columns if c not in ("pos", "ref", "alt", "ordinal")]
    best = markers.groupBy("pos", "ref", "alt").agg(F.min(F.struct(grade_rank(F.col("grade")).alias("rank"), "ordinal", *rest)).alias("b"))
    return best.select("pos", "ref", "alt", F.col("b.ordinal").alias("ordinal"), *[F.col(f"b.{c}").alias(c) for c in rest])


def append_new(existing: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """The catalogue with those of the further markers whose keys it lacks, each once (the first ordinal)."""
    rest = [c for c in more.columns if c not in keys and c != "ordinal"]
    fresh = more.join(existing.select(*keys), keys, "left_anti").groupBy(*keys).agg(F.min(F.struct("ordinal", *rest)).alias("b"))
    return existing.unionByName(fresh.select(*keys, F.col("b.ordinal").alias("ordinal"), *[F.col(f"b.{c}").alias(c) for c in rest]))


def gene_position(start: Column, end: Column, strand: Column, place: Column) -> Column:
    """Genome position (from 1) of a place in a gene (from 1; negative before its begin)."""
    offset = F.when(place > 0, place - 1).otherwise(place)
    return F.when(strand == "-", end - offset).otherwise(start + offset)


def _one_letter(three: Column) -> Column:
    """One-letter code of a three-letter amino acid, anything else as it is."""
    table = F.create_map(*[F.lit(x) for one, name in _THREE.items() if one != "*" for x in (name, one)])
    return F.coalesce(F.try_element_at(table, three), three)


_PROTEIN = r"^p\.([A-Z][a-z]{2})(\d+)([A-Z][a-z]{2}|\*|del|ins.*)"


def variant_parts(name: Column) -> Column:
    """Gene and mutation of ``gene_mutation``; ``LoF_`` goes to the gene, protein changes get one-letter codes."""
    rest = F.regexp_extract(name, "^[^_]*_(.*)$", 1)
    lost = F.startswith(rest, F.lit("LoF_"))
    bare = F.when(lost, F.substring(rest, F.lit(5), F.length(rest))).otherwise(rest)
    part = lambda i: F.regexp_extract(bare, _PROTEIN, i)
    protein = F.when(part(1) != "", F.concat(_one_letter(part(1)), part(2), _one_letter(part(3)))).otherwise(F.regexp_replace(bare, r"^p\.", ""))
    gene = F.concat(F.regexp_extract(name, "^([^_]*)", 1), F.when(lost, "_LoF").otherwise(""))
    whole = ~F.contains(name, F.lit("_"))
    return F.struct(F.when(whole, name).otherwise(gene).alias("gene"), F.when(whole, name).when(F.startswith(bare, F.lit("p.")), protein).otherwise(bare).alias("mutation"))


def protein_snps(variants: DataFrame, reference: ReferenceStore | str) -> DataFrame:
    """Protein changes (``mutation`` like ``p.Ser450Leu``, with gene ``start``, ``end``, ``strand``) as single bases.

    Adds pos, ref and alt, one row a changed base.  The codon with the fewest
    changes is taken, on ties the first by middle, first and last base in T, C, A, G order.  Changes whose
    first amino acid is not the reference's, insertions and deletions drop out.
    """
    part = lambda i: F.regexp_extract("mutation", _PROTEIN, i)
    told = variants.where((part(1) != "") & ~part(3).rlike("^(del|ins)")).withColumns({"_from": _one_letter(part(1)), "_to": _one_letter(part(3)), "_cds": (part(2).cast("int") - 1) * 3})
    plus = F.col("strand") == "+"
    told = told.withColumn("_first", F.when(plus, F.col("start") + F.col("_cds")).otherwise(F.col("end") - F.col("_cds") - 2))
    told = with_bases(told, reference, F.col("_first") - 1, F.lit(3), "_cut")
    told = told.withColumn("_codon", F.when(plus, F.col("_cut")).otherwise(clean_revcomp(F.col("_cut")))).drop("_cut").where(amino1(F.col("_codon")) == F.col("_from"))
    ordered = sorted(CODONS, key=lambda c: ["TCAG".index(c[i]) for i in (1, 0, 2)])
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("c"), F.lit(CODONS[c]).alias("a")) for i, c in enumerate(ordered)])
    at = lambda c, j: F.substring(c, F.lit(j), F.lit(1))
    changes = lambda c: sum((F.when(at(c, j) != at(F.col("_codon"), j), 1).otherwise(0) for j in (1, 2, 3)), F.lit(0))
    best = F.array_min(F.transform(F.filter(table, lambda x: x["a"] == F.col("_to")), lambda x: F.struct(changes(x["c"]).alias("n"), x["i"].alias("i"), x["c"].alias("c"))))["c"]
    rows = told.withColumn("_new", best).where("_new is not null").withColumn("_j", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    base = lambda c: F.substring(F.col(c), F.col("_j") + 1, F.lit(1))
    rows = rows.where(base("_codon") != base("_new"))
    strand = lambda c: F.when(plus, base(c)).otherwise(complement(base(c)))
    return rows.withColumns({"pos": F.when(plus, F.col("_first") + F.col("_j")).otherwise(F.col("_first") + 2 - F.col("_j")), "ref": strand("_codon"), "alt": strand("_new")}).drop("_from", "_to", "_cds", "_first", "_codon", "_new", "_j")


def base_snps(variants: DataFrame, reference: ReferenceStore | str) -> DataFrame:
    """Base changes (``c.1210C>T``, ``c.-15C>T``, ``n.1401A>G``) with pos, ref and alt on the genome.

    On the reverse strand the bases are complemented, unless only the bases as
    written agree with the reference; a change that agrees neither way drops out.
    """
    form = r"^[cn]\.(-?\d+)([ACGT])>([ACGT])"
    part = lambda i: F.regexp_extract("mutation", form, i)
    told = variants.where(part(1) != "").withColumn("pos", gene_position(F.col("start"), F.col("end"), F.col("strand"), part(1).cast("int")))
    told = with_bases(told, reference, F.col("pos") - 1, F.lit(1), "_there")
    there = F.col("_there")
    turned = lambda i: F.when(F.col("strand") == "-", complement(part(i))).otherwise(part(i))
    pick = lambda i: F.when(there == turned(2), turned(i)).when(there == part(2), part(i))
    return told.withColumns({"ref": pick(2), "alt": pick(3)}).where("ref is not null and pos > 0").drop("_there")


def literature_grade(confidence: Column) -> Column:
    """Free text on confidence as a grade; its case counts.  Text that says nothing is ``TBProfiler_literature``.  The texts looked for and the grades are fixed values."""
    has = lambda x: F.contains(F.coalesce(confidence, F.lit("")), F.lit(x))
    grade = lambda interim, plain: F.when(has("Interim"), interim).otherwise(plain)
    return (
        F.when(has("Assoc w R") & ~has("Not"), grade("2) Assoc w R - Interim", "1) Assoc w R"))
        .when(has("Uncertain"), "3) Uncertain significance")
        .when(has("Not assoc"), grade("4) Not assoc w R - Interim", "5) Not assoc w R"))
        .otherwise("TBProfiler_literature")
    )


def with_drug(variants: DataFrame, grades: DataFrame, gene_drug: DataFrame) -> DataFrame:
    """``variants`` (variant, gene) of the genes in ``gene_drug`` (gene, drug) with ``label`` and ``grade``.

    Both come from ``grades``; where no drug has grade 1 or 2 it is the gene's drug with the variant's strongest grade, or ``Unknown``.
    """
    best = grades.groupBy("variant").agg(F.min(F.struct(grade_rank(F.col("grade")), "grade"))["grade"].alias("_any"))
    own = collapse(grades).withColumnRenamed("grade", "_own")
    out = variants.join(gene_drug.select("gene", F.col("drug").alias("_drug")), "gene").join(own, "variant", "left").join(best, "variant", "left")
    return out.select(*variants.columns, F.coalesce("label", "_drug").alias("label"), F.coalesce("_own", "_any", F.lit("Unknown")).alias("grade"))


def gene_of(mutations: DataFrame, genes: DataFrame) -> DataFrame:
    """``mutations`` (gene) with the start, end, strand and gene_id of the gene (ordinal, name, gene_id, start, end, strand) so named, the last if several, else of the first with this id."""
    place = F.struct("start", "end", "strand", "gene_id")
    named = genes.where("name != ''").groupBy(F.col("name").alias("gene")).agg(F.max_by(place, "ordinal").alias("by_name"))
    known = genes.where("gene_id != ''").groupBy(F.col("gene_id").alias("gene")).agg(F.min_by(place, "ordinal").alias("by_id"))
    found = mutations.join(named, "gene", "left").join(known, "gene", "left").withColumn("_g", F.coalesce("by_name", "by_id")).where("_g IS NOT NULL")
    return found.select(*mutations.columns, "_g.*")


def catalogue_counts(markers: DataFrame, by: tuple[str, ...] = ("drug", "type", "grade")) -> DataFrame:
    """(field, value, n): markers per value of each field."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in by])
    return markers.select(F.explode(cells).alias("c")).groupBy("c.field", "c.value").agg(F.count("*").alias("n"))


def reference_differences(one: DataFrame, other: DataFrame, size: int = 65_536) -> DataFrame:
    """One row, ``n``: positions at which two references (one row with seq each) differ, as far as both go."""
    pieces = lambda df, name: df.select(F.col("seq"), F.explode(F.sequence(F.lit(1), F.greatest(F.length("seq"), F.lit(1)), F.lit(size))).alias("at")).select("at", F.split(F.substring("seq", F.col("at"), F.lit(size)), "").alias(name))
    differ = F.size(F.filter(F.zip_with("a", "b", lambda x, y: x != y), lambda d: d))
    return pieces(one, "a").join(pieces(other, "b"), "at").agg(F.coalesce(F.sum(differ), F.lit(0)).cast("long").alias("n"))
