"""Registered queries over genes, variants, masks and file names, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kmerlake.operators import annotate as A, reports, scan
from kmerlake.plans import fixtures as X
from kmerlake.plans.genotyping import _HITS

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


#: A variant a line item: a place on the genome with one to three bases.
_HIT = "hit AS (SELECT DISTINCT l_partkey % 3 * 4096 + (l_orderkey * 31 + l_linenumber * 7) % 2040 AS hit_id, CAST((l_orderkey * 31 + l_linenumber * 7) % 2040 AS INT) AS h_start, CAST((l_orderkey * 31 + l_linenumber * 7) % 2040 + 1 + l_partkey % 3 AS INT) AS h_end FROM lineitem)"
_GENE0 = X.GENE_SQL + ", g0 AS (SELECT g_start - 1 AS start, g_end AS stop, strand, id FROM gene)"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = X.table(spark, sf_dir, "lineitem")
    at = ((F.col("l_orderkey") * 31 + F.col("l_linenumber") * 7) % 2040).cast("int")
    return lines.select((F.col("l_partkey") % 3 * 4096 + at).alias("hit_id"), at.alias("h_start"), (at + 1 + F.col("l_partkey") % 3).cast("int").alias("h_end")).distinct()


def _genes(spark: SparkSession) -> DataFrame:
    return X.genes(spark).select((F.col("g_start") - 1).alias("start"), F.col("g_end").alias("stop"), "strand", "id")


@query("WITH " + _HIT + ", " + _GENE0 + " SELECT hit_id, h_start, h_end, start AS gene_start, stop AS gene_end, id AS gene, strand FROM hit LEFT JOIN g0 ON h_start < stop AND h_end > start QUALIFY row_number() OVER (PARTITION BY hit_id ORDER BY start, stop, id) = 1")
def gene_overlap_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.first_gene(_hits(spark, sf_dir), _genes(spark), "hit_id")
    return found.select("hit_id", "h_start", "h_end", F.col("gene.start").alias("gene_start"), F.col("gene.stop").alias("gene_end"), F.col("gene.id").alias("gene"), F.col("gene.strand").alias("strand"))


_FEATURE = "feat AS (SELECT p_partkey AS id, CAST((p_partkey * 53) % 1900 AS INT) AS start, CAST((p_partkey * 53) % 1900 + 1 + p_size * 3 AS INT) AS stop, CAST(p_size % 4 AS INT) AS priority FROM part)"


@query("WITH " + _HIT + ", " + _FEATURE + " SELECT h_start AS point, priority, stop - start AS span, start, id AS feature FROM (SELECT DISTINCT h_start FROM hit) p LEFT JOIN feat ON h_start < stop AND h_start + 1 > start QUALIFY row_number() OVER (PARTITION BY h_start ORDER BY priority, stop - start, start, stop, id) = 1")
def gff_best_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _hits(spark, sf_dir).select("h_start").distinct().withColumn("h_end", F.col("h_start") + 1)
    key = F.col("p_partkey")
    start = ((key * 53) % 1900).cast("int")
    feats = X.table(spark, sf_dir, "part").select(key.alias("id"), start.alias("start"), (start + 1 + F.col("p_size") * 3).cast("int").alias("stop"), (F.col("p_size") % 4).cast("int").alias("priority"))
    return A.best_feature(points, feats, "h_start").select(F.col("h_start").alias("point"), "best.priority", "best.span", "best.start", F.col("best.id").alias("feature"))


_CODON_SQL = "codon(c, a3, a1) AS (VALUES " + X._values([(c, A._THREE[a], a) for c, a in A.CODONS.items()]) + ")"
_VAR = "WITH " + X.REF_SQL + ", " + _GENE0 + ", " + _CODON_SQL + ", v AS (SELECT p_partkey AS vid, CAST((p_partkey * 37) % 2000 AS INT) AS pos0, CAST(1 + p_size % 3 AS INT) AS rl, CAST({al} AS INT) AS al FROM part), "
_VAR += "va AS (SELECT vid, pos0, rl, substr('ACGTTGCA', CAST(1 + vid % 5 AS INT), al) AS alt FROM v), vg AS (SELECT va.*, g0.* , strand = '+' AS fw FROM va JOIN g0 ON pos0 < stop AND pos0 + rl > start WHERE strand IN ('+', '-')), "
_VAR += "vp AS (SELECT *, CASE WHEN fw THEN pos0 ELSE 2048 - pos0 - rl END AS f1, CASE WHEN fw THEN pos0 + rl - 1 ELSE 2047 - pos0 END AS f2, CASE WHEN fw THEN start ELSE 2048 - stop END AS b0, CASE WHEN fw THEN stop - 1 ELSE 2047 - start END AS b1, CASE WHEN fw THEN alt ELSE reverse(translate(alt, 'ACGT', 'TGCA')) END AS ab, CASE WHEN fw THEN rseq ELSE reverse(translate(rseq, 'ACGT', 'TGCA')) END AS sq FROM vg, ref), ok AS (SELECT *, (f1 - b0) // 3 AS c1, (least(f2, b1) - b0) // 3 AS c2 FROM vp WHERE f1 >= b0) "


def _variants(spark: SparkSession, sf_dir: str, alt_len) -> DataFrame:
    parts = X.spread(X.table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    pos0 = ((F.col("p_partkey") * 37) % 2000).cast("int")
    v = parts.select(F.col("p_partkey").alias("vid"), pos0.alias("h_start"), (1 + F.col("p_size") % 3).cast("int").alias("rl"), alt_len.cast("int").alias("al"))
    v = v.select("vid", "h_start", (F.col("h_start") + F.col("rl")).alias("h_end"), "rl", F.substring(F.lit("ACGTTGCA"), (1 + F.col("vid") % 5).cast("int"), F.col("al")).alias("alt"))
    met = A.overlapping(v, _genes(spark))
    return A.with_amino_change(met, X.REFERENCE, *[F.col(c) for c in ("h_start", "rl", "alt", "start", "stop", "strand")]).where("aa is not null")


@query(_VAR.format(al="1 + p_size % 3") + ", cd AS (SELECT ok.*, i, substr(sq, CAST(b0 + 3 * i + 1 AS INT), 3) AS rc, (SELECT string_agg(CASE WHEN b0 + 3 * i + j BETWEEN f1 AND f2 THEN substr(ab, CAST(b0 + 3 * i + j - f1 + 1 AS INT), 1) ELSE substr(sq, CAST(b0 + 3 * i + j + 1 AS INT), 1) END, '' ORDER BY j) FROM range(0, 3) t(j)) AS nc FROM ok, range(0, 700) r(i) WHERE i BETWEEN c1 AND c2 AND b0 + 3 * i + 3 <= 2048) SELECT vid, id AS gene, CAST(min(i) + 1 AS INT) AS aa_pos, string_agg(coalesce(x.a3, '???') || (i + 1) || coalesce(y.a3, '???') || '(' || rc || '>' || nc || ')' || CASE WHEN coalesce(x.a3, '???') = coalesce(y.a3, '???') THEN ' syn' ELSE '' END, ';' ORDER BY i) AS change FROM cd LEFT JOIN codon x ON rc = x.c LEFT JOIN codon y ON nc = y.c GROUP BY vid, id")
def aa_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variants(spark, sf_dir, 1 + F.col("p_size") % 3).select("vid", F.col("id").alias("gene"), "aa.aa_pos", "aa.change")


@query(_VAR.format(al="1 + (p_size + 1) % 3") + "SELECT vid, id AS gene, CAST(c1 + 1 AS INT) AS aa_pos, 'frameshift_pos' || (c1 + 1) AS change FROM ok")
def frameshift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variants(spark, sf_dir, 1 + (F.col("p_size") + 1) % 3).select("vid", F.col("id").alias("gene"), "aa.aa_pos", "aa.change")


@query("WITH " + X.REF_SQL + ", " + _CODON_SQL + ", gp AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, CAST(1 + (p_partkey * 41) % 1900 AS INT) AS gs, CAST(1 + (p_partkey * 41) % 1900 + 8 + p_size AS INT) AS ge, CAST(p_partkey % 3 AS INT) AS ph FROM part), cs AS (SELECT id, strand, CAST(CASE WHEN strand = '+' THEN gs + ph + 3 * i ELSE ge - ph - 2 - 3 * i END AS INT) AS codon_start, gs, ge FROM gp, range(0, 40) t(i)), cc AS (SELECT id, strand, codon_start, CASE WHEN strand = '+' THEN substr(rseq, codon_start, 3) ELSE reverse(translate(substr(rseq, codon_start, 3), 'ACGT', 'TGCA')) END AS codon FROM cs, ref WHERE codon_start >= gs AND codon_start + 2 <= ge) SELECT id, strand, codon_start, codon, coalesce(a1, 'X') AS aa FROM cc LEFT JOIN codon ON codon = c")
def codon_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    start = (1 + (key * 41) % 1900).cast("int")
    genes = X.table(spark, sf_dir, "part").select(key.alias("id"), F.when(key % 2 == 0, "+").otherwise("-").alias("strand"), start.alias("g_start"), (start + 8 + F.col("p_size")).cast("int").alias("g_end"), (key % 3).cast("int").alias("phase"))
    return A.codon_series(genes, X.REFERENCE)


_RANGE = "rg AS (SELECT CAST(p_partkey % 20 AS INT) AS genome, CAST((p_partkey * 97) % 2000 AS INT) AS start, CAST((p_partkey * 97) % 2000 + 1 + p_size % 3 AS INT) AS stop FROM part), mr AS (SELECT genome, CAST(min(start) AS INT) AS start, CAST(max(stop) AS INT) AS stop FROM (SELECT *, sum(nw) OVER (PARTITION BY genome ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS isl FROM (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY genome ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM rg)) GROUP BY genome, isl)"


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = ((F.col("p_partkey") * 97) % 2000).cast("int")
    made = X.table(spark, sf_dir, "part").select((F.col("p_partkey") % 20).cast("int").alias("genome"), start.alias("start"), (start + 1 + F.col("p_size") % 3).cast("int").alias("stop"))
    return A.merged_ranges(made, ["genome"])


@query("WITH " + _RANGE + " SELECT * FROM mr")
def mask_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranges(spark, sf_dir)


@query("WITH " + X.REF_SQL + ", " + _RANGE + " SELECT genome, (SELECT string_agg(CASE WHEN EXISTS (SELECT 1 FROM mr WHERE mr.genome = g.genome AND p - 1 >= start AND p - 1 < stop) THEN 'N' ELSE substr(rseq, CAST(p AS INT), 1) END, '' ORDER BY p) FROM ref, range(1, 2049) t(p)) AS seq FROM (SELECT DISTINCT genome FROM mr) g")
def masked_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _ranges(spark, sf_dir).groupBy("genome").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    return by.select("genome", A.mask(F.lit(X.REFERENCE), F.col("ranges")).alias("seq"))


# Every marker is one base, so at most one codon changes; genomes without hits are those of the suppliers' nations.
_DETAIL = (
    _HITS + ", g0 AS (SELECT g_start - 1 AS start, g_end AS stop, strand, id FROM (VALUES " + X._values(X.GENES) + ") gene(g_start, g_end, strand, id)), " + _CODON_SQL + ", "
    "hm AS (SELECT hit.genome, hit.kmer, hit.kmer_pos, hit.genome_pos, hit.marker_id, m.pos, m.ref, m.alt, m.path, m.gene AS m_gene, substr(kmer, 16, 1) AS cut FROM hit JOIN marker m USING (marker_id)), "
    "fg AS (SELECT hm.*, g0.* FROM hm LEFT JOIN g0 ON pos - 1 < stop AND pos > start QUALIFY row_number() OVER (PARTITION BY genome, kmer ORDER BY start, stop, id) = 1), "
    "vp AS (SELECT fg.*, CASE WHEN strand = '+' THEN pos - 1 ELSE 2048 - pos END AS f1, CASE WHEN strand = '+' THEN start ELSE 2048 - stop END AS b0, CASE WHEN strand = '+' THEN cut ELSE translate(cut, 'ACGT', 'TGCA') END AS ab, CASE WHEN strand = '+' THEN rseq ELSE reverse(translate(rseq, 'ACGT', 'TGCA')) END AS sq FROM fg, ref), "
    "cd AS (SELECT vp.*, (f1 - b0) // 3 AS i, substr(sq, CAST(b0 + 3 * ((f1 - b0) // 3) + 1 AS INT), 3) AS rc FROM vp), "
    "nc AS (SELECT cd.*, substr(rc, 1, CAST(f1 - b0 - 3 * i AS INT)) || ab || substr(rc, CAST(f1 - b0 - 3 * i + 2 AS INT)) AS nc, strand IN ('+', '-') AND f1 >= b0 AS good FROM cd), "
    "aa AS (SELECT nc.*, coalesce(x.a3, '???') || (i + 1) || coalesce(y.a3, '???') || '(' || rc || '>' || nc || ')' || CASE WHEN x.a3 = y.a3 THEN ' syn' ELSE '' END AS change FROM nc LEFT JOIN codon x ON rc = x.c LEFT JOIN codon y ON nc = y.c), "
    "every AS (SELECT DISTINCT sample AS genome FROM asm UNION SELECT n_nationkey + 100 FROM nation) "
    'SELECT e.genome, kmer AS "k-mer", kmer_pos AS "k-merPOS", genome_pos AS "SNPgenome", pos AS "SNPreference", ref AS "REF", alt AS "ALT", path AS lineage, coalesce(id, m_gene) AS "Gene", start + 1 AS "Gene_Start", stop AS "Gene_End", CASE WHEN good THEN CAST(i + 1 AS INT) END AS "AA_Pos", CASE WHEN good THEN change ELSE CASE WHEN kmer IS NOT NULL THEN \'m\' || marker_id END END AS "AA_Change" FROM every e LEFT JOIN aa USING (genome)'
)


@query(_DETAIL)
def classify_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = scan.diagnostic_kmers(X.markers(spark).withColumn("mutation", F.concat(F.lit("m"), F.col("marker_id").cast("string"))), X.REFERENCE, X.K)
    blank = X.table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("genome"), F.lit(0).alias("contig"), F.lit("ACGT").alias("seq"))
    return reports.hit_detail(X.contigs(spark, sf_dir).unionByName(blank), made, _genes(spark), X.REFERENCE, X.K)
