"""Deterministic genome views over the driver's tables.

Every view exists twice: as a DataFrame and as a DuckDB common table expression
for the oracles.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kmerlake.functions.seq import clean_revcomp

K = 31
_HEX = str.maketrans("0123456789abcdef", "ACGTACGTACGTACGT")
REFERENCE = "".join(hashlib.md5(str(i).encode()).hexdigest() for i in range(64)).translate(_HEX)

#: Levels, gene and resistance path of each of the eight markers.
PANEL = (
    ("L1", "geneA", "RIF;RIF-R;geneA_S4L;1) Assoc w R;geneA;S4L"),
    ("L1;L1.1", "geneA", "INH;INH-R;geneA_K9T;2) Assoc w R - Interim;geneA;K9T"),
    ("L1;L1.2", "geneB", "EMB;EMB-R;geneB_M1V;3) Uncertain significance;geneB;M1V"),
    ("L2", "geneC", "RIF;RIF-R;geneC_D5G;3) Uncertain significance;geneC;D5G"),
    ("L2;L2.1", "geneC", "FQ;FQ-R;geneC_D9N;4) Not assoc w R - Interim;geneC;D9N"),
    ("L2;L2.1;L2.1.1", "geneD", "AMI;AMI-R;geneD_a1g;1) Assoc w R;geneD;a1g"),
    ("L4", "geneE", "STR;STR-R;geneE_K4R;TBProfiler_literature;geneE;K4R"),
    ("L4;L4.3", "geneE", "PZA;PZA-R;geneE_Q1P;5) Not assoc w R;geneE;Q1P"),
)
#: Genes as start (from 1), end, strand, id; some overlap, one has no strand.
GENES = ((150, 470, "+", "geneA"), (440, 700, "-", "geneB"), (590, 1000, "+", "geneC"), (950, 1260, ".", "geneD"), (1190, 1650, "-", "geneE"), (1400, 1500, "+", "geneF"))


def _values(rows) -> str:
    quote = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(quote(x) for x in r) + ")" for r in rows)


REF_SQL = "ref AS (SELECT string_agg(translate(md5(i::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT'), '' ORDER BY i) AS rseq FROM range(64) t(i))"
MARKER_SQL = (
    "panel(marker_id, path, gene, dr_path) AS (VALUES " + _values([(i, *p) for i, p in enumerate(PANEL)]) + "), "
    "marker AS (SELECT marker_id, 200 + 200 * marker_id AS pos, substr(rseq, 200 + 200 * marker_id, 1) AS ref, "
    "translate(substr(rseq, 200 + 200 * marker_id, 1), 'ACGT', 'GTAC') AS alt, path, gene, dr_path FROM panel, ref)"
)
KMER_SQL = "mk AS (SELECT marker_id, substr(rseq, pos - 15, 31) AS ref_kmer, substr(rseq, pos - 15, 15) || alt || substr(rseq, pos + 1, 15) AS alt_kmer FROM marker, ref)"
READ_SQL = """reads AS (SELECT sample, l_linestatus, CASE WHEN l_linestatus = 'F' THEN fwd ELSE reverse(translate(fwd, 'ACGT', 'TGCA')) END AS seq FROM (
SELECT sample, l_linestatus, substr(rseq, CAST(pos - 15 - off AS INT), CAST(off + 15 AS INT)) || CASE WHEN (sample + marker_id) % 3 = 0 OR l_returnflag = 'R' THEN alt ELSE ref END || substr(rseq, CAST(pos + 1 AS INT), CAST(84 - off AS INT)) AS fwd
FROM (SELECT o_custkey % 20 AS sample, l_partkey % 8 AS mid, (l_orderkey * 11 + l_linenumber) % 69 AS off, l_returnflag, l_linestatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey) x JOIN marker ON mid = marker_id, ref) y)"""
COUNT_SQL = """kx AS (SELECT sample, substr(seq, CAST(p AS INT), 31) AS kmer FROM reads, range(1, 71) t(p)),
idx AS (SELECT marker_id, ref_kmer AS kmer, 0 AS is_alt FROM mk UNION ALL SELECT marker_id, reverse(translate(ref_kmer, 'ACGT', 'TGCA')), 0 FROM mk
UNION ALL SELECT marker_id, alt_kmer, 1 FROM mk UNION ALL SELECT marker_id, reverse(translate(alt_kmer, 'ACGT', 'TGCA')), 1 FROM mk),
ac AS (SELECT sample, marker_id, CAST(sum(1 - is_alt) AS BIGINT) AS ref_count, CAST(sum(is_alt) AS BIGINT) AS alt_count FROM kx JOIN idx USING (kmer) GROUP BY 1, 2)"""
COUNTS = ",\n".join((REF_SQL, MARKER_SQL, KMER_SQL, READ_SQL, COUNT_SQL))
GENE_SQL = "gene(g_start, g_end, strand, id) AS (VALUES " + _values(GENES) + ")"
ASSEMBLY_SQL = """asm_full AS (SELECT s AS sample, (SELECT string_agg(CASE WHEN marker_id IS NOT NULL AND (s + marker_id) % 3 = 0 THEN alt ELSE substr(rseq, CAST(p AS INT), 1) END, '' ORDER BY p) FROM ref, range(1, 2049) q(p) LEFT JOIN marker ON pos = p) AS seq FROM (SELECT DISTINCT c_custkey % 20 AS s FROM customer) u),
asm AS (SELECT sample, 0 AS contig, substr(seq, 1, 1000) AS seq FROM asm_full UNION ALL SELECT sample, 1, reverse(translate(substr(seq, 1001), 'ACGT', 'TGCA')) FROM asm_full)"""
DNA_SQL = "dna AS (SELECT doc_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM documents)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table in few files, dealt to all tasks before it is exploded."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, 1))


def markers(spark: SparkSession) -> DataFrame:
    rows = [(i, 200 + 200 * i, REFERENCE[199 + 200 * i], REFERENCE[199 + 200 * i].translate(str.maketrans("ACGT", "GTAC")), p[0].split(";"), p[0], p[1], p[2]) for i, p in enumerate(PANEL)]
    return spark.createDataFrame(rows, "marker_id int, pos int, ref string, alt string, levels array<string>, path string, gene string, dr_path string")


def genes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(g) for g in GENES], "g_start int, g_end int, strand string, id string")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus")
    owner = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 20).alias("sample"))
    seen = spread(lines.join(owner, "l_orderkey"))
    seen = seen.withColumns({"marker_id": (F.col("l_partkey") % 8).cast("int"), "off": ((F.col("l_orderkey") * 11 + F.col("l_linenumber")) % 69).cast("int")})
    pos = 200 + 200 * F.col("marker_id")
    ref = F.substring(F.lit(REFERENCE), pos, F.lit(1))
    allele = F.when(((F.col("sample") + F.col("marker_id")) % 3 == 0) | (F.col("l_returnflag") == "R"), F.translate(ref, "ACGT", "GTAC")).otherwise(ref)
    fwd = F.concat(F.substring(F.lit(REFERENCE), pos - 15 - F.col("off"), F.col("off") + 15), allele, F.substring(F.lit(REFERENCE), pos + 1, 84 - F.col("off")))
    return seen.withColumn("fwd", fwd).select("sample", F.when(F.col("l_linestatus") == "F", F.col("fwd")).otherwise(clean_revcomp(F.col("fwd"))).alias("seq"))


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two contigs a sample, the second reverse-complemented."""
    parts, at = [], 0
    for i in range(len(PANEL)):
        pos = 200 + 200 * i
        ref = REFERENCE[pos - 1]
        parts += [F.lit(REFERENCE[at : pos - 1]), F.when((F.col("genome") + i) % 3 == 0, ref.translate(str.maketrans("ACGT", "GTAC"))).otherwise(ref)]
        at = pos
    whole = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 20).alias("genome")).distinct().withColumn("whole", F.concat(*parts, F.lit(REFERENCE[at:])))
    parts = F.array(F.substring("whole", 1, 1000), clean_revcomp(F.substring("whole", 1001, 4096)))
    return whole.select("genome", F.posexplode(parts).alias("contig", "seq"))


def bases(text: str) -> Column:
    """Letters of a text as bases, everything else removed."""
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")


def doc_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts as bases."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "lang", bases("text").alias("seq"))
