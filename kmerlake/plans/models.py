"""Registered queries over models, catalogues and file names, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kmerlake.functions import names as N
from kmerlake.operators import catalogue as C, features, forest as M
from kmerlake.plans import fixtures as X

Q: dict = {}
SQL: dict[str, str] = {}
K, TREES, DEPTH, LEAF = 8, 100, 20, 5


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query("SELECT lang AS label, CAST(row_number() OVER (ORDER BY min(doc_id), lang) - 1 AS INT) AS code FROM documents GROUP BY lang")
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes(spark, sf_dir)


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.label_codes(X.table(spark, sf_dir, "documents"), "lang", "doc_id").select(F.col("lang").alias("label"), "code")


@query("SELECT doc_id, lang, CAST((row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) - 1) % 5 AS INT) AS fold FROM documents")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.stratified_folds(X.table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 5)


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= greatest(1, least(count(*) OVER () - 1, CAST(floor(count(*) OVER () * 0.2 + 0.5) AS BIGINT))) AS is_test FROM documents")
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.holdout_split(X.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.2)


def _trained(spark: SparkSession, sf_dir: str, part: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features, labels and a forest of documents as bases, labelled by language."""
    cells = features.bucket_counts(X.doc_dna(spark, sf_dir), K, "doc_id").withColumnRenamed("doc_id", "seq")
    docs = X.table(spark, sf_dir, "documents").select("doc_id", "lang")
    if part:
        docs = M.holdout_split(docs, "doc_id", 0.2).where(part)
    labels = docs.join(_codes(spark, sf_dir), F.col("lang") == F.col("label")).select(F.col("doc_id").alias("seq"), "code")
    return cells, labels, M.train(cells, labels, TREES, DEPTH, LEAF)


@query()
def forest_train_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, labels, model = _trained(spark, sf_dir, "not is_test")
    every = X.table(spark, sf_dir, "documents").join(_codes(spark, sf_dir), F.col("lang") == F.col("label")).select(F.col("doc_id").alias("seq"), "code")
    return M.accuracy(M.votes(cells, model), every.join(labels, "seq", "left_anti")).select(F.lit(TREES).alias("trees"), F.col("n").alias("tested"), F.col("accuracy").alias("test_accuracy"))


@query()
def forest_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, _, model = _trained(spark, sf_dir)
    return M.vote_summary(M.votes(cells, model).join(_codes(spark, sf_dir), "code").select("seq", F.col("label").alias("cls")))


@query()
def oob_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, labels, model = _trained(spark, sf_dir)
    return M.accuracy(M.out_of_bag(M.votes(cells, model), labels, TREES), labels)


@query()
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, model = _trained(spark, sf_dir)
    ranked = M.importance(model)
    return ranked.join(features.bucket_kmers(X.doc_dna(spark, sf_dir), K, ranked), "bucket", "left")


@query()
def importance_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, model = _trained(spark, sf_dir)
    ranked = M.importance(model)
    return features.bucket_places(X.doc_dna(spark, sf_dir), K, ranked, "doc_id").join(F.broadcast(ranked), "bucket")


_DRUGS = (*(d for d in C.LABEL_ORDER if d != "FQ"), "LEV", "MXF")
_GRADED = "gr AS (SELECT l_partkey AS variant, [" + ", ".join(f"'{d}'" for d in _DRUGS) + "][CAST(l_suppkey % 15 + 1 AS INT)] AS drug, CAST(1 + l_linenumber % 5 AS VARCHAR) || ') grade' AS grade, l_orderkey * 10 + l_linenumber AS ordinal FROM lineitem)"


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    drug = F.element_at(F.array(*[F.lit(d) for d in _DRUGS]), (F.col("l_suppkey") % 15 + 1).cast("int"))
    return X.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("variant"), drug.alias("drug"), F.concat((1 + F.col("l_linenumber") % 5).cast("string"), F.lit(") grade")).alias("grade"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))


@query("WITH " + _GRADED + ", k AS (SELECT DISTINCT variant, CASE WHEN drug IN ('LEV', 'MXF') THEN 'FQ' ELSE drug END AS drug, grade FROM gr WHERE grade[1] IN ('1', '2')), d AS (SELECT variant, drug, coalesce(list_position([" + ", ".join(f"'{d}'" for d in C.LABEL_ORDER) + "], drug), 99) AS place FROM k GROUP BY 1, 2) SELECT d.variant, string_agg(drug, '_' ORDER BY place, drug) AS label, any_value(g.grade) AS grade FROM d JOIN (SELECT variant, min(grade) AS grade FROM k GROUP BY 1) g ON d.variant = g.variant GROUP BY d.variant")
def catalogue_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.collapse(_graded(spark, sf_dir))


_MARKS = _GRADED + ", mk AS (SELECT variant % 700 AS pos, 'A' AS ref, ['C', 'G', 'T'][CAST(variant % 3 + 1 AS INT)] AS alt, drug, grade, min(ordinal) AS ordinal FROM gr GROUP BY ALL)"


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    alt = F.element_at(F.array(F.lit("C"), F.lit("G"), F.lit("T")), (F.col("variant") % 3 + 1).cast("int"))
    rows = _graded(spark, sf_dir).select((F.col("variant") % 700).alias("pos"), F.lit("A").alias("ref"), alt.alias("alt"), "drug", "grade", "ordinal")
    return rows.groupBy("pos", "ref", "alt", "drug", "grade").agg(F.min("ordinal").alias("ordinal"))


@query("WITH " + _MARKS + " SELECT pos, ref, alt, grade, ordinal, drug FROM mk QUALIFY row_number() OVER (PARTITION BY pos, ref, alt ORDER BY grade, ordinal, drug) = 1")
def catalogue_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.strongest_of_each(_marks(spark, sf_dir))


def _append(keys: str) -> str:
    return "WITH " + _MARKS + f", old AS (SELECT * FROM mk WHERE grade[1] IN ('1', '2')), more AS (SELECT * FROM mk WHERE grade[1] NOT IN ('1', '2') QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY ordinal, grade, drug) = 1) SELECT pos, ref, alt, drug, grade, ordinal FROM old UNION ALL SELECT m.pos, m.ref, m.alt, m.drug, m.grade, m.ordinal FROM more m WHERE NOT EXISTS (SELECT 1 FROM old o WHERE " + " AND ".join(f"o.{k} = m.{k}" for k in keys.split(", ")) + ")"


def _appended(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    marks = _marks(spark, sf_dir)
    strong = C.grade_rank(F.col("grade")) <= 1
    more = marks.where(~strong)
    return C.append_new(marks.where(strong), more, keys)


@query(_append("pos, ref, alt"))
def catalogue_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _appended(spark, sf_dir, ["pos", "ref", "alt"])


@query(_append("pos, ref, alt, drug"))
def coordinate_port(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _appended(spark, sf_dir, ["pos", "ref", "alt", "drug"])


@query("SELECT p_partkey AS variant, CASE WHEN p_partkey % 2 = 0 THEN 1000 + p_size * 10 + (CASE WHEN pl > 0 THEN pl - 1 ELSE pl END) ELSE 2000 + p_size * 10 - (CASE WHEN pl > 0 THEN pl - 1 ELSE pl END) END AS genome_pos FROM (SELECT *, CAST(p_partkey % 41 - 20 AS INT) AS pl FROM part)")
def gene_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    strand = F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-")
    place = (F.col("p_partkey") % 41 - 20).cast("int")
    return X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("variant"), C.gene_position(1000 + F.col("p_size") * 10, 2000 + F.col("p_size") * 10, strand, place).alias("genome_pos"))


_ENDS = ("_R1_001.fastq.gz", "_R2_001.fastq.gz", "_R1.fq", "_2.fastq", ".1.fq.gz", ".fastq", "-R2.fastq", "_1.fastq")
_PATHS = "paths AS (SELECT DISTINCT 'run' || (c_nationkey % 4) || '/S' || (c_custkey % 90) || [" + ", ".join(f"'{e}'" for e in _ENDS) + "][CAST(c_custkey // 90 % 8 + 1 AS INT)] AS path FROM customer), fl AS (SELECT path, regexp_extract(path, '[^/]*$') AS name, regexp_extract(path, '^(.*)/', 1) AS dir FROM paths)"
_NAME = "CASE WHEN regexp_extract(b, '^(.+?)(?:_[Rr][12]_001|_[Rr][12]|_[12]|\\.[12]|-[Rr][12]|-[12])$', 1) <> '' THEN regexp_extract(b, '^(.+?)(?:_[Rr][12]_001|_[Rr][12]|_[12]|\\.[12]|-[Rr][12]|-[12])$', 1) ELSE b END"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.element_at(F.array(*[F.lit(e) for e in _ENDS]), (F.floor(F.col("c_custkey") / 90) % 8 + 1).cast("int"))
    return X.table(spark, sf_dir, "customer").select(F.concat(F.lit("run"), (F.col("c_nationkey") % 4).cast("string"), F.lit("/S"), (F.col("c_custkey") % 90).cast("string"), end).alias("path")).distinct()


@query("WITH " + _PATHS + ", bb AS (SELECT path, regexp_replace(name, '(\\.fastq\\.gz|\\.fq\\.gz|\\.fastq|\\.fq)$', '') AS b FROM fl) SELECT path, " + _NAME + " AS sample FROM bb")
def sample_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("path", N.sample_name(F.col("path")).alias("sample"))


def _tries(what: str) -> str:
    out = []
    for p in N.PAIRS:
        for n in (1, 2):
            hit = f"regexp_extract(name, '{p.format(n)}', 1)"
            out.append(f"WHEN {hit} <> '' THEN " + (hit if what == "base" else str(n)))
    return "CASE " + " ".join(out) + (" ELSE path END" if what == "base" else " ELSE 0 END")


@query("WITH " + _PATHS + ", m AS (SELECT path, dir, " + _tries("base") + " AS base, " + _tries("read") + " AS rd FROM fl), g AS (SELECT dir, base, max(rd) > min(rd) AS paired, string_agg(path, ',' ORDER BY rd, path) AS files FROM m GROUP BY 1, 2), bb AS (SELECT *, regexp_replace(regexp_extract(split_part(files, ',', 1), '[^/]*$'), '(\\.fastq\\.gz|\\.fq\\.gz|\\.fastq|\\.fq)$', '') AS b FROM g) SELECT dir, base, CASE WHEN paired THEN base ELSE " + _NAME + " END AS sample, paired, files FROM bb")
def paired_end_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.read_pairs(_paths(spark, sf_dir)).withColumn("files", F.array_join("files", ","))


_RAW = "raw AS (SELECT p_partkey AS n, [CASE WHEN p_partkey % 50 = 0 THEN 'x' ELSE CAST(p_partkey AS VARCHAR) END, 'A', CASE WHEN p_partkey % 33 = 0 THEN ' ' ELSE ' c ' END, 'L' || p_size, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'L' || p_size || '.1' END, '', p_name, '', p_brand] AS c FROM part)"


@query("WITH " + _RAW + ", r AS (SELECT n, TRY_CAST(c[1] AS INT) AS pos, c[2] AS ref, upper(trim(c[3])) AS alt, c[4:] AS rest FROM raw), s AS (SELECT *, list_position(rest, '') AS gap FROM r) SELECT n AS marker_id, pos, ref, alt, array_to_string(rest[1:gap - 1], ';') AS levels, array_to_string(list_filter(rest[gap + 1:], lambda x: x <> ''), ';') AS notes FROM s WHERE pos > 0 AND alt <> ''")
def marker_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kmerlake.sources.files import parse_markers

    key = F.col("p_partkey")
    level = F.concat(F.lit("L"), F.col("p_size").cast("string"))
    cells = F.array(F.when(key % 50 == 0, "x").otherwise(key.cast("string")), F.lit("A"), F.when(key % 33 == 0, " ").otherwise(" c "), level, F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(level, F.lit(".1"))), F.lit(""), F.col("p_name"), F.lit(""), F.col("p_brand"))
    found = parse_markers(X.table(spark, sf_dir, "part").select(key.alias("ordinal"), cells.alias("cells")))
    return found.withColumns({"levels": F.array_join("levels", ";"), "notes": F.array_join("notes", ";")})


#: A second frame: another base at every 37th place.
_ANCESTOR = "".join(c if i % 37 else {"A": "C", "C": "G", "G": "T", "T": "A"}[c] for i, c in enumerate(X.REFERENCE))
_FRAME_DRUGS = (*C.CATALOGUE_ORDER, "XYZ")


@query(
    "WITH " + X.REF_SQL + ", anc AS (SELECT string_agg(CASE WHEN (p - 1) % 37 = 0 THEN translate(substr(rseq, CAST(p AS INT), 1), 'ACGT', 'CGTA') ELSE substr(rseq, CAST(p AS INT), 1) END, '' ORDER BY p) AS aseq FROM ref, range(1, 2049) t(p)), "
    "m AS (SELECT p_partkey AS id, CAST(1 + (p_partkey * 29) % 2060 AS INT) AS pos, ['A', 'C', 'G', 'T', 'GA'][CAST(1 + p_partkey % 5 AS INT)] AS r0, ['A', 'C', 'G', 'T'][CAST(1 + p_size % 4 AS INT)] AS alt, [" + ", ".join(f"'{d}'" for d in _FRAME_DRUGS) + f"][CAST(1 + p_partkey % {len(_FRAME_DRUGS)} AS INT)] AS drug FROM part), "
    "f AS (SELECT m.*, 'first' AS frame, rseq AS s FROM m, ref UNION ALL SELECT m.*, 'second', aseq FROM m, anc), b AS (SELECT *, CASE WHEN pos <= 2048 THEN substr(s, pos, length(r0)) ELSE r0 END AS ref FROM f) "
    "SELECT id, pos, ref, alt, drug, ref <> r0 AS changed, frame, CAST(coalesce(list_position([" + ", ".join(f"'{d}'" for d in C.CATALOGUE_ORDER) + "], drug) - 1, 999) AS INT) AS drug_rank FROM b WHERE ref <> alt"
)
def catalogue_two_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, pick = F.col("p_partkey"), lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (1 + i).cast("int"))
    markers = X.table(spark, sf_dir, "part").select(
        key.alias("id"), (1 + (key * 29) % 2060).cast("int").alias("pos"), pick(("A", "C", "G", "T", "GA"), key % 5).alias("ref"), pick("ACGT", F.col("p_size") % 4).alias("alt"), pick(_FRAME_DRUGS, key % len(_FRAME_DRUGS)).alias("drug")
    )
    return C.catalogue_frames(markers, {"first": X.REFERENCE, "second": _ANCESTOR})
