"""Registered queries over result tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kmerlake.operators import insights as I, views as V
from kmerlake.operators.lineage import lineage_counts
from kmerlake.operators.selection import quantiles
from kmerlake.plans import fixtures as X
from kmerlake.plans.genotyping import _BRANCH, _CALLED, _TALLY, _branches, _called

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_ORDER = "drug_order(o) AS (VALUES ([" + ", ".join(f"'{d}'" for d in I.DRUG_ORDER) + "]))"
_DR = (
    _CALLED.format(p=50) + ", " + _ORDER + ", dp AS (SELECT sample, coverage, string_split(dr_path, ';') AS p FROM called), dv AS (SELECT sample, coverage, CASE WHEN upper(p[1]) = 'AMI' THEN 'AMK' ELSE upper(p[1]) END AS drug, p[6] AS mutation, "
    "CASE WHEN p[4] LIKE '1)%' OR p[4] LIKE '2)%' THEN 'resistant' WHEN p[4] LIKE '3)%' THEN 'uncertain' WHEN p[4] LIKE '4)%' OR p[4] LIKE '5)%' THEN 'not_assoc' ELSE 'ungraded' END AS verdict FROM dp), "
    "dr AS (SELECT *, list_position(['resistant', 'uncertain', 'ungraded', 'not_assoc'], verdict) AS vr FROM dv), prof AS (SELECT sample, drug, CAST(coalesce(list_position((SELECT o FROM drug_order), drug) - 1, 17) AS INT) AS drug_rank, arg_min(verdict, vr) AS verdict, count(*) AS n_mutations, count(*) FILTER (WHERE verdict = 'resistant') AS n_resistant, string_agg(mutation, ',' ORDER BY vr, coverage DESC, mutation) AS mutations FROM dr GROUP BY sample, drug)"
)


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.profile(_called(spark, sf_dir, 50), "sample")


@query(_DR + " SELECT * FROM prof")
def dr_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(spark, sf_dir)


@query(_DR + " SELECT sample, " + ", ".join(f"max(CASE WHEN drug = '{d}' THEN verdict END) AS \"{d}\"" for d in I.DRUG_ORDER) + " FROM prof GROUP BY sample")
def dr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.profile_matrix(_profile(spark, sf_dir), "sample")


@query(_DR + ", dl AS (SELECT sample, string_agg(drug, ', ' ORDER BY drug_rank, drug) FILTER (WHERE verdict = 'resistant') AS r, string_agg(drug, ', ' ORDER BY drug_rank, drug) FILTER (WHERE verdict = 'uncertain') AS u FROM prof GROUP BY sample) SELECT sample, CASE WHEN r IS NOT NULL THEN 'Resistant: ' || r WHEN u IS NOT NULL THEN 'No resistance markers; uncertain: ' || u ELSE 'No resistance markers' END AS summary FROM dl")
def dr_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.profile_summary(_profile(spark, sf_dir), "sample")


@query(_DR + " SELECT drug, verdict, count(*) AS samples FROM prof GROUP BY 1, 2")
def dr_call_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.call_tally(_profile(spark, sf_dir))


@query("WITH p AS (SELECT CASE WHEN l_partkey % 2 = 0 THEN 'RIF;RIF-R;m' || l_suppkey || ';' || (l_linenumber % 7) || ') Assoc w R;g;x' ELSE 'L' || l_suppkey || ';L' || l_linenumber END AS path FROM lineitem) SELECT n_paths, n_resistance, n_resistance >= greatest(1, ceil(n_paths * 0.5)) AS is_panel FROM (SELECT count(*) AS n_paths, count(*) FILTER (WHERE regexp_matches(path, '^RIF;[^;]*;[^;]*;[1-5]\\)')) AS n_resistance FROM p)")
def panel_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("RIF;RIF-R;m"), F.col("l_suppkey").cast("string"), F.lit(";"), (F.col("l_linenumber") % 7).cast("string"), F.lit(") Assoc w R;g;x"))).otherwise(F.concat(F.lit("L"), F.col("l_suppkey").cast("string"), F.lit(";L"), F.col("l_linenumber").cast("string")))
    return I.is_resistance_panel(X.table(spark, sf_dir, "lineitem").select(path.alias("path")))


@query(_CALLED.format(p=50) + _TALLY + _BRANCH + ", own AS (SELECT * FROM br WHERE specific > 0), ld AS (SELECT branch, count(*) AS leads FROM (SELECT sample, branch FROM own QUALIFY row_number() OVER (PARTITION BY sample ORDER BY specific DESC, total DESC, branch) = 1) GROUP BY branch), nm AS (SELECT branch FROM ld JOIN (SELECT branch, sum(specific) AS w FROM own GROUP BY branch) USING (branch) ORDER BY leads DESC, w DESC, branch LIMIT 3) SELECT sample, CASE WHEN branch IN (SELECT branch FROM nm) THEN branch ELSE 'Other' END AS slot, CAST(sum(specific) AS BIGINT) AS specific FROM own GROUP BY 1, 2")
def lineage_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.composition(_branches(spark, sf_dir), "sample")


@query("WITH v AS (SELECT l_discount * 1000 AS pct FROM lineitem) SELECT CAST(least(9, floor(least(100, greatest(0, pct)) / 10)) AS INT) AS bin, count(*) AS n FROM v GROUP BY 1")
def allele_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.histogram(X.table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 1000).alias("pct")), "pct")


@query("WITH v AS (SELECT l_discount * 1000 AS pct FROM lineitem) SELECT count(*) AS n, count(*) FILTER (WHERE pct BETWEEN 20 AND 80) AS middle, count(*) FILTER (WHERE pct BETWEEN 20 AND 80) / count(*) AS share FROM v")
def allele_mixed_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.mixed_share(X.table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 1000).alias("pct")), "pct")


@query("SELECT l_returnflag AS flag, count(*) AS n, quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.25) AS q25, quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.5) AS median, quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.99) AS q99 FROM lineitem GROUP BY 1")
def value_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = X.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    return quantiles(lines, ["flag"], "l_extendedprice", {"q25": 0.25, "median": 0.5, "q99": 0.99}, few=10_000)


@query(_CALLED.format(p=5) + ", s AS (SELECT sample, list_sort(list(coverage)) AS d, count(*) AS n, count(*) FILTER (WHERE alt_percent BETWEEN 20 AND 80) AS middle FROM called GROUP BY sample) SELECT sample, d[1] AS min_depth, d[-1] AS max_depth, d[CAST(n // 2 + 1 AS INT)] AS median_depth, middle, middle / n AS middle_ratio FROM s WHERE n >= 3")
def depth_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.depth_fraction(_called(spark, sf_dir, 5), "sample")


@query(_CALLED.format(p=5) + " SELECT CAST(sum(alt_count) AS BIGINT) AS alt_reads, sum(alt_count) * 100.0::DOUBLE / sum(coverage) AS weighted_alt, quantile_cont(alt_percent, 0.5) AS median_alt, count(*) FILTER (WHERE alt_percent >= 95) AS fixed_loci, quantile_cont(CAST(coverage AS DOUBLE), 0.5) AS median_depth, count(*) FILTER (WHERE coverage < 10) AS low_depth FROM called")
def read_support_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.read_support(_called(spark, sf_dir, 5))


@query(_CALLED.format(p=50) + _TALLY + ", k AS (SELECT sample, max(n) * 100.0::DOUBLE / sum(n) AS support, count(*) AS paths FROM tally GROUP BY sample) SELECT count(*) AS samples, avg(support) AS mean_support, count(*) FILTER (WHERE support < 60) AS weak, count(*) FILTER (WHERE paths > 1) AS multi FROM k")
def lineage_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.lineage_evidence(_tally(spark, sf_dir))


def _tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage_counts(_called(spark, sf_dir, 50), "sample")


@query(_CALLED.format(p=5) + " SELECT sample, count(*) AS loci, CAST(sum(coverage) AS BIGINT) AS coverage, sum(alt_count) * 100.0::DOUBLE / sum(coverage) AS weighted_alt, quantile_cont(alt_percent, 0.5) AS median_alt FROM called GROUP BY sample ORDER BY weighted_alt DESC, coverage DESC, sample LIMIT 8")
def read_support_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.sample_support(_called(spark, sf_dir, 5))


@query(_CALLED.format(p=5) + " SELECT sample, marker_id, coverage, alt_percent FROM called ORDER BY alt_percent DESC, coverage DESC, sample, marker_id LIMIT 6")
def strongest_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.strongest_markers(_called(spark, sf_dir, 5).select("sample", "marker_id", "coverage", "alt_percent"))


@query(_CALLED.format(p=50) + _TALLY + ", k AS (SELECT sample, max(n) * 100.0::DOUBLE / sum(n) AS support, count(*) AS paths, CAST(sum(n) AS BIGINT) AS evidence FROM tally GROUP BY sample) SELECT * FROM k ORDER BY support, evidence DESC, sample LIMIT 8")
def weakest_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.weakest_groups(_tally(spark, sf_dir))


@query(_CALLED.format(p=50) + _TALLY + " SELECT path, CAST(sum(n) AS BIGINT) AS n FROM tally GROUP BY path ORDER BY n DESC, lower(path), path LIMIT 5")
def frequent_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.frequent_paths(_tally(spark, sf_dir))


@query("WITH v AS (SELECT l_tax * 12 AS c FROM lineitem) SELECT CASE WHEN c < 0.5 THEN '<0.5' WHEN c < 0.7 THEN '0.5-0.7' WHEN c < 0.9 THEN '0.7-0.9' ELSE '>=0.9' END AS bin, count(*) AS n, round(CAST(avg(c) AS DOUBLE), 9) AS mean FROM v GROUP BY 1")
def confidence_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.confidence_bins(X.table(spark, sf_dir, "lineitem"), F.col("l_tax") * 12).withColumn("mean", F.round(F.col("mean").cast("double"), 9))


@query("WITH v AS (SELECT user_id, CASE WHEN value > 1.2 AND value <= 100 THEN value / 100 ELSE value END AS s FROM events), c AS (SELECT user_id, coalesce(least(1, greatest(0, s)), 0) AS s FROM v) SELECT count(*) AS n, round(avg(s), 9) AS mean_score, max(s) AS best_score, count(DISTINCT user_id) AS refs FROM c")
def match_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.match_scores(X.table(spark, sf_dir, "events"), "value", "user_id")


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, lower(event_type), event_type) = 1) SELECT event_type AS call, count(*) AS genomes FROM b GROUP BY 1")
def majority_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.majority(X.table(spark, sf_dir, "events"), "user_id", "event_type")


@query("SELECT event_type, count(value) AS n, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.9) AS p90, min(value) AS low, max(value) AS high FROM events GROUP BY event_type HAVING count(value) >= greatest(3, 0.2 * count(*))")
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.quality_summary(X.table(spark, sf_dir, "events"), "event_type", "value")


#: Events, some with a call that says nothing.
_TOLD = "told AS (SELECT user_id, CASE WHEN event_id % 11 = 0 THEN ' Unknown ' WHEN event_id % 13 = 0 THEN 'n/a' WHEN event_id % 17 = 0 THEN NULL ELSE event_type END AS call FROM events), flag AS (SELECT *, lower(trim(coalesce(call, ''))) IN (" + ", ".join(f"'{u}'" for u in I.UNKNOWN) + ") AS open FROM told)"


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    return X.table(spark, sf_dir, "events").select("user_id", F.when(key % 11 == 0, " Unknown ").when(key % 13 == 0, "n/a").when(key % 17 != 0, F.col("event_type")).alias("call"))


@query("WITH " + _TOLD + ", c AS (SELECT trim(coalesce(call, '')) AS label, count(*) AS n FROM told GROUP BY 1), f AS (SELECT * FROM c WHERE label <> '' ORDER BY n DESC, lower(label), label LIMIT 5) SELECT * FROM f UNION ALL SELECT 'Unresolved', count(*) FROM flag WHERE open")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.facets(_told(spark, sf_dir), "call")


@query("WITH c AS (SELECT p_brand AS label, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, label) AS k FROM c) SELECT CASE WHEN k <= 7 THEN label ELSE 'Other' END AS label, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1")
def topn_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.top_with_other(X.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("label")).agg(F.count("*").alias("n")), "label", "n", 7)


@query("WITH " + _TOLD + ", c AS (SELECT call, count(*) AS n FROM flag WHERE NOT open GROUP BY 1) SELECT (SELECT count(DISTINCT user_id) FROM events) AS samples, CAST((SELECT sum(n) FROM c) AS BIGINT) AS assigned, (SELECT count(*) FROM flag WHERE open) AS unresolved, call AS top_call, n * 100.0::DOUBLE / (SELECT sum(n) FROM c) AS top_share FROM c ORDER BY n DESC, call LIMIT 1")
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.overview(_told(spark, sf_dir), "user_id", "call")


@query("SELECT p_brand AS gene, CAST(min(p_size) AS INT) AS low, CAST(max(p_size) AS INT) AS high, count(*) AS n, CASE WHEN 2 * count(*) FILTER (WHERE p_partkey % 3 > 0) >= count(*) THEN '+' ELSE '-' END AS strand FROM part GROUP BY 1")
def gene_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    strand = F.when(F.col("p_partkey") % 3 > 0, "+").otherwise("-")
    return V.gene_segments(X.table(spark, sf_dir, "part").withColumn("strand", strand), "p_brand", "p_size", "strand")


_MODE = "SELECT gene, {c} AS v FROM (SELECT gene, {c}, count(*) AS n FROM r GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY gene ORDER BY n DESC, {c}) = 1"


@query("WITH r AS (SELECT l_suppkey AS gene, l_partkey AS pos, l_linestatus AS strand, CAST(l_linenumber % 3 AS INT) AS phase FROM lineitem), a AS (" + _MODE.format(c="strand") + "), b AS (" + _MODE.format(c="phase") + ") SELECT gene, min(pos) AS low, max(pos) AS high, any_value(a.v) AS strand, any_value(b.v) AS phase FROM r JOIN a USING (gene) JOIN b USING (gene) GROUP BY gene")
def gene_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("gene"), F.col("l_partkey").alias("pos"), F.col("l_linestatus").alias("strand"), (F.col("l_linenumber") % 3).cast("int").alias("phase"))
    return V.gene_context(rows, "gene", "pos")


@query("SELECT page_id, url FROM pages WHERE contains(lower(concat_ws(chr(1), CAST(page_id AS VARCHAR), url)), 'a') AND page_id >= 20 AND contains(lower(url), 'http')")
def table_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.filter_rows(X.table(spark, sf_dir, "pages").select("page_id", "url"), "a", {"page_id": ">= 20", "url": "HTTP"})


_POINTS = "CASE WHEN list_contains(f, '{w}') THEN 14 WHEN len(list_filter(f, lambda x: starts_with(x, '{w}'))) > 0 THEN 8 WHEN len(list_filter(f, lambda x: contains(x, '{w}'))) > 0 THEN 4 ELSE 0 END"


@query("WITH p AS (SELECT p_partkey, [lower(p_name), lower(p_brand), lower(p_type), CAST(p_size AS VARCHAR)] AS f FROM part), s AS (SELECT p_partkey, " + _POINTS.format(w="7") + " + " + _POINTS.format(w="brand") + " AS score FROM p) SELECT p_partkey, score FROM s WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 2500")
def scored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.scored_search(X.table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type", "p_size"], "7 Brand", ["p_partkey"]).select("p_partkey", "score")


@query("WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT event_id, user_id FROM r WHERE i % greatest(1, CAST(ceil(n / 5) AS BIGINT)) = 0")
def track_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.every_nth(X.table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"], 5).select("event_id", "user_id")


@query("WITH c AS (SELECT user_id AS seq, event_type AS cls, count(*) AS votes, dense_rank() OVER (ORDER BY event_type) - 1 AS ci FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY votes DESC, ci DESC) AS k, sum(votes) OVER (PARTITION BY seq) AS total FROM c), w AS (SELECT * FROM r WHERE k = 1), o AS (SELECT r.*, row_number() OVER (PARTITION BY r.seq ORDER BY r.votes DESC, r.ci) AS j FROM r WHERE k > 1) SELECT w.seq, w.cls AS winner, w.votes / w.total AS confidence, (w.votes - coalesce((SELECT max(votes) FROM o WHERE o.seq = w.seq), 0)) / w.total AS margin, coalesce((SELECT string_agg(cls || ':' || votes, ' ' ORDER BY j) FROM o WHERE o.seq = w.seq AND j <= 3), '') AS others FROM w")
def vote_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kmerlake.operators.forest import vote_summary as summarise

    return summarise(X.table(spark, sf_dir, "events").select(F.col("user_id").alias("seq"), F.col("event_type").alias("cls")))
