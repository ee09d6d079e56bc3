"""Registered queries over the driver's tables, each with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import cohort, lineage, metrics, models, report, sequences, similarity, splits, training
from ..operators.contracts import join_many_to_one
from ..sources import tables
from ..sources.tables import table
from ..streaming import windows
from . import roles as R

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_cascade(spark, sf_dir)


# scans, filters, projections


@query("SELECT * FROM region")
def scan_parquet(spark, d):
    return table(spark, d, "region")


@query("SELECT coalesce(n_nationkey::VARCHAR, '') AS n_nationkey, coalesce(n_name, '') AS n_name, coalesce(n_regionkey::VARCHAR, '') AS n_regionkey FROM nation")
def scan_strings(spark, d):
    n = table(spark, d, "nation")
    return n.select(*[F.col(c).cast("string").alias(c) for c in n.columns]).na.fill("")


@query("SELECT DISTINCT o_custkey FROM orders")
def pruned_distinct(spark, d):
    return table(spark, d, "orders").select("o_custkey").distinct()


@query("SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE starts_with(p_name, 'small ') AND p_brand = 'Brand#2' AND p_type = 'PROMO'")
def filter_conjunctive(spark, d):
    return table(spark, d, "part").where(F.col("p_name").startswith("small ") & (F.col("p_brand") == "Brand#2") & (F.col("p_type") == "PROMO")).select("p_partkey", "p_name", "p_brand", "p_type")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view')")
def filter_in(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("click", "view")).select("event_id", "event_type")


@query(f"WITH {R.OBS} SELECT count(*) FILTER (drug NOT IN ('click', 'view')) AS unsupported_drug, count(*) FILTER (k % 2 = 1) AS non_binary_or_missing_label FROM obs")
def excluded_counts(spark, d):
    odd = R.observations(spark, d).withColumn("label", F.when(F.col("k") % 2 == 1, "").otherwise("Resistant"))
    return cohort.excluded_counts(odd, "drug", "label", ["click", "view"])


@query("SELECT c_custkey AS genome_id, c_name AS genome_name, c_mktsegment AS cluster_id FROM customer")
def project_rename(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("genome_id"), F.col("c_name").alias("genome_name"), F.col("c_mktsegment").alias("cluster_id"))


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 'Resistant' WHEN 'A' THEN 'Susceptible' END AS label FROM lineitem WHERE l_returnflag IN ('R', 'A')")
def label_map(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.value_map(F.col("l_returnflag"), {"R": "Resistant", "A": "Susceptible"}).alias("label")).where("label IS NOT NULL")


@query(f"WITH {R.OBS} SELECT event_id, value > 0 AS has_measurement, trim(k::VARCHAR) <> '' AS has_standard, label IN ('Resistant', 'Susceptible') AS is_binary_label FROM obs")
def audit_flags(spark, d):
    return R.observations(spark, d).select("event_id", (F.col("value") > 0).alias("has_measurement"), (C.strip(F.col("k").cast("string")) != "").alias("has_standard"), F.col("label").isin(*cohort.LABELS).alias("is_binary_label"))


@query(f"WITH {R.OBS} SELECT drug, bool_or(NOT starts_with(label, 'Res')) AS any_other, bool_and(value > 0) AS all_measured FROM obs GROUP BY drug")
def bool_any(spark, d):
    return R.observations(spark, d).groupBy("drug").agg(F.bool_or(~F.col("label").startswith("Res")).alias("any_other"), F.bool_and(F.col("value") > 0).alias("all_measured"))


@query("""SELECT p_partkey AS genome_id, CASE WHEN p_type = 'PROMO' THEN 'mutation::' || split_part(p_name, ' ', 1) || '::' || CASE WHEN instr(p_name, ' ') > 0 THEN substr(p_name, instr(p_name, ' ') + 1) ELSE 'unknown' END ELSE 'gene::' || p_name END AS feature_key,
CASE WHEN p_type = 'PROMO' THEN 'mutation' ELSE 'gene' END AS evidence_category, CAST(p_size AS DOUBLE) AS coverage, p_retailprice AS identity, 1 AS feature_value FROM part""")
def evidence_normalize(spark, d):
    point = F.col("p_type") == "PROMO"
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("genome_id"), F.when(point, C.mutation_key(F.col("p_name"), " ")).otherwise(F.concat(F.lit("gene::"), "p_name")).alias("feature_key"),
        F.when(point, "mutation").otherwise("gene").alias("evidence_category"), F.col("p_size").try_cast("double").alias("coverage"), F.col("p_retailprice").alias("identity"), F.lit(1).alias("feature_value"),
    )


@query("SELECT p_partkey, p_name FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda x: upper(trim(x)) IN ('RING', 'BOLT'))) > 0")
def token_overlap(spark, d):
    return table(spark, d, "part").where(C.shares_token(F.col("p_name"), ["RING", "BOLT"], " ")).select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part WHERE p_type = 'PROMO' OR (coalesce(p_size, 0) >= 40 AND coalesce(p_retailprice, 0) >= 950)")
def strong_evidence(spark, d):
    return table(spark, d, "part").where(C.strong_evidence(F.col("p_type") == "PROMO", F.col("p_size"), F.col("p_retailprice"), 40, 950)).select("p_partkey")


_CONTIGS = """ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents), c AS (SELECT doc_id, CAST(length(s) AS BIGINT) AS n, CAST(length(regexp_replace(s, '[a-zA-Z]', '', 'g')) AS BIGINT) AS odd FROM ln WHERE s <> ''),
r AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY n DESC ROWS UNBOUNDED PRECEDING) AS up, sum(n) OVER (PARTITION BY doc_id) AS whole FROM c),
m AS (SELECT doc_id, CAST(max(whole) AS BIGINT) AS genome_length, count(*) AS contigs, max(CASE WHEN 2 * up >= whole THEN n END) AS contig_n50, CAST(sum(odd) AS BIGINT) AS ambiguous_bases, CAST(sum(odd) AS BIGINT) / max(whole)::DOUBLE AS ambiguous_fraction FROM r GROUP BY doc_id)"""


def _contig_metrics(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("s")).where("s <> ''")
    return sequences.contig_metrics(lines, "doc_id", "s", "a-zA-Z")


@query(f"WITH {_CONTIGS} SELECT * FROM m")
def fasta_metrics(spark, d):
    return _contig_metrics(spark, d)


_BOUNDS = {
    "minimum_length": 200, "maximum_length": 20000, "maximum_contigs": 50, "minimum_n50": 100, "maximum_ambiguous_fraction": 0.6,
    "compare": True, "minimum_completeness": 10.0, "maximum_contamination": 5.0, "allowed_quality": ["en", "fr", "de"],
}
_REASONS = """q AS (SELECT doc_id, concat_ws(';', CASE WHEN genome_length < 200 THEN 'genome_too_short' END, CASE WHEN genome_length > 20000 THEN 'genome_too_long' END, CASE WHEN contigs > 50 THEN 'too_many_contigs' END,
 CASE WHEN contig_n50 < 100 THEN 'n50_too_low' END, CASE WHEN ambiguous_bases / genome_length::DOUBLE > 0.6 THEN 'too_many_ambiguous_bases' END, CASE WHEN n_chars <> 0 AND n_chars <> genome_length THEN 'download_length_mismatch' END,
 CASE WHEN doc_id % 3 <> 0 AND doc_id % 3 <> contigs THEN 'download_contig_count_mismatch' END, CASE WHEN doc_id % 5 <> 0 AND doc_id % 101 < 10 THEN 'checkm_completeness_too_low' END, CASE WHEN doc_id % 7 > 5 THEN 'checkm_contamination_too_high' END,
 CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 'unsupported_genome_quality' END) AS rejection_reasons FROM m JOIN documents USING (doc_id))"""


def _stated(spark, d):
    """What a source states of its genomes: lengths are the documents' characters, the rest comes from identifiers."""
    k = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("expected_length"), (k % 3).alias("expected_contigs"), F.when(k % 5 != 0, k % 101).alias("completeness"), (k % 7).alias("contamination"), F.col("lang").alias("quality"))


@query(f"WITH {_CONTIGS}, {_REASONS} SELECT doc_id, rejection_reasons, rejection_reasons = '' AS passed_qc FROM q")
def quality_reasons(spark, d):
    why = C.reasons(sequences.quality_rules(_BOUNDS))
    return _contig_metrics(spark, d).join(_stated(spark, d), "doc_id").select("doc_id", F.array_join(why, ";").alias("rejection_reasons"), (F.size(why) == 0).alias("passed_qc"))


@query(f"WITH {_CONTIGS}, {_REASONS} SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM q WHERE rejection_reasons = '')")
def qc_pass_filter(spark, d):
    passed = quality_reasons(spark, d).where(F.lower(F.col("passed_qc").cast("string")) == "true")
    return table(spark, d, "documents").join(passed, "doc_id", "left_semi").select("doc_id", "source")


@query("SELECT page_id, length(html) <= 20000 AND regexp_matches(lower(url), '\\d$') AS accepted FROM pages")
def upload_gate(spark, d):
    return table(spark, d, "pages").select("page_id", ((F.length("html") <= 20000) & F.lower("url").rlike(r"\d$")).alias("accepted"))


@query("SELECT page_id, regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/*$', 1), '\\.[^.]*$', '') AS stem FROM pages")
def path_stem(spark, d):
    return table(spark, d, "pages").select("page_id", C.path_stem(F.col("url")).alias("stem"))


@query("SELECT page_id, CAST(i - 1 AS INT) AS contig_idx, split_part(p, '>', 1) AS header FROM (SELECT page_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS p FROM (SELECT page_id, string_split(html, '<') AS ps FROM pages)) WHERE i > 1")
def fasta_records(spark, d):
    parts = table(spark, d, "pages").select("page_id", F.posexplode(F.split("html", "<")).alias("contig_idx", "p"))
    return parts.where("contig_idx > 0").select("page_id", "contig_idx", F.substring_index("p", ">", 1).alias("header"))


@query(f"WITH {R.SCORED} SELECT event_id, {R.SIGNAL} AS model_signal FROM sc")
def model_signal(spark, d):
    return R.scored(spark, d).select("event_id", C.model_signal(F.col("p"), R.LOWER, R.UPPER).alias("model_signal"))


def _decisions(spark, d):
    s = R.scored(spark, d).withColumn("model_signal", C.model_signal(F.col("p"), R.LOWER, R.UPPER))
    made = C.decision(
        qc=F.col("event_id") % 11 != 0, lineage=F.col("user_id") % 7 != 0, inside=F.col("value") / 500 >= 0.02, signal=F.col("model_signal"),
        relevant=F.col("k") % 5 == 0, strong=F.col("k") % 10 == 0, target=F.col("event_id") % 3 != 0,
    )
    return s.withColumns(made).withColumn("confidence", F.round(C.confidence(F.col("call"), F.col("p")), 6))


_DECIDE = f"""{R.SCORED}, sg AS (SELECT *, {R.SIGNAL} AS model_signal FROM sc), st AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN 1 WHEN user_id % 7 = 0 THEN 2 WHEN value / 500 < 0.02 THEN 3
 WHEN model_signal = 'susceptible_signal' AND k % 5 = 0 THEN 4 WHEN model_signal = 'susceptible_signal' AND event_id % 3 = 0 THEN 5 WHEN model_signal = 'susceptible_signal' THEN 6
 WHEN model_signal = 'resistant_signal' AND k % 10 = 0 THEN 7 WHEN model_signal = 'resistant_signal' THEN 8 WHEN k % 5 = 0 THEN 9 ELSE 10 END AS gate FROM sg),
de AS (SELECT event_id, drug, p, y, model_signal, CASE WHEN gate = 6 THEN 'likely_to_work' WHEN gate IN (7, 8) THEN 'likely_to_fail' ELSE 'no_call' END AS call,
 CASE gate WHEN 4 THEN 'conflicting_known_resistance_evidence' WHEN 7 THEN 'known_resistance_gene_or_mutation' WHEN 8 THEN 'statistical_association_only' WHEN 9 THEN 'known_resistance_evidence_but_model_uncertain' ELSE 'no_known_resistance_signal' END AS category,
 CASE gate WHEN 1 THEN 'qc' WHEN 2 THEN 'lineage_out_of_distribution' WHEN 3 THEN 'outside_amr_feature_distribution' WHEN 4 THEN 'model_susceptible_but_resistance_evidence_detected' WHEN 5 THEN 'molecular_target_not_verified' WHEN 9 THEN 'calibrated_probability_inside_no_call_region' WHEN 10 THEN 'calibrated_probability_inside_no_call_region' ELSE '' END AS reason FROM st)"""


@query(f"WITH {_DECIDE} SELECT event_id, drug, model_signal, call, category, reason, round(CASE call WHEN 'likely_to_work' THEN 1 - p WHEN 'likely_to_fail' THEN p ELSE greatest(p, 1 - p) END, 6) AS confidence FROM de")
def decision_cascade(spark, d):
    return _decisions(spark, d).select("event_id", "drug", "model_signal", "call", "category", "reason", "confidence")


@query("SELECT conv_id, count(*) FILTER (role = 'user') AS asked, string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (role = 'user') AS turns FROM conversations GROUP BY conv_id")
def array_filter(spark, d):
    one = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("all"))
    user = F.filter("all", lambda x: x["role"] == "user")
    return one.select("conv_id", F.size(user).cast("long").alias("asked"), F.when(F.size(user) > 0, F.array_join(F.transform(user, lambda x: x["turn"].cast("string")), ",")).alias("turns"))


@query("""SELECT c_custkey, coalesce(a.v, b.v, n.n_name) AS origin FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderpriority) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a ON a.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, min(o_orderpriority) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) b ON b.o_custkey = c_custkey LEFT JOIN nation n ON n_nationkey = c_nationkey""")
def coalesce_source(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    by = [o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderpriority").alias("origin")) for s in "FP"]
    last = c.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("origin"))
    return tables.first_source(c.select("c_custkey"), [*by, last], "c_custkey", "origin")


# joins


@query(f"WITH {R.DET} SELECT o_custkey, o_orderpriority, c_mktsegment, n_name, CAST(c_acctbal < 0 AS INT) AS target FROM det JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def modeling_table(spark, d):
    """Both joins check that their right side has each key once."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey", (F.col("c_acctbal") < 0).cast("int").alias("target"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return join_many_to_one(join_many_to_one(R.detected(spark, d), c, ["o_custkey"]), n, ["c_nationkey"]).select("o_custkey", "o_orderpriority", "c_mktsegment", "n_name", "target")


@query("""SELECT *, least(negative, positive) AS minimum_class_count FROM (SELECT c_mktsegment, r_name, count(DISTINCT CASE WHEN c_acctbal < 0 THEN c_custkey END) AS negative, count(DISTINCT CASE WHEN c_acctbal >= 0 THEN c_custkey END) AS positive, count(DISTINCT n_nationkey) AS clusters
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)""")
def split_support(spark, d):
    n = join_many_to_one(table(spark, d, "nation").withColumnRenamed("n_regionkey", "r_regionkey"), table(spark, d, "region"), ["r_regionkey"])
    rows = join_many_to_one(table(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), n, ["n_nationkey"])
    rows = rows.withColumn("sign", F.when(F.col("c_acctbal") < 0, "negative").otherwise("positive"))
    return splits.support(rows, ["c_mktsegment", "r_name"], "c_custkey", "n_nationkey", "sign", ["negative", "positive"])


_CALLED = """count(*) FILTER (model_signal <> 'no_call') AS called_count, round(avg(CAST(model_signal <> 'no_call' AS INT)), 6) AS coverage,
 round(avg(CASE WHEN model_signal <> 'no_call' THEN CAST((model_signal = 'resistant_signal') = (y = 1) AS INT) END), 6) AS accuracy, count(*) FILTER (model_signal = 'susceptible_signal') AS susceptible_calls, count(*) FILTER (model_signal = 'resistant_signal') AS resistant_calls,
 round(avg(y) FILTER (model_signal = 'susceptible_signal'), 6) AS resistant_fraction_in_susceptible_calls, round(avg(1 - y) FILTER (model_signal = 'resistant_signal'), 6) AS susceptible_fraction_in_resistant_calls"""
_REPORTED = """count(*) AS total, count(*) FILTER (call <> 'no_call') AS called, round(avg(CAST(call <> 'no_call' AS INT)), 6) AS coverage, round(avg(CAST(call = 'no_call' AS INT)), 6) AS no_call_rate,
 round(avg(CAST(call = CASE y WHEN 1 THEN 'likely_to_fail' ELSE 'likely_to_work' END AS INT)) FILTER (call <> 'no_call'), 6) AS called_accuracy, round(avg(CAST(call = 'likely_to_fail' AS INT)) FILTER (y = 1), 6) AS resistant_recall_including_no_calls,
 round(avg(CAST(call = 'likely_to_work' AS INT)) FILTER (y = 0), 6) AS susceptible_recall_including_no_calls"""


def _rounded(df, *keys):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c not in keys else F.col(c) for c, t in df.dtypes])


@query(f"WITH {_DECIDE} SELECT drug, {_REPORTED} FROM de GROUP BY drug")
def report_scoring(spark, d):
    calls = _decisions(spark, d).select(F.col("event_id").alias("genome_id"), "drug", "call")
    truth = R.scored(spark, d).select(F.col("event_id").alias("genome_id"), "drug", "y")
    return _rounded(report.score(calls, truth))


@query(f"WITH {R.SCORED}, sg AS (SELECT *, {R.SIGNAL} AS model_signal FROM sc) SELECT drug, {_CALLED} FROM sg GROUP BY drug")
def called_metrics(spark, d):
    return _rounded(metrics.called_metrics(R.scored(spark, d).withColumn("model_signal", C.model_signal(F.col("p"), R.LOWER, R.UPPER)), ["drug"]))


_KEYS = "ck AS (SELECT genome_id, drug FROM obs GROUP BY 1, 2 HAVING count(DISTINCT label) > 1)"


@query(f"WITH {R.OBS}, {_KEYS} SELECT * FROM ck")
def conflict_keys(spark, d):
    return cohort.conflict_keys(R.observations(spark, d), ["genome_id", "drug"], "label")


_CLEAN = f"{R.OBS}, {_KEYS}, cl AS (SELECT DISTINCT genome_id, drug, label FROM obs WHERE (genome_id, drug) NOT IN (SELECT (genome_id, drug) FROM ck))"


def _clean(spark, d):
    return cohort.clean(R.observations(spark, d).select("genome_id", "drug", "label"), ["genome_id", "drug"], "label").labels


@query(f"WITH {_CLEAN} SELECT * FROM cl")
def conflict_anti_join(spark, d):
    return _clean(spark, d)


_CHOSEN = "u AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = (SELECT min(o_orderpriority) FROM orders))"


def _chosen(spark, d):
    o = table(spark, d, "orders")
    first = o.agg(F.min("o_orderpriority").alias("o_orderpriority"))
    return o.where("o_orderstatus = 'F'").join(F.broadcast(first), "o_orderpriority", "left_semi").select(F.col("o_custkey").alias("c_custkey")).distinct()


@query(f"WITH {_CHOSEN} SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM u)")
def semi_join(spark, d):
    return table(spark, d, "customer").join(_chosen(spark, d), "c_custkey", "left_semi").select("c_custkey", "c_name")


@query(f"WITH {_CHOSEN} SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM u) THEN c_name ELSE '' END AS c_name FROM customer")
def missing_names_union(spark, d):
    c, u = table(spark, d, "customer"), _chosen(spark, d)
    return semi_join(spark, d).unionByName(c.join(u, "c_custkey", "left_anti").select("c_custkey", F.lit("").alias("c_name")))


@query(f"WITH {R.EDGE} SELECT left_id, right_id, round(estimated_ani, 6) AS estimated_ani FROM edge")
def similarity_self_join(spark, d):
    return similarity.similar_pairs(R.gram_sets(spark, d), "doc_id", 5, 0.95).withColumn("estimated_ani", F.round("estimated_ani", 6))


_PARTS = f"""WITH RECURSIVE {R.EDGE}, walk AS (SELECT doc_id AS v, doc_id AS root FROM documents UNION SELECT e.b, w.root FROM walk w JOIN (SELECT left_id AS a, right_id AS b FROM edge UNION ALL SELECT right_id, left_id FROM edge) e ON e.a = w.v),
cc AS (SELECT v AS doc_id, min(root) AS root FROM walk GROUP BY v)"""


def _components(spark, d):
    return similarity.set_clusters(table(spark, d, "documents").select("doc_id"), R.gram_sets(spark, d), "doc_id", 5, 0.95)


@query(f"{_PARTS} SELECT * FROM cc")
def connected_components(spark, d):
    return _components(spark, d)


@query(f"{_PARTS} SELECT doc_id, 'cluster_' || lpad(CAST(dense_rank() OVER (ORDER BY root) AS VARCHAR), 5, '0') AS cluster_id FROM cc")
def cluster_labels(spark, d):
    return similarity.cluster_labels(_components(spark, d), "doc_id").select("doc_id", "cluster_id")


@query(f"{_PARTS} SELECT doc_id, count(*) OVER (PARTITION BY root) AS cluster_size FROM cc")
def cluster_size(spark, d):
    return similarity.cluster_labels(_components(spark, d), "doc_id").select("doc_id", "cluster_size")


@query(f"""{_PARTS}, g AS (SELECT root, count(*) AS n FROM cc GROUP BY root), o AS (SELECT root, n, row_number() OVER (ORDER BY n DESC, sha256('42:' || root::VARCHAR)) AS i, sum(n) OVER () AS total FROM g),
fold AS (SELECT 0::BIGINT AS i, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c, NULL::BIGINT AS root, '' AS split UNION ALL
 SELECT o.i, fold.a + CASE WHEN s = 0 THEN o.n ELSE 0 END, fold.b + CASE WHEN s = 1 THEN o.n ELSE 0 END, fold.c + CASE WHEN s = 2 THEN o.n ELSE 0 END, o.root, CASE s WHEN 0 THEN 'train' WHEN 1 THEN 'calibration' ELSE 'test' END
 FROM (SELECT *, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS s FROM (SELECT fold.*, o.i AS oi, abs(fold.a + o.n - 0.70::DOUBLE * total) - abs(fold.a - 0.70::DOUBLE * total) AS d0,
  abs(fold.b + o.n - 0.15::DOUBLE * total) - abs(fold.b - 0.15::DOUBLE * total) AS d1, abs(fold.c + o.n - 0.15::DOUBLE * total) - abs(fold.c - 0.15::DOUBLE * total) AS d2 FROM fold JOIN o ON o.i = fold.i + 1)) fold JOIN o ON o.i = fold.oi)
SELECT root, split FROM fold WHERE i > 0""")
def grouped_split(spark, d):
    sizes = _components(spark, d).groupBy("root").agg(F.count("*").alias("n"))
    return splits.assign(sizes, "root", "n")


@query(f"""WITH {R.EDGE} SELECT doc_id, round(coalesce(max(ani), 0), 6) AS maximum, min(r) FILTER (ani = m) AS nearest FROM (SELECT q.doc_id, s.r, s.ani, max(s.ani) OVER (PARTITION BY q.doc_id) AS m FROM (SELECT doc_id FROM documents) q
LEFT JOIN sim s ON s.l = q.doc_id) GROUP BY doc_id""")
def nearest_reference(spark, d):
    """Each document's nearest other one."""
    sets = R.gram_sets(spark, d).withColumns({"q": F.lit(True), "r": F.lit(True)})
    found = lineage.nearest_sets(sets, table(spark, d, "documents").select("doc_id"), "doc_id", 5, apart=True)
    return found.withColumn("maximum", F.round("maximum", 6))


_JAC = "coalesce((bit_count(a.u & b.u) + bit_count(a.v & b.v)) / nullif(bit_count(a.u | b.u) + bit_count(a.v | b.v), 0)::DOUBLE, 1.0::DOUBLE)"


@query(f"WITH {R.PROF} SELECT a.vec_id, round(max({_JAC}), 6) AS similarity FROM prof a, (SELECT DISTINCT u, v FROM prof WHERE vec_id % 20 <> 0) b WHERE a.vec_id % 20 = 0 GROUP BY a.vec_id")
def max_jaccard(spark, d):
    """The stated query set (identifiers divisible by 20) against all other rows."""
    p = R.profiles(spark, d)
    return similarity.maximum_jaccard(p.where("vec_id % 20 = 0"), p.where("vec_id % 20 <> 0"), "vec_id", "profile", R.WIDTH).withColumn("similarity", F.round("similarity", 6))


_LOO = f"{R.PROF}, un AS (SELECT DISTINCT profile, u, v FROM prof), loo AS (SELECT a.profile, coalesce(max({_JAC}), 1.0) AS similarity FROM un a LEFT JOIN un b ON a.u <> b.u OR a.v <> b.v GROUP BY a.profile)"


@query(f"WITH {_LOO} SELECT array_to_string(profile, ',') AS profile, round(similarity, 6) AS similarity FROM loo")
def loo_jaccard(spark, d):
    one = similarity.leave_one_out(R.profiles(spark, d), "profile", R.WIDTH)
    return one.select(F.array_join(F.transform("profile", lambda x: x.cast("string")), ",").alias("profile"), F.round("similarity", 6).alias("similarity"))


@query(f"WITH {R.PROF} SELECT array_to_string(profile, ',') AS profile, count(*) AS n FROM prof GROUP BY profile")
def unique_profiles(spark, d):
    one = R.profiles(spark, d).groupBy("profile").agg(F.count("*").alias("n"))
    return one.select(F.array_join(F.transform("profile", lambda x: x.cast("string")), ",").alias("profile"), "n")


@query(f"WITH {_LOO} SELECT round(quantile_cont(similarity, 0.05::DOUBLE), 6) AS floor FROM loo")
def novelty_floor(spark, d):
    return similarity.novelty_floor(similarity.least_alike(R.profiles(spark, d), "profile", R.WIDTH, 0.05), "similarity", 0.05).withColumn("floor", F.round("floor", 6))


_CAND = f"""{R.SCORED}, ps AS (SELECT drug, p, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg FROM sc GROUP BY 1, 2), ca AS (SELECT *, low_calls >= 5 AND low_errors / low_calls::DOUBLE <= 0.1 AS low_ok, high_calls >= 5 AND high_errors / high_calls::DOUBLE <= 0.1 AS high_ok FROM (
 SELECT drug, p, CAST(sum(pos + neg) OVER u AS BIGINT) AS low_calls, CAST(sum(pos) OVER u AS BIGINT) AS low_errors, CAST(sum(pos + neg) OVER w AS BIGINT) AS high_calls, CAST(sum(neg) OVER w AS BIGINT) AS high_errors FROM ps
 WINDOW u AS (PARTITION BY drug ORDER BY p ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY drug ORDER BY p DESC ROWS UNBOUNDED PRECEDING)))"""


@query(f"WITH {_CAND} SELECT * FROM ca")
def threshold_candidates(spark, d):
    return metrics.threshold_candidates(R.scored(spark, d), ["drug"], 0.1, 5)


@query(f"""WITH {_CAND.replace("drug, p, CAST", "1 AS drug, p, CAST", 1).replace("GROUP BY 1, 2", "GROUP BY p", 1)}, pa AS (SELECT a.p AS lower, b.p AS upper, a.low_calls, b.high_calls, a.low_errors / a.low_calls::DOUBLE AS low_error, b.high_errors / b.high_calls::DOUBLE AS high_error FROM ca a JOIN ca b ON a.p < b.p WHERE a.low_ok AND b.high_ok)
SELECT lower, upper, low_calls, high_calls, low_error, high_error FROM pa ORDER BY low_calls + high_calls DESC, least(low_calls, high_calls) DESC, low_calls DESC LIMIT 1""")
def threshold_pairs(spark, d):
    every = metrics.threshold_candidates(R.scored(spark, d).withColumn("all", F.lit(1)), ["all"], 0.1, 5)
    return metrics.best_thresholds(every)


_REG = "reg AS (SELECT * FROM (VALUES ('add_to_cart', 3), ('click', 11), ('purchase', 10), ('search', 11), ('view', 5)) t(drug, required))"


def _registry(spark):
    return F.broadcast(spark.createDataFrame([("add_to_cart", 3), ("click", 11), ("purchase", 10), ("search", 11), ("view", 5)], "drug string, required int"))


@query(f"WITH {_REG} SELECT event_id, event_type AS drug, required FROM events JOIN reg ON event_type = drug")
def registry_lookup(spark, d):
    return table(spark, d, "events").select("event_id", F.col("event_type").alias("drug")).join(_registry(spark), "drug")


@query(f"""WITH sy AS (SELECT * FROM (VALUES ('add_to_cart', 1, [1, 2, 3]), ('click', 2, [3, 4, 5, 6]), ('purchase', 2, [7, 8])) t(drug, required_count, symbols)), ge AS (SELECT c_custkey AS genome_id FROM customer),
hi AS (SELECT DISTINCT user_id AS genome_id, CAST(json_extract_string(props, '$.k') AS INT) // 10 AS symbol FROM events WHERE value > 250), fo AS (SELECT h.genome_id, s.drug, list_sort(list(h.symbol::VARCHAR)) AS f FROM hi h JOIN sy s ON list_contains(s.symbols, h.symbol) GROUP BY 1, 2)
SELECT ge.genome_id, sy.drug, CASE WHEN coalesce(len(f), 0) >= required_count THEN 'present' ELSE 'not_verified' END AS status, array_to_string(coalesce(f, []), ',') AS detected, required_count FROM ge CROSS JOIN sy LEFT JOIN fo ON fo.genome_id = ge.genome_id AND fo.drug = sy.drug""")
def target_status(spark, d):
    """Customers as genomes, many of which have no hit."""
    rows = [("add_to_cart", 1, ["1", "2", "3"]), ("click", 2, ["3", "4", "5", "6"]), ("purchase", 2, ["7", "8"])]
    registry = spark.createDataFrame(rows, "drug string, minimum_targets_detected int, target_symbols array<string>")
    k = F.get_json_object("props", "$.k").cast("int")
    hits = table(spark, d, "events").where("value > 250").select(F.col("user_id").alias("genome_id"), F.floor(k / 10).cast("string").alias("symbol"))
    genomes = table(spark, d, "customer").select(F.col("c_custkey").alias("genome_id"))
    return report.target_status(registry, hits, genomes).withColumn("detected", F.array_join("detected", ","))


# aggregates


@query(f"""WITH {R.OBS} SELECT drug, count(*) AS observation_rows, count(DISTINCT genome_id) AS genomes, count(*) FILTER (label IN ('Resistant', 'Susceptible')) AS binary_rows, count(*) FILTER (value > 250) AS measurement_rows,
count(*) FILTER (label = 'Resistant') AS "Resistant", count(*) FILTER (label = 'Susceptible') AS "Susceptible" FROM obs GROUP BY drug""")
def audit_summary(spark, d):
    rows = R.observations(spark, d).withColumn("binary", F.col("label").isin(*cohort.LABELS)).withColumn("measured", F.col("value") > 250)
    return cohort.audit(rows, "genome_id", "drug", "label", {"binary_rows": "binary", "measurement_rows": "measured"})


_BAND = "CASE WHEN hour(ts) < 6 THEN 'missing' WHEN hour(ts) < 12 THEN 'morning' ELSE 'late' END"


def _band():
    h = F.hour("ts")
    return F.when(h < 6, "").when(h < 12, "morning").otherwise("late")


@query(f"WITH {R.OBS} SELECT drug, {_BAND} AS testing_standard, day(ts) % 7 AS testing_standard_year, count(*) AS observation_rows, count(DISTINCT genome_id) AS genomes FROM obs GROUP BY 1, 2, 3")
def audit_standards(spark, d):
    rows = R.observations(spark, d).withColumn("testing_standard", _band()).withColumn("testing_standard_year", (F.dayofmonth("ts") % 7).cast("long"))
    return cohort.audit_by(rows, "genome_id", ["drug", "testing_standard", "testing_standard_year"], ["testing_standard"])


@query(f"WITH {R.OBS} SELECT drug, {_BAND} AS laboratory_method, count(*) AS observation_rows, count(DISTINCT genome_id) AS genomes FROM obs GROUP BY 1, 2")
def audit_methods(spark, d):
    return cohort.audit_by(R.observations(spark, d).withColumn("laboratory_method", _band()), "genome_id", ["drug", "laboratory_method"], ["laboratory_method"])


_SUM = f"""{_CLEAN}, su AS (SELECT drug, count(DISTINCT genome_id) FILTER (label = 'Resistant') AS "Resistant", count(DISTINCT genome_id) FILTER (label = 'Susceptible') AS "Susceptible" FROM cl GROUP BY drug)"""


@query(f"""WITH {_SUM} SELECT *, "Resistant" + "Susceptible" AS total, "Resistant" / ("Resistant" + "Susceptible")::DOUBLE AS resistant_fraction FROM su""")
def summarize_labels(spark, d):
    return cohort.summarize(_clean(spark, d), "genome_id", "drug", "label")


@query(f"""WITH {_SUM} SELECT drug, 'Resistant' AS label, "Resistant" AS genomes FROM su UNION ALL SELECT drug, 'Susceptible', "Susceptible" FROM su""")
def unpivot_labels(spark, d):
    return summarize_labels(spark, d).select("drug", *cohort.LABELS).unpivot(["drug"], list(cohort.LABELS), "label", "genomes")


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query(f"WITH {R.DET} SELECT c_custkey, " + ", ".join(f"coalesce(max(CAST(o_orderpriority = '{p}' AS INT)), 0) AS f{p[0]}" for p in _PRIORITIES) + " FROM customer LEFT JOIN det ON o_custkey = c_custkey GROUP BY c_custkey")
def presence_matrix(spark, d):
    wide = R.detected(spark, d).withColumn("one", F.lit(1)).groupBy(F.col("o_custkey").alias("c_custkey")).pivot("o_orderpriority", list(_PRIORITIES)).max("one")
    wide = wide.select("c_custkey", *[F.col(f"`{p}`").alias(f"f{p[0]}") for p in _PRIORITIES])
    return table(spark, d, "customer").select("c_custkey").join(wide, "c_custkey", "left").na.fill(0)


@query(f"WITH {R.DET} SELECT o_orderpriority AS feature, count(*) AS genomes FROM det GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def feature_prevalence(spark, d):
    return R.detected(spark, d).groupBy(F.col("o_orderpriority").alias("feature")).agg(F.count("*").alias("genomes")).orderBy(F.desc("genomes"), "feature").limit(20)


@query(f"WITH {R.SCORED} SELECT drug, count(*) FILTER (y = 0) AS susceptible, count(*) FILTER (y = 1) AS resistant FROM sc GROUP BY drug")
def class_counts(spark, d):
    return metrics.class_counts(R.scored(spark, d), ["drug"])


_BIN = "CAST(" + " + ".join(f"CAST(p > {e!r}::DOUBLE AS INT)" for e in C.EDGES[1:-1]) + " AS INT)"
_REL = f"{R.SCORED}, re AS (SELECT drug, {_BIN} AS probability_bin, count(*) AS samples, round(avg(p), 6) AS mean_probability, round(avg(y), 6) AS observed_fraction FROM sc WHERE p BETWEEN 0 AND 1 GROUP BY 1, 2)"


def _reliability(spark, d):
    r = metrics.reliability(R.scored(spark, d), ["drug"])
    return r.withColumn("mean_probability", F.round("mean_probability", 6)).withColumn("observed_fraction", F.round("observed_fraction", 6))


@query(f"WITH {_REL} SELECT *, round(probability_bin * 0.1::DOUBLE, 6) AS bin_lower, round((probability_bin + 1) * 0.1::DOUBLE, 6) AS bin_upper FROM re")
def reliability_table(spark, d):
    return _rounded(_reliability(spark, d))


@query(f"WITH {_REL} SELECT drug, string_agg(probability_bin::VARCHAR || ':' || samples::VARCHAR, ',' ORDER BY probability_bin) AS bins FROM re GROUP BY drug")
def reliability_nested(spark, d):
    one = _reliability(spark, d).groupBy("drug").agg(F.sort_array(F.collect_list(F.struct("probability_bin", "samples"))).alias("b"))
    return one.select("drug", F.array_join(F.transform("b", lambda x: F.concat_ws(":", x["probability_bin"].cast("string"), x["samples"].cast("string"))), ",").alias("bins"))


@query(f"WITH {R.SCORED} SELECT y, {_BIN} AS bin, count(*) AS n FROM sc WHERE p BETWEEN 0 AND 1 GROUP BY 1, 2")
def probability_histogram(spark, d):
    return R.scored(spark, d).withColumn("bin", C.probability_bin(F.col("p"))).where("bin IS NOT NULL").groupBy("y", "bin").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS rows, count(DISTINCT source) AS sources, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs, sha256(string_agg(DISTINCT source, chr(10) ORDER BY source)) AS schema_sha256 FROM documents")
def dataset_manifest(spark, d):
    names = F.sort_array(F.collect_set("source"))
    return table(spark, d, "documents").agg(F.count("*").alias("rows"), F.count_distinct("source").alias("sources"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"), F.sha2(F.array_join(names, "\n"), 256).alias("schema_sha256"))


@query("""SELECT (SELECT count(*) = count(DISTINCT c_custkey) FROM customer) AS unique_key, (SELECT bool_and(l_linestatus IN ('O', 'F')) FROM lineitem) AS binary_domain, (SELECT max(n) = 1 FROM (SELECT count(DISTINCT n_regionkey) AS n FROM nation GROUP BY n_nationkey)) AS one_region,
(SELECT count(*) = 0 FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) AS no_orphans, (SELECT count(*) FILTER (c_acctbal IS NULL) = 0 FROM customer) AS complete""")
def contract_checks(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    one = c.agg((F.count("*") == F.count_distinct("c_custkey")).alias("unique_key"), (F.count_if(F.col("c_acctbal").isNull()) == 0).alias("complete"))
    two = table(spark, d, "lineitem").agg(F.bool_and(F.col("l_linestatus").isin("O", "F")).alias("binary_domain"))
    three = table(spark, d, "nation").groupBy("n_nationkey").agg(F.count_distinct("n_regionkey").alias("n")).agg((F.max("n") == 1).alias("one_region"))
    four = o.select("o_custkey").distinct().join(c, F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg((F.count("*") == 0).alias("no_orphans"))
    return one.crossJoin(two).crossJoin(three).crossJoin(four)  # one row each


@query("SELECT source AS split, count(*) AS genomes, count(DISTINCT lang) AS clusters FROM documents GROUP BY source")
def split_summary(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("split")).agg(F.count("*").alias("genomes"), F.count_distinct("lang").alias("clusters"))


@query("""SELECT conv_id, '[' || string_agg('{"turn":' || turn::VARCHAR || ',"role":"' || role || '"}', ',' ORDER BY turn) || ']' AS report FROM conversations GROUP BY conv_id""")
def report_document(spark, d):
    one = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return one.select("conv_id", F.to_json("r").alias("report"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_flatten(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int").alias("p")).select("event_id", F.col("p.k").alias("k"))


# order


@query("SELECT c_custkey, sha256('42:' || c_custkey::VARCHAR) AS selection_rank FROM customer")
def stable_rank(spark, d):
    return table(spark, d, "customer").select("c_custkey", C.stable_rank(F.col("c_custkey")).alias("selection_rank"))


@query("SELECT c_custkey, sha256('42:' || c_custkey::VARCHAR) AS rank_hash FROM customer ORDER BY 2, 1 LIMIT 50")
def hash_sample(spark, d):
    return cohort.hash_sample(table(spark, d, "customer").select("c_custkey"), "c_custkey", 50)


@query("SELECT doc_id, lang, rank FROM (SELECT doc_id, lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || doc_id::VARCHAR), doc_id) AS INT) AS rank FROM documents) WHERE rank <= 20")
def top_k_per_group(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").withColumn("h", C.stable_rank(F.col("doc_id")))
    return cohort.top_k_per_group(rows, ["lang"], 20, ["h", "doc_id"]).select("doc_id", "lang", "rank")


@query(f"""WITH {_CLEAN}, h AS (SELECT *, sha256('42:' || genome_id) AS hash FROM cl), f AS (SELECT DISTINCT genome_id FROM (SELECT genome_id, row_number() OVER (PARTITION BY drug, label ORDER BY hash, genome_id) AS i FROM h) WHERE i <= 20),
cv AS (SELECT genome_id, min(hash) AS hash, count(DISTINCT drug) AS n FROM h GROUP BY 1) SELECT genome_id, n AS label_count, hash AS selection_rank FROM cv ORDER BY genome_id IN (SELECT genome_id FROM f) DESC, n DESC, hash, genome_id LIMIT 2000""")
def select_genomes(spark, d):
    return cohort.select_genomes(_clean(spark, d), "genome_id", "drug", "label", 20, 2000)


@query("SELECT l_partkey, l_orderkey, l_linenumber, l_discount, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_discount, l_extendedprice DESC, l_orderkey, l_linenumber) AS i FROM lineitem) WHERE i = 1")
def best_hit(spark, d):
    order = F.struct("l_discount", (-F.col("l_extendedprice")).alias("o"), "l_orderkey", "l_linenumber")
    best = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.min(order).alias("b"))
    return best.select("l_partkey", "b.l_orderkey", "b.l_linenumber", "b.l_discount", (-F.col("b.o")).alias("l_extendedprice"))


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity / 50 >= 0.8 AND 100 - 100 * l_tax >= 97")
def blast_filter(spark, d):
    return table(spark, d, "lineitem").where("l_quantity / 50 >= 0.8 AND 100 - 100 * l_tax >= 97").select("l_partkey").distinct()


_PS = f"{R.SCORED}, ps AS (SELECT drug, p, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg FROM sc GROUP BY 1, 2)"


@query(f"WITH {_PS}, b AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY drug ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM ps) SELECT drug, round(sum(pos * (below + 0.5::DOUBLE * neg)) / (sum(pos) * sum(neg))::DOUBLE, 6) AS auroc FROM b GROUP BY drug")
def auroc(spark, d):
    return _rounded(metrics.auroc(R.scored(spark, d), ["drug"]))


@query(f"WITH {_PS}, t AS (SELECT *, sum(pos) OVER w AS tp, sum(pos + neg) OVER w AS n FROM ps WINDOW w AS (PARTITION BY drug ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) SELECT drug, CASE WHEN sum(neg) > 0 THEN round(sum(pos * tp / n::DOUBLE) / nullif(sum(pos), 0)::DOUBLE, 6) END AS average_precision FROM t GROUP BY drug")
def average_precision(spark, d):
    return _rounded(metrics.average_precision(R.scored(spark, d), ["drug"]))


@query(f"""WITH {R.SCORED}, n AS (SELECT drug, (count(*) FILTER (y = 1 AND p >= 0.5))::DOUBLE AS tp, count(*) FILTER (y = 0 AND p < 0.5) AS tn, count(*) FILTER (y = 0 AND p >= 0.5) AS fp, count(*) FILTER (y = 1 AND p < 0.5) AS fn, avg(pow(p - y, 2)) AS brier FROM sc GROUP BY drug)
SELECT drug, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS resistant_recall, round(coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0), 6) AS susceptible_recall, round((tp / nullif(tp + fn, 0) + tn::DOUBLE / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(brier, 6) AS brier FROM n""")
def evaluate(spark, d):
    return _rounded(metrics.evaluate(R.scored(spark, d), ["drug"]))


@query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events) WHERE i = 1")
def first_per_key(spark, d):
    return cohort.first_per_key(table(spark, d, "events").select("user_id", "event_type", "value", "event_id"), "user_id", "event_id").select("user_id", "event_type", "value")


@query("SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier ORDER BY s_nationkey, s_acctbal DESC, s_suppkey")
def sort_mixed(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal").orderBy("s_nationkey", F.desc("s_acctbal"), "s_suppkey")


@query("SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 100")
def limit_n(spark, d):
    return table(spark, d, "events").select("event_id", "ts").orderBy("ts", "event_id").limit(100)


@query(f"WITH {R.OBS} SELECT DISTINCT genome_id, drug, label FROM obs")
def distinct_rows(spark, d):
    return R.observations(spark, d).select("genome_id", "drug", "label").distinct()


@query(f"""WITH {R.DET}, a AS (SELECT o_custkey, list(o_orderpriority) AS f FROM det GROUP BY 1) SELECT o_custkey, array_to_string(list_sort(list_filter(f, lambda x: x IN ('1-URGENT', '2-HIGH', '9-NEW'))), ',') AS recognized, array_to_string(list_sort(list_filter(f, lambda x: x NOT IN ('1-URGENT', '2-HIGH', '9-NEW'))), ',') AS unknown FROM a""")
def recognized_unknown(spark, d):
    known = F.array(F.lit("1-URGENT"), F.lit("2-HIGH"), F.lit("9-NEW"))
    one = R.detected(spark, d).groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("f"))
    return one.select("o_custkey", F.array_join(F.array_sort(F.array_intersect("f", known)), ",").alias("recognized"), F.array_join(F.array_sort(F.array_except("f", known)), ",").alias("unknown"))


@query("SELECT doc_id, count(DISTINCT g) AS kept FROM (SELECT doc_id, substr(text, i, 9) AS g FROM (SELECT doc_id, text, unnest(range(1, length(text) - 7)) AS i FROM documents WHERE length(text) >= 9)) WHERE substr(sha256(g), 1, 1) = '0' GROUP BY doc_id")
def kmer_sketch(spark, d):
    return sequences.kmer_sketch(table(spark, d, "documents"), "doc_id", "text", 9).groupBy("doc_id").agg(F.count("*").alias("kept"))


# models: their results are checked against a brute-force fit in the tests


@query()
def logistic_fit(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"), (F.col("label") >= 5).cast("int").alias("y"))
    w = models.fit_logistic(rows, "x", "y", iterations=100)
    return rows.select("vec_id", "y", F.round(C.sigmoid(models.margin("x", w)), 6).alias("probability"))


@query()
def platt_fit(spark, d):
    rows = R.scored(spark, d).withColumn("decision", 4 * F.col("p") - 2)
    a, b = models.fit_platt(rows, "decision", "y")
    return rows.select("event_id", F.round(C.calibrated(F.col("decision"), a, b), 6).alias("probability"))


@query(f"""WITH {R.DET}, c AS (SELECT c_custkey, c_mktsegment AS drug, c_acctbal < 3000 AS y, CASE WHEN c_custkey % 20 < 14 THEN 'train' WHEN c_custkey % 20 < 17 THEN 'calibration' ELSE 'test' END AS split FROM customer WHERE c_custkey IN (SELECT o_custkey FROM det))
SELECT drug, count(*) FILTER (split = 'train' AND NOT y) AS train_susceptible, count(*) FILTER (split = 'train' AND y) AS train_resistant, count(*) FILTER (split = 'calibration' AND NOT y) AS calibration_susceptible, count(*) FILTER (split = 'calibration' AND y) AS calibration_resistant,
 count(*) FILTER (split = 'test' AND NOT y) AS test_susceptible, count(*) FILTER (split = 'test' AND y) AS test_resistant FROM c GROUP BY drug""")
def split_classes(spark, d):
    return training.class_counts(R.modeling(spark, d))


@query()
def train_models(spark, d):
    """One model a market segment, its states, thresholds and metrics on test rows."""
    made = training.train_all(R.modeling(spark, d), [f"f{p[0]}" for p in _PRIORITIES], training.Settings())
    return made.summary


@query()
def model_predictions(spark, d):
    made = training.train_all(R.modeling(spark, d), [f"f{p[0]}" for p in _PRIORITIES], training.Settings())
    return made.predictions.select("genome_id", "drug", "y", F.round("raw_p", 6).alias("raw_p"), F.round("p", 6).alias("p"), "model_signal")


@query(f"""WITH {R.EDGE}, be AS (SELECT d.doc_id, coalesce(max(s.ani), 0) AS m, min(s.r) FILTER (s.ani = x.best) AS n FROM documents d LEFT JOIN (SELECT l, max(ani) AS best FROM sim WHERE r % 5 > 1 GROUP BY l) x ON x.l = d.doc_id LEFT JOIN sim s ON s.l = d.doc_id AND s.r % 5 > 1 WHERE d.doc_id % 5 < 2 GROUP BY d.doc_id),
fl AS (SELECT quantile_cont(m, 0.4::DOUBLE) AS f FROM be WHERE doc_id % 5 = 0)
SELECT doc_id, CASE WHEN m >= f THEN 'in_distribution' ELSE 'out_of_distribution' END AS status, round(m, 6) AS maximum, round(f, 6) AS floor, n AS nearest FROM be, fl WHERE doc_id % 5 = 1""")
def lineage_status(spark, d):
    """Documents as genomes: three of five are for training, one for calibration, one is new."""
    asks = F.col("doc_id") % 5 < 2
    sets = R.gram_sets(spark, d).withColumns({"q": asks, "r": ~asks})
    near = lineage.nearest_sets(sets, table(spark, d, "documents").where(asks).select("doc_id"), "doc_id", 5)
    floor = similarity.novelty_floor(near.where("doc_id % 5 = 0"), "maximum", 0.4).first()["floor"]
    found = lineage.judged(near.where("doc_id % 5 = 1"), floor, "doc_id")
    return found.select("doc_id", "status", F.round("maximum", 6).alias("maximum"), F.round("floor", 6).alias("floor"), "nearest")


# beyond the reference's inputs: counts in windows, on a batch here and on a stream in the tests


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, d):
    return windows.tumbling_counts(table(spark, d, "events"), "ts", ["event_type"], "1 hour", "10 minutes")
