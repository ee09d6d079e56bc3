"""The driver's tables in the roles of the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grams import hashed_grams
from ..sources.tables import table

DRUGS = ("add_to_cart", "click", "purchase", "search", "view")


def observations(spark: SparkSession, d: str) -> DataFrame:
    """Events as laboratory observations: a user's day is a genome, an event type a drug."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select(
        F.concat(F.col("user_id").cast("string"), F.lit("."), F.dayofmonth("ts").cast("string")).alias("genome_id"), F.col("event_type").alias("drug"),
        F.when(k % 2 == 0, "Resistant").otherwise("Susceptible").alias("label"), "event_id", "value", k.alias("k"), "ts",
    )


OBS = """obs AS (SELECT user_id::VARCHAR || '.' || day(ts)::VARCHAR AS genome_id, event_type AS drug,
  CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 2 = 0 THEN 'Resistant' ELSE 'Susceptible' END AS label,
  event_id, value, CAST(json_extract_string(props, '$.k') AS INT) AS k, ts FROM events)"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Events as scored rows: probability p and target y."""
    k = F.get_json_object("props", "$.k").cast("int")
    p = (7 * k + 3 * ((37 * F.col("event_id")) % 100)) / F.lit(990.0)
    return table(spark, d, "events").select("event_id", F.col("event_type").alias("drug"), "user_id", "value", k.alias("k"), (k >= 50).cast("int").alias("y"), p.alias("p"))


SCORED = """sc AS (SELECT event_id, event_type AS drug, user_id, value, k, CAST(k >= 50 AS INT) AS y, CAST(7 * k + 3 * ((37 * event_id) % 100) AS DOUBLE) / 990.0::DOUBLE AS p
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""

LOWER, UPPER = 0.3, 0.7
SIGNAL = f"CASE WHEN p <= {LOWER}::DOUBLE THEN 'susceptible_signal' WHEN p >= {UPPER}::DOUBLE THEN 'resistant_signal' ELSE 'no_call' END"


def detected(spark: SparkSession, d: str) -> DataFrame:
    """Orders as features found: a customer is a genome, an order priority a feature."""
    return table(spark, d, "orders").select("o_custkey", "o_orderpriority").distinct()


DET = "det AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)"


def modeling(spark: SparkSession, d: str) -> DataFrame:
    """Customers with orders as genomes, market segments as drugs, order priorities as features."""
    priorities = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    wide = detected(spark, d).withColumn("one", F.lit(1.0)).groupBy("o_custkey").pivot("o_orderpriority", list(priorities)).max("one").na.fill(0)
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    rows = wide.join(c, F.col("o_custkey") == k)
    split = F.when(k % 20 < 14, "train").when(k % 20 < 17, "calibration").otherwise("test")
    return rows.select(k.alias("genome_id"), F.col("c_mktsegment").alias("drug"), split.alias("split"), (F.col("c_acctbal") < 3000).cast("int").alias("y"), *[F.col(f"`{p}`").alias(f"f{p[0]}") for p in priorities])


def grams(spark: SparkSession, d: str) -> DataFrame:
    """Distinct lower-cased word 5-grams of documents."""
    w = table(spark, d, "documents").select("doc_id", F.filter(F.split(F.lower("text"), "[ \t\n\r]+"), lambda x: x != "").alias("w")).where(F.size("w") >= 5)
    return w.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 4), lambda i: F.array_join(F.slice(F.col("w"), i, 5), " ")))).alias("g"))


def gram_sets(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, set): hashes of the grams of each document, made where its text lies; no text and no gram moves."""
    docs = table(spark, d, "documents")
    sets = hashed_grams(docs.select("doc_id", F.lower("text").alias("text")), "doc_id", "text")
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return sets
    return sets.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("set"))).alias("set"))


GRAM = """toks AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM documents),
gram AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM toks WHERE len(w) >= 5))"""
EDGE = GRAM + """, sz AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY 1),
pr AS (SELECT a.doc_id AS l, b.doc_id AS r, count(*) AS i FROM gram a JOIN gram b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
sim AS (SELECT l, r, pow(2 * j / (1 + j), 0.2::DOUBLE) AS ani FROM (SELECT l, r, i::DOUBLE / (x.n + y.n - i) AS j FROM pr JOIN sz x ON x.doc_id = l JOIN sz y ON y.doc_id = r)),
edge AS (SELECT l AS left_id, r AS right_id, ani AS estimated_ani FROM sim WHERE l < r AND ani >= 0.95)"""


#: Numbers of an embedding.
WIDTH = 64


def profiles(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as binary profiles: which of their numbers are positive."""
    return table(spark, d, "embeddings").select("vec_id", F.filter(F.transform("embedding", lambda x, i: F.when(x > 0, i + 1)), lambda x: x.isNotNull()).alias("profile"))


PROF = "prof AS (SELECT vec_id, list_filter(range(1, len(embedding) + 1), lambda i: embedding[i] > 0) AS profile, list_sum(list_transform(range(1, 33), lambda i: CASE WHEN embedding[i] > 0 THEN 1::BIGINT << (i - 1) ELSE 0 END))::BIGINT AS u, list_sum(list_transform(range(33, 65), lambda i: CASE WHEN embedding[i] > 0 THEN 1::BIGINT << (i - 33) ELSE 0 END))::BIGINT AS v FROM embeddings)"
