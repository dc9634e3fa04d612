"""Metrics of predictions against labels, and plain sets and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyproof.functions.lexicon import LABELS
from storyproof.operators import measures
from storyproof.plans import evidence_queries as E
from storyproof.plans.registry import query, table

PAIRS = """pairs AS (SELECT CASE doc_id % 7 WHEN 0 THEN 'NEUTRAL' ELSE CASE quality WHEN 1 THEN 'SUPPORT' ELSE 'CONTRADICT' END END AS y,
  CASE WHEN doc_id % 5 = 0 THEN 'NEUTRAL' WHEN toxic = 1 OR quality = 0 THEN 'CONTRADICT' ELSE 'SUPPORT' END AS p FROM labels)"""
CELLS = PAIRS + ", names AS (SELECT unnest(['SUPPORT', 'NEUTRAL', 'CONTRADICT']) AS l), cells AS (SELECT a.l AS true_label, b.l AS pred_label, (SELECT count(*) FROM pairs WHERE y = a.l AND p = b.l) AS n FROM names a, names b)"
CLASSES = (
    CELLS
    + """, sums AS (SELECT l AS label, sum(n) FILTER (true_label = l AND pred_label = l) AS tp, sum(n) FILTER (true_label = l) AS support, sum(n) FILTER (pred_label = l) AS predicted FROM names, cells GROUP BY l),
rates AS (SELECT label, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall, support FROM sums),
classes AS (SELECT label, precision, recall, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1, support FROM rates)"""
)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    y = F.when(d % 7 == 0, F.lit("NEUTRAL")).when(F.col("quality") == 1, F.lit("SUPPORT")).otherwise(F.lit("CONTRADICT"))
    p = F.when(d % 5 == 0, F.lit("NEUTRAL")).when((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit("CONTRADICT")).otherwise(F.lit("SUPPORT"))
    return measures.checked_labels(table(spark, sf_dir, "labels").select(y.alias("y"), p.alias("p")), "y")


@query(f"WITH {CELLS} SELECT * FROM cells")
def confusion_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.confusion(pairs(spark, sf_dir), LABELS)


@query(f"WITH {CLASSES} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM classes")
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = measures.by_class(measures.confusion(pairs(spark, sf_dir), LABELS))
    return made.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f"WITH {CLASSES} SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 FROM classes")
def macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = measures.macro(measures.by_class(measures.confusion(pairs(spark, sf_dir), LABELS)))
    return made.select(*(F.round(c, 6).alias(c) for c in made.columns))


@query(f"WITH {PAIRS} SELECT count(*) AS n_eval, round(avg(CAST(y = p AS INT)), 6) AS accuracy FROM pairs")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.accuracy(pairs(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


@query(f"""{E.DECIDED} SELECT count(*) FILTER (y = 1 AND prediction = 1) AS tp, count(*) FILTER (y = 0 AND prediction = 0) AS tn, count(*) FILTER (y = 0 AND prediction = 1) AS fp, count(*) FILTER (y = 1 AND prediction = 0) AS fn FROM decided""")
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"))
    return measures.binary(E.decided(spark, sf_dir).join(gold, "id").select("y", F.col("prediction").alias("p")))


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT user_id FROM events)")
def missing_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id").join(table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id")), "doc_id", "left_anti")


@query("SELECT user_id AS id FROM events UNION SELECT doc_id FROM labels ORDER BY id")
def union_of_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).union(table(spark, sf_dir, "labels").select("doc_id")).distinct().orderBy("id")


@query("SELECT c_custkey AS id, 'train' AS split FROM customer UNION ALL SELECT s_suppkey, 'test' FROM supplier")
def train_and_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("train").alias("split"))
    return one.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("test").alias("split")))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) ORDER BY c_custkey")
def ids_with_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").orderBy("c_custkey")


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def ids_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey").subtract(table(spark, sf_dir, "orders").select("o_custkey"))


@query("SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.first_of(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("SELECT event_id, TRY_CAST(CASE event_id % 3 WHEN 0 THEN 'x' ELSE CAST(event_id AS VARCHAR) END AS BIGINT) AS n FROM events WHERE event_type IS NOT NULL")
def lossy_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("event_id") % 3 == 0, F.lit("x")).otherwise(F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").dropna(subset=["event_type"]).select("event_id", said.try_cast("bigint").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_partkey, l_orderkey, l_linenumber LIMIT 80")
def head_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the first 80 lines by part."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").orderBy("l_partkey", "l_orderkey", "l_linenumber").limit(80)


@query("SELECT n_regionkey, string_agg(DISTINCT lower(n_name), ',' ORDER BY lower(n_name)) AS names, count(*) AS n FROM nation GROUP BY n_regionkey")
def sorted_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set(F.lower("n_name"))), ",").alias("names"), F.count(F.lit(1)).alias("n"))
