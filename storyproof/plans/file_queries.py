"""Tables and texts through files and back: what is read must be what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyproof.config import load
from storyproof.functions import text as T
from storyproof.operators import graph, verify
from storyproof.plans.registry import query, table
from storyproof.sources import readers, store, writers

CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit('"'), "c_name", F.lit(",\n")).alias("c_name"), "c_nationkey", "c_acctbal", "c_mktsegment")


WRITTEN = "SELECT c_custkey, '\"' || c_name || ',' || chr(10) AS c_name, c_nationkey, c_acctbal, c_mktsegment"


@query(f"{WRITTEN}, NULL::VARCHAR AS caption FROM customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes, commas and line ends in fields; a column that the file lacks is null."""
    path = store.new_path(spark, "csv")
    writers.csv(customers(spark, sf_dir), path)
    return readers.csv(spark, path, f"{CUSTOMER}, caption string")


@query(f"{WRITTEN} FROM customer")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.new_path(spark, "lines") + ".jsonl"
    writers.jsonl(customers(spark, sf_dir), path)
    return readers.table(spark, path, CUSTOMER)


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def partition_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One partition of a table that was written by status; the others aren't read."""
    path = store.new_path(spark, "orders")
    writers.parquet(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), path, "o_orderstatus")
    return spark.read.parquet(path).where("o_orderstatus = 'F'")


@query("SELECT n_nationkey, n_name FROM nation")
def first_table_there(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a chain of places the first that exists."""
    return readers.first_there(spark, [(f"{sf_dir}/nothing.csv", "n_name string"), (f"{sf_dir}/nation.parquet", "n_nationkey int, n_name string"), (f"{sf_dir}/region.parquet", "r_name string")])[1]


@query(r"""SELECT CAST(item_id AS VARCHAR) AS book_name, CAST(item_id AS VARCHAR) || '.txt' AS file_name, octet_length(encode(text)) AS byte_len, sha256(text) AS sha256, 'utf-8' AS encoding, regexp_replace(text, '\r\n?', chr(10), 'g') AS text FROM benchmark""")
def novels_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item as a text file of its own, read as a novel with what the registry keeps of it."""
    folder = store.new_path(spark, "novels")
    writers.files(table(spark, sf_dir, "benchmark"), folder, "item_id", "text", ".txt").write.format("noop").mode("overwrite").save()
    return readers.novels(spark, folder).select("book_name", "file_name", "byte_len", "sha256", "encoding", "text")


@query("SELECT CAST(doc_id AS VARCHAR) AS key, CASE quality WHEN 1 THEN 'consistent' ELSE 'contradict' END AS gold FROM labels")
def gold_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels whose columns are called id and y."""
    path = store.new_path(spark, "gold")
    writers.csv(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, F.lit("consistent")).otherwise(F.lit("contradict")).alias("y")), path)
    return readers.gold_labels(spark, path)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'run_' || o_orderstatus END AS run_id, regexp_replace(o_orderpriority, '[^a-zA-Z0-9_-]+', '_', 'g') AS file FROM orders")
def run_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    path = F.when(key % 3 == 0, F.concat(F.lit("/out/gold/run_id=run_"), "o_orderstatus", F.lit("/results"))).otherwise(F.lit("/out/gold/results"))
    return table(spark, sf_dir, "orders").select("o_orderkey", readers.run_id_of(path).alias("run_id"), T.file_key(F.col("o_orderpriority")).alias("file"))


@query("SELECT 3 AS k, true AS enforce_buckets, 'high_recall' AS mode, 300 AS step, 0.52::DOUBLE AS entail_threshold, 0.15::DOUBLE AS alpha")
def settings_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings from defaults and variables of the environment; what isn't a truth value leaves the default."""
    s = load(environ={"STORYPROOF_RETRIEVAL_K": "3", "STORYPROOF_RETRIEVAL_ENFORCE_BUCKETS": " Yes", "STORYPROOF_AGGREGATION_MODE": "high_recall", "STORYPROOF_VERIFIER_SENTENCE_LEVEL": "perhaps"})
    return spark.createDataFrame([(s.retrieval.k, s.retrieval.enforce_buckets, s.aggregation.mode, s.chunking.step, s.verifier.entail_threshold, s.verifier.score_mix_alpha)], "k int, enforce_buckets boolean, mode string, step int, entail_threshold double, alpha double")


@query("SELECT p_partkey, CAST(to_json({'brand': p_brand, 'size': p_size, 'kind': p_type}) AS VARCHAR) AS metadata FROM part")
def metadata_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_type").alias("kind"))).alias("metadata"))


@query("""WITH ranked AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events)
SELECT user_id, rank, event_id FROM ranked ORDER BY user_id, rank""")
def ranked_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows by key and rank, as candidates are stored."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    return table(spark, sf_dir, "events").select("user_id", rank.cast("long").alias("rank"), "event_id").orderBy("user_id", "rank")


FOUND = """told AS (SELECT c_custkey AS id, c_name AS char, c_name || ' lives in ' || c_mktsegment || '.' AS passage, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS said,
  CASE c_custkey % 4 WHEN 0 THEN 'NEUTRAL' ELSE 'SUPPORT' END AS label, c_custkey % 100 / 100.0::DOUBLE AS confidence, c_custkey % 5 AS kind FROM customer),
parsed AS (SELECT *, CASE kind WHEN 0 THEN 'Age' WHEN 1 THEN 'Died' WHEN 2 THEN 'BornYear' ELSE 'Claim' END AS p,
  CASE kind WHEN 0 THEN '12' WHEN 1 THEN 'true' WHEN 2 THEN NULL ELSE 'lives, and stays' END AS o, CASE kind WHEN 0 THEN 'int' WHEN 1 THEN 'bool' ELSE 'string' END AS o_type,
  least(1, greatest(0, 0.65 * 0.86 + 0.35 * confidence)) AS fc FROM told WHERE label = 'SUPPORT'),
facts AS (SELECT id, char AS s, p, o, o_type, round(fc, 6) AS fact_confidence, CASE WHEN said <> '' THEN said ELSE passage END AS excerpt,
  CASE WHEN said <> '' THEN instr(passage, said) - 1 ELSE 0 END AS span_start, CASE WHEN said <> '' THEN instr(passage, said) - 1 + length(said) ELSE length(passage) END AS span_end, label, confidence, said FROM parsed WHERE o IS NOT NULL AND fc >= 0.4
  UNION ALL SELECT id, char, 'SupportsClaim', char || ' lives', 'string', round(least(1, greatest(0.55, confidence)), 6), passage, 0, length(passage), label, confidence, said FROM parsed WHERE o IS NULL OR fc < 0.4)"""


def found_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as rows of evidence: where they live is the passage, their segment the sentence."""
    key, name = F.col("c_custkey"), F.col("c_name")
    quoted = lambda pred, *more: F.concat(F.lit(pred + '("'), name, F.lit('"'), *map(F.lit, more), F.lit(")"))
    form = F.when(key % 5 == 0, quoted("Age", ", 12")).when(key % 5 == 1, quoted("Died")).when(key % 5 == 2, quoted("BornYear", ", unknown")).otherwise(quoted("Claim", ', "lives, and stays"'))
    return table(spark, sf_dir, "customer").select(
        key.alias("id"), F.concat(key.cast("string"), F.lit("_c01")).alias("claim_id"), F.lit("b").alias("book_name"), F.concat(F.lit("k"), (key % 10).cast("string")).alias("chunk_id"), F.when(key % 2 == 0, F.col("c_mktsegment")).otherwise(F.lit("")).alias("evidence_text"),
        F.when(key % 4 == 0, F.lit("NEUTRAL")).otherwise(F.lit("SUPPORT")).alias("label"), (key % 100 / 100.0).alias("confidence"), F.lit("r").alias("run_id"), F.concat(name, F.lit(" lives in "), "c_mktsegment", F.lit(".")).alias("passage"), name.alias("char"),
        F.concat(name, F.lit(" lives")).alias("claim_text"), F.array(form).alias("predicate_form"),
    )


@query(f"WITH {FOUND} SELECT id, s, p, o, o_type, fact_confidence, excerpt, span_start, span_end, label, round(confidence, 6) AS confidence FROM facts")
def facts_stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of supported evidence: typed objects, excerpts and spans, and a plain statement where no predicate gives one."""
    made = verify.facts(found_evidence(spark, sf_dir))
    return made.select("id", "s", "p", "o", "o_type", F.round("fact_confidence", 6).alias("fact_confidence"), "excerpt", F.col("span_start").cast("long").alias("span_start"), F.col("span_end").cast("long").alias("span_end"), "label", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {FOUND}, kept AS (SELECT *, 'k' || CAST(id % 10 AS VARCHAR) AS chunk_id, 'chunk ' || CAST(id % 10 AS VARCHAR) || ' is about ' || CASE id % 10 WHEN 4 THEN 'BUILDING' ELSE 'nothing' END AS body FROM facts WHERE fact_confidence >= 0.65),
placed AS (SELECT *, CASE WHEN p = 'Claim' AND said <> '' THEN said ELSE excerpt END AS ex FROM kept),
numbered AS (SELECT *, row_number() OVER (ORDER BY id, CAST(id AS VARCHAR) || '_c01', chunk_id, p, o) AS n FROM placed)
SELECT 't_' || lpad(CAST(n AS VARCHAR), CAST(greatest(5, length(CAST(n AS VARCHAR))) AS INT), '0') AS triple_id, id, s, p, o, CASE id % 10 WHEN 0 THEN 'EARLY' WHEN 9 THEN NULL ELSE 'LATE' END AS time_bucket, ex AS excerpt_text, label AS support_label,
  round(confidence, 6) AS evidence_confidence FROM numbered""")
def triples_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered triples of the facts with enough confidence; every tenth fact's chunk is unknown."""
    found = found_evidence(spark, sf_dir)
    aliases = graph.alias_table(found.select("id", "claim_id", "char", "book_name"))
    about = F.when(F.col("n") == 4, F.lit("BUILDING")).otherwise(F.lit("nothing"))
    bucket = F.when(F.col("n") == 0, F.lit("EARLY")).otherwise(F.lit("LATE"))
    chunks = spark.range(9).withColumnRenamed("id", "n").select(F.concat(F.lit("k"), F.col("n").cast("string")).alias("chunk_id"), F.lit("b").alias("book_name"), bucket.alias("time_bucket"), F.lit("ch000").alias("chapter_id"), F.lit(0.5).alias("chunk_pos"), F.concat(F.lit("chunk "), F.col("n").cast("string"), F.lit(" is about "), about).alias("chunk_text"))
    made = graph.triples(verify.facts(found).withColumn("fact_confidence", F.round("fact_confidence", 6)), chunks, found, aliases)
    return made.select("triple_id", "id", "s", "p", "o", "time_bucket", "excerpt_text", "support_label", F.round("evidence_confidence", 6).alias("evidence_confidence"))
