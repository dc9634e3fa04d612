"""BM25 and constrained top-K: documents are chunks, their language is the corpus, benchmark items ask every corpus."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyproof.config import Retrieval
from storyproof.functions.text import bucket, tokens
from storyproof.operators import retrieval
from storyproof.plans.registry import query, table
from storyproof.sources.readers import spread
from storyproof.sources.store import new_path
from storyproof.streaming import asof, segments

CFG = Retrieval(max_per_chapter=3)
SEEDED = dataclasses.replace(CFG, k=6, max_per_chapter=2, enforce_buckets=True)

DOCS = """docs AS (SELECT lang AS corpus, doc_id AS doc, regexp_extract_all(lower(text), '[a-z0-9'']+') AS toks, source AS chapter,
  CASE WHEN (doc_id * 7919 % 1000) / 1000.0 <= 0.33 THEN 'EARLY' WHEN (doc_id * 7919 % 1000) / 1000.0 <= 0.66 THEN 'MID' ELSE 'LATE' END AS bucket FROM documents),
stats AS (SELECT corpus, count(*) AS n, avg(len(toks)) AS avgdl FROM docs GROUP BY corpus),
postings AS (SELECT corpus, doc, dl, term, count(*) AS f FROM (SELECT corpus, doc, len(toks) AS dl, unnest(toks) AS term FROM docs) GROUP BY ALL),
dfs AS (SELECT corpus, term, count(*) AS df FROM postings GROUP BY ALL)"""
SCORED = (
    DOCS
    + """,
asked AS (SELECT DISTINCT item_id AS query, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS term FROM benchmark),
scored AS (SELECT query, p.corpus, doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM asked JOIN postings p USING (term) JOIN dfs USING (corpus, term) JOIN stats USING (corpus) GROUP BY ALL)"""
)
POOLED = (
    SCORED
    + """,
full_pairs AS (SELECT i.item_id AS query, d.corpus, d.doc, d.chapter, d.bucket, coalesce(s.score, 0) AS score
  FROM benchmark i CROSS JOIN docs d LEFT JOIN scored s ON s.query = i.item_id AND s.corpus = d.corpus AND s.doc = d.doc),
placed AS (SELECT *, row_number() OVER (PARTITION BY query, corpus ORDER BY score DESC, doc) AS place FROM full_pairs),
pool AS (SELECT *, min(score) OVER w AS low, max(score) OVER w AS high FROM placed WHERE place <= 80 WINDOW w AS (PARTITION BY query, corpus))"""
)
NORM = "round(CASE WHEN high > low THEN (score - low) / (high - low) ELSE 0 END, 6)"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = (F.col("doc_id") * 7919 % 1000) / 1000.0
    return spread(table(spark, sf_dir, "documents").select("lang", "doc_id", "text", "source")).select(F.col("lang").alias("corpus"), F.col("doc_id").alias("doc"), "text", F.col("source").alias("chapter"), bucket(place).alias("bucket"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item asks every corpus; the corpora are the handful of languages."""
    corpora = table(spark, sf_dir, "documents").select(F.col("lang").alias("corpus")).distinct()
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), tokens(F.col("text")).alias("terms"))
    return items.crossJoin(F.broadcast(corpora))


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("query", "corpus", "doc", F.round("score", 6).alias("score"), F.round("score_norm", 6).alias("score_norm"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {DOCS} SELECT corpus, n, round(avgdl, 6) AS avgdl FROM stats")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.build(docs(spark, sf_dir)).corpora.select("corpus", "n", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {DOCS} SELECT corpus, term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM dfs JOIN stats USING (corpus)")
def term_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.build(docs(spark, sf_dir)).weights().select("corpus", "term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {DOCS} SELECT corpus, doc, term, f, dl FROM postings")
def term_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.build(docs(spark, sf_dir)).postings.select("corpus", "doc", "term", F.col("f").cast("long").alias("f"), F.col("dl").cast("long").alias("dl"))


@query(f"WITH {SCORED} SELECT query, corpus, doc, round(score, 6) AS score FROM scored")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.scores(retrieval.build(docs(spark, sf_dir)), queries(spark, sf_dir), CFG).withColumn("score", F.round("score", 6))


@query(f"WITH {POOLED} SELECT query, corpus, doc, place, round(score, 6) AS score, {NORM} AS score_norm FROM pool")
def candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = retrieval.pool(retrieval.build(docs(spark, sf_dir)), queries(spark, sf_dir), CFG)
    return made.select("query", "corpus", "doc", F.col("place").cast("long").alias("place"), F.round("score", 6).alias("score"), F.round("score_norm", 6).alias("score_norm"))


TOP = f"""WITH {POOLED}, roomy AS (SELECT *, row_number() OVER (PARTITION BY query, corpus, chapter ORDER BY place) AS nth FROM pool),
kept AS (SELECT *, row_number() OVER (PARTITION BY query, corpus ORDER BY place) AS rank FROM roomy WHERE nth <= 3)"""


@query(f"{TOP} SELECT query, corpus, doc, round(score, 6) AS score, {NORM} AS score_norm, rank FROM kept WHERE rank <= 12")
def retrieve_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(retrieval.top_k(retrieval.pool(retrieval.build(docs(spark, sf_dir)), queries(spark, sf_dir), CFG), CFG))


def _seeded_sql() -> str:
    out = f"WITH {POOLED}, s0 AS (SELECT *, NULL::INT AS seed FROM pool)"
    for i, name in enumerate(("EARLY", "MID", "LATE")):
        out += f""",
f{i} AS (SELECT *, bucket = '{name}' AND seed IS NULL AND count(seed) OVER (PARTITION BY query, corpus, chapter) < 2 AS free FROM s{i}),
s{i + 1} AS (SELECT * EXCLUDE (seed, free), CASE WHEN free AND row_number() OVER (PARTITION BY query, corpus, free ORDER BY place) = 1 THEN {i} ELSE seed END AS seed FROM f{i})"""
    return (
        out
        + f""",
room AS (SELECT *, count(seed) OVER (PARTITION BY query, corpus, chapter) AS held, count(seed) OVER (PARTITION BY query, corpus) AS seeded,
  row_number() OVER (PARTITION BY query, corpus, chapter, seed IS NULL ORDER BY place) AS nth FROM s3),
fill AS (SELECT *, row_number() OVER (PARTITION BY query, corpus, seed IS NULL ORDER BY place) AS filled FROM room WHERE seed IS NOT NULL OR nth <= 2 - held),
kept AS (SELECT *, row_number() OVER (PARTITION BY query, corpus ORDER BY coalesce(seed, 3), place) AS rank FROM fill WHERE seed IS NOT NULL OR filled <= 6 - seeded)
SELECT query, corpus, doc, round(score, 6) AS score, {NORM} AS score_norm, rank FROM kept"""
    )


@query(_seeded_sql())
def retrieve_topk_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(retrieval.top_k(retrieval.pool(retrieval.build(docs(spark, sf_dir)), queries(spark, sf_dir), SEEDED), SEEDED))


COVERED = "SELECT query, corpus, count(*) AS k_found, count(DISTINCT bucket) AS buckets_covered, count(DISTINCT chapter) AS unique_chapters"


@query(f"{TOP} {COVERED} FROM kept WHERE rank <= 12 GROUP BY ALL")
def retrieval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = queries(spark, sf_dir)
    return retrieval.coverage(asked, retrieval.top_k(retrieval.pool(retrieval.build(docs(spark, sf_dir)), asked, CFG), CFG))


@query(f"{TOP} SELECT query, corpus, doc, round(score, 6) AS score, {NORM} AS score_norm, rank FROM kept WHERE rank <= 12")
def retrieve_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a micro-batch of the stream of claims is answered with."""
    return _ranked(asof.answered(queries(spark, sf_dir), retrieval.build(docs(spark, sf_dir)), CFG))


ARRIVED = ("(doc_id * 7919 % 1000) / 1000.0 <= 0.66", "TRUE")


def _of_version(version: int) -> str:
    some = TOP.replace("FROM documents)", f"FROM documents WHERE {ARRIVED[version - 1]})")
    return f"SELECT {version} AS version, * FROM ({some} SELECT query, corpus, doc, round(score, 6) AS score, {NORM} AS score_norm, rank FROM kept WHERE rank <= 12)"


@query(f"{_of_version(1)} UNION ALL {_of_version(2)}")
def retrieve_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same queries as of two versions of a stored index: the documents of the bucket LATE arrive after the first answers."""
    folder, rows, asked = new_path(spark, "growing-index"), docs(spark, sf_dir), queries(spark, sf_dir)
    made = [segments.append(spark, folder, rows.where("bucket <> 'LATE'")), segments.append(spark, folder, rows.where("bucket = 'LATE'"))]
    answers = [_ranked(asof.answered(asked, segments.load(spark, folder, v), CFG)).withColumn("version", F.lit(v)) for v in made]
    return answers[0].unionByName(answers[1])
