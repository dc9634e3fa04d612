"""A corpus from raw documents to packed training sequences: five stages, each applying one operator to all that is left.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyproof.llm import decontaminate, near_copies, packing, secrets, toxicity
from storyproof.llm.common import column, fresh, materialize


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold of their language.

    Null and empty texts are scored as texts without words. Repeated rows are kept or go alike. Columns of any name stay.
    """
    model, name = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), fresh("score", docs)
    return toxicity.score(docs, model, name).where(F.col(name) < toxicity.limit(model)).select(*_all(docs))


def _all(docs: DataFrame) -> list[Column]:
    return [column(c) for c in docs.columns]


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id, whether or not other groups have rows of that doc_id.

    Near copies have 5-word shingles of Jaccard similarity 0.8 or more, groups are what such pairs link. Texts without words,
    null or empty, are one group. Repeated rows are copies. A row without doc_id can't be named by a group and stays. Columns
    of any name stay.
    """
    uid = fresh("uid", docs)
    named = materialize(docs.where(F.col("doc_id").isNotNull()).withColumn(uid, F.monotonically_increasing_id()), "numbered")
    kept = near_copies.heads(named.select(F.col(uid).alias("uid"), "doc_id", "text")).select(F.col("uid").alias(uid))
    heads = named.join(kept, uid, "left_semi").select(*_all(docs))
    return heads.unionByName(docs.where(F.col("doc_id").isNull()))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with no window of a benchmark item.

    Null and empty texts have none and stay, as do repeated rows of what stays, a null doc_id and columns of any name.
    """
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=True)
    return found.where(F.size("items") == 0).select(*(F.col(f"kept_{i}").alias(c) for i, c in enumerate(docs.columns)))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by its kind in brackets; null and empty texts and all columns stay."""
    return secrets.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 2048 tokens; null and empty texts are the closing id alone."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("toxicity", without_toxic),
    ("simhash", without_copies),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: No SQL can express these stages; tests compare them with plain versions on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each over the written result of the one before, which is removed then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        docs = materialize(made, f"stage-{name}", replaces=docs) if i + 1 < len(STAGES) else made
    return docs
