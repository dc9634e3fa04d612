"""Tables and texts from files, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyproof import schemas


def spread(df: DataFrame) -> DataFrame:
    """df as it is, unless it comes from fewer files than there are cores and is too small for full splits of them.

    Such a table may be one row group, which one task reads; it is dealt to all cores then. A large table never is.
    """
    spark = df.sparkSession
    cores, split = spark.sparkContext.defaultParallelism, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * split and len(df.inputFiles()) < cores:
        return df.repartition(cores)
    return df


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quoted fields may hold commas, doubled quotes and line ends; columns are found by name, empty fields are null."""
    options = {"header": True, "multiLine": True, "escape": '"', "enforceSchema": False}
    there = spark.read.options(**options, inferSchema=False).csv(path)
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], schema).schema}
    return there.select(*((F.col(c).try_cast(k) if c in there.columns else F.lit(None).cast(k)).alias(c) for c, k in kinds.items()))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """By the end of the path: .jsonl or .json, .parquet, else CSV."""
    if path.endswith((".jsonl", ".json")):
        return jsonl(spark, path, schema)
    return spark.read.schema(schema).parquet(path) if path.endswith(".parquet") else csv(spark, path, schema)


def first_there(spark: SparkSession, choices: list[tuple[str, str]]) -> tuple[str, DataFrame]:
    """The first of some (path, schema) that exists, and its table."""
    for path, schema in choices:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            return path, table(spark, path, schema)
    raise FileNotFoundError(", ".join(p for p, _ in choices))


def decoded(content: Column) -> tuple[Column, Column]:
    """The text of bytes and its encoding: UTF-8 if they are valid, else Latin-1; line ends become one."""
    utf8 = F.is_valid_utf8(content.cast("string"))
    text = F.when(utf8, F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "\r\n?", "\n"), F.when(utf8, F.lit("utf-8")).otherwise(F.lit("latin-1"))


def file_name_of(path: Column) -> Column:
    """The last part of a path whose special characters are encoded."""
    return F.element_at(F.split(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "/"), -1)


def stem_of(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def novels(spark: SparkSession, *paths: str) -> DataFrame:
    """One row for each text file: its stem as book_name, what the registry keeps, and the whole text."""
    files = spark.read.format("binaryFile").load(list(paths))
    text, encoding = decoded(F.col("content"))
    name = file_name_of(F.col("path"))
    return files.select(
        stem_of(name).alias("book_name"), name.alias("file_name"), F.col("path").alias("file_path"), F.col("length").alias("byte_len"),
        F.sha2("content", 256).alias("sha256"), encoding.alias("encoding"), text.alias("text"), F.current_timestamp().alias("ingest_ts"),
    )


def gold_labels(spark: SparkSession, path: str) -> DataFrame:
    """(key, gold) from a labelled table whatever its id column is called: claim_id or id, and label, gold_label or y."""
    raw = spark.read.json(path) if path.endswith((".jsonl", ".json")) else spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    key = next((c for c in ("claim_id", "id") if c in raw.columns), None)
    label = next((c for c in ("gold_label", "label", "y") if c in raw.columns), None)
    if key is None or label is None:
        raise ValueError(f"{path} needs an id and a label column; it has {raw.columns}")
    return raw.select(F.col(key).cast("string").alias("key"), F.col(label).cast("string").alias("gold"))


def run_id_of(path: Column) -> Column:
    """The run in a path like …/run_id=name/…, or null."""
    return F.nullif(F.regexp_extract(path, "run_id=([^/]+)", 1), F.lit(""))


TABLES = {"train": schemas.TRAIN, "test": schemas.TEST}
