"""Importance resampling towards a target distribution: hashed n-grams, a gain for each bucket, Gumbel keys for the draw.

All of it is built-in expressions. A document's features become one array of buckets by higher-order functions, and its weight is
an aggregate over that array that looks each bucket up in one literal array of gains, so scoring explodes and shuffles nothing.
The arrays are stored between the two, about two bytes a feature, since making them is nearly all of the work. Only the totals of the buckets are shuffled, summed before by each task: at most BUCKETS rows a task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyproof.llm.common import documents, materialize

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 42, 20, 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text with only A-Z lower-cased; none for null."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(_WORD), F.lit(0)), F.array().cast("array<string>"))


def with_buckets(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with words and buckets in place of the text: the bucket of each run of one to three words, repeats included.

    Runs of two and three words are made by zipping the words with what follows them, so the work is linear in the words.
    """
    after = lambda c, n: F.slice(c, F.lit(n + 1), F.greatest(F.size("words") - n, F.lit(0)))
    pairs = F.zip_with(F.slice("words", F.lit(1), F.greatest(F.size("words") - 1, F.lit(0))), after("words", 1), lambda a, b: F.concat(a, F.lit(" "), b))
    triples = F.zip_with(F.slice("pairs", F.lit(1), F.greatest(F.size("words") - 2, F.lit(0))), after("words", 2), lambda a, b: F.concat(a, F.lit(" "), b))
    bucket = lambda x: (F.crc32(x.cast("binary")) % BUCKETS).cast("int")
    made = rows.withColumn("words", words(F.col(text))).withColumn("pairs", pairs)
    each = F.concat(F.transform("words", bucket), F.transform("pairs", bucket), F.transform(triples, bucket))
    return made.select(*(c for c in rows.columns if c != text), F.size("words").alias("n_words"), each.alias("buckets"))


def totals(rows: DataFrame) -> list[int]:
    """How many features of all rows with buckets lie in each bucket.

    explode_outer, since for explode Spark would add a filter by the array's size, which makes all buckets once more.
    """
    out = [0] * BUCKETS
    counts = rows.select(F.explode_outer("buckets").alias("bucket")).groupBy("bucket").agg(F.count("bucket").alias("n"))
    for bucket, n in counts.collect():  # at most BUCKETS and one for rows without any
        if bucket is not None:
            out[bucket] = n
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """What a feature of each bucket adds to a weight: the smoothed log ratio of its shares in target and source, in thousandths."""
    s, t = float(sum(source)) + BUCKETS, float(sum(target)) + BUCKETS
    return [math.floor(1000 * math.log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(source, target, strict=True)]


def weight(gain: list[int]) -> Column:
    """The sum of the gains of a row's buckets; 0 without any."""
    literal = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded into one literal array
    return F.aggregate("buckets", F.lit(0).cast("long"), lambda total, b: total + F.element_at(literal, b + 1))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A Gumbel variate in thousandths, from a hash of the seed and the id; a null id counts as empty text."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """rows with their place in the order, from 1: sorted in ranges by all tasks, each range numbered on from those before it."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed, "ranges")
    part = F.shiftright("_at", 33)
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row a partition
    before, offsets = 0, []
    for p, n in sizes:
        offsets.append((p, before))
        before += n
    starts = rows.sparkSession.createDataFrame(offsets, "part long, before long")
    return placed.join(F.broadcast(starts), part == F.col("part")).withColumn(name, F.col("before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "part", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_features, weight, score, rank; rank is null for what isn't drawn.

    Drawn is that percentage, rounded down, of the rows with at least so many words: those with the highest score, of equal
    scores those with the smaller doc_id, a null doc_id last. target (text) says what is wanted. A text that is null or without words has no features
    and weight 0. Repeated rows keep their rows and are drawn one by one; equal rows have the ranks next to each other. An empty
    docs gives none; an empty target only smooths. Other columns are ignored, whatever their names. A text is one row in
    memory, whatever its length.
    """
    made = materialize(with_buckets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "buckets")
    gain = gains(totals(made), totals(with_buckets(target.select("text"))))
    w = weight(gain)
    scored = made.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), w.alias("weight"))
    scored = materialize(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored", replaces=made)
    able = F.col("n_words") >= least_words
    drawn = percent * scored.where(able).count() // 100
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    out = ranked(scored.where(able), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]).withColumn("rank", rank)
    return out.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long"))).select("doc_id", "n_features", "weight", "score", "rank")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """resample() of all documents towards the texts of benchmark: 5 of 100 documents of at least 20 words."""
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = rf"""
WITH texts AS (
  SELECT 0 AS side, doc_id, row_number() OVER () AS uid, text FROM documents UNION ALL SELECT 1, NULL, row_number() OVER (), text FROM benchmark
), split AS (
  SELECT side, uid, doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM texts
), places AS (
  SELECT side, uid, w, unnest(range(1, len(w) + 1)) AS i FROM split
), features AS (
  SELECT side, uid, array_to_string(w[i:i + k - 1], ' ') AS f FROM places, range(1, 4) r(k) WHERE i + k - 1 <= len(w)
), counted AS (
  SELECT side, uid, f, count(*) AS n FROM features GROUP BY ALL
), bytes AS (
  SELECT f, hex(f) AS h FROM (SELECT DISTINCT f FROM counted)
), steps AS (
  SELECT f, flatten(list_transform(range(len(h) // 2), lambda i: [('0x' || substr(h, 2 * i + 1, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])) AS s FROM bytes
), hashed AS (
  SELECT f, xor(4294967295, list_reduce([4294967295] || s, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) % {BUCKETS} AS bucket FROM steps
), bucketed AS (
  SELECT side, uid, bucket, sum(n)::BIGINT AS n FROM counted JOIN hashed USING (f) GROUP BY ALL
), sides AS (
  SELECT b, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t
  FROM range({BUCKETS}) r(b) LEFT JOIN bucketed ON bucket = b GROUP BY b
), gain AS (
  SELECT b AS bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM sides) + {BUCKETS}) / ((s + 1) * ((SELECT sum(t) FROM sides) + {BUCKETS}))))::BIGINT AS g FROM sides
), weights AS (
  SELECT uid, sum(n * g)::BIGINT AS weight, sum(n)::BIGINT AS n_features FROM bucketed JOIN gain USING (bucket) WHERE side = 0 GROUP BY uid
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) AS n_words,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM split LEFT JOIN weights USING (uid) WHERE side = 0
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST) AS r, count(*) FILTER (n_words >= {LEAST_WORDS}) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {LEAST_WORDS} AND r <= {PERCENT} * n // 100 THEN r END AS rank FROM ordered
"""
