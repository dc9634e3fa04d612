"""Predictions for claims from their evidence, and how well predictions fit labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyproof.functions.lexicon import LABELS


def strongest(evidence: DataFrame) -> DataFrame:
    """(claim_id, pred_label) of the most confident row of each claim, ties by chunk_id."""
    return evidence.groupBy("claim_id").agg(F.min_by("label", F.struct(-F.col("confidence"), F.col("chunk_id"))).alias("pred_label"))


def voted(evidence: DataFrame) -> DataFrame:
    """(claim_id, pred_label) of the most frequent label, ties by its best confidence, then by name."""
    counted = evidence.groupBy("claim_id", "label").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("c"))
    return counted.groupBy("claim_id").agg(F.min_by("label", F.struct(-F.col("n"), -F.col("c"), F.col("label"))).alias("pred_label"))


def confusion(pairs: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """(true_label, pred_label, n) for all combinations of the labels, zeros too; pairs (y, p)."""
    grid = pairs.sparkSession.createDataFrame([(a, b) for a in labels for b in labels], "true_label string, pred_label string")
    found = pairs.groupBy(F.col("y").alias("true_label"), F.col("p").alias("pred_label")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(grid).join(found, ["true_label", "pred_label"], "left").na.fill(0, ["n"])


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def by_class(cells: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) from the cells of a confusion table; 0 where a denominator is."""
    told = cells.select(F.explode(F.array("true_label", "pred_label")).alias("label"), "true_label", "pred_label", "n").distinct()
    hit, true, pred = (F.sum(F.when(c, F.col("n")).otherwise(0)) for c in ((F.col("true_label") == F.col("label")) & (F.col("pred_label") == F.col("label")), F.col("true_label") == F.col("label"), F.col("pred_label") == F.col("label")))
    sums = told.groupBy("label").agg(hit.alias("tp"), true.alias("support"), pred.alias("predicted"))
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return sums.select("label", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), "support")


def macro(classes: DataFrame) -> DataFrame:
    return classes.agg(*(F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")))


def accuracy(pairs: DataFrame) -> DataFrame:
    """(n_eval, accuracy) of pairs (y, p)."""
    return pairs.agg(F.count(F.lit(1)).alias("n_eval"), F.avg((F.col("y") == F.col("p")).cast("int")).alias("accuracy"))


def binary(pairs: DataFrame) -> DataFrame:
    """(tp, tn, fp, fn) of pairs of 0 and 1."""
    cell = lambda y, p: F.count(F.when((F.col("y") == y) & (F.col("p") == p), 1))
    return pairs.agg(cell(1, 1).alias("tp"), cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"))


def first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def checked_labels(rows: DataFrame, column: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """rows, failing where a label isn't one of the known."""
    return rows.withColumn(column, F.when(F.col(column).isin(*labels), F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"{column} has an unexpected label: "), F.coalesce(column, F.lit("null"))))))


def code_labels(x: Column, mapping: str) -> Column:
    """Labels of whole numbers by a mapping like 0=CONTRADICT,1=NEUTRAL,2=SUPPORT."""
    from storyproof.functions.text import normal_label

    pairs = [p.split("=", 1) for p in mapping.split(",") if p.strip()]
    return F.create_map(*(v for k, lab in pairs for v in (F.lit(int(k)), normal_label(F.lit(lab)))))[x.try_cast("int")]
