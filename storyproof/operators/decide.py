"""Evidence by id and label, thresholds from labelled ids, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyproof.config import Decision
from storyproof.functions import scores
from storyproof.functions.lexicon import LABELS
from storyproof.sources.store import materialize

QUANTILES = [round(0.05 + 0.025 * i, 3) for i in range(37)]


def pivoted(evidence: DataFrame) -> DataFrame:
    """For each id: the sum of confidences (…_weight) and the number (…_n) of each label, in one pass."""
    out = [f(F.when(F.col("label") == x, v)).alias(f"{x.lower()}_{n}") for x in LABELS for f, v, n in ((F.sum, F.col("confidence"), "weight"), (F.count, F.lit(1), "n"))]
    return evidence.groupBy("id").agg(*out)


def features(ids: DataFrame, evidence: DataFrame, constraints: DataFrame, labels: DataFrame, cfg: Decision | None = None) -> DataFrame:
    """One row for each id: evidence and its score, constraint status, label y and split.

    ids without evidence have zeros; without constraints SAT. An id without a label of 0 or 1 is in split test.
    """
    cfg = cfg or Decision()
    known = constraints.select("id", "status", F.col("confidence").alias("logic_conf"))
    base = ids.select("id").distinct().join(pivoted(evidence), "id", "left").join(known, "id", "left").join(labels.select("id", "y"), "id", "left")
    zero = {f"{x.lower()}_weight": 0.0 for x in LABELS} | {f"{x.lower()}_n": 0 for x in LABELS} | {"status": "SAT", "logic_conf": 0.0}
    out = base.na.fill(zero)
    return out.withColumns({
        "hard_violations": (F.col("status") == "UNSAT").cast("int"), "soft_violations": (F.col("status") == "SOFT_VIOLATIONS").cast("int"),
        "split": F.when(F.col("y").isNull(), F.lit("test")).otherwise(F.lit("train")), "evidence_score": scores.evidence_score(cfg),
    })


def thresholds(labelled: DataFrame) -> DataFrame:
    """Candidate thresholds t: the distinct values of 37 quantiles of the scores, with linear interpolation."""
    return quantiles(labelled, "evidence_score", QUANTILES).select(F.col("value").alias("t")).distinct()


def quantiles(rows: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """(share, value): exact quantiles of a column's values that aren't null, with linear interpolation; no rows without any.

    Distinct values are counted and dealt into ranges. The sizes of the ranges, a row each, say which range holds each rank
    that is asked for; only those ranges are numbered through, each in a task of its own, so no task sorts all values.
    """
    counted = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("c"))
    ranges = materialize(counted.repartitionByRange("value").withColumn("part", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("part").agg(F.sum("c").alias("size"))
    sizes = sizes.select("part", "size", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"), F.sum("size").over(Window.partitionBy(F.lit(0))).alias("n"))
    at = F.col("share") * (F.col("n") - 1)
    asked = sizes.select("*", F.explode(F.array(*map(F.lit, shares))).alias("share")).withColumn("at", at)
    ranks = asked.select("share", "at", "part", "before", "size", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank")).where("before <= rank and rank < before + size")
    held = ranges.join(F.broadcast(ranks.select("part").distinct()), "part", "left_semi")
    numbered = held.withColumn("upto", F.sum("c").over(Window.partitionBy("part").orderBy("value")))
    found = numbered.join(F.broadcast(ranks), "part").where("rank >= before + upto - c and rank < before + upto")
    whole = F.floor("at") == F.ceil("at")
    part = F.when(whole, F.col("value")).when(F.col("rank") == F.floor("at"), (F.ceil("at") - F.col("at")) * F.col("value")).otherwise((F.col("at") - F.floor("at")) * F.col("value"))
    return found.groupBy("share").agg(F.sum(part).alias("value"))


def trials(labelled: DataFrame) -> DataFrame:
    """(t, n, tp, fp, fn, tn) of labelled (evidence_score, y) for each candidate threshold, at most 37 rows.

    Counts of scores and labels are joined to the candidates, so the product is of distinct scores with those few.
    """
    counted = labelled.groupBy("evidence_score", "y").agg(F.count(F.lit(1)).alias("c"))
    over = counted.crossJoin(F.broadcast(thresholds(labelled))).withColumn("p", (F.col("evidence_score") >= F.col("t")).cast("int"))
    cell = lambda p, y: F.coalesce(F.sum(F.when((F.col("p") == p) & (F.col("y") == y), F.col("c"))), F.lit(0))
    return over.groupBy("t").agg(F.sum("c").alias("n"), cell(1, 1).alias("tp"), cell(1, 0).alias("fp"), cell(0, 1).alias("fn"), cell(0, 0).alias("tn"))


def calibrated(labelled: DataFrame, cfg: Decision | None = None) -> DataFrame:
    """One row, threshold: 0 if nothing is labelled.

    balanced: the most accurate candidate, ties to the larger. high_recall: among those with the minimal precision the best
    recall, then precision, then the larger; if none has it, the best recall, ties to the larger.
    """
    cfg = cfg or Decision()
    tried = trials(labelled)
    recall = F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn"))
    precision = F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp"))
    if cfg.mode == "high_recall":
        order: Column = F.when(precision >= cfg.min_precision, F.struct(F.lit(1).alias("a"), recall.alias("b"), precision.alias("c"), F.col("t").alias("d"))).otherwise(F.struct(F.lit(0).alias("a"), recall.alias("b"), F.lit(0.0).alias("c"), F.col("t").alias("d")))
    else:
        order = F.struct(((F.col("tp") + F.col("tn")) / F.col("n")).alias("a"), F.col("t").alias("b"))
    return tried.agg(F.coalesce(F.max_by("t", order), F.lit(0.0)).alias("threshold"))


def decisions(feats: DataFrame, threshold: DataFrame, cfg: Decision | None = None) -> DataFrame:
    """The decision table; threshold is one row."""
    cfg = cfg or Decision()
    made = feats.crossJoin(F.broadcast(threshold)).withColumn("prediction", scores.verdict(F.col("evidence_score"), F.col("threshold"))).withColumn("rationale", scores.reason(cfg))
    return made.select("id", "split", "prediction", "evidence_score", "support_weight", "contradict_weight", "neutral_weight", "support_n", "contradict_n", "neutral_n", "status", "hard_violations", "soft_violations", "logic_conf", "rationale")
