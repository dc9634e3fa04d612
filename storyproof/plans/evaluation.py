"""How well a run's predictions fit labels: the chain of prediction sources, metrics, and the files that tell of them."""

from __future__ import annotations

import json
from dataclasses import asdict
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyproof.config import Settings, load
from storyproof.functions.lexicon import LABELS
from storyproof.functions.text import normal_label
from storyproof.operators import measures, report
from storyproof.sources import readers, writers
from storyproof.sources.paths import Files

NAMES = ("label", "pred_label", "prediction_label", "final_label", "y_pred", "decision")
MAPPING = "0=CONTRADICT,1=SUPPORT"


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.options(header=True, multiLine=True, escape='"').csv(path)


def predictions(spark: SparkSession, gold: str, silver: str, run_id: str, aggregation: str = "max_conf", mapping: str = MAPPING) -> tuple[DataFrame, str]:
    """(claim_id, pred_label) and where they come from: results with labels, else numbered decisions, else labelled evidence.

    aggregation says how the evidence of a claim becomes one label: max_conf or vote.
    """
    store, results = Files(spark), f"{gold}/run_id={run_id}/results"
    if store.exists(results):
        found = _csv(spark, results)
        key, label = (next((c for c in names if c in found.columns), None) for names in (("claim_id", "id"), NAMES))
        if key and label:
            return found.select(F.col(key).cast("string").alias("claim_id"), normal_label(F.col(label)).alias("pred_label")), "gold_results"
    decided = f"{gold}/decisions/run_id={run_id}"
    if store.exists(decided):
        rows = spark.read.parquet(decided)
        return rows.select(F.col("id").cast("string").alias("claim_id"), measures.code_labels(F.col("prediction"), mapping).alias("pred_label")), "gold_decision_scores"
    told = f"{silver}/evidence/run_id={run_id}"
    if not store.exists(told):
        raise FileNotFoundError(f"no predictions at {results}, {decided} or {told}")
    if aggregation not in ("max_conf", "vote"):
        raise ValueError("aggregation must be max_conf or vote")
    rows = spark.read.parquet(told).select("claim_id", "chunk_id", normal_label(F.col("label")).alias("label"), "confidence")
    return (measures.strongest if aggregation == "max_conf" else measures.voted)(rows), f"silver_evidence ({aggregation})"


def measured(pairs: DataFrame) -> tuple[dict, list[tuple[str, str, int]], list[dict]]:
    """Metrics, cells of the confusion table and rows by class, for pairs (y, p) of known labels."""
    cells = measures.confusion(pairs, LABELS)
    classes = measures.by_class(cells)
    metrics = measures.accuracy(pairs).first().asDict() | measures.macro(classes).first().asDict()
    by_name = {r["label"]: r.asDict() for r in classes.collect()}  # as many rows as there are labels
    return metrics, [tuple(r) for r in cells.collect()], [by_name[x] for x in LABELS]


def evaluate(spark: SparkSession, labels: str, out: str, run_id: str | None = None, aggregation: str = "max_conf", mapping: str = MAPPING, cfg: Settings | None = None) -> dict[str, str]:
    """Compares a run under out with labels; writes metrics.json and a report, and puts it into the report of the run.

    Without a run_id the last run by name counts. Labels are of claims or ids, whatever the predictions are of; those without a
    prediction aren't counted. Gives the paths of the files.
    """
    store, gold, silver = Files(spark), f"{out.rstrip('/')}/gold", f"{out.rstrip('/')}/silver"
    there = [n.removeprefix("run_id=") for n in store.names(gold) if n.startswith("run_id=")]
    run_id = run_id or (there[-1] if there else "")
    pred, source = predictions(spark, gold, silver, run_id, aggregation, mapping)
    known = readers.gold_labels(spark, labels)
    said = F.when(F.lower("gold").startswith("cons"), F.lit("SUPPORT")).when(F.lower("gold").startswith("contradict"), F.lit("CONTRADICT")).otherwise(normal_label(F.col("gold")))
    gold_rows = measures.checked_labels(known.select(F.col("key").alias("claim_id"), said.alias("y")), "y")
    pairs = gold_rows.join(measures.checked_labels(pred, "pred_label").withColumnRenamed("pred_label", "p"), "claim_id").select("y", "p")
    metrics, cells, classes = measured(pairs)
    cfg = cfg or load()
    about = {"Generated": f"{datetime.now(UTC):%Y-%m-%dT%H:%M:%SZ}", "Gold labels": labels, "Pred source": source, "verifier used": cfg.verifier.backend} | {k: str(v) for k, v in asdict(cfg.verifier).items() if "threshold" in k}
    told = report.evaluation_markdown(run_id, metrics, cells, classes, LABELS, about)
    top = f"{gold}/run_id={run_id}"
    measures_json = json.dumps(metrics | {"run_id": run_id, "source": source, "confusion": cells, "by_class": classes}, indent=2)
    paths = {"metrics": store.write(f"{top}/metrics.json", measures_json), "report": store.write(f"{top}/eval_train_report.md", told)}
    for name in [n for n in store.names(top) if n.startswith("report_") and n.endswith(".md")][:1]:
        old = store.read(f"{top}/{name}")
        paths["run_report"] = store.write(f"{top}/{name}", writers.put_section(old, "## Train evaluation (auto)\n\n" + told))
    return paths
