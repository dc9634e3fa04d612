"""Events as evidence: users are ids, event types labels, values confidences; labels of documents are labels of users."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyproof.config import Decision, Verifier
from storyproof.functions import scores
from storyproof.functions.text import model_label, normal_label, truth
from storyproof.operators import decide, measures, report, verify
from storyproof.plans.registry import query, table

CFG = Decision()
RECALL = dataclasses.replace(CFG, mode="high_recall")
VERIFIER = Verifier()

EVIDENCE = """evidence AS (SELECT user_id AS id, event_id, CAST(user_id AS VARCHAR) || '_c' || CAST(event_id % 5 AS VARCHAR) AS claim_id, event_id AS chunk_id,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'SUPPORT' WHEN event_type = 'error' THEN 'CONTRADICT' ELSE 'NEUTRAL' END AS label,
  least(1.0::DOUBLE, value / 500.0::DOUBLE) AS confidence FROM events)"""
FEATURES = (
    EVIDENCE
    + """,
sums AS (SELECT id, round(coalesce(sum(confidence) FILTER (label = 'SUPPORT'), 0), 6) AS support_weight, count(*) FILTER (label = 'SUPPORT') AS support_n,
  round(coalesce(sum(confidence) FILTER (label = 'NEUTRAL'), 0), 6) AS neutral_weight, count(*) FILTER (label = 'NEUTRAL') AS neutral_n,
  round(coalesce(sum(confidence) FILTER (label = 'CONTRADICT'), 0), 6) AS contradict_weight, count(*) FILTER (label = 'CONTRADICT') AS contradict_n FROM evidence GROUP BY id),
states AS (SELECT o_custkey AS id, CASE WHEN max(o_totalprice) > 499000 THEN 'UNSAT' WHEN max(o_totalprice) > 450000 THEN 'SOFT_VIOLATIONS' ELSE 'SAT' END AS status,
  round(max(o_totalprice) / 599999.0::DOUBLE, 9) AS logic_conf FROM orders GROUP BY o_custkey),
ids AS (SELECT id FROM sums UNION SELECT c_custkey FROM customer),
feats AS (SELECT i.id, coalesce(support_weight, 0) AS support_weight, coalesce(support_n, 0) AS support_n, coalesce(neutral_weight, 0) AS neutral_weight, coalesce(neutral_n, 0) AS neutral_n,
  coalesce(contradict_weight, 0) AS contradict_weight, coalesce(contradict_n, 0) AS contradict_n, coalesce(status, 'SAT') AS status, coalesce(logic_conf, 0) AS logic_conf,
  CAST(coalesce(status, 'SAT') = 'UNSAT' AS INT) AS hard_violations, CAST(coalesce(status, 'SAT') = 'SOFT_VIOLATIONS' AS INT) AS soft_violations, l.quality AS y,
  CASE WHEN l.quality IS NULL THEN 'test' ELSE 'train' END AS split,
  round(coalesce(support_weight, 0) + 0.15 * coalesce(neutral_weight, 0) - 2.0 * coalesce(contradict_weight, 0), 6) AS evidence_score
  FROM ids i LEFT JOIN sums s ON s.id = i.id LEFT JOIN states t ON t.id = i.id LEFT JOIN labels l ON l.doc_id = i.id)"""
)
GRID = ", ".join(f"{q:g}" for q in decide.QUANTILES)
TRIED = (
    FEATURES
    + f""",
train AS (SELECT evidence_score, y FROM feats WHERE split = 'train'),
cands AS (SELECT DISTINCT round(unnest(quantile_cont(evidence_score, [{GRID}])), 9) AS t FROM train),
tried AS (SELECT t, count(*) AS n, count(*) FILTER (evidence_score >= t AND y = 1) AS tp, count(*) FILTER (evidence_score >= t AND y = 0) AS fp,
  count(*) FILTER (evidence_score < t AND y = 1) AS fn, count(*) FILTER (evidence_score < t AND y = 0) AS tn FROM train CROSS JOIN cands GROUP BY t)"""
)
BALANCED = "(SELECT round(t, 9) AS threshold FROM tried ORDER BY (tp + tn) / n DESC, t DESC LIMIT 1)"


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    label = F.when(kind.isin("purchase", "signup"), F.lit("SUPPORT")).when(kind == "error", F.lit("CONTRADICT")).otherwise(F.lit("NEUTRAL"))
    claim = F.concat(F.col("user_id").cast("string"), F.lit("_c"), (F.col("event_id") % 5).cast("string"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id", claim.alias("claim_id"), F.col("event_id").alias("chunk_id"), label.alias("label"), F.least(F.lit(1.0), F.col("value") / 500.0).alias("confidence"))


def constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.max("o_totalprice")
    status = F.when(top > 499000, F.lit("UNSAT")).when(top > 450000, F.lit("SOFT_VIOLATIONS")).otherwise(F.lit("SAT"))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(status.alias("status"), F.round(top / 599999.0, 9).alias("confidence"))


def feats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of all users with events and of all customers, rounded so that the order of addends doesn't matter."""
    found = evidence(spark, sf_dir)
    ids = found.select("id").union(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))).distinct()
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"))
    made = decide.features(ids, found, constraints(spark, sf_dir), labels, CFG)
    made = made.withColumns({c: F.round(c, 6) for c in ("support_weight", "neutral_weight", "contradict_weight")})
    return made.withColumn("evidence_score", F.round(scores.evidence_score(CFG), 6))


@query(f"WITH {EVIDENCE} SELECT id, label, round(sum(confidence), 6) AS weight, count(*) AS n FROM evidence GROUP BY ALL")
def evidence_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir).groupBy("id", "label").agg(F.round(F.sum("confidence"), 6).alias("weight"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {FEATURES} SELECT * FROM sums")
def evidence_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = decide.pivoted(evidence(spark, sf_dir))
    return made.withColumns({c: F.round(F.coalesce(c, F.lit(0.0)), 6) for c in ("support_weight", "neutral_weight", "contradict_weight")})


@query(f"WITH {FEATURES} SELECT * FROM feats")
def decision_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feats(spark, sf_dir)


@query(f"WITH {TRIED} SELECT * FROM tried")
def threshold_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.trials(feats(spark, sf_dir).where("split = 'train'")).withColumn("t", F.round("t", 9))


@query(f"WITH {TRIED} SELECT * FROM {BALANCED}")
def threshold_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.calibrated(feats(spark, sf_dir).where("split = 'train'"), CFG).select(F.round("threshold", 9).alias("threshold"))


@query(f"""WITH {TRIED}, measured AS (SELECT t, tp / greatest(1, tp + fn) AS r, tp / greatest(1, tp + fp) AS p FROM tried)
SELECT round(t, 9) AS threshold FROM measured ORDER BY p >= 0.55 DESC, r DESC, CASE WHEN p >= 0.55 THEN p ELSE 0 END DESC, t DESC LIMIT 1""")
def threshold_high_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.calibrated(feats(spark, sf_dir).where("split = 'train'"), RECALL).select(F.round("threshold", 9).alias("threshold"))


RATIONALE = """CASE WHEN status = 'UNSAT' THEN 'Hard contradiction detected by Step-6 (UNSAT).' WHEN support_n + neutral_n + contradict_n = 0 THEN 'No evidence retrieved for this id.'
  WHEN support_n + neutral_n = 0 THEN 'Only contradicting evidence found; predicting 0.' WHEN contradict_n > 0 AND support_n = 0 THEN 'Neutral/contradict mix; score penalizes contradictions.'
  WHEN contradict_n > 0 THEN 'Mixed evidence (support/neutral with contradictions); prediction uses score/threshold.'
  WHEN support_n = 0 THEN 'Only neutral evidence; treated as weak support (alpha=0.15).' ELSE 'Supporting evidence present; no hard contradictions detected.' END"""
DECIDED = f"""WITH {TRIED}, decided AS (SELECT *, CASE WHEN hard_violations = 1 OR support_n + neutral_n = 0 THEN 0 ELSE CAST(evidence_score >= (SELECT threshold FROM {BALANCED}) - 1e-9 AS INT) END AS prediction FROM feats)"""


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = feats(spark, sf_dir)
    return decide.decisions(made, decide.calibrated(made.where("split = 'train'"), CFG), CFG)


@query(f"""{DECIDED} SELECT id, split, prediction, evidence_score, support_weight, contradict_weight, neutral_weight, support_n, contradict_n, neutral_n, status, hard_violations, soft_violations, logic_conf,
  {RATIONALE} AS rationale FROM decided""")
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir)


@query(f"{DECIDED} SELECT id, prediction FROM decided d WHERE EXISTS (FROM labels l WHERE l.doc_id = d.id) ORDER BY id")
def results_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi").select("id", "prediction").orderBy("id")


@query(f"{DECIDED} SELECT id, prediction FROM decided d WHERE NOT EXISTS (FROM labels l WHERE l.doc_id = d.id) ORDER BY id")
def results_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), "id", "left_anti").select("id", "prediction").orderBy("id")


BEST = f"""WITH {EVIDENCE}, best AS (SELECT id, claim_id, {", ".join(f"coalesce(max(confidence) FILTER (label = '{x}'), 0) AS {n}, coalesce(max_by('s' || event_id, (confidence, -event_id)) FILTER (label = '{x}' AND confidence > 0), '') AS {n}_sentence" for n, x in (("sup", "SUPPORT"), ("con", "CONTRADICT"), ("neu", "NEUTRAL")))}
  FROM evidence GROUP BY ALL)"""


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = evidence(spark, sf_dir).select("id", "claim_id", "label", "confidence", F.col("event_id").alias("pos"), F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("sentence"))
    return verify.best_of_each(judged, ["id", "claim_id"])


ROUNDED = ", ".join(f"round({n}, 6) AS {n}, {n}_sentence" for n in ("sup", "con", "neu"))


@query(f"{BEST} SELECT id, claim_id, {ROUNDED} FROM best")
def best_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("sup", "con", "neu")})


@query(f"""{BEST}, told AS (SELECT *, CASE WHEN sup >= 0.52 AND sup >= con + 0.04 THEN 'SUPPORT' WHEN con >= 0.78 AND con >= sup + 0.04 THEN 'CONTRADICT' ELSE 'NEUTRAL' END AS label FROM best),
mixed AS (SELECT *, least(1, greatest(0, 0.85 * CASE label WHEN 'SUPPORT' THEN sup WHEN 'CONTRADICT' THEN con ELSE greatest(neu, sup, con) END + 0.15 * neu)) AS conf, id % 3 <> 0 AS named FROM told)
SELECT id, claim_id, CASE WHEN label = 'CONTRADICT' AND NOT named THEN 'NEUTRAL' ELSE label END AS label, round(CASE WHEN label = 'CONTRADICT' AND NOT named THEN least(conf, 0.65) ELSE conf END, 6) AS confidence,
  CASE label WHEN 'SUPPORT' THEN coalesce(nullif(sup_sentence, ''), nullif(neu_sentence, ''), con_sentence) WHEN 'CONTRADICT' THEN coalesce(nullif(con_sentence, ''), nullif(neu_sentence, ''), sup_sentence)
  ELSE coalesce(nullif(CASE WHEN neu >= sup AND neu >= con THEN neu_sentence WHEN sup >= con THEN sup_sentence ELSE con_sentence END, ''), nullif(sup_sentence, ''), nullif(con_sentence, ''), neu_sentence) END AS sentence,
  CASE WHEN label = 'SUPPORT' THEN round(least(1, greatest(0, 0.559 + 0.35 * conf)), 6) END AS fact_confidence FROM mixed""")
def three_way_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with margins, mixed confidences, the gate on contradictions, the chosen sentence and the confidence of a fact."""
    made = best(spark, sf_dir)
    label, confidence = scores.three_way(F.col("sup"), F.col("con"), F.col("neu"), VERIFIER)
    mixed = scores.mixed(confidence, F.col("neu"), VERIFIER.score_mix_alpha)
    gated, capped = scores.gated(label, mixed, F.col("id") % 3 != 0, "CONTRADICT")
    fact = F.when(label == "SUPPORT", F.round(scores.fact_confidence(mixed), 6))
    return made.select("id", "claim_id", gated.alias("label"), F.round(capped, 6).alias("confidence"), verify.chosen_sentence(VERIFIER).alias("sentence"), fact.alias("fact_confidence"))


@query(f"""WITH {EVIDENCE} SELECT claim_id, arg_min(label, (-confidence, chunk_id)) AS pred_label FROM evidence GROUP BY claim_id""")
def strongest_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.strongest(evidence(spark, sf_dir))


@query(f"""WITH {EVIDENCE}, counted AS (SELECT claim_id, label, count(*) AS n, max(confidence) AS c FROM evidence GROUP BY ALL)
SELECT claim_id, label AS pred_label FROM counted QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY n DESC, c DESC, label) = 1""")
def voted_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.voted(evidence(spark, sf_dir))


SUMS = f"""WITH {EVIDENCE}, claim_sums AS (SELECT id, claim_id, round(coalesce(sum(confidence) FILTER (label = 'SUPPORT'), 0), 6) AS support_sum, round(coalesce(sum(confidence) FILTER (label = 'CONTRADICT'), 0), 6) AS contradict_sum,
  round(coalesce(sum(confidence) FILTER (label = 'NEUTRAL'), 0), 6) AS neutral_sum FROM evidence GROUP BY ALL)"""


def sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence(spark, sf_dir)
    return report.claim_sums(found, found).withColumns({c: F.round(c, 6) for c in ("support_sum", "contradict_sum", "neutral_sum")})


@query(f"""{SUMS}, told AS (SELECT *, max(contradict_sum) OVER (PARTITION BY id) > 0 AS contested FROM claim_sums)
SELECT id, claim_id, support_sum, contradict_sum, neutral_sum, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN contested THEN contradict_sum ELSE support_sum END DESC, CASE WHEN contested THEN support_sum ELSE neutral_sum END DESC, claim_id) AS claim_rank
FROM told QUALIFY claim_rank <= 4""")
def key_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.key_claims(sums(spark, sf_dir), 4).withColumn("claim_rank", F.col("claim_rank").cast("long"))


@query(f"""WITH {EVIDENCE}, told AS (SELECT *, bool_or(label = 'CONTRADICT') OVER (PARTITION BY id, claim_id) AS contested FROM evidence)
SELECT id, claim_id, chunk_id, label, round(confidence, 6) AS confidence, row_number() OVER (PARTITION BY id, claim_id ORDER BY CASE WHEN NOT contested THEN 0 WHEN label = 'CONTRADICT' THEN 0 WHEN label = 'SUPPORT' THEN 1 ELSE 2 END, confidence DESC, chunk_id) AS evidence_rank
FROM told QUALIFY evidence_rank <= 3""")
def top_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top_evidence(evidence(spark, sf_dir), 3).select("id", "claim_id", "chunk_id", "label", F.round("confidence", 6).alias("confidence"), F.col("evidence_rank").cast("long").alias("evidence_rank"))


@query("""SELECT event_id, CASE WHEN contains(lower(event_type), 'entail') THEN 'SUPPORT' WHEN contains(lower(event_type), 'contrad') THEN 'CONTRADICT' ELSE 'NEUTRAL' END AS by_model,
  upper(trim(event_type)) AS normal, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS y, CASE event_id % 4 WHEN 0 THEN 'CONTRADICT' WHEN 1 THEN 'NEUTRAL' WHEN 2 THEN 'SUPPORT' END AS coded FROM events""")
def label_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(F.lit("Consistent "), F.lit("contradict"), F.lit("?")), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", model_label(F.col("event_type")).alias("by_model"), normal_label(F.col("event_type")).alias("normal"), truth(said).alias("y"), measures.code_labels(F.col("event_id") % 4, "0=C,1=N,2=SUPPORT").alias("coded"))
