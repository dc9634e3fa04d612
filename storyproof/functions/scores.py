"""Confidences, decisions and their reasons as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyproof.config import Decision, Verifier


def unit(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def mixed(model: Column, retrieval: Column, alpha: float) -> Column:
    """A model's confidence with a share of the normalised retrieval score; null counts as 0."""
    a = min(1.0, max(0.0, alpha))
    return unit((1.0 - a) * F.coalesce(model, F.lit(0.0)) + a * F.coalesce(retrieval, F.lit(0.0)))


def fact_confidence(evidence: Column, base: float = 0.86) -> Column:
    return unit(F.lit(0.65 * base) + 0.35 * evidence)


def three_way(support: Column, contradict: Column, neutral: Column, cfg: Verifier) -> tuple[Column, Column]:
    """Label and confidence from the best confidence of each class."""
    for_it = (support >= cfg.entail_threshold) & (support >= contradict + cfg.nli_margin)
    against = (contradict >= cfg.contra_threshold) & (contradict >= support + cfg.nli_margin)
    label = F.when(for_it, F.lit("SUPPORT")).when(against, F.lit("CONTRADICT")).otherwise(F.lit("NEUTRAL"))
    return label, F.when(for_it, support).when(against, contradict).otherwise(F.greatest(neutral, support, contradict))


def gated(label: Column, confidence: Column, gate: Column, which: str, cap: float = 0.65) -> tuple[Column, Column]:
    """A label of one kind becomes NEUTRAL, its confidence capped, where the gate is false."""
    closed = (label == which) & ~gate
    return F.when(closed, F.lit("NEUTRAL")).otherwise(label), F.when(closed, F.least(confidence, F.lit(cap))).otherwise(confidence)


def evidence_score(cfg: Decision) -> Column:
    return F.col("support_weight") + cfg.neutral_alpha * F.col("neutral_weight") - cfg.contradiction_penalty * F.col("contradict_weight")


def verdict(score: Column, threshold: Column) -> Column:
    """0 for a hard violation or without support or neutral evidence, else whether the score reaches the threshold."""
    return F.when((F.col("hard_violations") == 1) | (F.col("support_n") + F.col("neutral_n") == 0), F.lit(0)).otherwise((score >= threshold).cast("int"))


def reason(cfg: Decision) -> Column:
    s, c, n = F.col("support_n"), F.col("contradict_n"), F.col("neutral_n")
    return (
        F.when(F.col("status") == "UNSAT", F.lit("Hard contradiction detected by Step-6 (UNSAT)."))
        .when((s + n == 0) & (c == 0), F.lit("No evidence retrieved for this id."))
        .when(s + n == 0, F.lit("Only contradicting evidence found; predicting 0."))
        .when((c > 0) & (s == 0), F.lit("Neutral/contradict mix; score penalizes contradictions."))
        .when(c > 0, F.lit("Mixed evidence (support/neutral with contradictions); prediction uses score/threshold."))
        .when(s == 0, F.concat(F.lit("Only neutral evidence; treated as weak support (alpha="), F.format_string("%.2f", F.lit(float(cfg.neutral_alpha))), F.lit(").")))
        .otherwise(F.lit("Supporting evidence present; no hard contradictions detected."))
    )
