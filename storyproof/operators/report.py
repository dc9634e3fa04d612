"""Readable reports: the key claims of an id and the evidence behind them, as Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyproof.functions import text as T
from storyproof.operators import statements


def claim_sums(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, claim_id, support_sum, contradict_sum, neutral_sum) of every claim, zeros without evidence."""
    out = [F.coalesce(F.sum(F.when(F.col("label") == x.upper(), F.col("confidence"))), F.lit(0.0)).alias(f"{x}_sum") for x in ("support", "contradict", "neutral")]
    return claims.select("id", "claim_id").distinct().join(evidence.select("id", "claim_id", "label", "confidence"), ["id", "claim_id"], "left").groupBy("id", "claim_id").agg(*out)


def key_claims(sums: DataFrame, most: int = 4) -> DataFrame:
    """The first claims of each id: by contradiction, then support if any of the id's claims is contradicted, else by support, then neutral."""
    contested = F.max("contradict_sum").over(Window.partitionBy("id")) > 0
    rows = sums.withColumn("_c", contested)
    a, b = F.when(F.col("_c"), F.col("contradict_sum")).otherwise(F.col("support_sum")), F.when(F.col("_c"), F.col("support_sum")).otherwise(F.col("neutral_sum"))
    order = Window.partitionBy("id").orderBy(F.desc(a), F.desc(b), "claim_id")
    return rows.withColumn("claim_rank", F.row_number().over(order)).where(F.col("claim_rank") <= most).drop("_c")


def top_evidence(evidence: DataFrame, most: int = 3) -> DataFrame:
    """The first rows of each claim: contradictions, support, neutral by confidence if any contradicts, else by confidence."""
    of = Window.partitionBy("id", "claim_id")
    rows = evidence.withColumn("_c", F.max((F.col("label") == "CONTRADICT").cast("int")).over(of))
    kind = F.when(F.col("_c") == 0, F.lit(0)).when(F.col("label") == "CONTRADICT", F.lit(0)).when(F.col("label") == "SUPPORT", F.lit(1)).when(F.col("label") == "NEUTRAL", F.lit(2)).otherwise(F.lit(9))
    order = of.orderBy(kind, F.desc("confidence"), "chunk_id")
    return rows.withColumn("evidence_rank", F.row_number().over(order)).where(F.col("evidence_rank") <= most).drop("_c")


HEAD = "| label | conf | rank | score_lex_norm | chunk_id | chapter | bucket | excerpt |\n|---|---:|---:|---:|---|---|---|---|"


def dossiers(decisions: DataFrame, claims: DataFrame, evidence: DataFrame, candidates: DataFrame, chunks: DataFrame, key_claims_per_id: int = 4, rows_per_claim: int = 3) -> DataFrame:
    """(id, prediction, split, markdown) of each decided id that has claims."""
    meta = chunks.dropDuplicates(["chunk_id"]).select("chunk_id", "chapter_id", "time_bucket", "chunk_text")
    told = claims.groupBy("id", "claim_id").agg(*(F.min_by(c, statements.order(claims)).alias(c) for c in ("claim_text", "claim_type", "t_hint", "keywords", "char")))
    best = top_evidence(evidence.select("id", "claim_id", "chunk_id", "label", "confidence"), rows_per_claim)
    rows = best.join(candidates.select("id", "claim_id", "chunk_id", "rank", "score_lex_norm"), ["id", "claim_id", "chunk_id"], "left").join(meta, "chunk_id", "left").join(told.select("id", "claim_id", "char", "keywords"), ["id", "claim_id"])
    part = T.cell(T.excerpt(F.col("chunk_text"), F.concat(F.array("char"), F.slice("keywords", 1, 6))))
    empty = lambda c: F.coalesce(c, F.lit(""))
    line = F.concat(
        F.lit("| "), "label", F.lit(" | "), F.format_string("%.3f", F.col("confidence")), F.lit(" | "), empty(F.col("rank").cast("string")), F.lit(" | "), F.when(F.col("score_lex_norm").isNull(), F.lit("")).otherwise(F.format_string("%.3f", F.col("score_lex_norm"))),
        F.lit(" | `"), "chunk_id", F.lit("` | "), empty(F.col("chapter_id")), F.lit(" | "), empty(F.col("time_bucket")), F.lit(" | "), part, F.lit(" |"),
    )
    tables = rows.withColumn("_line", line).groupBy("id", "claim_id").agg(F.array_sort(F.collect_list(F.struct("evidence_rank", "_line"))).alias("_lines"))
    table = F.when(F.col("_lines").isNull(), F.lit("_No evidence found for this claim._\n---\n")).otherwise(F.concat(F.lit(HEAD + "\n"), F.array_join(F.transform("_lines", lambda x: x["_line"]), "\n"), F.lit("\n\n---\n")))
    keyed = key_claims(claim_sums(claims, evidence), key_claims_per_id).join(told, ["id", "claim_id"]).join(tables, ["id", "claim_id"], "left")
    section = F.concat(F.lit("### "), "claim_id", F.lit("  \n**type:** "), "claim_type", F.lit(" | **t_hint:** "), "t_hint", F.lit("\n\n**claim:** "), "claim_text", F.lit("\n\n"), table)
    sections = keyed.withColumn("_section", section).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_rank", "_section"))), lambda x: x["_section"]), "\n").alias("_sections"))
    first = claims.groupBy("id").agg(*(F.min_by(c, statements.order(claims)).alias(c) for c in ("book_name", "char", "caption")))
    bold = lambda name, value, end: F.concat(F.lit(f"**{name}:** "), value, F.lit(end))
    caption = F.when(empty(F.col("caption")) != "", bold("caption", F.col("caption"), "  \n")).otherwise(F.lit(""))
    why = F.when(empty(F.col("rationale")) != "", bold("rationale", F.col("rationale"), "\n")).otherwise(F.lit(""))
    top = F.concat(F.lit("# Evidence Dossier — id "), F.col("id").cast("string"), F.lit("\n\n"), bold("book_name", empty(F.col("book_name")), "  \n"), bold("target char", empty(F.col("char")), "  \n"), caption, bold("split", "split", "  \n"), bold("prediction", F.col("prediction").cast("string"), "  \n"), bold("logic_status", "status", "  \n"), why, F.lit("\n---\n\n## Key claims & linked evidence\n\n"))
    return decisions.join(first, "id").join(sections, "id").select("id", "prediction", "split", F.concat(top, "_sections").alias("markdown"))


def confusion_markdown(cells: list[tuple[str, str, int]], labels: tuple[str, ...]) -> str:
    """A Markdown table of collected cells (true, predicted, n)."""
    n = {(t, p): c for t, p, c in cells}
    rows = [f"| {t} | " + " | ".join(str(n.get((t, p), 0)) for p in labels) + " |" for t in labels]
    return "\n".join(["| true\\pred | " + " | ".join(labels) + " |", "|---|" + "|".join("---" for _ in labels) + "|", *rows]) + "\n"


def evaluation_markdown(run_id: str, metrics: dict, cells: list[tuple[str, str, int]], classes: list[dict], labels: tuple[str, ...], about: dict[str, str]) -> str:
    """The report of an evaluation from a handful of collected rows."""
    out = [f"# Train Evaluation{f' — {run_id}' if run_id else ''}\n", *(f"- {k}: **{v}**" for k, v in about.items()), f"- n_eval: **{metrics['n_eval']}**\n", "## Metrics (train)"]
    out += [f"- {k.replace('_', ' ')}: **{metrics[k]:.4f}**" for k in ("accuracy", "macro_precision", "macro_recall", "macro_f1")]
    out += ["\n## Confusion matrix (train)", confusion_markdown(cells, labels), "## Per-class (train)", "| class | precision | recall | f1 | support |", "|---|---:|---:|---:|---:|"]
    out += [f"| {c['label']} | {c['precision']:.4f} | {c['recall']:.4f} | {c['f1']:.4f} | {int(c['support'])} |" for c in classes]
    return "\n".join(out) + "\n"
