"""Evidence labels for claims and retrieved passages, and the facts that supported claims state.

A verifier gives each (premise, hypothesis) a label and a confidence. The default compares tokens with built-in expressions; a
model can take its place through the same interface.
"""

from __future__ import annotations

import importlib.util
import re
import warnings
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyproof.config import Verifier
from storyproof.functions import lexicon, normal, scores
from storyproof.functions import text as T
from storyproof.functions.text import words_in
from storyproof.operators import statements
from storyproof.sources.store import materialize


ANSWER = "label string, confidence double, entail double, contradict double, neutral double"


class Judge(Protocol):
    """Labels of premises and hypotheses: a struct<label,confidence,entail,contradict,neutral> column."""

    name: str

    def __call__(self, premise: Column, hypothesis: Column) -> Column: ...


class LexicalJudge:
    """Support is the share of the hypothesis' tokens that the premise has; a negation on one side only turns it around."""

    name = "lexical"

    def __call__(self, premise: Column, hypothesis: Column) -> Column:
        p, h = T.token_set(premise), T.token_set(hypothesis)
        share = F.when(F.size(h) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(p, h)) / F.size(h))
        unlike = T.negated(p) != T.negated(h)
        entail, contradict = F.when(unlike, F.lit(0.0)).otherwise(share), F.when(unlike, share).otherwise(F.lit(0.0))
        neutral = 1.0 - share
        label = F.when((entail >= contradict) & (entail >= neutral), F.lit("SUPPORT")).when(contradict >= neutral, F.lit("CONTRADICT")).otherwise(F.lit("NEUTRAL"))
        return F.struct(label.alias("label"), F.greatest(entail, contradict, neutral).alias("confidence"), entail.alias("entail"), contradict.alias("contradict"), neutral.alias("neutral"))


class ModelJudge:
    """A model in Arrow batches, asked by judged(). load() runs once in each Python worker and gives f(premises, hypotheses) -> probabilities.

    Each row of the probabilities is (entail, contradict, neutral); of equal ones the first of entail, contradict, neutral counts.
    """

    def __init__(self, name: str, load: Callable[[], Callable[[list[str], list[str]], list[tuple[float, float, float]]]]):
        self.name, self.load = f"mnli:{name}", load

    def __call__(self, premise: Column, hypothesis: Column) -> Column:
        load = self.load

        @F.pandas_udf(ANSWER)
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            predict = load()
            for premises, hypotheses in batches:
                p = pd.DataFrame(predict(premises.fillna("").tolist(), hypotheses.fillna("").tolist()), columns=["entail", "contradict", "neutral"], dtype=float)
                label = p.idxmax(axis=1).map({"entail": "SUPPORT", "contradict": "CONTRADICT", "neutral": "NEUTRAL"})
                yield pd.DataFrame({"label": label, "confidence": p.max(axis=1)}).join(p)

        return run(premise, hypothesis)


def judged(rows: DataFrame, judge: Callable[[Column, Column], Column], premise: str, hypothesis: str, known: str = "") -> DataFrame:
    """rows with _j, the judge's answer to the texts of two columns.

    A model is asked once for each distinct pair, however many rows have it, in the order of length, so that the texts of a
    batch are about as long as each other. The answers meet the rows by a hash of the pair. With known, a folder, answers are
    stored there by model, and only pairs that it doesn't have are asked for; a pair that two runs ask at once has one answer.
    """
    if not isinstance(judge, ModelJudge):
        return rows.withColumn("_j", judge(F.col(premise), F.col(hypothesis)))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    pair = F.sha2(F.concat(F.length(text(premise)).cast("string"), F.lit(":"), text(premise), text(hypothesis)), 256)
    keyed = rows.withColumn("_pair", pair)
    pairs = keyed.select("_pair", text(premise).alias("premise"), text(hypothesis).alias("hypothesis")).dropDuplicates(["_pair"])
    folder = f"{known.rstrip('/')}/{re.sub('[^A-Za-z0-9._-]+', '_', judge.name)}" if known else ""
    old = answers(rows.sparkSession, folder) if folder else None
    new = pairs if old is None else pairs.join(old.select("_pair"), "_pair", "left_anti")
    size = F.length("premise") + F.length("hypothesis")
    found = new.repartitionByRange(size).sortWithinPartitions(size).select("_pair", judge(F.col("premise"), F.col("hypothesis")).alias("_j"))
    if folder:
        found.write.mode("append").parquet(folder)
        found = answers(rows.sparkSession, folder)
    else:
        found = materialize(found, "answers")
    return keyed.join(found, "_pair").drop("_pair")


def answers(spark: SparkSession, folder: str) -> DataFrame | None:
    """(_pair, _j) of the answers that judged() has stored in a folder; nothing if there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(f"_pair string, _j struct<{ANSWER}>").parquet(folder).groupBy("_pair").agg(F.min("_j").alias("_j"))


def hugging_face(model_name: str, max_length: int = 512, batch_size: int = 16, device: str = "cpu") -> ModelJudge:
    """A sequence classifier of the transformers library, which need not be installed for anything else."""

    def load() -> Callable[[list[str], list[str]], list[tuple[float, float, float]]]:
        import torch
        from transformers import AutoModelForSequenceClassification, AutoTokenizer

        tokenizer = AutoTokenizer.from_pretrained(model_name)
        model = AutoModelForSequenceClassification.from_pretrained(model_name).to(device).eval()
        names = {str(v).lower(): int(k) for k, v in model.config.id2label.items()}
        at = lambda part, default: next((i for n, i in names.items() if part in n), default)
        order = [at("entail", 2), at("contrad", 0), at("neutral", 1)]

        def predict(premises: list[str], hypotheses: list[str]) -> list[tuple[float, float, float]]:
            out: list[tuple[float, float, float]] = []
            for i in range(0, len(premises), batch_size):
                x = tokenizer(premises[i : i + batch_size], hypotheses[i : i + batch_size], truncation="only_first", max_length=max_length, padding=True, return_tensors="pt").to(device)
                with torch.inference_mode():
                    out += [tuple(r) for r in torch.softmax(model(**x).logits, -1)[:, order].tolist()]
            return out

        return predict

    return ModelJudge(model_name, load)


def judge_of(cfg: Verifier) -> Judge:
    """The judge that the settings name: lexical, or mnli:model for a model of the transformers library.

    Where that library or its torch isn't installed there is a warning, and the lexical judge takes its place.
    """
    kind, _, model = cfg.backend.partition(":")
    if kind == "lexical":
        return LexicalJudge()
    if kind != "mnli" or not model:
        raise ValueError(f"unknown verifier {cfg.backend!r}; use lexical or mnli:model")
    missing = [m for m in ("torch", "transformers") if importlib.util.find_spec(m) is None]
    if missing:
        warnings.warn(f"{', '.join(missing)} can't be imported; statements are compared by their tokens", stacklevel=2)
        return LexicalJudge()
    return hugging_face(model)


def sentence_scores(passages: DataFrame, keys: list[str], top: int) -> DataFrame:
    """The most telling sentences of each passage: keys, pos, sentence, sent_score; ties keep their order.

    passages has keys, passage, claim_text and plain aliases. A sentence has 2 for an alias, 0.6 for each anchor up to 2, and its
    length / 600 up to 0.4. A passage without sentences gives its first 400 characters.
    """
    spans = F.filter(F.transform(T.sentence_spans(F.col("passage")), lambda s: F.trim(s)), lambda s: s != "")
    found = T.let(spans, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.trim(F.substring(F.col("passage"), 1, 400)))))
    # what a passage has once is worked out below the explosion; beside it, it would be worked out for each sentence
    whole = passages.select(*keys, normal.wider(F.col("aliases")).alias("_aliases"), T.tokens(F.col("claim_text")).alias("_claim"), found.alias("_spans"))
    whole = whole.select(*keys, "_aliases", normal.anchors(F.col("_claim"), F.col("_aliases"), words_in(lexicon.NEGATIONS)).alias("_anchors"), "_spans")
    rows = whole.select(*keys, "_aliases", "_anchors", F.posexplode("_spans").alias("pos", "sentence")).withColumn("_plain", normal.plain(F.col("sentence")))
    rows = rows.withColumn("_words", F.concat(F.lit(" "), F.regexp_replace("_plain", r"(?U)\W+", " ")))
    hits = F.size(F.filter("_anchors", normal.begins(F.col("_plain"), F.col("_words"))))
    score = F.when(normal.named(F.col("_plain"), F.col("_aliases")), F.lit(2.0)).otherwise(F.lit(0.0)) + F.least(F.lit(2.0), 0.6 * hits) + F.least(F.lit(0.4), F.length("sentence") / 600.0)
    order = Window.partitionBy(*keys).orderBy(F.desc("sent_score"), "pos")
    return rows.withColumn("sent_score", score).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max(1, top)).select(*keys, "pos", "sentence", "sent_score")


def best_of_each(judged: DataFrame, keys: list[str]) -> DataFrame:
    """For keys the best confidence and sentence of each label: sup, sup_sentence and so on; the first wins a tie, none is 0 and ''."""
    out = []
    for name, label in (("sup", "SUPPORT"), ("con", "CONTRADICT"), ("neu", "NEUTRAL")):
        of = F.col("label") == label
        out += [F.coalesce(F.max(F.when(of, F.col("confidence"))), F.lit(0.0)).alias(name), F.coalesce(F.max_by("sentence", F.when(of & (F.col("confidence") > 0), F.struct("confidence", -F.col("pos")))), F.lit("")).alias(f"{name}_sentence")]
    return judged.groupBy(*keys).agg(*out)


def chosen_sentence(cfg: Verifier) -> Column:
    """The sentence of the winning label, else the next in line that isn't empty."""
    label, _ = scores.three_way(F.col("sup"), F.col("con"), F.col("neu"), cfg)
    first = lambda *c: F.coalesce(*(F.nullif(F.col(f"{x}_sentence"), F.lit("")) for x in c), F.lit(""))
    best = F.when((F.col("neu") >= F.col("sup")) & (F.col("neu") >= F.col("con")), F.col("neu_sentence")).when(F.col("sup") >= F.col("con"), F.col("sup_sentence")).otherwise(F.col("con_sentence"))
    return F.when(label == "SUPPORT", first("sup", "neu", "con")).when(label == "CONTRADICT", first("con", "neu", "sup")).otherwise(F.coalesce(F.nullif(best, F.lit("")), first("sup", "con", "neu")))


def evidence(candidates: DataFrame, claims: DataFrame, chunks: DataFrame, judge: Judge | None = None, cfg: Verifier | None = None, run_id: str = "") -> DataFrame:
    """The evidence table with passage, claim columns and predicate_form kept for facts().

    candidates (id, claim_id, book_name, chunk_id, score_lex_norm) meet their claims, of several of one claim_id the
    row that was made last, and the text of their chunks, empty where it is missing.
    """
    cfg, judge = cfg or Verifier(), judge or LexicalJudge()
    told = claims.groupBy("claim_id").agg(F.max_by(F.struct("claim_text", "char", "char_aliases", "predicate_form"), statements.order(claims)).alias("_last")).select("claim_id", "_last.*")
    texts = chunks.select("chunk_id", F.col("chunk_text").alias("passage")).dropDuplicates(["chunk_id"])
    work = candidates.select("id", "claim_id", "book_name", "chunk_id", "score_lex_norm").join(told, "claim_id").join(texts, "chunk_id", "left")
    work = work.withColumn("passage", F.coalesce("passage", F.lit("")))
    work = work.withColumn("_joined", F.array_join(F.concat(F.array(F.coalesce("char", F.lit(""))), "char_aliases"), " ¶ ")).withColumn("aliases", F.filter(F.split(normal.plain(F.col("_joined")), " ¶ "), lambda a: F.trim(a) != "")).drop("_joined")
    keys = ["id", "claim_id", "chunk_id"]
    if cfg.sentence_level:
        told_of = sentence_scores(work, keys, cfg.top_sentences).join(told.select("claim_id", "claim_text"), "claim_id")
        told_of = judged(told_of, judge, "sentence", "claim_text", cfg.known).select(*keys, "pos", "sentence", "_j.label", "_j.confidence")
        label, confidence = scores.three_way(F.col("sup"), F.col("con"), F.col("neu"), cfg)
        found = best_of_each(told_of, keys).select(*keys, label.alias("_label"), confidence.alias("_confidence"), chosen_sentence(cfg).alias("evidence_text"))
        out = work.join(found, keys)
    else:
        out = judged(work, judge, "passage", "claim_text", cfg.known).withColumns({"_label": F.col("_j.label"), "_confidence": F.col("_j.confidence"), "evidence_text": F.lit("")}).drop("_j")
    out = out.withColumn("_confidence", scores.mixed(F.col("_confidence"), F.col("score_lex_norm"), cfg.score_mix_alpha))
    for on, which in ((cfg.enable_alias_gate, "SUPPORT"), (cfg.enable_contra_alias_gate, "CONTRADICT")):
        if on:
            open_ = (F.size("aliases") == 0) | normal.named(F.col("_passage"), normal.wider(F.col("aliases")))
            label, confidence = scores.gated(F.col("_label"), F.col("_confidence"), open_, which)
            out = out.withColumn("_passage", normal.plain(F.col("passage"))).withColumn("_gated", F.struct(label.alias("label"), confidence.alias("confidence")))
            out = out.withColumns({"_label": F.col("_gated.label"), "_confidence": F.col("_gated.confidence")}).drop("_gated", "_passage")
    return out.select("id", "claim_id", "book_name", "chunk_id", "evidence_text", F.col("_label").alias("label"), F.col("_confidence").alias("confidence"), F.lit(judge.name).alias("verifier_model"), F.lit(run_id).alias("run_id"), "passage", "char", "claim_text", "predicate_form")


def facts(found: DataFrame, cfg: Verifier | None = None, whole_object: bool = True) -> DataFrame:
    """The fact table of supported rows of evidence(): one for each predicate with an object, else, if asked, a plain statement.

    Died has the object true; Age and BornYear need a number. whole_object keeps commas inside an object.
    """
    cfg = cfg or Verifier()
    supported = found.where("label = 'SUPPORT'")
    keys = ["id", "claim_id", "book_name", "chunk_id"]
    at = F.instr("passage", F.col("evidence_text"))
    placed = (F.col("evidence_text") != "") & (at > 0)
    head = F.trim(F.substring(F.col("passage"), 1, 400))
    parts = supported.withColumn("_p", F.explode("predicate_form")).withColumns({"p": T.predicate_name(F.col("_p")), "_args": T.predicate_args(F.col("_p"), whole_object)})
    number = F.col("p").isin("Age", "BornYear")
    o = F.when(F.col("p") == "Died", F.lit("true")).when(number, F.trim(F.get("_args", F.lit(1))).try_cast("bigint").cast("string")).otherwise(F.get("_args", F.lit(1)))
    kind = F.when(F.col("p") == "Died", F.lit("bool")).when(number, F.lit("int")).otherwise(F.lit("string"))
    made = parts.select(
        *keys, F.col("char").alias("s"), "p", o.alias("o"), kind.alias("o_type"), F.lit("POS").alias("polarity"), scores.fact_confidence(F.col("confidence")).alias("fact_confidence"),
        F.coalesce(F.nullif(F.col("evidence_text"), F.lit("")), head).alias("excerpt"), F.when(placed, at - 1).otherwise(F.lit(0)).alias("span_start"),
        F.when(placed, at - 1 + F.length("evidence_text")).otherwise(F.least(F.lit(400), F.length("passage"))).alias("span_end"), "label", "confidence", "run_id",
    ).where(F.col("p").isNotNull() & F.col("o").isNotNull() & (F.col("fact_confidence") >= cfg.min_fact_conf))
    if not cfg.emit_supports_claim_fallback:
        return made
    rest = supported.join(made.select(*keys).distinct(), keys, "left_anti").select(
        *keys, F.col("char").alias("s"), F.lit("SupportsClaim").alias("p"), F.coalesce(F.nullif(F.col("claim_text"), F.lit("")), "claim_id").alias("o"), F.lit("string").alias("o_type"), F.lit("POS").alias("polarity"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.55), "confidence")).alias("fact_confidence"), head.alias("excerpt"), F.lit(0).alias("span_start"), F.least(F.lit(400), F.length("passage")).alias("span_end"), "label", "confidence", "run_id",
    )
    return made.unionByName(rest)
