"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of three hashed embeddings: of the whole word, of its first bytes and of its last ones, so
inflected forms share what they have in common. Filters of several widths run over the words of a text, the maximum of each
over all places is kept, and a logistic unit reads those maxima. After training, embeddings and filters are multiplied out
into one table a hashed feature, so scoring is gathers and additions on whole arrays: a map over rows without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from storyproof.llm.common import Words, arrow_map, bounded, documents, freed, payloads, slices

WIDTHS, FILTERS, SIZE = (1, 2, 3), 8, 12
BUCKETS = (1 << 15, 1 << 13, 1 << 13)  # of whole words, beginnings, endings
BEGINNING, ENDING = 4, 4
SLICE = 400_000
#: The bounds of the training sample: labelled rows of each class, those with the smallest hash of their doc_id, and the bytes of their whole texts.
ROWS_PER_CLASS, BYTES_PER_CLASS = 3000, 24 << 20
#: Of crc32(doc_id) modulo 5, the remainders of rows that are held out from everything, and of those that thresholds are chosen on.
HELD_OUT, CALIBRATION = 0, 1
#: A language has a threshold of its own if so many calibration rows of either label are in it, else 0.5.
LEAST = 25
#: Calibration labels are sent to where texts are read while there are so many; more meet the scores of all texts.
LABELS = 1_000_000
#: Bins of scores that thresholds are chosen between; of all labelled rows, only counts by bin reach the driver.
BINS = 1000


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each word of some texts its three buckets, numbered through, and where each text begins among the words."""
    w = Words(texts, BEGINNING, ENDING)
    base, out = 0, np.empty((len(w.hash), 3), dtype=np.int32)
    for i, (h, n) in enumerate(zip((w.hash, w.prefix, w.suffix), BUCKETS, strict=True)):
        out[:, i] = (h % np.uint64(n)).astype(np.int32) + base
        base += n
    return out, w.first


@dataclass
class Model:
    table: np.ndarray  # buckets x all taps of all filters
    bias: np.ndarray  # a filter
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def pooled(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The maximum of each filter over the places of each text, at least 0."""
        n = len(first) - 1
        text = np.repeat(np.arange(n), np.diff(first))
        taps = self.table[words[:, 0]] + self.table[words[:, 1]] + self.table[words[:, 2]]
        pooled, at = np.zeros((n, FILTERS * len(WIDTHS)), dtype=np.float32), 0
        for k, width in enumerate(WIDTHS):
            m = len(text) - width + 1
            if m > 0:
                made = sum(taps[i : i + m, at + i * FILTERS : at + (i + 1) * FILTERS] for i in range(width))
                if width > 1:
                    inside = text[:m] == text[width - 1 :]
                    made, of = made[inside], text[:m][inside]
                else:
                    of = text
                if len(of):
                    begin = np.flatnonzero(np.diff(of, prepend=-1))
                    best = np.maximum.reduceat(made, begin) + self.bias[k * FILTERS : (k + 1) * FILTERS]
                    pooled[of[begin], k * FILTERS : (k + 1) * FILTERS] = np.maximum(best, 0)
            at += width * FILTERS
        return pooled

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = []
        for lo, hi in slices(map(len, texts), SLICE):
            z = self.pooled(*features(texts[lo:hi])).astype(np.float64) @ self.out + self.out_bias
            out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)


def _start(words: list[np.ndarray], y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Embeddings before training: small random ones, and in the first place the log odds of a bucket's texts, nearer to 0 the fewer they are."""
    total = sum(BUCKETS)
    counts = np.zeros((2, total))
    for w, label in zip(words, y, strict=True):
        counts[int(label), np.unique(w)] += 1
    n = np.array([max(1, (y == 0).sum()), max(1, (y == 1).sum())])
    odds = np.log((counts[1] + 0.5) / (n[1] + 1)) - np.log((counts[0] + 0.5) / (n[0] + 1))
    out = rng.normal(0, 0.05, (total, SIZE)).astype(np.float32)
    seen = counts.sum(0)
    out[:, 0] = np.where(seen > 0, np.clip(odds * seen / (seen + 3), -3, 3), -0.5) / 3
    return out


def fit(texts: list[bytes], labels: list[int], prior: float, epochs: int = 6, batch: int = 48, rate: float = 0.01, seed: int = 7) -> Model:
    """Trains on some texts with Adam; the last unit is then shifted from the sample's share of label 1 to the prior.

    One class only, or no text, gives the constant model of the prior.
    """
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    rng, y = np.random.default_rng(seed), np.array(labels, dtype=np.float32)
    pools, taps = FILTERS * len(WIDTHS), FILTERS * sum(WIDTHS)
    if not texts or y.min() == y.max():
        return Model(np.zeros((sum(BUCKETS), taps), np.float32), np.zeros(pools, np.float32), np.zeros(pools), float(np.log(prior / (1 - prior))))
    words = []
    for lo, hi in slices(map(len, texts), SLICE):
        all_words, first = features(texts[lo:hi])
        words += [all_words[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    E = _start(words, y, rng)
    W = rng.normal(0, 0.3, (SIZE, taps)).astype(np.float32)
    W[0] = np.abs(W[0]) + 0.3
    b, v, c = np.zeros(pools, np.float32), np.full(pools, 0.3, np.float32), np.zeros(1, np.float32)
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (E, W, b, v, c)]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    starts = np.cumsum([0, *(FILTERS * w for w in WIDTHS)])
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), batch):
            some = order[lo : lo + batch]
            x = np.concatenate([words[i] for i in some])
            first = np.concatenate([[0], np.cumsum([len(words[i]) for i in some])])
            text = np.repeat(np.arange(len(some)), np.diff(first))
            emb = E[x[:, 0]] + E[x[:, 1]] + E[x[:, 2]]
            made_taps = emb @ W
            pooled, where = np.zeros((len(some), pools), np.float32), np.full((len(some), pools), -1)
            for k, width in enumerate(WIDTHS):
                m = len(text) - width + 1
                if m <= 0:
                    continue
                a = starts[k]
                made = sum(made_taps[i : i + m, a + i * FILTERS : a + (i + 1) * FILTERS] for i in range(width)) + b[k * FILTERS : (k + 1) * FILTERS]
                place = np.flatnonzero(text[:m] == text[width - 1 :])
                if not len(place):
                    continue
                made, of = made[place], text[:m][place]
                begin = np.flatnonzero(np.diff(of, prepend=-1))
                for t, s, e in zip(of[begin], begin, [*begin[1:], len(of)], strict=True):
                    top = made[s:e].argmax(0)
                    best = made[s:e][top, np.arange(FILTERS)]
                    pooled[t, k * FILTERS : (k + 1) * FILTERS] = np.maximum(best, 0)
                    where[t, k * FILTERS : (k + 1) * FILTERS] = np.where(best > 0, place[s + top], -1)
            z = pooled @ v + c
            g = (1 / (1 + np.exp(-z)) - y[some]) * weight[some] / len(some)
            gv, gc, gp = pooled.T @ g + 1e-4 * v, g.sum(keepdims=True), g[:, None] * v
            gE, gW, gb = np.zeros_like(E), 1e-4 * W, np.zeros_like(b)
            for k, width in enumerate(WIDTHS):
                for f in range(FILTERS):
                    j = k * FILTERS + f
                    hit = np.flatnonzero(where[:, j] >= 0)
                    if len(hit):
                        gb[j] += gp[hit, j].sum()
                        for i in range(width):
                            tap, at = starts[k] + i * FILTERS + f, where[hit, j] + i
                            gW[:, tap] += emb[at].T @ gp[hit, j]
                            for col in range(3):
                                np.add.at(gE, x[at, col], gp[hit, j][:, None] * W[:, tap])
            step += 1
            for p, grad, (m1, m2) in zip((E, W, b, v, c), (gE, gW, gb, gv, gc), state, strict=True):
                if p is E:
                    rows = np.unique(np.concatenate([x[where[where >= 0]].ravel(), x[np.minimum(where[where >= 0] + 1, len(x) - 1)].ravel(), x[np.minimum(where[where >= 0] + 2, len(x) - 1)].ravel()]))
                    m1[rows] = 0.9 * m1[rows] + 0.1 * grad[rows]
                    m2[rows] = 0.99 * m2[rows] + 0.01 * grad[rows] ** 2
                    p[rows] -= rate * m1[rows] / (np.sqrt(m2[rows]) + 1e-6)
                else:
                    m1 *= 0.9
                    m1 += 0.1 * grad
                    m2 *= 0.99
                    m2 += 0.01 * grad**2
                    p -= rate * m1 / (np.sqrt(m2) + 1e-6)
    return Model(E @ W, b, v.astype(np.float64), float(c[0]) + float(np.log(prior / (1 - prior))))


def threshold(clean: np.ndarray, toxic: np.ndarray) -> float:
    """The edge of a score bin at which fewest rows are on the wrong side, from 0.05 to 0.95 and as near to 0.5 as that allows.

    clean and toxic are counts by bin; a row is flagged from the lower edge of its bin on.
    """
    cuts = np.arange(BINS // 20, BINS - BINS // 20 + 1)
    missed, all_clean = np.concatenate([[0], np.cumsum(toxic)]), np.concatenate([[0], np.cumsum(clean)])
    wrong = (missed + all_clean[-1] - all_clean)[cuts]
    best = cuts[wrong == wrong.min()]
    return float(best[np.abs(best - BINS // 2).argmin()] / BINS)


def calibrate(model: Model, docs: DataFrame, labels: DataFrame) -> None:
    """Sets the thresholds by language from all rows of labels (doc_id, toxic), by their counts in each bin of scores.

    Texts are never shuffled: few labels come to the texts, many to the scores of all of them.
    """
    rows, few = docs.select("doc_id", "text", "lang").where("lang is not null"), bounded(labels, LABELS, 0)
    scored = score(rows.join(F.broadcast(labels), "doc_id"), model, "score") if few else score(rows, model, "score").drop("text").join(labels, "doc_id")
    at = F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int")
    counts: dict[str, np.ndarray] = {}
    for r in scored.groupBy("lang", "toxic", at.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect():  # at most 2 * BINS rows a language
        counts.setdefault(r["lang"], np.zeros((2, BINS), dtype=np.int64))[int(r["toxic"]), r["bin"]] += r["n"]
    model.thresholds.update({lang: threshold(*c) for lang, c in sorted(counts.items()) if min(c.sum(1)) >= LEAST})


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, bytes_per_class: int = BYTES_PER_CLASS) -> Model:
    """Fits a model to labelled rows that are neither held out nor for calibration, then calibrates it on all of the latter.

    The sample is bounded for each label by rows_per_class, those with the smallest hash of doc_id, and of these to
    bytes_per_class of whole texts: one that would go beyond is left out. Labels that are null or neither 0 nor 1 are ignored.
    The prior is the share of label 1 among all labelled rows that aren't held out. Repeated labels count as often as they come.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    counts = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    to_fit = usable.where(fold(F.col("doc_id")) != CALIBRATION)
    sample = to_fit.where("toxic = 1").orderBy(*by_hash).limit(rows_per_class).unionByName(to_fit.where("toxic = 0").orderBy(*by_hash).limit(rows_per_class))
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    sizes = texts.select("doc_id", size.alias("size")).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.sum("size").alias("size")).orderBy(*by_hash, "toxic").collect()
    chosen, held = [], {0: 0, 1: 0}
    for r in sizes:
        if held[r["toxic"]] + r["size"] <= bytes_per_class:
            held[r["toxic"]] += r["size"]
            chosen.append((r["doc_id"], r["toxic"]))
    kept = docs.sparkSession.createDataFrame(chosen, to_fit.schema)
    rows = texts.join(F.broadcast(kept), "doc_id").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["toxic"], bytes(r["text"] or b"")))
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    model = fit([bytes(r["text"] or b"") for r in rows], [r["toxic"] for r in rows], prior)
    del rows
    freed()  # the driver holds nothing of the sample while later steps run
    calibrate(model, docs, usable.where(fold(F.col("doc_id")) == CALIBRATION))
    return model


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a column of that name, 0 to 1, appended; one that docs has already is replaced.

    Null or empty texts get the score of a text without words. Whole texts are read. Repeated rows keep their rows, an empty
    table gives none; all other columns stay as they are.
    """
    docs = docs.drop(name)
    held = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.schema.fieldNames().index("text")
    schema = StructType([*docs.schema, StructField(name, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(held.value.score(payloads(b.column(text))), pa.float64())], [*b.schema.names, name])

    return arrow_map(docs, run, schema)


def limit(model: Model) -> Column:
    """The threshold of a row's language, 0.5 where none was calibrated."""
    pairs = [x for k, v in model.thresholds.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[F.col("lang")], F.lit(0.5)) if pairs else F.lit(0.5)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of all documents by a model of labels that aren't held out; threshold and flagged go by the language."""
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    made = score(docs.select("doc_id", "text", "lang"), model)
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), limit(model).alias("threshold"), (F.col("score") >= limit(model)).alias("flagged"))
