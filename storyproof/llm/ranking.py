"""Ranked lexical search over a document-sharded index: each shard is the postings of its documents in CSR form.

A shard is one row of a stored table: its sorted terms, where each term's postings end, and for each posting the place of the
document in the shard and its impact. Impacts are integers, made once when the corpus is known whole: what a term gives to a
document's score but for the term's own weight. A search reads the shards, adds weight times impact term by term into one dense
array of a shard's documents, takes the best of it with all that tie with the last, and keeps the best of a task; the best of
all tasks meet by item. Shuffled are counts of the asked terms and the best few of each task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyproof.llm.common import Words, arrow_map, documents, materialize, payloads, slices

TOP = 10
#: Bytes of text of a shard (or one longer text), and bytes of text that are cut into words at a time.
SHARD_BYTES, SLICE = 4 << 20, 500_000
#: Distinct terms, and pairs of an item and a term, that one search holds in every task; more items are searched in parts.
TERMS, PAIRS = 1_000_000, 4_000_000
COUNTED = "doc_ids array<long>, sizes array<long>, terms array<long>, ends array<int>, places array<int>, tfs array<int>"
SHARD = "doc_ids array<long>, terms array<long>, ends array<int>, places array<int>, impacts array<int>"


def _one(values: np.ndarray | pa.Array, kind: pa.DataType) -> pa.Array:
    """One list that holds all the values."""
    values = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind))


def _row(columns: list[tuple[str, np.ndarray | pa.Array, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_one(v, k) for _, v, k in columns], [n for n, _, _ in columns])


def _shard(texts: list[bytes], doc_ids: pa.Array) -> pa.RecordBatch:
    """The COUNTED row of some documents: words are hashed a slice of texts at a time."""
    n, found = np.zeros(len(texts), dtype=np.int64), []
    for lo, hi in slices(map(len, texts), SLICE):
        w = Words(texts[lo:hi])
        n[lo:hi] = np.diff(w.first)
        order = np.lexsort([w.text, w.hash])
        term, place = w.hash[order], w.text[order]
        first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (place[1:] != place[:-1])])) if len(term) else np.zeros(0, dtype=np.int64)
        found.append((term[first], place[first] + lo, np.diff(np.append(first, len(term)))))
    term, place, tf = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, dtype=np.uint64 if i == 0 else np.int64) for i in range(3))
    order = np.argsort(term, kind="stable")  # places rise within a term: slices are in order
    term, place, tf = term[order], place[order], tf[order]
    last = np.flatnonzero(np.concatenate([term[1:] != term[:-1], [True] * bool(len(term))]))
    return _row([("doc_ids", doc_ids, pa.int64()), ("sizes", n, pa.int64()), ("terms", term[last].view(np.int64), pa.int64()), ("ends", last + 1, pa.int32()), ("places", place, pa.int32()), ("tfs", tf, pa.int32())])


def counted(docs: DataFrame) -> DataFrame:
    """COUNTED rows of docs (doc_id, text), a shard each; the terms are hashes of words with A-Z lower-cased."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ids, held = [], [], 0
        for b in batches:
            for i, t in enumerate(payloads(b.column(1))):
                if held and held + len(t) > SHARD_BYTES:
                    yield _shard(texts, pa.array(ids, pa.int64()))
                    texts, ids, held = [], [], 0
                texts.append(t)
                ids.append(b.column(0)[i].as_py())
                held += len(t) + 1
        if texts:
            yield _shard(texts, pa.array(ids, pa.int64()))

    return materialize(arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, COUNTED), "counted", wide=True)


def length_norm(n: int, total: int, documents: int) -> int:
    """m of a document of n terms: from 10 on, 100 at the mean length."""
    return 100 - 90 + (90 * n * documents) // total


class Index:
    """shards (SHARD rows, stored), and the number of documents that have terms."""

    def __init__(self, docs: DataFrame):
        """Indexes each row of docs (doc_id, text); null texts have no terms.

        Lengths and term counts are stored first; impacts need the number of documents and of all their terms, so they are made
        from the stored counts, which go then.
        """
        rows = counted(docs)
        sizes = rows.select(F.explode("sizes").alias("n")).where("n > 0")
        self.documents, total = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        n_docs = self.documents

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    ids, n, terms, ends, places, tfs = (b.column(c).slice(i, 1).flatten() for c in range(6))
                    m = np.array([length_norm(int(x), total, n_docs) if x else 0 for x in n.to_numpy()], dtype=np.int64)
                    tf = tfs.to_numpy().astype(np.int64)
                    impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[places.to_numpy()])
                    yield _row([("doc_ids", ids, pa.int64()), ("terms", terms, pa.int64()), ("ends", ends, pa.int32()), ("places", places, pa.int32()), ("impacts", impact, pa.int32())])

        self.shards = materialize(arrow_map(rows, run, SHARD), "shards", replaces=rows, wide=True)


def asked(items: DataFrame) -> DataFrame:
    """(item, terms) of items (item_id, text): the distinct terms of all texts of an id, stored; items without id or terms have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = payloads(b.column(1))
            for lo, hi in slices(map(len, texts), SLICE):
                w = Words(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).take(pa.array(w.text)), pa.array(w.hash.view(np.int64))], ["item", "term"])

    found = arrow_map(items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), "text"), run, "item string, term long")
    return materialize(found.distinct(), "asked")


def _frequencies(shards: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How many documents hold each of the sorted terms."""
    held = shards.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(len(held.value), dtype=np.int64)
        for b in batches:
            for i in range(b.num_rows):
                terms, ends = (b.column(c).slice(i, 1).flatten().to_numpy() for c in range(2))
                at, there = _find(terms.view(np.uint64), held.value)
                totals[there] += np.diff(ends, prepend=0)[at[there]]
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(totals[used])], ["term", "n"])

    sums = arrow_map(shards.select("terms", "ends"), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocabulary), dtype=np.int64)
    out[sums["term"].to_numpy()] = sums["n"].to_numpy()
    return out


def _find(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of the wanted values stands in a sorted array, and whether it does."""
    if not len(known):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


def term_weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def best(scores: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """The places of the top highest scores above 0, equal ones by ascending id, highest first.

    argpartition alone would choose at random among those that tie with the last; so all above that score are taken, and of
    those that have it the ones with the smallest ids.
    """
    some = np.flatnonzero(scores > 0)
    if len(some) > top:
        last = scores[some[np.argpartition(scores[some], len(some) - top)[len(some) - top]]]
        above, tied = some[scores[some] > last], some[scores[some] == last]
        left = top - len(above)
        if len(tied) > left:
            edge = np.partition(ids[tied], left - 1)[left - 1]
            below = tied[ids[tied] < edge]
            tied = np.concatenate([below, tied[ids[tied] == edge][: left - len(below)]])
        some = np.concatenate([above, tied])
    return some[np.lexsort([ids[some], -scores[some]])]


def search(index: Index, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item, rank, doc_id, score): the top best documents of the index for each of items (item_id, text).

    Terms are compared by 64-bit hashes; only those of the items reach the driver, in parts of at most TERMS of them and PAIRS
    of an item and a term (or one item), and a part's items are searched in one pass over the shards.
    """
    pairs = asked(items)
    each = pairs.groupBy("item").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    parts = max(1, -(-each[0] // min(TERMS, PAIRS)))
    found = [_search(index, pairs.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == i) if parts > 1 else pairs, top) for i in range(parts)]
    return reduce(DataFrame.unionByName, found)


def _search(index: Index, pairs: DataFrame, top: int) -> DataFrame:
    rows = pairs.orderBy("item", "term").toArrow()
    names, first = np.unique(rows["item"].to_numpy(zero_copy_only=False).astype(str), return_index=True)
    names = [rows["item"][int(i)].as_py() for i in first]
    term = rows["term"].combine_chunks().to_numpy().view(np.uint64)
    vocabulary, of = np.unique(term, return_inverse=True)
    n_docs = index.documents
    weights = np.array([term_weight(int(x), n_docs) for x in _frequencies(index.shards, vocabulary)], dtype=np.int64)
    held = pairs.sparkSession.sparkContext.broadcast((names, vocabulary, weights, np.split(of, first[1:])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vocabulary, weights, lists = held.value
        kept = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))] * len(names)
        for b in batches:
            for i in range(b.num_rows):
                ids, terms, ends, places, impacts = (b.column(c).slice(i, 1).flatten() for c in range(5))
                ids = ids.fill_null(np.iinfo(np.int64).max).to_numpy()
                terms, ends, places, impacts = terms.to_numpy().view(np.uint64), ends.to_numpy(), places.to_numpy(), impacts.to_numpy()
                at, there = _find(terms, vocabulary)
                starts = ends - np.diff(ends, prepend=0)
                for k, wanted in enumerate(lists):
                    scores = np.zeros(len(ids), dtype=np.int64)
                    for t in wanted[there[wanted]].tolist():
                        some = slice(starts[at[t]], ends[at[t]])
                        scores[places[some]] += weights[t] * impacts[some].astype(np.int64)
                    found = best(scores, ids, top)
                    if len(found):
                        s, d = np.concatenate([kept[k][0], scores[found]]), np.concatenate([kept[k][1], ids[found]])
                        order = np.lexsort([d, -s])[:top]
                        kept[k] = s[order], d[order]
        n = [len(s) for s, _ in kept]
        d = np.concatenate([d for _, d in kept]) if kept else np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, m in zip(names, n, strict=True) for _ in range(m)], pa.string()), pa.array(d, mask=d == np.iinfo(np.int64).max), pa.array(np.concatenate([s for s, _ in kept]) if kept else d, pa.int64())], ["item", "doc_id", "score"])

    made = arrow_map(index.shards, run, "item string, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return made.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item, rank, doc_id, score): for each of items (item_id, text) the top documents of docs (doc_id, text) with a score above 0.

    Scores are integers, as the contract of op12 states them. Null or empty texts have no terms: such documents count nowhere
    and such items have no rows; an item without id has none either, texts of one id are one item. Repeated rows are documents
    of their own and rank next to each other; a document without doc_id ranks after those of its score. An empty table on either
    side gives no rows. Other columns are ignored, whatever their names. Very long texts are a shard of their own.
    """
    return search(Index(docs), items, top)


def op12_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rank() of all documents for each item of benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = rank(documents(spark, sf_dir), items)
    return found.select(F.col("item").cast(items.schema["item_id"].dataType).alias("item_id"), "rank", "doc_id", "score")


SQL = r"""
WITH found AS (
  SELECT uid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS uid, doc_id, text FROM documents)
), tfs AS (
  SELECT uid, doc_id, term, count(*)::BIGINT AS tf FROM found GROUP BY ALL
), sizes AS (
  SELECT uid, sum(tf)::BIGINT AS n FROM tfs GROUP BY uid
), corpus AS (
  SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM sizes
), norms AS (
  SELECT uid, 100 - 90 + (90 * n * nn) // ll AS m FROM sizes, corpus
), weights AS (
  SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, corpus GROUP BY term, nn
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL
), scores AS (
  SELECT item_id, uid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN norms USING (uid) GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
