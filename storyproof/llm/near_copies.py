"""SimHash near-dedup by a similarity instead of a distance: exact Jaccard similarity of word shingles decides.

Texts with the same shingles are one class. Fingerprints of the classes meet in SimHash blocks, as in the operator by distance;
that finds the bulk of the copies, but pairs of similarity 0.8 differ in about ten of 64 bits, too many for keys that are
selective. So bands of minimum hashes of the same shingles complete the candidates: classes with an equal band share a bucket, and every
pair of a bucket is either verified exactly or linked through verified pairs already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyproof.llm import simhash
from storyproof.llm.common import NO_SPACE, Words, arrow_map, materialize, mixed, payloads, slices
from storyproof.llm.components import components

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
#: A pair of similarity 0.8 shares no band with probability (1 - 0.8**5)**24, 7 in 100,000; of 0.85, 2 in a million.
BANDS, ROWS = 24, 5
#: All pairs of a bucket of at most so many classes are candidates at once; a larger one begins with the links to one of its classes.
SMALL = 8
#: Larger buckets whose classes are not all linked then are compared in tiles of about so many classes, two at a time.
TILE, DENSE = 1000, 1 << 25
SLICE = 400_000
_random = np.random.default_rng(SEED)
_XOR, _TIMES = _random.integers(0, 1 << 32, (2, BANDS * ROWS, 1), dtype=np.uint64).astype(np.uint32) | np.array([0, 1], dtype=np.uint32)[:, None, None]
_PLACES = _random.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)


def shingles(texts: list[bytes], n: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text the distinct hashes of its runs of n words, sorted; of the whole text if it has fewer words, none without words.

    Words are runs of anything but ASCII space, A-Z lower-cased. A hash is made of the 64-bit hashes of the words.
    """
    for lo, hi in slices(map(len, texts), SLICE):
        w = Words(texts[lo:hi], inside=NO_SPACE)
        m = len(w.hash)
        made = np.zeros(max(0, m - n + 1), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(n):
                made += w.hash[j : j + len(made)] * _PLACES[j]
        made = mixed(made)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if b - a >= n:
                yield np.unique(made[a : b - n + 1])
            else:
                yield mixed((w.hash[a:b] * _PLACES[n + b - a : n + 2 * (b - a)]).sum(keepdims=True)) if b > a else np.zeros(0, dtype=np.uint64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of two sorted arrays of distinct values; of two empty ones 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def bands(values: np.ndarray) -> list[int]:
    """One signed hash for each band of minimum hashes; none for a text without words."""
    if not len(values):
        return []
    short = (values >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, dtype=np.uint32)
    for i in range(0, len(short), 1024):
        np.minimum(least, ((short[i : i + 1024] ^ _XOR) * _TIMES).min(1), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(least.reshape(BANDS, ROWS))]


def sketches(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, cls, fp, bands) for each row of docs (uid, doc_id, text): cls is a hash of all its shingles, fp their SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63), simhash.majority(s), bands(s)) for s in shingles(payloads(b.column(2)))]
            made = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], ["uid", "doc_id", "cls", "fp", "bands"])

    return materialize(arrow_map(docs.select("uid", F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "uid long, doc_id long, cls long, fp long, bands array<long>"), "sketches")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (a, b) of classes whose texts (cls, text) are at least so similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = payloads(batch.column(2)), payloads(batch.column(3))
            texts = list(dict.fromkeys([*left, *right]))
            of = dict(zip(texts, shingles(texts), strict=True))
            close = [jaccard(of[s], of[t]) >= similarity for s, t in zip(left, right, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(close, pa.bool_()))

    sides = [texts.select(F.col("cls").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab"]
    joined = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "text_a", "text_b")
    return materialize(arrow_map(joined, run, "a long, b long"), "verified")


def spanning(sets: list[np.ndarray], roots: list[int], similarity: float) -> list[tuple[int, int]]:
    """Links between places of sets, enough to connect all that pairs of at least that similarity connect; equal roots are connected before."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    common = np.bincount(column, minlength=len(values)) > 1  # others are in no intersection
    place = np.cumsum(common) - 1
    rows, column, shared = np.repeat(np.arange(len(sets)), sizes), place[column], common[column]
    rows, column = rows[shared], column[shared]
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    width = max(1, DENSE // len(sets))
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    for lo in range(0, int(common.sum()), width):
        a, b = np.searchsorted(column, [lo, lo + width])
        has = np.zeros((len(sets), min(width, int(common.sum()) - lo)), dtype=np.float32)
        has[rows[a:b], column[a:b] - lo] = 1
        both += has @ has.T
    close = both >= similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-3
    of, out, left = np.array(roots), [], np.ones(len(sets), dtype=bool)
    while left.any():
        todo = [int(left.argmax())]
        left[todo[0]] = False
        while todo:
            i = todo.pop()
            same = of == of[i]
            for j in np.flatnonzero(left & (same | close[i])).tolist():
                if not same[j] and jaccard(sets[i], sets[j]) < similarity:
                    continue
                left[j] = False
                todo.append(j)
                if not same[j]:
                    out.append((i, j))
    return out


def linked(many: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that connect what similar pairs of a bucket connect, for rows (bucket, cls, root) with texts (cls, text).

    Classes of the most frequent root of a bucket are connected already and never compared with each other, only with the
    others. Each pair of tiles of a bucket is one group, so no task holds a bucket whole and only links leave Python.
    """
    counted = many.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    sizes = counted.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("all"))
    sizes = sizes.select("bucket", F.col("most.root").alias("most"), F.ceil(F.col("most.n") / TILE).cast("int").alias("main"), F.ceil((F.col("all") - F.col("most.n")) / TILE).cast("int").alias("rest"))
    at = F.xxhash64("cls")
    main = F.col("root") == F.col("most")
    tiles = many.join(sizes, "bucket").withColumn("own", F.when(main, F.pmod(at, F.col("main"))).otherwise(F.col("main") + F.pmod(at, F.col("rest"))).cast("int"))
    last = F.col("main") + F.col("rest") - 1
    dealt = tiles.withColumn("other", F.explode(F.when(main, F.sequence(F.col("main"), last)).otherwise(F.sequence(F.lit(0), last))))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cls", "root").join(texts, "cls").select("bucket", "i", "j", "cls", "root", "text")

    def run(group: pa.Table) -> pa.Table:
        cls, sets = group.column("cls").to_pylist(), list(shingles(payloads(group.column("text").combine_chunks())))
        pairs = spanning(sets, group.column("root").to_pylist(), similarity)
        return pa.table([pa.array([cls[k] for k, _ in pairs], pa.int64()), pa.array([cls[k] for _, k in pairs], pa.int64())], ["a", "b"])

    return materialize(dealt.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long"), "links-within")


def _stars(classes: DataFrame) -> DataFrame:
    """For classes (cls, fp, n) that SimHash puts together the pair (a, b) of each with the most frequent one."""
    roots = simhash.groups(classes.select("fp").distinct()).withColumnRenamed("node", "fp")
    named = classes.select("cls", "fp", "n").join(roots, "fp", "left").select("cls", "n", F.coalesce("root", "fp").alias("root"))
    stars = named.groupBy("root").agg(F.max(F.struct("n", "cls"))["cls"].alias("star"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return named.join(stars, "root").where("cls <> star").select(F.col("cls").alias("a"), F.col("star").alias("b"))


def heads(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(uid, doc_id) of the row that heads each group of near copies among docs (uid, doc_id, text); uid must tell rows apart.

    Groups are the connected components of pairs whose 5-word shingles have at least that Jaccard similarity. A head has the
    smallest doc_id, then the smallest uid. Texts without words, null included, are one group. Texts of any length are read
    whole, repeated rows are copies, an empty table gives none. Other columns are ignored, whatever their names.
    """
    found = sketches(docs)
    first = F.min(F.struct("doc_id", "uid")).alias("head")
    classes = materialize(found.groupBy("cls").agg(first, F.count(F.lit(1)).alias("n"), F.min_by("bands", "uid").alias("bands"), F.min("fp").alias("fp")), "classes")
    entries = classes.select("cls", "n", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("n", "cls"))["cls"].alias("star")).where("size > 1")
    members = materialize(entries.join(shared, "bucket").select("bucket", "cls", "size", "star"), "buckets")
    pair = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    few = members.where(F.col("size") <= SMALL)
    met = few.select("bucket", F.col("cls").alias("a")).join(few.select("bucket", F.col("cls").alias("b")), "bucket").where("a < b").select("a", "b")
    stars = members.where(F.col("size") > SMALL).select(F.col("cls").alias("a"), F.col("star").alias("b")).where("a <> b")
    tried = materialize(met.unionByName(stars.unionByName(_stars(classes)).select(*pair)).distinct(), "pairs")
    needed = tried.select(F.explode(F.array("a", "b")).alias("cls")).unionByName(members.where(F.col("size") > SMALL).select("cls")).distinct()
    texts = docs.select("uid", "text").join(classes.join(needed, "cls", "left_semi").select("cls", F.col("head.uid").alias("uid")), "uid").select("cls", "text")
    texts = materialize(texts, "candidates")
    links = verified(tried, texts, similarity)
    roots = components(links)
    # in the larger buckets, the pairs that verified ones don't link
    many = members.where(F.col("size") > SMALL).join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("bucket", "cls", F.coalesce("root", "cls").alias("root"))
    split = many.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
    many = materialize(many.join(split, "bucket"), "split")
    if not many.isEmpty():
        roots = components(roots.toDF("a", "b").unionByName(linked(many, texts, similarity)))
    grouped = classes.select("cls", "head").join(roots.withColumnRenamed("node", "cls"), "cls", "left").groupBy(F.coalesce("root", "cls").alias("root"))
    return grouped.agg(F.min("head").alias("head")).select("head.uid", "head.doc_id")
