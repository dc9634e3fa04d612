"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors are rotated and split into blocks of few dimensions. Two vectors with a cosine of at least the threshold are at
most sqrt(2 - 2 * threshold) apart, so in some block their squared distance is within the block's proportional share of that
budget. Each block is range-joined on a grid: a vector stands in the cell of its point, and looks into all cells that the
ball around it touches. Points and balls of one cell travel in tiles, so that the join is of tiles and the distances of a pair
of tiles are one matrix product; the tiles of a full cell are split among tasks. The union of the candidates is verified on the whole vectors in double precision.

Equal vectors are one class: a group of copies of any size is one point in the joins and counts by its size in the links.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types

from storyproof.llm.common import arrow_map, materialize
from storyproof.llm.components import components

THRESHOLD = 0.98
BLOCK_DIMS, GRID_DIMS, TILE = 8, 3, 1024
#: Classes that one task deals into tiles, a block after the other.
CLASSES_PER_TASK = 100_000
#: Bytes of vectors likewise, however many classes that are.
BYTES_PER_TASK = 256 << 20
#: Tiles of either side of a cell that one task compares; the tiles of a cell with more are split among several.
TILES_PER_TASK = 16
SLACK = 1e-4  # of the squared-distance budget, for the single precision of block coordinates
SEED = 11


@lru_cache(maxsize=8)
def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def _precision(vectors: DataFrame) -> str:
    """How a component is stored: in single precision if the source has no more."""
    kind = vectors.schema["embedding"].dataType
    return "<f4" if isinstance(kind, types.ArrayType) and isinstance(kind.elementType, types.FloatType) else "<f8"


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, key, vec): vec the bytes of the components, key that of label and vec; both null for what links with nothing.

    That is a null label, a null, empty or zero vector, or one with null or non-finite components.
    """
    precision = _precision(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(2)
            column = column.cast(pa.list_(pa.float64()))
            flat = column.flatten()
            values = flat.to_numpy(zero_copy_only=False).astype("<f8")  # null components become nan
            sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
            ends = np.cumsum(sizes)
            keys, vecs = [], []
            for label, s, e in zip(b.column(1).to_pylist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
                v = values[s:e]
                if label is None or not len(v) or not np.isfinite(v).all() or not v.any():
                    keys.append(None)
                    vecs.append(None)
                    continue
                most = np.abs(v).max()
                if not 1e-100 < most < 1e100:  # squares would leave the range; a power of two changes no cosine
                    v = np.ldexp(v, -np.frexp(most)[1])
                v = (v + 0.0).astype(precision).tobytes()  # -0.0 is 0.0
                keys.append(hashlib.blake2b(v, digest_size=16, key=hashlib.blake2b(str(label).encode()).digest()).digest())
                vecs.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], ["vec_id", "label", "key", "vec"])

    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    return materialize(arrow_map(source, run, "vec_id long, label string, key binary, vec binary"), "vectors")


def _radius(threshold: float, part: int, dims: int) -> float:
    """How far apart two vectors may be in a block of so many of all dimensions."""
    return float(np.sqrt((2 - 2 * threshold) * part / dims + SLACK))


def _cells(part: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For points of a block their numbers and cells, and the numbers and cells of all cells that the balls around them touch.

    Cells are a little wider than balls, so a ball touches two in each dimension of the grid at most.
    """
    grid = part[:, :GRID_DIMS].astype(np.float64)
    width = max(2 * radius * (1 + 1e-6), 1e-3)
    own, low, high = (np.floor((grid + d) / width).astype(np.int64) for d in (0, -radius, radius))
    number = lambda cell: ((cell + (1 << 19)) << (20 * np.arange(cell.shape[1]))).sum(1)
    all_of, cells = [], []
    for corner in itertools.product((False, True), repeat=grid.shape[1]):
        there = np.flatnonzero(((high > low) | ~np.array(corner)).all(1))
        all_of.append(there)
        cells.append(number(np.where(corner, high[there], low[there])))
    return np.arange(len(part)), number(own), np.concatenate(all_of), np.concatenate(cells)


def _dealt(classes: DataFrame, threshold: float, precision: str) -> DataFrame:
    """Tiles (label, block, cell, ball, ids, points) of classes: ball says whether its vectors look into the cell or stand in it."""
    names = ["label", "block", "cell", "ball", "ids", "points"]
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())

    def tiles(group: str, ids: np.ndarray, x: np.ndarray) -> Iterator[tuple]:
        dims = x.shape[1]
        for block, lo in enumerate(range(0, dims, BLOCK_DIMS)):
            part = x[:, lo : lo + BLOCK_DIMS]
            stand, own, look, touched = _cells(part, _radius(threshold, part.shape[1], dims))
            for ball, rows, cells in ((False, stand, own), (True, look, touched)):
                order = np.argsort(cells, kind="stable")
                rows, cells = rows[order], cells[order]
                for first in np.flatnonzero(np.diff(cells, prepend=-1)).tolist():
                    last = int(np.searchsorted(cells, cells[first], side="right"))
                    for i in range(first, last, TILE):
                        some = rows[i : min(i + TILE, last)]
                        yield group, block, int(cells[first]), ball, ids[some].tobytes(), part[some].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, int], tuple[list, list]] = {}
        for b in batches:
            for label, cid, vec in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, vecs = groups.setdefault((label, len(vec)), ([], []))
                ids.append(cid)
                vecs.append(vec)
        while groups:
            (label, size), (ids, vecs) = groups.popitem()
            x = np.frombuffer(b"".join(vecs), dtype=precision).reshape(len(ids), -1).astype(np.float64)
            x = ((x / np.linalg.norm(x, axis=1, keepdims=True)) @ rotation(x.shape[1])).astype("<f4")
            made, held = [], 0
            for tile in tiles(f"{label}/{x.shape[1]}", np.array(ids, dtype="<i8"), x):
                made.append(tile)
                held += len(tile[5])
                if held >= 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names)
                    made, held = [], 0
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names)

    count, size = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("vec")), F.lit(0))).first()
    n = max(1, -(-count // CLASSES_PER_TASK), -(-size // BYTES_PER_TASK))
    return materialize(arrow_map(classes.select("label", "cid", "vec").coalesce(n), run, "label string, block int, cell long, ball boolean, ids binary, points binary"), "tiles")


def _split(tiles: DataFrame) -> DataFrame:
    """Pairs of tiles of a cell, (label, ia, pa, ib, pb): a tile that stands there with one that looks into it.

    A cell with more than TILES_PER_TASK tiles of a side is split: its tiles are dealt to a grid of shares, and each tile of
    one side goes to all shares of the other, so that no task meets more than that number of either.
    """
    at = ["label", "block", "cell"]
    shares = lambda ball: F.greatest(F.lit(1), F.ceil(F.count(F.when(F.col("ball") == ball, 1)) / TILES_PER_TASK)).cast("int")
    full = materialize(tiles.groupBy(*at).agg(shares(False).alias("np"), shares(True).alias("nb")).where("np > 1 or nb > 1"), "full-cells")
    known = tiles.join(full, at, "left").withColumns({"np": F.coalesce("np", F.lit(1)), "nb": F.coalesce("nb", F.lit(1))})
    own = lambda n: F.pmod(F.xxhash64("ids"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    points = known.where("not ball").withColumn("i", own("np")).withColumn("j", every("nb")).select(*at, "i", "j", F.col("ids").alias("ia"), F.col("points").alias("pa"))
    balls = known.where("ball").withColumn("j", own("nb")).withColumn("i", every("np")).select(*at, "i", "j", F.col("ids").alias("ib"), F.col("points").alias("pb"))
    return points.join(balls, [*at, "i", "j"]).select("label", "ia", "pa", "ib", "pb")


def _candidates(tiles: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs a < b of classes that are within the budget of some block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for group, ia, pa_, ib, pb in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ia, ib = np.frombuffer(ia, dtype="<i8"), np.frombuffer(ib, dtype="<i8")
                x, y = np.frombuffer(pa_, dtype="<f4").reshape(len(ia), -1), np.frombuffer(pb, dtype="<f4").reshape(len(ib), -1)
                budget = _radius(threshold, x.shape[1], int(group.rpartition("/")[2])) ** 2
                near = (x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T <= budget
                i, j = np.nonzero(near)
                a, c = ia[i], ib[j]
                if (a < c).any():
                    yield pa.RecordBatch.from_arrays([pa.array(a[a < c]), pa.array(c[a < c])], ["a", "b"])

    return arrow_map(_split(tiles), run, "a long, b long").distinct()


def links(classes: DataFrame, threshold: float = THRESHOLD, precision: str = "<f8") -> DataFrame:
    """Pairs (a, b) of classes (cid) whose cosine, in double precision on whole vectors, is at least the threshold; each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            left, right = (r.column(i).to_pylist() for i in (2, 3))
            close = np.zeros(r.num_rows, dtype=bool)
            sizes = np.array([len(v) for v in left])  # classes that meet are equally long
            for size in np.unique(sizes):
                some = np.flatnonzero(sizes == size)
                x, y = (np.frombuffer(b"".join(side[i] for i in some), dtype=precision).reshape(len(some), -1).astype(np.float64) for side in (left, right))
                close[some] = (x * y).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)) >= threshold
            yield r.select(["a", "b"]).filter(pa.array(close))

    pairs = _candidates(_dealt(classes, threshold, precision), threshold)
    whole = pairs.join(classes.select(F.col("cid").alias("a"), F.col("vec").alias("va")), "a").join(classes.select(F.col("cid").alias("b"), F.col("vec").alias("vb")), "b")
    return materialize(arrow_map(whole.select("a", "b", "va", "vb"), run, "a long, b long"), "cosine-links")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Only vectors of equal labels and lengths link. What links with nothing is its own component. Repeated rows are vectors of
    their own, linked with each other. A null vec_id never names a component unless it is alone there. Other columns are
    ignored, whatever their names; an empty table gives none.
    """
    rows = prepared(vectors)
    named = rows.where("key is not null").groupBy("key").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    classes = materialize(named.withColumn("cid", F.monotonically_increasing_id()), "classes")
    pairs = links(classes, threshold, _precision(vectors))
    slim = classes.select("cid", "n", "least")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(slim.select(F.col("cid").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("linked")).withColumnRenamed("a", "cid")
    roots = components(pairs).withColumnRenamed("node", "cid")
    heads = roots.join(slim, "cid").groupBy("root").agg(F.min("least").alias("head"))
    known = classes.select("key", "cid", "n", "least").join(others, "cid", "left").join(roots, "cid", "left").join(heads, "root", "left").select("key", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("head", "least").alias("head"))
    out = rows.select("vec_id", "key").join(known, "key", "left")
    component = F.coalesce("head", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of all embeddings at a cosine of 0.98."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT vec_id AS u, vec_id AS w FROM embeddings UNION SELECT r.u, p.w FROM reach r JOIN pairs p ON r.w = p.u),
least AS (SELECT u AS vec_id, min(w) AS component_id FROM reach GROUP BY u),
degree AS (SELECT u AS vec_id, count(*) AS n_links FROM pairs GROUP BY u)
SELECT l.vec_id, coalesce(d.n_links, 0) AS n_links, l.component_id, l.vec_id = l.component_id AS kept
FROM least l LEFT JOIN degree d USING (vec_id)"""
