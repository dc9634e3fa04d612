"""SimHash near-dedup: fingerprints of word shingles, pigeonhole blocks, Hamming verification, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyproof.llm.common import arrow_map, documents, materialize, payloads
from storyproof.llm.components import components

SHINGLE, SEED, BITS, DISTANCE = 3, 42, 64, 3


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as a signed 64-bit integer; zero for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    return majority(hashes)


def majority(hashes: list[int] | np.ndarray) -> int:
    """The bits that are set in over half of some unsigned 64-bit hashes, as a signed integer."""
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for each row of docs (doc_id, text); null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(x) for x in payloads(b.column(1))], pa.int64())], ["doc_id", "fp"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


def _keys(distance: int) -> list[tuple[int, int]]:
    """(number of the key, mask): twice as many blocks as bits may differ, so that the close pairs share half of the blocks whole."""
    blocks = 2 * distance
    cut = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [((1 << cut[i + 1]) - (1 << cut[i])) for i in range(blocks)]
    out = [sum(masks[i] for i in c) for c in combinations(range(blocks), blocks - distance)]
    return [(i, m - (1 << 64) if m >> 63 else m) for i, m in enumerate(out)]


def close_pairs(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs a < b of distinct fingerprints fp at most so many bits apart; each pair once or more often.

    Of 2 * distance blocks, distance bits touch at most half, so any close pair has an equal key among those made of the
    other half of the blocks (about 32 bits each). Equal keys meet in a hash join; its condition counts the bits that differ.
    """
    keys = F.array(*(F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in _keys(distance)))
    dealt = prints.select("fp", F.inline(keys))
    a, b = dealt.select(F.col("fp").alias("a"), "i", "key"), dealt.select(F.col("fp").alias("b"), "i", "key")
    return a.join(b, ["i", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b")


def groups(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(node, root) of the distinct fingerprints fp that link to another: what close pairs connect."""
    return components(close_pairs(prints, distance))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row for each row of docs: doc_id, fp, component_id (the smallest doc_id reachable by links, its own included).

    Null or empty texts have fingerprint zero and link like others. Equal fingerprints are one node, so a group of copies
    of any size costs one row in the joins. Repeated rows keep their rows. A null doc_id never names a component; a
    component without any doc_id has a null component_id. Other columns of docs are ignored, whatever their names; an empty
    table gives none. Texts of any length are read whole.
    """
    prints = materialize(fingerprints(docs), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = groups(classes.select("fp"), distance)
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    heads = roots.select(F.col("node").alias("fp"), "root").join(classes, "fp").groupBy("root").agg(F.min("least").alias("head"))
    known = named.join(heads, "root", "left").select("fp", F.when(F.col("head").isNull(), F.col("least")).otherwise(F.col("head")).alias("component_id"))
    return prints.join(known, "fp").select("doc_id", "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of all documents: 3-word shingles, links at 3 or fewer differing bits of 64."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
