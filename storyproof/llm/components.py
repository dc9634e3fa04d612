"""Connected components of an edge table by alternating large-star and small-star rounds, each a few joins of slim rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from storyproof.llm.common import materialize


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star operation on edges (u, v) with u > v; of a small one an edge may come out more than once."""
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
    moved = both.join(least, "u")
    if small:
        out = moved.select(F.col("v").alias("u"), F.col("w").alias("v")).unionByName(least.select("u", F.col("w").alias("v")))
    else:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("w").alias("v"))
    return out.where("u <> v").distinct() if not small else out.where("u <> v")  # a node of many neighbours would come out as often


def _stored(edges: DataFrame, name: str, replaces: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """The distinct edges (u, v) stored, and their number and checksum, taken while they are written."""
    seen = Observation()
    counted = edges.distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
    return materialize(counted, name, replaces=replaces), seen.get


def components(edges: DataFrame) -> DataFrame:
    """For edges (a, b) of non-null ids, either way round and repeated or not: (node, root), root the smallest id reachable.

    Only nodes with an edge to another node have a row. The state between rounds is one row a node, written to the shared
    folder; the driver sees a row count and a checksum. An empty table gives an empty result.
    """
    now, after = _stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "links")
    before = None
    while after["n"] and after != before:
        before = after
        now, after = _stored(_star(_star(now, small=False), small=True), "stars", replaces=now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
