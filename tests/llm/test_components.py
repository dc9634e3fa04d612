"""Connected components: what they connect, and how many jobs and exchanges the driver has to plan and keep for them."""

from __future__ import annotations

import random

import pytest

from storyproof.llm.components import components


def _plain(edges: list[tuple[int, int]]) -> dict[int, int]:
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("seed", [1, 2])
def test_as_a_plain_search(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(500 + i, 501 + i) for i in range(9)] + [(900, 1000 + i) for i in range(30)]
    edges = [*edges, *edges[:10], *((b, a) for a, b in edges[:10])]
    linked = [(a, b) for a, b in edges if a != b]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == _plain(linked)


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


def test_no_jobs_beside_the_writing(spark):
    """Counts and checksums come with the stored rounds: each job and exchange leaves threads and plans on the driver."""
    sc, edges = spark.sparkContext, spark.createDataFrame([(i, i + 1) for i in range(6)], "a long, b long")
    sc.setJobGroup("components", "")
    try:
        assert components(edges).count() == 7
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("components")) <= 40
