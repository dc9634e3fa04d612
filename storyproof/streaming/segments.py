"""A stored index that grows: each batch of documents is a segment of its own, and a version says which segments are the index.

folder/segments/NAME holds the tables of a segment, folder/versions/N the names of version N's segments, a line each. Segments
are never changed and a version is written after its segments, so whoever reads a version sees it whole, whatever is added
meanwhile. Counts of documents, words and terms are kept by block, so that a version's are sums over its segments' blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from storyproof.operators import retrieval

TABLES = ("docs", "blocks", "sizes")


def _path(spark: SparkSession, folder: str, *names: str):
    """(file system, path) of something in the folder, whatever store that is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([folder.rstrip("/"), *names]))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the versions that are there, oldest first."""
    fs, path = _path(spark, folder, "versions")
    if not fs.exists(path):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(path)]
    return sorted(int(n) for n in names if n.isdecimal())


def segments(spark: SparkSession, folder: str, version: int) -> list[str]:
    """The names of a version's segments."""
    return [r[0] for r in spark.read.text(f"{folder}/versions/{version}").collect()]


def _commit(spark: SparkSession, folder: str, version: int, names: list[str]) -> int:
    """Writes a version under another name and gives it its own at once; fails if somebody else has made it meanwhile."""
    fs, draft = _path(spark, folder, "versions", f".{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray("\n".join(names).encode()))
    out.close()
    made = _path(spark, folder, "versions", str(version))[1]
    if fs.exists(made) or not fs.rename(draft, made):
        fs.delete(draft, False)
        raise RuntimeError(f"version {version} of {folder} was made by another writer; try again")
    return version


def _written(folder: str, name: str, compute: Callable[..., retrieval.Index]) -> str:
    """Stores the tables that compute(keep) gives as an index into a new segment."""

    def keep(df: DataFrame, table: str) -> DataFrame:
        path = f"{folder}/segments/{name}/{table}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    keep(compute(keep).docs, "docs")
    return name


def append(spark: SparkSession, folder: str, docs: DataFrame, text: str = "text", replace: bool = False) -> int:
    """Adds docs (corpus, doc, text and whatever else) as a segment; gives the number of the new version.

    Only docs are read; what is there already isn't. A doc that the index has already counts as another one. An empty table
    makes a version like the one before. With replace, the new version has nothing else.
    """
    before = versions(spark, folder)
    version = before[-1] + 1 if before else 1
    old = segments(spark, folder, before[-1]) if before and not replace else []
    name = _written(folder, f"{version:08d}-{uuid.uuid4().hex}", lambda keep: retrieval.build(docs, text, keep, segment=version))
    return _commit(spark, folder, version, [*old, name])


def merge(spark: SparkSession, folder: str) -> int:
    """Makes one segment of all, from their postings, as a new version; answers stay the same, a search reads fewer files."""
    index, version = load(spark, folder), versions(spark, folder)[-1] + 1
    name = _written(folder, f"{version:08d}-{uuid.uuid4().hex}", lambda keep: retrieval.blocked(index.postings, index.docs, keep, segment=version))
    return _commit(spark, folder, version, [name])


def vacuum(spark: SparkSession, folder: str, keep_versions: int = 2) -> list[str]:
    """Removes all but the last versions, and the segments that none of those has; gives the names of the latter.

    For a writer that is alone: a segment that another one is about to commit would go, too.
    """
    known = versions(spark, folder)
    if not known:
        return []
    held = {s for v in known[-keep_versions:] for s in segments(spark, folder, v)}
    for v in known[:-keep_versions]:
        fs, path = _path(spark, folder, "versions", str(v))
        fs.delete(path, False)
    fs, path = _path(spark, folder, "segments")
    gone = sorted(n for n in (x.getPath().getName() for x in fs.listStatus(path)) if n not in held)
    for n in gone:
        fs.delete(_path(spark, folder, "segments", n)[1], True)
    return gone


def load(spark: SparkSession, folder: str, version: int | None = None) -> retrieval.Index:
    """The index as of a version, or as of now: the version file is read once, here."""
    known = versions(spark, folder)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"no such version of an index in {folder}: {version}")
    names = segments(spark, folder, known[-1] if version is None else version)
    docs, blocks, sizes = (spark.read.parquet(*(f"{folder}/segments/{n}/{t}" for n in names)) for t in TABLES)
    return retrieval.Index(docs, blocks, sizes)
