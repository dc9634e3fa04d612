"""Tables between steps: Parquet in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, or what was given to setCheckpointDir.

    Only a local session, where driver and executors are one process, may do without: it gets a folder of this machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="storyproof-")
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(shutil.rmtree, found.removeprefix("file://"), True)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return re.sub("^file:/(?!/)", "file:///", found).rstrip("/")


_written: dict[str, tuple] = {}


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses; what is there when this process ends is removed then."""
    if not _written:
        atexit.register(_clean)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written[path] = (spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration())
    return path


def remove(path: str) -> None:
    """Deletes one of those paths, if it can be reached."""
    jvm, conf = _written.pop(path)
    with contextlib.suppress(Exception):
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def _clean() -> None:
    for path in list(_written):
        remove(path)


#: Parquet of rows of megabytes: sizes are looked at after each row, else a hundred rows are held before a page or row group
#: can end, and a reader has as many in memory at once.
WIDE = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}


def materialize(df: DataFrame, name: str, replaces: DataFrame | None = None, compression: str | None = None, wide: bool = False) -> DataFrame:
    """df written as Parquet into the shared folder and read back: lineage ends there, and lost executors lose nothing.

    replaces is a table made here before that nothing needs any more once the new one is there; it is removed. compression is
    that of the files, where it should not be the session's. wide is for rows of megabytes, of which only a few should be in
    memory at once.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**(WIDE if wide else {})).parquet(path, compression=compression)
    if old := getattr(replaces, "_stored_at", None):
        remove(old)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out
