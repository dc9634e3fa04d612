"""Small files and listings of any store that Spark's file systems know, named as the user names them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Files:
    """Reads, writes, lists and copies through the session's file systems; paths are plain or have a scheme."""

    spark: SparkSession

    def _at(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.conf), where

    @property
    def conf(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    def uri(self, path: str) -> str:
        """The path with its scheme and with what URIs must not hold encoded, as executors need it."""
        fs, where = self._at(path)
        made = fs.makeQualified(where).toUri().toString()
        return "file://" + made.removeprefix("file:") if made.startswith("file:/") and not made.startswith("file://") else made

    def exists(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.exists(where)

    def names(self, folder: str) -> list[str]:
        """What lies in a folder, sorted; nothing if it isn't there."""
        fs, where = self._at(folder)
        return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []

    def write(self, path: str, text: str) -> str:
        fs, where = self._at(path)
        out = fs.create(where, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return path

    def read(self, path: str) -> str:
        """A small file's text; Spark reads it, so its store need not be the driver's."""
        return bytes(self.spark.read.format("binaryFile").load(path).select("content").first()[0]).decode()

    def copy(self, source: str, target: str) -> None:
        """A file into another place, maybe of another store, replacing what is there."""
        (a, old), (b, new) = self._at(source), self._at(target)
        self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(a, old, b, new, False, True, self.conf)
