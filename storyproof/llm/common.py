"""What the operators of this subpackage share: shared-folder tables, Arrow maps and a vectorised tokenizer."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import io
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from storyproof.sources.readers import spread
from storyproof.sources.store import materialize, shared_dir  # noqa: F401

#: Bounds of an Arrow batch: rows, and bytes beyond which no further row is added.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}
PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a session, so that their Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_storyproof_shipped", False):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent))
    path = os.path.join(tempfile.mkdtemp(prefix="storyproof-code-"), "storyproof_code.zip")
    Path(path).write_bytes(packed.getvalue())
    atexit.register(shutil.rmtree, os.path.dirname(path), True)
    sc.addPyFile(path)
    sc._storyproof_shipped = True


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow(f, schema) in batches of bounded rows and bytes, so that a worker holds few texts at once.

    The bounds are settings of the session; they are lowered to BATCH where they are higher. Workers outlive their tasks; what a
    task has freed goes back to the system at its end. f sees the names of df and yields columns in the order of the schema; in
    between, columns go by place, so they may have any names, with dots or backticks in them, too.
    """
    spark = df.sparkSession
    ship(spark)
    for name, most in BATCH.items():
        now = spark.conf.get(name, None)
        if now is None or not 0 < _bytes(now) <= most:
            spark.conf.set(name, str(most))
    names, schema = df.columns, StructType.fromDDL(schema) if isinstance(schema, str) else schema
    places = [f"c{i}" for i in range(len(schema))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for made in f(b.rename_columns(names) for b in batches):
                yield made.rename_columns(places)
        finally:
            freed()

    by_place = StructType([StructField(p, x.dataType, x.nullable) for p, x in zip(places, schema.fields, strict=True)])
    made = df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(run, by_place)
    return made.toDF(*schema.names)


def column(name: str) -> Column:
    """The column of a name that may hold dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def _bytes(setting: str) -> int:
    """A number with or without a unit of bytes."""
    digits = setting.lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(digits[-1:], 0)
    return int(digits[:-1] if unit else digits) << unit


def freed() -> None:
    """Gives memory that is free in this process back to the system, where the platform can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def fresh(name: str, df: DataFrame) -> str:
    """A column name like the given one that df doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table of documents; one that is a single small file is dealt to all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def payloads(column: pa.Array) -> list[bytes]:
    """Each string of an Arrow column in UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of items whose sizes add up to at most limit, or of one larger item."""
    first = held = i = 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield first, i
            first, held = i, 0
        held += max(size, 1)
    if held:
        yield first, i + 1


def bounded(df: DataFrame, rows: int, size: int, *texts: str) -> bool:
    """Whether df has at most so many rows and bytes of text: what may be gathered on the driver and sent to all executors."""
    total = sum((F.coalesce(F.octet_length(F.col(c).cast("binary")), F.lit(0)) for c in texts), F.lit(0))
    n, b = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(total), F.lit(0))).first()
    return n <= rows and b <= size


# Bytes of a word after lower-casing A-Z: digits, letters and everything beyond ASCII.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True
#: The same for words that are runs of anything but ASCII space.
NO_SPACE = np.ones(256, dtype=bool)
NO_SPACE[9:14] = NO_SPACE[32] = False

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of the word hash and of its inverse, modulo 2**64."""
    size = max(1 << 16, 1 << (n - 1).bit_length())
    if size not in _powers:
        with np.errstate(over="ignore"):
            ones = lambda x: np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, x, dtype=np.uint64)]))
            made = ones(_BASE), ones(_INVERSE)
        if size > 1 << 23:
            return made
        _powers[size] = made
    return _powers[size]


def mixed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit integers with their bits mixed, in place."""
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


class Words:
    """The words of some texts, found in whole arrays: text has each word's text, start and end its bytes, hash its 64-bit hash.

    first has, for each text and once more at the end, the number of words before it.
    """

    def __init__(self, texts: list[bytes], prefix: int = 0, suffix: int = 0, inside: np.ndarray = IN_WORD):
        joined = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        data = LOWER[joined]
        inside = inside[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edges = np.concatenate([[0], edges])
        self.start, self.end = edges[0::2], edges[1::2]
        ends = np.cumsum(np.fromiter((len(x) + 1 for x in texts), dtype=np.int64, count=len(texts)))
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)])
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        up, down = _power(len(data) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
            part = lambda s, e: mixed((sums[e] - sums[s]) * down[s])
            self.hash = part(self.start, self.end)
            self.prefix = part(self.start, np.minimum(self.start + prefix, self.end)) if prefix else None
            self.suffix = part(np.maximum(self.end - suffix, self.start), self.end) if suffix else None
