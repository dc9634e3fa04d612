"""Results as files in any store: tables, dossiers and packages by the executors, the few small files of a run by the driver."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyproof.sources.paths import Files

START, END = "<!-- AUTO:EVAL:START -->", "<!-- AUTO:EVAL:END -->"


def parquet(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nested columns become JSON."""
    nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "struct", "map")]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def files(df: DataFrame, folder: str, name: str = "id", text: str = "markdown", suffix: str = ".md") -> DataFrame:
    """One file for each row, written by the executors to a store that they share; gives (name, path, bytes) of the files.

    A repeated task writes the same file again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        for b in batches:
            fs.create_dir(base, recursive=True)
            out = []
            for n, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = (t or "").encode()
                with fs.open_output_stream(f"{base}/{n}{suffix}") as f:
                    f.write(data)
                out.append((n, f"{folder}/{n}{suffix}", len(data)))
            columns = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["name", "path", "bytes"])

    return df.select(F.col(name).cast("string"), text).mapInArrow(run, "name string, path string, bytes long")


def manifest(store: Files, path: str, payload: dict) -> str:
    return store.write(path, json.dumps(payload, indent=2, ensure_ascii=False, default=str))


def zipped(spark: SparkSession, path: str, members: dict[str, str]) -> str:
    """A zip of files by their names in it, made by one task in the store of the path, a part of a file at a time.

    What isn't there is left out, folders are taken whole, but for files whose names begin with a dot or an underscore. A
    repeated task writes the same file again. The driver sees nothing of the files.
    """
    store = Files(spark)
    sources, target = {n: store.uri(p) for n, p in members.items()}, store.uri(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import shutil
        import zipfile

        import pyarrow.fs

        asked = sum(b.num_rows for b in batches)
        if not asked:
            return
        fs, base = pyarrow.fs.FileSystem.from_uri(target)
        n = 0
        with fs.open_output_stream(base) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, uri in sources.items():
                from_fs, source = pyarrow.fs.FileSystem.from_uri(uri)
                kind = from_fs.get_file_info(source).type
                if kind == pyarrow.fs.FileType.File:
                    found = [(name, source)]
                elif kind == pyarrow.fs.FileType.Directory:
                    inside = from_fs.get_file_info(pyarrow.fs.FileSelector(source, recursive=True))
                    paths = sorted((f.path[len(source) :].strip("/"), f.path) for f in inside if f.type == pyarrow.fs.FileType.File)
                    found = [(f"{name}/{short}", full) for short, full in paths if not any(x[0] in "._" for x in short.split("/"))]
                else:
                    found = []
                for member, full in found:
                    with from_fs.open_input_stream(full, compression=None) as data, z.open(member, "w", force_zip64=True) as to:
                        shutil.copyfileobj(data, to, 1 << 20)
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["members"])

    spark.range(1).coalesce(1).mapInArrow(run, "members long").collect()
    return path


def put_section(old: str, section: str) -> str:
    """old with the section between its marks replaced, or appended; doing it again changes nothing."""
    block = f"{START}\n{section.strip()}\n{END}\n"
    if START in old and END in old:
        before, after = old.split(START, 1)[0], old.split(END, 1)[1]
        return before.rstrip() + "\n\n" + block + after.lstrip("\n")
    return old.rstrip() + "\n\n" + block


def run_report(run_id: str, has_dossiers: bool) -> str:
    parts = [f"# Run Report — {run_id}\n", "This package contains the outputs of one run.\n", "## Included", "- results.csv", "- run_manifest.json"]
    return "\n".join([*parts, *(["- dossiers (zip)"] if has_dossiers else [])]) + "\n"
