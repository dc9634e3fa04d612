"""Chunks of text files of any size: files are read in ranges, and what a range can't know is carried on from the ranges before."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyproof.config import Chunking
from storyproof.functions.text import title_code
from storyproof.operators.chunking import ahead, anchored, described, with_entities
from storyproof.sources.readers import file_name_of, stem_of
from storyproof.sources.paths import Files
from storyproof.sources.store import materialize

#: Words of a line that are one row at most.
CUT = 4096


def ranges(spark: SparkSession, *paths: str) -> DataFrame:
    """The lines of text files with the range of the file that they begin in: file_path, file_size, block, row, value.

    Ranges are as large as spark.sql.files.maxPartitionBytes; row orders the lines of one. Lines end in a line feed only.
    """
    read = spark.read.option("lineSep", "\n").text(list(paths))
    return read.select("_metadata.file_path", "_metadata.file_size", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")


def encodings(lines: DataFrame) -> DataFrame:
    """For each range of ranges(): whether its file is UTF-8, and how many characters at its end no line feed stands for (0 or 1).

    A file is UTF-8 if all its lines are. A last line without a line feed is told by the size of the file.
    """
    size = F.sum(F.octet_length("value") + F.lit(1).cast("long"))
    of_range = lines.groupBy("file_path", "block").agg(size.alias("bytes"), F.max("file_size").alias("file_size"), F.bool_and(F.is_valid_utf8("value")).alias("valid"), F.max_by(F.endswith("value", F.lit("\r")), "row").alias("returned"))
    of_file = Window.partitionBy("file_path")
    over = F.col("file_size") - F.sum("bytes").over(of_file)
    returned = F.max_by("returned", "block").over(of_file)
    # a byte order mark, three bytes that the reader skips, may stand before the first line
    return of_range.select("file_path", "block", F.bool_and("valid").over(of_file).alias("utf8"), F.when(over.isin(-1, 2) & ~returned, F.lit(1)).otherwise(F.lit(0)).alias("missing"))


def pieces(lines: DataFrame, known: DataFrame, pattern: str) -> DataFrame:
    """Lines as pieces that begin at headings or after CUT words, with what their range has before them.

    file_path, block, missing; n, the characters of a line with its end, on its first piece; words, joined by a space, count and
    length, a space after each; sums of n, count and length before the piece; heads, the headings up to it; head, the last one.
    """
    text = F.when(F.col("utf8"), F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    ended = lines.join(known, ["file_path", "block"]).withColumn("_text", F.regexp_replace(F.concat(text, F.lit("\n")), "\r\n?", "\n"))
    # sums run on within a task: a range is in one, as scans and joins by range leave it, and lies in order there
    ended = ended.select("file_path", "block", "row", "missing", "_text").sortWithinPartitions("file_path", "block", "row")
    parts = F.transform(F.split("_text", ahead(pattern)), lambda p: F.struct(F.regexp_extract(p, anchored(pattern), 0).alias("title"), F.length(p).alias("n"), F.regexp_extract_all(p, F.lit(r"(?U)\S+"), F.lit(0)).alias("words")))
    cut = ended.select("file_path", "block", "missing", F.inline(parts))
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size("words") / CUT).cast("int") - 1))).alias("_at")
    first = F.col("_at") == 0
    told = cut.select("*", at).select(
        "file_path", "block", "missing", F.when(first, F.trim("title")).otherwise("").alias("title"), F.when(first & (F.col("title") != ""), F.lit(1)).otherwise(F.lit(0)).alias("begins"),
        F.when(first, F.col("n")).otherwise(0).cast("long").alias("n"), F.slice("words", F.col("_at") * CUT + 1, CUT).alias("_words"),
    )
    count = F.size("_words").cast("long")
    joined = told.select("file_path", "block", "missing", "title", "begins", "n", F.array_join("_words", " ").alias("words"), count.alias("count"))
    sized = joined.withColumn("length", F.when(F.col("count") > 0, F.length("words") + 1).otherwise(0).cast("long"))
    return sized.mapInArrow(_summed, PIECE)


PIECE = "file_path string, block long, missing int, n long, words string, count long, length long, chars long, counted long, lengths long, heads long, head struct<title:string,chars:long,counted:long,lengths:long>"
SUMS = ("chars", "counted", "lengths", "heads")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the sums of a range before each of its rows, and the last heading up to it; a range may go on in the next batch."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    key, total, last = None, dict.fromkeys(SUMS, 0), None
    for b in batches:
        if not b.num_rows:
            continue
        path, block = b.column("file_path"), b.column("block")
        rows = np.arange(b.num_rows)
        fresh = np.empty(b.num_rows, dtype=bool)
        fresh[0] = key != (path[0].as_py(), block[0].as_py())
        fresh[1:] = pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(block[1:], block[:-1])).to_numpy(zero_copy_only=False)
        start = np.maximum.accumulate(np.where(fresh, rows, -1))
        goes_on = start < 0
        sums = {}
        for name, of in zip(SUMS, ("n", "count", "length", "begins"), strict=True):
            x = b.column(of).to_numpy().astype(np.int64)
            before = np.cumsum(x) - x
            sums[name] = before - before[np.maximum(start, 0)] + np.where(goes_on, total[name], 0)
            total[name] = int(sums[name][-1] + x[-1])
        begins = b.column("begins").to_numpy() > 0
        heads = sums["heads"] + begins
        at = np.maximum.accumulate(np.where(begins, rows, -1))
        here = at >= np.maximum(start, 0)
        take = np.where(here, at, 0)
        # a heading of an earlier batch stands behind the rows of this one
        earlier = ~here & goes_on & (last is not None)
        old = last or ("", 0, 0, 0)
        titles = pa.concat_arrays([b.column("title"), pa.array([old[0]], pa.string())]).take(pa.array(np.where(earlier, b.num_rows, take)))
        places = [np.where(earlier, v, sums[k][take]) for k, v in zip(SUMS[:3], old[1:], strict=True)]
        none = ~(here | earlier)
        head = pa.StructArray.from_arrays([titles, *(pa.array(p) for p in places)], ["title", *SUMS[:3]], mask=pa.array(none))
        last = None if none[-1] else (titles[-1].as_py(), *(int(p[-1]) for p in places))
        key = path[-1].as_py(), block[-1].as_py()
        kept = [b.column(c) for c in ("file_path", "block", "missing", "n", "words", "count", "length")]
        yield pa.RecordBatch.from_arrays([*kept, *(pa.array(sums[k]) for k in SUMS[:3]), pa.array(heads.astype(np.int64)), head], ["file_path", "block", "missing", "n", "words", "count", "length", *SUMS, "head"])


def placed(cut: DataFrame) -> DataFrame:
    """Pieces with words, placed in their chapters: no, chapter_title, chapter_start, full_len, word_from and length_from.

    Only sums of ranges meet in a file, so no file is sorted in one task, and texts aren't shuffled. What stands before the first
    heading is dropped; a file without headings is one chapter 0.
    """

    def moved(of: Column) -> Column:
        """A heading of a range as one of the file."""
        return F.when(of.isNotNull(), F.struct(of["title"].alias("title"), *((of[k] + F.col(f"before_{k}")).alias(k) for k in SUMS[:3])))

    all_of = {"chars": F.sum("n"), "counted": F.sum("count"), "lengths": F.sum("length"), "heads": F.max("heads")}
    sums = cut.groupBy("file_path", "block").agg(*(v.alias(f"_{k}") for k, v in all_of.items()), F.max(F.when(F.col("head").isNotNull(), F.struct("heads", "head")))["head"].alias("_head"), F.max("missing").alias("missing"))
    of_file, earlier = Window.partitionBy("file_path"), Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({f"before_{k}": F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)) for k in SUMS})
    sums = sums.withColumn("carried", F.last(moved(F.col("_head")), ignorenulls=True).over(earlier))
    sums = sums.withColumns({"full_len": F.sum("_chars").over(of_file) - F.max("missing").over(of_file), "all_heads": F.sum("_heads").over(of_file)})
    # stored, so that the join knows how small they are before it deals out texts
    sums = materialize(sums.select("file_path", "block", *(f"before_{k}" for k in SUMS), "carried", "full_len", "all_heads"), "range-sums")
    whole = F.struct(F.lit("NO_CHAPTER").alias("title"), *(F.lit(0).cast("long").alias(k) for k in SUMS[:3]))
    joined = cut.where("count > 0").join(sums, ["file_path", "block"]).withColumn("own", F.coalesce(moved(F.col("head")), "carried", whole)).withColumn("no", F.col("before_heads") + F.col("heads"))
    return joined.where("no > 0 or all_heads = 0").select(
        "file_path", "no", F.col("own.title").alias("chapter_title"), F.col("own.chars").alias("chapter_start"), "full_len", "words", "count",
        (F.col("before_counted") + F.col("counted") - F.col("own.counted")).alias("word_from"), (F.col("before_lengths") + F.col("lengths") - F.col("own.lengths")).alias("length_from"),
    )


def windows(within: DataFrame, cfg: Chunking) -> DataFrame:
    """The windows of placed pieces, as chunking.windows() makes them of whole chapters: each gathers the words it has of a piece.

    A window has at most as many pieces as words. One that only repeats the end of the window before it is no window.
    """
    step, most, n = cfg.step, cfg.window_words, F.col("count")
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("word_from") - most) / step) + 1)
    last = F.floor((F.col("word_from") + n - 1) / step)
    at = within.withColumns({"_first": first, "_last": last}).where("_first <= _last").withColumn("_split", F.split("words", " ")).withColumn("nth", F.explode(F.sequence("_first", "_last")))
    begins = F.col("nth") * step - F.col("word_from")
    lo, hi = F.greatest(F.lit(0), begins).cast("int"), F.least(n, begins + most).cast("int")
    length = F.col("length_from") + F.when(lo > 0, F.length(F.array_join(F.slice("_split", F.lit(1), lo), " ")) + 1).otherwise(0)
    some = F.when((lo == 0) & (hi == n), F.col("words")).otherwise(F.array_join(F.slice("_split", lo + 1, hi - lo), " "))
    held = at.where(lo < hi).select("file_path", "no", "chapter_title", "chapter_start", "full_len", "nth", F.struct("word_from", some.alias("words")).alias("_held"), (hi - lo).alias("_count"), length.alias("_length"))
    made = held.groupBy("file_path", "no", "nth").agg(
        *(F.max(c).alias(c) for c in ("chapter_title", "chapter_start", "full_len")), F.min("_length").alias("before"), F.sum("_count").alias("_count"), F.array_join(F.transform(F.array_sort(F.collect_list("_held")), lambda h: h["words"]), " ").alias("chunk_text")
    )
    word_start = F.col("nth") * step
    told = made.where((F.col("nth") == 0) | (F.col("_count") > most - step)).withColumns({"word_start": word_start, "word_end": word_start + F.col("_count")})
    return told.withColumn("chapter_id", F.format_string("ch%03d", "no")).drop("_count", "no")


def windows_of(spark: SparkSession, paths: list[str], cfg: Chunking) -> DataFrame:
    """The windows of text files with their book_name, as chunking.described() takes them; the files aren't read after this."""
    lines = ranges(spark, *paths)
    cut = materialize(pieces(lines, materialize(encodings(lines), "encodings"), cfg.chapter_regex), "pieces", compression="zstd")
    return windows(placed(cut), cfg).withColumn("book_name", stem_of(file_name_of(F.col("file_path")))).drop("file_path")


def chunks(spark: SparkSession, paths: list[str], cfg: Chunking | None = None, run_id: str = "") -> DataFrame:
    """The chunk table of text files: the rows of chunking.chunks(readers.novels()), but no text of a file or chapter is one row.

    Ranges may be of any size. A heading is looked for within a line; a line with its end, which a reader must hold anyway, is
    the longest text in memory. A byte order mark is no text. Files without words have no chunks.
    """
    cfg = cfg or Chunking()
    return with_entities(described(windows_of(spark, paths, cfg), title_code(F.col("book_name")), cfg), run_id)


def registry(spark: SparkSession, *paths: str) -> DataFrame:
    """What is kept of each text file, as readers.novels() gives it, without the text: files of any size, read part by part."""
    there = spark.read.format("binaryFile").load(list(paths)).select("_metadata.file_path", F.col("length").alias("byte_len"))
    utf8 = encodings(ranges(spark, *paths)).groupBy("file_path").agg(F.bool_and("utf8").alias("utf8"))
    known = there.join(digests(there.select("file_path")), "file_path").join(utf8, "file_path", "left")
    name = file_name_of(F.col("file_path"))
    encoding = F.when(F.coalesce("utf8", F.lit(True)), F.lit("utf-8")).otherwise(F.lit("latin-1"))
    return known.select(stem_of(name).alias("book_name"), name.alias("file_name"), "file_path", "byte_len", "sha256", encoding.alias("encoding"), F.current_timestamp().alias("ingest_ts"))


def digests_of(spark: SparkSession, *paths: str) -> dict[str, str]:
    """The SHA-256 of each of some files, named as they were given."""
    uris = {p: Files(spark).uri(p) for p in paths}
    found = dict(map(tuple, digests(spark.createDataFrame([(u,) for u in uris.values()], "file_path string")).collect()))
    return {p: found[u] for p, u in uris.items()}


def digests(files: DataFrame) -> DataFrame:
    """(file_path, sha256) of files by their URIs, which executors read a megabyte at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            uris = batch.column(0).to_pylist()
            found = []
            for uri in uris:
                fs, path = pyarrow.fs.FileSystem.from_uri(uri)
                digest = hashlib.sha256()
                with fs.open_input_stream(path, compression=None) as data:
                    while part := data.read(1 << 20):
                        digest.update(part)
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(uris, pa.string()), pa.array(found, pa.string())], ["file_path", "sha256"])

    return files.mapInArrow(run, "file_path string, sha256 string")
