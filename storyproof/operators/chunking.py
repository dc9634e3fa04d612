"""Chapters of a text and overlapping windows of words in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyproof.config import Chunking
from storyproof.functions import lexicon
from storyproof.functions.text import among, bucket, let, text_or_empty, title_code


def chapters(texts: DataFrame, pattern: str = Chunking.chapter_regex) -> DataFrame:
    """texts (text and whatever else) with chapter_id, chapter_title, chapter_text, chapter_start, full_len; one row a chapter.

    A chapter begins at a heading and ends at the next; what stands before the first is dropped. A text without headings is
    one chapter ch000. A null text counts as empty.
    """
    text = text_or_empty(F.col("text"))
    parts = F.transform(F.split("_text", ahead(pattern)), lambda p: F.struct(p.alias("text"), F.regexp_extract(p, anchored(pattern), 0).alias("title"), F.length(p).alias("n")))
    sizes = F.transform("_parts", lambda p: p["n"])
    placed = F.transform("_parts", lambda p, i: F.struct(p["title"].alias("title"), p["text"].alias("text"), _before(i).alias("start")))
    made = F.filter("_placed", lambda p: p["title"] != "")
    numbered = F.transform("_made", lambda p, i: F.struct(F.format_string("ch%03d", i + 1).alias("chapter_id"), F.trim(p["title"]).alias("chapter_title"), p["text"].alias("chapter_text"), p["start"].alias("chapter_start")))
    whole = F.array(F.struct(F.lit("ch000").alias("chapter_id"), F.lit("NO_CHAPTER").alias("chapter_title"), F.col("_text").alias("chapter_text"), F.lit(0).alias("chapter_start")))
    kept = [c for c in texts.columns if c != "text"]
    cut = texts.select(*kept, text.alias("_text")).withColumn("_parts", parts).withColumn("_sizes", sizes).withColumn("_sums", _block_sums("_sizes")).withColumn("_placed", placed).withColumn("_made", made)
    return cut.select(*kept, F.length("_text").alias("full_len"), F.inline(F.when(F.size("_made") > 0, numbered).otherwise(whole)))


BLOCK = 128


def _added(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, b: a + b)


def _block_sums(sizes: str) -> Column:
    """The sums of each BLOCK numbers in a row, so that a sum of the first i needs few steps."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(sizes) / BLOCK).cast("int")), lambda b: _added(F.slice(sizes, b * BLOCK + 1, BLOCK)))


def _before(i: Column) -> Column:
    """The sum of the first i of _sizes."""
    blocks = F.floor(i / BLOCK).cast("int")
    return _added(F.slice("_sums", F.lit(1), blocks)) + _added(F.slice("_sizes", blocks * BLOCK + 1, i - blocks * BLOCK))


def _flags(pattern: str) -> tuple[str, str]:
    if pattern.startswith("(?") and ")" in pattern and pattern[2 : pattern.index(")")].isalpha():
        at = pattern.index(")") + 1
        return pattern[:at], pattern[at:]
    return "", pattern


def ahead(pattern: str) -> str:
    flags, rest = _flags(pattern)
    return f"{flags}(?={rest})"


def anchored(pattern: str) -> str:
    flags, rest = _flags(pattern)
    return f"{flags}\\A(?:{rest})"


def windows(parts: DataFrame, code: Column, cfg: Chunking | None = None) -> DataFrame:
    """The windows of the chapters above: chunk_id, chunk_text, chunk_pos, word and character offsets, time_bucket.

    Windows begin every window - overlap words; the last is the one that reaches the end. One with fewer words than the
    minimum is dropped unless it is the first. Offsets of characters count single spaces between words.
    """
    cfg = cfg or Chunking()
    step = cfg.step
    words = F.regexp_extract_all("chapter_text", F.lit(r"(?U)\S+"), F.lit(0))
    n = F.size("_words")
    last = F.when(n <= cfg.window_words, F.lit(0)).otherwise(F.ceil((n - cfg.window_words) / step).cast("int"))
    at = F.sequence(F.lit(0), last)
    # characters of the words from one window's beginning to the next one's
    blocks = F.transform(at, lambda i: F.length(F.array_join(F.slice("_words", i * step + 1, step), " ")) + 1)
    made = F.transform(
        at,
        lambda i: F.struct(
            i.alias("nth"),
            F.array_join(F.slice("_words", i * step + 1, cfg.window_words), " ").alias("chunk_text"),
            F.aggregate(F.slice("_blocks", F.lit(1), i), F.lit(0), lambda a, x: a + x).alias("before"),
            (i * step).cast("long").alias("word_start"),
            F.least(n, i * step + cfg.window_words).cast("long").alias("word_end"),
        ),
    )
    kept = [c for c in parts.columns if c != "chapter_text"]
    out = parts.withColumn("_words", words).where("size(_words) > 0").withColumn("_blocks", blocks).select(*kept, F.inline(made))
    return described(out, code, cfg)


def described(windows: DataFrame, code: Column, cfg: Chunking) -> DataFrame:
    """Windows (nth, chunk_text, characters before it in the chapter, word_start, word_end) with identifiers, places and sizes."""
    size = F.col("word_end") - F.col("word_start")
    start = (F.col("chapter_start") + F.col("before")).cast("long")
    end = start + F.length("chunk_text") + 1
    position = (start + end) / 2 / F.greatest(F.lit(1), F.col("full_len"))
    return (
        windows.where((size >= cfg.min_chunk_words) | (F.col("nth") == 0))
        .withColumns({"char_start": start, "char_end": end, "chunk_pos": F.round(position, 6), "time_bucket": bucket(position), "chunk_word_count": size, "token_count": size})
        .withColumn("chunk_id", F.concat_ws("_", code, "chapter_id", F.format_string("w%04d", F.col("nth"))))
        .drop("before", "nth", "chapter_start", "full_len")
    )


def ranked_words(found: Column, most: int) -> Column:
    """The most frequent of some words as array<struct<low,word>>, low the negative number; ties in the order of the words.

    The words are sorted once; where the runs of equal ones begin gives the numbers, so the work is that of sorting.
    """

    def runs(words: Column) -> Column:
        places = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
        return F.filter(places, lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))

    def of_runs(words: Column, starts: Column) -> Column:
        counted = F.transform(starts, lambda at, k: F.struct((at - F.coalesce(F.get(starts, k + 1), F.size(words))).alias("low"), F.get(words, at).alias("word")))
        return F.slice(F.sort_array(counted), 1, most)

    return let(F.sort_array(found), lambda words: let(runs(words), lambda starts: of_runs(words, starts)))


def counted(rows: DataFrame, keys: list[str], found: Column, most: int, name: str) -> DataFrame:
    """For each row of keys the most frequent of some words, ties in their order: (keys, rank, name, n).

    Counting, ranking and cutting happen inside the row, whose words are at hand; nothing is shuffled.
    """
    out = rows.select(*keys, F.posexplode(ranked_words(found, most)).alias("_at", "_hit"))
    return out.select(*keys, (F.col("_at") + 1).alias("rank"), F.col("_hit.word").alias(name), (-F.col("_hit.low")).alias("n"))


def entity_words(text: Column) -> Column:
    """Capitalised words of three letters or more that aren't on the list of those that are no entities."""
    return F.filter(F.regexp_extract_all(text_or_empty(text), F.lit(r"(?U)\b[A-Z][a-z]{2,}\b"), F.lit(0)), lambda w: ~among(w, lexicon.NOT_ENTITIES))


def keyword_words(text: Column) -> Column:
    """Words of four letters or more that are no stop words."""
    return F.filter(F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(r"\p{L}[\p{L}\p{M}\-']+"), F.lit(0)), lambda w: (F.length(w) >= 4) & ~among(w, lexicon.STOPWORDS))


def most_frequent(found: Column, most: int) -> Column:
    """The same ranking as an array of words."""
    return F.transform(ranked_words(found, most), lambda r: r["word"])


def chunks(novels: DataFrame, cfg: Chunking | None = None, run_id: str = "") -> DataFrame:
    """The chunk table of novels (book_name, text)."""
    cfg = cfg or Chunking()
    made = windows(chapters(novels.select("book_name", "text"), cfg.chapter_regex), title_code(F.col("book_name")), cfg)
    return with_entities(made, run_id)


def with_entities(chunks: DataFrame, run_id: str) -> DataFrame:
    entities = most_frequent(entity_words(F.col("chunk_text")), 12)
    return chunks.withColumns({"entities": entities, "entity_mentions": entities, "run_id": F.lit(run_id)})
