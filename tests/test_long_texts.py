"""Text files read in ranges: the same chunks as from whole texts, whatever the ranges."""

import random

import pytest

from storyproof.config import Chunking
from storyproof.operators import chunking, long_texts
from storyproof.sources import readers

CFG = Chunking(12, 3, 3)


def texts(folder):
    """Files with headings anywhere, all line ends, long lines, no line end at the end, and no words."""
    pick = random.Random(5)
    words = ["the", "Old", "naïve", "Harbour", "sea-wall", "Anna", "chapter", "x", "été", "«Oui»", "John"]
    folder.mkdir()
    for i, end in enumerate(["\n", "\r\n", "\r", "\n", "\n"]):
        lines = []
        for j in range(40):
            kind = pick.random()
            lines.append("" if kind < 0.2 else f"  Chapter {j}" if kind < 0.25 else f"CHAPTER {j} of the sea" if kind < 0.33 and i != 3 else " ".join(pick.choices(words, k=pick.randint(1, 40))))
        lines = [x.replace("chapter", "room") if i == 3 else x for x in lines]
        text = end.join(lines) + (end if i % 2 else "")
        (folder / f"book {i}+1.txt").write_bytes(text.encode("latin-1" if i == 1 else "utf-8"))
    (folder / "one line.txt").write_text("Chapter 1 " + " ".join(pick.choices(words, k=3000)))
    (folder / "nothing.txt").write_bytes(b"")
    (folder / "blank.txt").write_bytes(b"\n \n\n")
    (folder / "return.txt").write_bytes(b"Chapter\r\nAnna and the sea\r")
    (folder / "heading.txt").write_bytes(b"Preface\nChapter 1\n\nChapter 2")


def rows(df):
    return sorted(repr(r) for r in df.select(sorted(df.columns)).collect())


@pytest.mark.parametrize("size", [400, 10_000_000])
def test_ranges_of_any_size_give_the_chunks_of_whole_texts(spark, tmp_path, monkeypatch, size):
    folder = tmp_path / "books"
    texts(folder)
    want = rows(chunking.chunks(readers.novels(spark, str(folder)), CFG, "r"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    monkeypatch.setattr(long_texts, "CUT", 50)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 16)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        found = long_texts.chunks(spark, [str(folder)], CFG, "r")
        assert rows(found) == want and len(want) > 150
        assert long_texts.ranges(spark, str(folder)).select("file_path", "block").distinct().count() > (15 if size == 400 else 6)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_what_is_kept_of_files(spark, tmp_path):
    texts(tmp_path / "books")
    kept = ("book_name", "file_name", "byte_len", "sha256", "encoding")
    assert rows(long_texts.registry(spark, str(tmp_path / "books")).select(*kept)) == rows(readers.novels(spark, str(tmp_path / "books")).select(*kept))


def test_a_byte_order_mark_is_no_text(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfChapter 1\nAnna went home.")
    found = long_texts.chunks(spark, [str(tmp_path / "a.txt")], CFG)
    assert [(r["chapter_title"], r["chunk_text"], r["char_start"]) for r in found.collect()] == [("Chapter 1", "Chapter 1 Anna went home.", 0)]
