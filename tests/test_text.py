"""Scalar functions against plain versions and fixed expectations."""

import re

import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storyproof.config import Chunking
from storyproof.functions import names, normal
from storyproof.functions import text as T
from storyproof.operators import chunking, statements
from storyproof.plans import catalog

QUIET = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def test_clean_and_keys(spark):
    assert one(spark, T.clean(F.col("a")), a="  “it’s”\n\t so ") == '"it\'s" so'
    assert one(spark, T.clean(F.col("a")), a=None) == ""
    assert one(spark, T.mention_key(F.col("a")), a="Edmond Dantès!") == "edmond dant s"
    assert one(spark, T.title_key(F.col("a")), a=" The Count of Monte-Cristo ") == "thecountofmontecristo"
    assert one(spark, T.title_code(F.col("a")), a="In Search of the Castaways") == "castaways"
    assert one(spark, T.title_code(F.col("a")), a="The Count of Monte Cristo") == "montecristo"
    assert one(spark, T.title_code(F.col("a")), a="Emma") == "emma"
    assert one(spark, T.title_code(F.col("a")), a="!") == "book"
    assert one(spark, T.title_code(F.col("a")), a="abcdefghijklmnopqrst") != one(spark, T.title_code(F.col("a")), a="abcdefghijklmnopzzzz")


def test_sentences_and_clauses(spark):
    assert one(spark, T.sentences(F.col("a")), a='He said "no." Then left!\nDone') == ['He said "no."', "Then left!", "Done"]
    assert one(spark, T.clauses(F.col("a")), a="Born poor, he rose; but fell (twice) – and Andy stayed") == ["Born poor, he rose", "fell", "twice", "Andy stayed"]
    assert one(spark, T.sentence_spans(F.col("a")), a="One. Two?! three") == ["One. ", "Two?! ", "three"]


def test_statements(spark):
    text = "He was born. It is of the by. He sailed far away to the south; his wife stayed! Too short"
    assert one(spark, statements.statements(F.col("a")), a=text) == ["He was born.", "He sailed far away to the south.", "his wife stayed!"]
    assert one(spark, statements.statements(F.col("a")), a=None) == []


def test_sentences_of_joining_words(spark, tmp_path):
    """Runs keep them whole, as the source does; the query and its SQL have no statement of them."""
    text = " ".join(["And"] * 12)
    assert one(spark, statements.statements(F.col("a")), a=text) == [f"{text}."]
    rows = [(1, text), (2, f"He was born. {text}\n; : ( and so\nHe sailed far away to the south")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, catalog.QUERIES["statement_split"](spark, str(tmp_path)).collect()))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(duck.execute(catalog.SQL["statement_split"]).fetchall()) == [(2, 1, "He was born."), (2, 2, "He sailed far away to the south.")]


def test_all_statements_of_long_texts(spark, tmp_path):
    """However many a text has, in one sentence or in many, repeated or not; runs take as many claims as the source unless told otherwise."""
    said = {1: [f"He was born in {i}." for i in range(300)], 2: [f"she was born in {i}" for i in range(1, 200)] + ["she was born."], 3: ["He was born."] * 81, 4: ["He was born."]}
    rows = [(1, "\n".join(said[1])), (2, "; ".join(said[2])), (3, " ".join(said[3])), (4, said[4][0]), (5, ""), (6, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, catalog.QUERIES["statement_split"](spark, str(tmp_path)).collect()))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == [(k, i, s if s.endswith(".") else f"{s}.") for k, v in said.items() for i, s in enumerate(v, 1)]
    assert got == sorted(duck.execute(catalog.SQL["statement_split"]).fetchall())
    summary = spark.createDataFrame([(1, "b", "Ayrton", rows[0][1])], "id long, book_name string, char string, content string")
    assert [statements.claims(summary, "train", **most).count() for most in ({}, {"most": None})] == [statements.MOST, 300]


def test_aliases(spark):
    made = one(spark, names.aliases(F.col("a")), a="Edmond  Dantès")
    assert {"Edmond Dantès", "Edmond", "Dantès", "Mr. Dantès", "Mlle. Dantès", "Count Dantès"} <= set(made)
    assert made == sorted(made) and len({a.lower() for a in made}) == len(made)
    assert one(spark, names.aliases(F.col("a")), a="Ayrton") == ["Ayrton"]
    assert one(spark, names.aliases(F.col("a")), a="none") == []


def test_mentions_and_standalone(spark):
    def said(claim, char="Jacques Paganel"):
        return one(spark, names.standalone(F.col("c"), names.aliases(F.col("c")), F.col("t")), c=char, t=claim)

    assert said("his mother died.") == "Jacques Paganel's mother died."
    assert said("They sailed on.") == "Jacques Paganel sailed on."
    assert said("Paganel sailed on.") == "Paganel sailed on."
    assert said("boyhood was hard.") == "Jacques Paganel's boyhood was hard."
    assert said("Paganelli sailed on.") == "Jacques Paganel Paganelli sailed on."
    assert said("hers was a hard life.") == "Jacques Paganel hers was a hard life."


def test_predicates(spark):
    p = one(spark, T.predicate(F.col("c"), F.col("t")), c="A \"B\" C", t="he said, \"no\"")
    assert p == "Claim(\"A 'B' C\", \"he said, 'no'\")"
    assert one(spark, T.predicate_name(F.col("p")), p=p) == "Claim"
    assert one(spark, T.predicate_name(F.col("p")), p="no predicate") is None
    assert one(spark, T.predicate_args(F.col("p")), p='BornIn(Lord_G, "Scotland")') == ["Lord_G", "Scotland"]
    assert one(spark, T.predicate_args(F.col("p"), whole_object=False), p='Claim("A", "b, c")') == ["A", "b", "c"]


def test_plain(spark):
    assert one(spark, normal.plain(F.col("a")), a="Mercédès —  L’Abbé\n") == "mercedes l'abbe"
    assert one(spark, normal.named(F.col("a"), F.array(F.lit("lord glenarvan"))), a="then lord glenarvan spoke") is True
    assert one(spark, normal.named(F.col("a"), F.array(F.lit("glen"))), a="glenarvan") is False


def test_keyword_list(spark):
    assert one(spark, T.keyword_list(F.col("a")), a='["x", "y z"]') == ["x", "y z"]
    assert one(spark, T.keyword_list(F.col("a")), a="x, y z") == ["x", "y", "z"]
    assert one(spark, T.keyword_list(F.col("a")), a=None) == []


def test_title_case(spark):
    assert one(spark, names.title_case(F.col("a")), a="mrs. o'neil de la cruz") == "mrs. o'neil de la cruz".title()


def plain_windows(text: str, cfg: Chunking):
    words, out = re.findall(r"\S+", text), []
    for i, start in enumerate(range(0, len(words), cfg.step)):
        end = min(len(words), start + cfg.window_words)
        if end - start < cfg.min_chunk_words and start:
            break
        at = sum(len(w) + 1 for w in words[:start])
        out.append((i, " ".join(words[start:end]), start, end, at, at + sum(len(w) + 1 for w in words[start:end])))
        if end == len(words):
            break
    return out


@QUIET
@given(st.lists(st.text("ab \n", max_size=60), min_size=1, max_size=8), st.integers(1, 6), st.integers(0, 5), st.integers(1, 4))
def test_windows(spark, texts, window, overlap, least):
    cfg = Chunking(window, overlap, least)
    rows = spark.createDataFrame(list(enumerate(texts)), "d int, text string")
    made = chunking.windows(chunking.chapters(rows, cfg.chapter_regex), F.lit("b"), cfg)
    got = sorted((r["d"], int(r["chunk_id"][-4:]), r["chunk_text"], r["word_start"], r["word_end"], r["char_start"], r["char_end"]) for r in made.collect())
    assert got == sorted((d, *w) for d, t in enumerate(texts) for w in plain_windows(t, cfg))


def test_chapters(spark):
    text = "before\nChapter I\none\nCHAPITRE II x\ntwo\n"
    made = chunking.chapters(spark.createDataFrame([(1, text), (2, "none at all"), (3, None)], "d int, text string")).orderBy("d", "chapter_start").collect()
    assert [(r["d"], r["chapter_id"], r["chapter_title"], r["chapter_text"], r["chapter_start"]) for r in made] == [
        (1, "ch001", "Chapter I", "Chapter I\none\n", 7), (1, "ch002", "CHAPITRE II x", "CHAPITRE II x\ntwo\n", 21), (2, "ch000", "NO_CHAPTER", "none at all", 0), (3, "ch000", "NO_CHAPTER", "", 0),
    ]
