"""Self-contained statements from summaries of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyproof.functions import names
from storyproof.functions import text as T
from storyproof.operators.chunking import keyword_words, most_frequent

#: Claims of a summary in a run, the first ones, as in the source.
MOST = 80
#: Letters of the runs by which texts that hold one another meet.
GRAM = 4


def statements(content: Column, most: int | None = None, whole: bool = True) -> Column:
    """All clauses of a text that are worth keeping, each ended by a mark, in order, or the first so many of them; whole says what a sentence of joining words alone is."""
    parts = F.flatten(F.transform(T.sentences(F.trim(T.text_or_empty(content))), lambda s: T.clauses(s, whole)))
    kept = F.transform(F.filter(parts, T.worth_keeping), T.ended)
    return kept if most is None else F.slice(kept, 1, most)


def claims(rows: DataFrame, split: str, run_id: str = "", most: int | None = MOST) -> DataFrame:
    """The claim table of rows (id, book_name, char, content, caption where there is one), most claims a row or, if that is None, all."""
    caption = F.col("caption") if "caption" in rows.columns else F.lit(None).cast("string")
    base = rows.select(
        F.col("id").cast("long").alias("id"), "book_name", F.coalesce(F.col("raw_book_name") if "raw_book_name" in rows.columns else F.col("book_name")).alias("raw_book_name"),
        "char", caption.alias("caption"), names.aliases(F.col("char")).alias("char_aliases"), F.posexplode(statements(F.col("content"), most)).alias("_nth", "raw_claim_text"),
    )
    text = names.standalone(F.col("char"), F.col("char_aliases"), F.col("raw_claim_text"))
    return base.withColumn("claim_text", text).select(
        "id", "book_name", "raw_book_name", "char", "caption", "char_aliases", F.concat(F.col("id").cast("string"), F.lit("_c"), F.format_string("%02d", F.col("_nth") + 1)).alias("claim_id"),
        "raw_claim_text", "claim_text", F.array(T.predicate(F.col("char"), F.col("claim_text"))).alias("predicate_form"),
        F.array_sort(F.array_distinct(most_frequent(keyword_words(F.col("claim_text")), 12))).alias("keywords"),
        F.lit("UNK").alias("claim_type"), F.lit("UNK").alias("t_hint"), F.lit("POS").alias("polarity"), F.lit(split).alias("split"), F.lit(run_id).alias("run_id"), F.monotonically_increasing_id().alias("row"),
    )


def order(claims: DataFrame) -> Column:
    """The order in which claims were made: training rows first, then by the number that claims() gives them.

    Claims without that number, from elsewhere, go by the number in their claim_id, then by it and their text.
    """
    known = {c.lower() for c in claims.columns}
    number = F.regexp_extract("claim_id", r"_c(\d{1,9})$", 1).try_cast("int")
    parts = [F.col("split") == "test" if "split" in known else F.lit(False), F.coalesce("row", F.lit(0)) if "row" in known else F.lit(0), number, F.col("claim_id")]
    return F.struct(*(p.alias(f"o{i}") for i, p in enumerate([*parts, *([F.col("claim_text")] if "claim_text" in known else [])])))


def remap_titles(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """rows with book_name replaced by the pretty title of the same key, else by the first title whose key holds it or is held.

    titles (book_name, position) are the novels, as many as there may be. A title with an empty key matches nothing.
    """
    known = titles.select(F.col("book_name").alias("_pretty"), T.title_key(F.col("book_name")).alias("_key"), F.col("position").alias("_position")).where("_key <> ''")
    keyed = rows.select("book_name").distinct().withColumn("_own", T.title_key(F.col("book_name")))
    first = lambda df: df.groupBy("book_name").agg(F.min_by("_pretty", "_position").alias("_pretty"))
    same = first(keyed.join(known, F.col("_own") == F.col("_key")))
    # only names that no title equals are searched for one that holds them or is held
    rest = keyed.where("_own <> ''").join(same, "book_name", "left_anti")
    names_held = contained(rest.select(F.col("_own").alias("inner")), known.select(F.col("_key").alias("outer")))
    titles_held = contained(known.select(F.col("_key").alias("inner")), rest.select(F.col("_own").alias("outer")))
    met = names_held.select(F.col("inner").alias("_own"), F.col("outer").alias("_key")).unionByName(titles_held.select(F.col("outer").alias("_own"), F.col("inner").alias("_key"))).distinct()
    best = same.unionByName(first(rest.join(met, "_own").join(known, "_key")))
    return rows.withColumn("raw_book_name", F.col("book_name")).join(best, "book_name", "left").withColumn("book_name", F.coalesce("_pretty", "book_name")).drop("_pretty")


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """The distinct (inner, outer) of two tables of one column each with inner a part of outer; neither may be empty text.

    A text within another brings all its runs of GRAM letters, or itself if it is shorter, along. So each inner text meets
    only the outer texts that have the one of its runs that the fewest of them have; those are compared whole.
    """
    inner, outer = inner.distinct(), outer.distinct()
    places = lambda c, n: F.when(F.length(c) >= n, F.sequence(F.lit(1), F.length(c) - n + 1)).otherwise(F.array().cast("array<int>"))
    runs = lambda c, n: F.transform(places(c, n), lambda i: F.substring(c, i, n))
    every = outer.select("outer", F.explode(F.array_distinct(F.concat(*(runs(F.col("outer"), F.lit(n)) for n in range(1, GRAM + 1))))).alias("gram"))
    own = inner.select("inner", F.explode(F.array_distinct(runs(F.col("inner"), F.least(F.lit(GRAM), F.length("inner"))))).alias("gram"))
    often = own.join(every.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram", "left")
    rarest = often.groupBy("inner").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least")).where("least.n > 0").select("inner", F.col("least.gram").alias("gram"))
    return rarest.join(every, "gram").where(F.contains("outer", "inner")).select("inner", "outer")


def looked_up(rows: DataFrame, key: Column, names_table: DataFrame, name: str, default: Column) -> DataFrame:
    """rows with name: the value of names_table (key, value) for the trimmed, lower-cased key, or the default."""
    table = names_table.select(F.lower(F.trim("key")).alias("_key"), "value").groupBy("_key").agg(F.min("value").alias("_value"))
    return rows.withColumn("_key", F.lower(F.trim(key))).join(table, "_key", "left").withColumn(name, F.coalesce("_value", default)).drop("_key", "_value")
