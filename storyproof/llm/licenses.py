"""License scans: hand-written signature rules behind a keyword prefilter, in DataFrame operations only.

A text without any keyword costs substring searches and a count of its words. Of the others, the words are joined by single
spaces; the rules whose keyword is there run over that string, and each match becomes an interval of words. Intervals that lie
inside one of the same or a higher priority are suppressed. Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyproof.functions.text import let
from storyproof.llm.common import documents
from storyproof.llm.license_rules import rules

# The phrases of the contract and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE_WEIGHT = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" ")))


def _prefilter(low: Column) -> Column:
    """Whether a lower-cased text can hold a keyword: it holds the first word of one, and the second if there is one."""
    found = F.lit(False)
    firsts: dict[str, set[str]] = {}
    for keyword in sorted({r["keyword"] for r in rules()} | set(PHRASES)):
        first, *rest = keyword.split(" ")
        firsts.setdefault(first, set()).add(rest[-1] if rest else "")
    for first, seconds in sorted(firsts.items()):
        some = low.contains(first)
        if "" not in seconds:
            more = F.lit(False)
            for second in sorted(seconds):
                more = more | low.contains(second)
            some = some & more
        found = found | some
    return found


def _matches(line: Column, rule: Column) -> Column:
    """The intervals [start, end) of words where a rule matches the line, whose first word is a sentinel."""
    pattern = F.concat(F.lit("(?<= )(?:"), rule["pattern"], F.lit(")(?= )"))
    none = F.array().cast("array<struct<start:int,end:int,rule:int,priority:int,weight:double,label:string>>")

    def placed(hits: Column, gaps: Column) -> Column:
        def add(held: Column, i: Column) -> Column:
            start = held["at"] + _spaces(gaps[i])
            end = start + _spaces(hits[i]) + 1
            one = F.struct((start - 1).alias("start"), (end - 1).alias("end"), rule["rule"].alias("rule"), rule["priority"].alias("priority"), rule["weight"].alias("weight"), rule["label"].alias("label"))
            return F.struct((end - 1).alias("at"), F.array_append(held["out"], one).alias("out"))

        places = F.when(F.size(hits) > 0, F.sequence(F.lit(0), F.size(hits) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda held: held["out"])

    # the text is searched and split once, however many matches it has
    return let(F.regexp_extract_all(line, pattern, F.lit(0)), lambda hits: let(F.split(line, pattern), lambda gaps: placed(hits, gaps)))


def _unsuppressed(found: Column) -> Column:
    """The intervals that don't lie inside another of the same or a higher priority; of equal ones the first rule stays.

    They are taken by start, the longest first, so that what holds an interval comes before it; the furthest end so far is
    kept for each priority.
    """
    keyed = F.transform(found, lambda m: F.struct(m["start"], (-m["end"]).alias("back"), (-m["priority"]).alias("low"), m["rule"], m["weight"], m["label"]))
    kinds = "array<struct<start:int,end:int,label:string,weight:double>>"

    def add(held: Column, m: Column) -> Column:
        end, priority = -m["back"], -m["low"]
        reach = F.when(priority >= 3, held["p3"]).when(priority == 2, F.greatest(held["p2"], held["p3"])).otherwise(F.greatest(held["p1"], held["p2"], held["p3"]))
        one = F.struct(m["start"].alias("start"), end.alias("end"), m["label"].alias("label"), m["weight"].alias("weight"))
        grown = lambda p, name: F.when(priority == p, F.greatest(held[name], end)).otherwise(held[name]).alias(name)
        return F.struct(grown(1, "p1"), grown(2, "p2"), grown(3, "p3"), F.when(reach >= end, held["out"]).otherwise(F.array_append(held["out"], one)).alias("out"))

    start = F.struct(F.lit(0).alias("p1"), F.lit(0).alias("p2"), F.lit(0).alias("p3"), F.array().cast(kinds).alias("out"))
    return F.aggregate(F.array_sort(keyed), start, add, lambda held: held["out"])


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, found.

    found are the unsuppressed detections, array<struct<start,end,label,weight>> in words. A null text counts as empty: no
    words, no places, empty lists. Whole texts of any length are scanned. Repeated rows keep their rows, a null doc_id is carried
    along, an empty table gives none; other columns are ignored, whatever their names.
    """
    low = docs.select("doc_id", F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER).alias("low"))
    line = F.when(_prefilter(F.col("low")), F.concat(F.lit(". "), F.trim(F.regexp_replace("low", GAP, " ")), F.lit(" ")))
    lined = low.select("doc_id", F.regexp_count("low", F.lit(WORD)).cast("long").alias("n_words"), line.alias("line"))
    starts = F.split("line", f"(?<= )(?=(?:{'|'.join(PHRASES)}) )")
    table = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in r.items())) for r in rules()))
    matches = F.flatten(F.transform(F.filter(table, lambda r: F.contains(F.col("line"), r["keyword"])), lambda r: _matches(F.col("line"), r)))
    based = lined.withColumn("parts", starts).withColumn("found", F.when(F.col("line").isNotNull(), _unsuppressed(matches)))
    n_base = F.coalesce(F.size("parts") - 1, F.lit(0)).cast("long")
    any_base = F.col("line").isNotNull() & (F.size("parts") > 1)
    labels = F.array_sort(F.array_compact(F.array(*(F.when(F.contains(F.col("line"), F.lit(f" {p} ")), F.lit(v)) for p, v in PHRASES.items()))))
    return based.select(
        "doc_id",
        "n_words",
        F.when(any_base, n_base).otherwise(F.lit(0).cast("long")).alias("n_base"),
        F.when(any_base, (_spaces(F.col("parts")[0]) - 1).cast("long")).alias("first_word"),
        F.when(any_base, F.col("n_words") - _spaces(F.element_at("parts", -1))).alias("last_word"),
        F.coalesce(labels, F.array().cast("array<string>")).alias("base_labels"),
        F.coalesce("found", F.array().cast("array<struct<start:int,end:int,label:string,weight:double>>")).alias("found"),
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan() over documents; the score is the weight of the strongest detection."""
    found = scan(documents(spark, sf_dir))
    labels = F.array_sort(F.array_union("base_labels", F.transform("found", lambda m: m["label"])))
    weight = F.coalesce(F.array_max(F.transform("found", lambda m: m["weight"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.greatest(weight, F.when(F.col("n_base") > 0, F.lit(BASE_WEIGHT)).otherwise(F.lit(0.0))).alias("score"), F.size("found").cast("long").alias("n_found"),
    )
