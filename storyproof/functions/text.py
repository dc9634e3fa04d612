"""Text functions from columns to columns; every one is a built-in expression, so all of them stay in generated code.

Java's classes are ASCII unless asked otherwise; patterns start with (?U) where letters, words and space are meant in Unicode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyproof.functions import lexicon

CURLY, STRAIGHT = "’‘“”", "''\"\""


def words_in(values: list[str] | tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


def among(x: Column, values: list[str] | tuple[str, ...]) -> Column:
    """Whether x is one of some fixed values, by a hash set."""
    return x.isin(*values)


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is worked out once however often f uses it."""
    return F.transform(F.array(x), f)[0]


def text_or_empty(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def tokens(x: Column) -> Column:
    """Runs of a-z, digits and apostrophes in the lower-cased text."""
    return F.regexp_extract_all(F.lower(text_or_empty(x)), F.lit("[a-z0-9']+"), F.lit(0))


def token_set(x: Column) -> Column:
    """The distinct tokens without stop words."""
    return F.array_except(tokens(x), words_in(lexicon.SET_STOPWORDS))


def negated(token_array: Column) -> Column:
    return F.arrays_overlap(token_array, words_in(lexicon.SET_NEGATIONS))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def clean(x: Column) -> Column:
    """Straight quotes, single spaces, no space at the ends."""
    return F.trim(F.regexp_replace(F.translate(text_or_empty(x), CURLY, STRAIGHT), r"(?U)\s+", " "))


def mention_key(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text_or_empty(x)), r"[^a-z0-9\s]", " "), r"\s+", " "))


def title_key(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text_or_empty(x))), "[^a-z0-9]+", "")


def title_code(x: Column) -> Column:
    """A short code for identifiers: two titles have codes of their own, others the head of their key, and a hash if it is cut."""
    key = title_key(x)
    hashed = F.concat(F.substring(key, 1, 16), F.lit("_"), F.lower(F.hex(F.pmod(F.xxhash64(key), F.lit(1 << 32)))))
    return (
        F.when(key.contains("castaways"), F.lit("castaways"))
        .when(key.contains("montecr"), F.lit("montecristo"))
        .when(key == "", F.lit("book"))
        .when(F.length(key) > 16, hashed)
        .otherwise(key)
    )


def file_key(x: Column) -> Column:
    return F.regexp_replace(x.cast("string"), r"[^a-zA-Z0-9_\-]+", "_")


def bucket(position: Column) -> Column:
    return F.when(position <= 0.33, F.lit("EARLY")).when(position <= 0.66, F.lit("MID")).otherwise(F.lit("LATE"))


def sentences(x: Column) -> Column:
    """Parts of a text that end a sentence, closing quotes or brackets included, or a line."""
    return F.filter(F.split(text_or_empty(x), r"(?U)(?=\s)(?:(?<=[.?!])|(?<=[.?!][\"”’)\]]))\s+|\n+"), lambda s: F.trim(s) != "")


def sentence_spans(x: Column) -> Column:
    """Consecutive parts of a passage, each up to the space behind a full stop, with what is left at the end."""
    return F.regexp_extract_all(text_or_empty(x), F.lit(r"(?U)(?s).*?[.!?]+(?:\s+|$)|.+$"), F.lit(0))


def clauses(sentence: Column, whole: bool = True) -> Column:
    """Parts of a sentence between marks and joining words; commas don't split. One that is nothing but those is itself a part if whole, else has none."""
    marks = r"(?iU)(?:[;:()—–]| - |\b(?:" + "|".join(lexicon.CLAUSE_WORDS) + r")\b)\s*"
    parts = lambda c: F.filter(F.transform(F.split(c, marks), lambda p: F.trim(p)), lambda p: p != "")
    return let(clean(sentence), lambda c: let(parts(c), lambda p: F.when(F.size(p) == 0, F.array(c)).otherwise(p)) if whole else parts(c))


def facty(clause: Column) -> Column:
    return clause.rlike(rf"(?iU)\b(?:{lexicon.FACT_WORDS})\b")


def worth_keeping(clause: Column) -> Column:
    """Facts always; others of four words or more that aren't mostly stop words, if short."""

    def telling(words: Column) -> Column:
        stop = F.size(F.filter(words, lambda w: among(F.lower(w), lexicon.STOPWORDS)))
        return (F.size(words) >= 4) & ((F.size(words) > 10) | (stop / F.size(words) <= 0.6))

    return let(F.split(clause, " "), telling) | facty(clause)  # the dearer test only where it decides


def ended(clause: Column) -> Column:
    return F.when(clause.rlike("[.!?]$"), clause).otherwise(F.concat(clause, F.lit(".")))


def predicate(char: Column, claim: Column) -> Column:
    """Claim("name", "statement") with single quotes inside."""
    quoted = lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit("'")), F.lit('"'))
    return F.concat(F.lit("Claim("), quoted(F.trim(text_or_empty(char))), F.lit(", "), quoted(clean(claim)), F.lit(")"))


def predicate_name(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"(?s)^\s*([A-Za-z_][A-Za-z0-9_]*)\((.*)\)\s*$", 1), F.lit(""))


def predicate_args(x: Column, whole_object: bool = True) -> Column:
    """The arguments without quotes. Those after the first are one, unless commas inside them are to split them too."""
    inside = F.regexp_extract(x, r"(?s)^\s*([A-Za-z_][A-Za-z0-9_]*)\((.*)\)\s*$", 2)
    bare = lambda a: F.regexp_replace(F.regexp_replace(F.trim(a), '^"+|"+$', ""), "^'+|'+$", "")
    return F.transform(F.split(inside, ",", 2 if whole_object else -1), bare)


def normal_label(x: Column) -> Column:
    said = F.upper(F.trim(text_or_empty(x)))
    return F.when(said.isin("ENTAILMENT", "ENTAIL", "E"), F.lit("SUPPORT")).when(said.isin("CONTRADICTION", "C"), F.lit("CONTRADICT")).when(said.isin("N", "UNKNOWN", "UNVERIFIED"), F.lit("NEUTRAL")).otherwise(said)


def model_label(x: Column) -> Column:
    said = F.lower(F.trim(text_or_empty(x)))
    return F.when(said.contains("entail"), F.lit("SUPPORT")).when(said.contains("contrad"), F.lit("CONTRADICT")).otherwise(F.lit("NEUTRAL"))


def truth(x: Column) -> Column:
    """1 for a label that begins like consistent, 0 for one like contradict, else null."""
    said = F.lower(F.trim(text_or_empty(x)))
    return F.when(said.startswith("cons"), F.lit(1)).when(said.startswith("contr"), F.lit(0))


def keyword_list(x: Column) -> Column:
    """Keywords from a JSON list or a text with commas or spaces between them."""
    plain = F.filter(F.split(x, r"[,\s]+"), lambda w: w != "")
    return F.coalesce(F.from_json(x, "array<string>"), plain, F.array().cast("array<string>"))


def excerpt(text: Column, terms: Column, most: int = 320, around: int = 120) -> Column:
    """The surroundings of the first of some terms that the text holds, with ellipses; without one, the head of the text."""
    text = text_or_empty(text)
    found = F.filter(F.transform(F.filter(terms, lambda t: t != ""), lambda t: F.instr(F.lower(text), F.lower(t))), lambda i: i > 0)
    at = F.get(found, F.lit(0)) - 1
    start, end = F.greatest(F.lit(0), at - around), F.least(F.length(text), at + around)
    part = F.concat(F.when(start > 0, F.lit("…")).otherwise(F.lit("")), F.trim(F.substring(text, start + 1, end - start)), F.when(end < F.length(text), F.lit("…")).otherwise(F.lit("")))
    cut = F.when(F.length(part) > most, F.concat(F.substring(part, F.lit(1), F.lit(most - 1)), F.lit("…"))).otherwise(part)
    head = F.concat(F.substring(text, F.lit(1), F.lit(most)), F.when(F.length(text) > most, F.lit("…")).otherwise(F.lit("")))
    return F.when(at.isNull(), head).otherwise(cut)


def cell(x: Column) -> Column:
    """A text fit for a cell of a Markdown table."""
    return F.replace(F.replace(x, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def located(text: Column, needle: Column) -> Column:
    """Where a passage stands in a text, exactly or in another case: (start, end), or null."""
    hit = F.coalesce(F.nullif(F.instr(text, needle), F.lit(0)), F.nullif(F.instr(F.lower(text), F.lower(needle)), F.lit(0)))
    return F.when((needle != "") & hit.isNotNull(), F.struct((hit - 1).alias("start"), (hit - 1 + F.length(needle)).alias("end")))


def fuzzily_located(text: Column, needle: Column) -> Column:
    """The surroundings of a mention, or of its first word: from 40 characters before to 80 behind, or null."""
    low, said = F.lower(text), F.lower(text_or_empty(needle))
    first = F.get(F.filter(F.split(said, r"\s+"), lambda w: w != ""), F.lit(0))
    hit = F.coalesce(F.nullif(F.instr(low, said), F.lit(0)), F.nullif(F.instr(low, first), F.lit(0))) - 1
    return F.when((text != "") & (said != "") & hit.isNotNull(), F.struct(F.greatest(F.lit(0), hit - 40).alias("start"), F.least(F.length(text), hit + F.length(needle) + 80).alias("end")))
