"""Names of characters: aliases, mentions, and statements that stand by themselves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyproof.functions import lexicon
from storyproof.functions.text import clean, text_or_empty, words_in


def _parts(name: Column) -> tuple[Column, Column, Column]:
    """All parts of a cleaned name, the first, and the last (null for a single one)."""
    parts = F.split(name, " ")
    return parts, parts[0], F.when(F.size(parts) > 1, F.element_at(parts, -1))


def aliases(char: Column) -> Column:
    """The ways a character is spoken of, sorted, one for each spelling apart from case."""
    name = clean(char)
    _, first, last = _parts(name)
    titles = [x for t in lexicon.DOTTED_TITLES for x in (t, f"{t}.")] + lexicon.PLAIN_TITLES
    titled = F.transform(words_in(titles), lambda t: F.concat(t, F.lit(" "), last))
    made = F.concat(F.array(name, first), F.when(last.isNotNull(), F.concat(F.array(last, F.concat(first, F.lit(" "), last)), titled)).otherwise(F.array().cast("array<string>")))
    ordered = F.array_sort(F.array_distinct(F.filter(made, lambda a: (a != "") & (F.lower(a) != "none"))))
    low = F.transform(ordered, F.lower)
    return F.filter(ordered, lambda a, i: F.array_position(low, F.lower(a)) == i + 1)


def _escaped(x: Column) -> Column:
    return F.regexp_replace(x, r"([^\p{L}\p{N}\s])", r"\\$1")


def mentions(text: Column, alias_array: Column) -> Column:
    """Whether a text has an alias: a single word as a word, several as they stand."""
    low = F.lower(clean(text))

    def hit(alias: Column) -> Column:
        a = F.lower(clean(alias))
        word = (F.instr(a, " ") == 0) & (F.length(a) >= 2)
        return (a != "") & F.contains(low, a) & (~word | F.regexp_like(low, F.concat(F.lit(r"(?U)\b"), _escaped(a), F.lit(r"\b"))))

    return F.exists(alias_array, hit)


def standalone(char: Column, alias_array: Column, claim: Column) -> Column:
    """A statement that names its subject: a pronoun at its start becomes the name, else the name is put before it."""
    c = clean(claim)
    own = r"(?iU)^(?:his|her|their)\b\s*"
    who = r"(?iU)^(?:he|she|they|him|them)\b\s*"
    start = r"(?iU)^(?:boyhood|childhood|youth|mother|father|parents?)\b"
    joined = lambda mid, rest: F.concat(text_or_empty(char), F.lit(mid), rest)
    return (
        F.when((c == "") | mentions(c, alias_array), c)
        .when(c.rlike(own), joined("'s ", F.regexp_replace(c, own, "")))
        .when(c.rlike(who), joined(" ", F.regexp_replace(c, who, "")))
        .when(c.rlike(start), joined("'s ", c))
        .otherwise(joined(" ", c))
    )


def weighted_aliases(char: Column) -> Column:
    """array<struct<mention,confidence>> of a character for the graph, titles included."""
    name = F.trim(F.regexp_replace(text_or_empty(char), r"(?U)\s+", " "))
    _, first, last = _parts(name)
    w = lexicon.ALIAS_WEIGHTS
    one = lambda mention, kind: F.struct(mention.alias("mention"), F.lit(w[kind]).alias("confidence"))
    titled = lambda rest, kind: F.transform(words_in(lexicon.GRAPH_TITLES), lambda t: one(title_case(F.concat(t, F.lit(" "), rest)), kind))
    both = F.concat(first, F.lit(" "), last)
    made = F.concat(F.array(one(name, "full"), one(F.when(F.lower(both) != F.lower(name), both), "first_last"), one(first, "first"), one(last, "last")), titled(last, "title_last"), titled(name, "title_full"))
    return F.when(name == "", F.array().cast("array<struct<mention:string,confidence:double>>")).otherwise(F.filter(made, lambda a: F.coalesce(a["mention"] != "", F.lit(False))))


def title_case(x: Column) -> Column:
    """A capital after anything but a letter, small letters elsewhere."""
    parts = F.regexp_extract_all(F.lower(x), F.lit(r"(?U)\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), "")
