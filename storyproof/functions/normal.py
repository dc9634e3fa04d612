"""Text without accents. Unicode decomposition is no built-in function, so it is an Arrow batch function here."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from storyproof.functions.text import let

PLAIN = str.maketrans({"’": "'", "‘": "'", "`": "'", "“": '"', "”": '"', "—": " ", "–": " "})


def plain_text(x: str | None) -> str:
    parts = unicodedata.normalize("NFKD", (x or "").translate(PLAIN))
    return re.sub(r"\s+", " ", "".join(c for c in parts if not unicodedata.combining(c)).lower()).strip()


def plain(x: Column) -> Column:
    """Straight quotes, no dashes, no accents, lower case, single spaces; null counts as empty."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(plain_text)

    return run(x)


def name_words(plain_name: Column) -> Column:
    """The words of a name that is plain already."""
    return F.filter(F.split(F.regexp_replace(plain_name, r"[^a-z0-9\s']", " "), r"\s+"), lambda w: w != "")


def wider(aliases: Column) -> Column:
    """Plain aliases with the first and last word of each that has several, if that has three letters: distinct, in order."""
    ends = F.flatten(F.transform(aliases, lambda a: F.concat(F.array(a), F.when(F.size(name_words(a)) >= 2, F.filter(F.array(name_words(a)[0], F.element_at(name_words(a), -1)), lambda w: F.length(w) >= 3)).otherwise(F.array().cast("array<string>")))))
    return F.array_distinct(F.filter(ends, lambda a: a != ""))


def named(plain_passage: Column, aliases: Column) -> Column:
    """Whether a plain passage has one of some plain aliases, its words in a row."""

    def hit(alias: Column) -> Column:
        def found(plain_words: Column) -> Column:
            words = F.transform(plain_words, lambda w: F.regexp_replace(w, "'", "\\\\'"))
            # an expression is compiled only for a passage that holds the first word
            return (F.size(plain_words) > 0) & F.contains(plain_passage, F.get(plain_words, F.lit(0))) & F.regexp_like(plain_passage, F.concat(F.lit(r"(?U)\b"), F.array_join(words, r"\s+"), F.lit(r"\b")))

        return F.coalesce(let(name_words(alias), found), F.lit(False))

    return F.exists(aliases, hit)


def anchors(claim_tokens: Column, aliases: Column, negations: Column, most: int = 20) -> Column:
    """The telling words of a claim: three letters or more, no negation, no part of an alias; distinct, in order."""
    own = F.flatten(F.transform(aliases, name_words))
    return F.slice(F.array_distinct(F.filter(claim_tokens, lambda t: (F.length(t) >= 3) & ~F.array_contains(negations, t) & ~F.array_contains(own, t))), 1, most)


def begins(plain_passage: Column, words: Column) -> Callable[[Column], Column]:
    """Whether an anchor begins a word of a passage, given plain and as its words, each after a space.

    That is a search for the anchor after a space. Only an anchor with an apostrophe, which words are cut at, needs an expression.
    """

    def hit(anchor: Column) -> Column:
        pattern = F.concat(F.lit(r"(?U)\b"), F.replace(anchor, F.lit("'"), F.lit("\\'")), F.lit(r"\w*\b"))
        return F.when(F.contains(anchor, F.lit("'")), F.regexp_like(plain_passage, pattern)).otherwise(F.contains(words, F.concat(F.lit(" "), anchor)))

    return hit
