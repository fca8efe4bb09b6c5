"""Text functions: word counts, buckets, substring counts, keyword relevance, the index tokeniser."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scenelake.functions import taxonomy as T


def word_count(text: Column) -> Column:
    """Words between runs of white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))


def bucket(n: Column, width: int) -> Column:
    return (F.floor(n / width) * width).cast("long")


def substring_count(text: Column, part: str) -> Column:
    """Places, none overlapping another, where a part occurs in the lower-cased text."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return ((F.length(lowered) - F.length(F.replace(lowered, F.lit(part), F.lit("")))) / len(part)).cast("long")


def tokens(text: Column) -> Column:
    """Index terms: words of two or more letters or digits of any script, lower-cased, without stop words; repeats stay."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(T.STOP_WORDS))


def long_words(query: Column, between: str) -> Column:
    return F.filter(F.split(F.lower(query), between), lambda w: F.length(w) > 3)


def keyword_relevance(text: Column, query: Column) -> Column:
    """Every word of the query of more than three characters is a substring of the text; false without such words."""
    words = long_words(query, r"\W+")
    return (F.size(words) > 0) & F.forall(words, lambda w: F.contains(F.lower(text), w))
