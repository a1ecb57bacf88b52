"""Text functions as Column expressions; none needs Python at run time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import ABBREVIATIONS, PREFIXES, SUFFIXES


def letters(x: Column) -> Column:
    """Lower case, runs of other characters than a-z as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z]+", " "))


def normalize(x: Column) -> Column:
    """:func:`letters` after spelling out abbreviations; apply exactly once."""
    return letters(reduce(lambda c, ab: F.replace(c, F.lit(ab[0]), F.lit(ab[1])), ABBREVIATIONS, F.lower(x)))


def canonical(x: Column) -> Column:
    """:func:`normalize` without a billing prefix and one marketing suffix."""
    text = normalize(x)
    text = F.when(text.isin("member pass", "member plan"), text).otherwise(
        F.regexp_replace(text, f"^({'|'.join(PREFIXES)}) ", "")
    )
    return F.when(text.isin("digital plus", "digital service"), text).otherwise(
        F.regexp_replace(text, f" ({'|'.join(SUFFIXES)})$", "")
    )


def contains(x: Column, pattern: str) -> Column:
    return x.rlike(pattern)


def tokens(x: Column) -> Column:
    return F.filter(F.split(x, " "), lambda w: w != "")


def ngrams(words: Column, n: int) -> Column:
    """Space-joined runs of ``n`` words; shorter texts have none."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1)))
    grams = F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, grams).otherwise(F.array().cast("array<string>"))


def enriched(text: Column, mcc: Column, kind: Column) -> Column:
    """Document token: text, MCC, type, and text joined with its MCC."""
    return F.concat_ws(" ", text, F.concat(F.lit("mcc"), mcc), F.concat(F.lit("type"), kind), F.concat(F.translate(text, " ", "_"), F.lit("_m"), mcc))


def valid_id(x: Column) -> Column:
    return x.isNotNull() & (F.trim(x) != "") & (F.trim(x) == x)
