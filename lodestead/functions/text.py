"""Word, byte and shingle scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0)).cast("bigint")


def byte_length(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def shingles(text: Column, k: int = 5) -> Column:
    """Distinct 12-digit MD5 prefixes of all windows of k words; empty below k words.

    The words are bound by a one-element transform: the optimizer may merge projections, and would otherwise cut the
    text into words again for every window.
    """

    def windows(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.substring(F.md5(F.array_join(F.slice(w, i, k), " ").cast("binary")), 1, 12))
        return F.array_distinct(F.when(F.size(w) >= k, each).otherwise(F.array().cast("array<string>")))

    return F.get(F.transform(F.array(words(F.coalesce(text, F.lit("")))), windows), F.lit(0))
