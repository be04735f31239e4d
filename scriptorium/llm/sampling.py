"""Bounded, repeatable samples of labelled rows for fitting; their bound is what lets them be broadcast and collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(column: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as the empty text (remainder 0)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def lowest(rows: DataFrame, key: str, most: int, seed: str) -> DataFrame:
    """At most ``most`` distinct keys, those of the lowest hashes: every row counts alike, reruns agree."""
    return rows.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))).limit(most)
