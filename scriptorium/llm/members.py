"""Rows cut down to those whose key may be among given ones, before they are shuffled.

The given keys set bits in an array of fixed size (a Bloom filter), which every task gets. It only ever lets too many rows
pass, so a join that follows is as right as without it; with far more keys than bits it lets all pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the array: 8 MB to each task, twice that to the driver at most.
BITS = 1 << 26


def bits_of(keys: DataFrame, key: Column) -> np.ndarray:
    hashed = keys.select(F.xxhash64(key).alias("h"))
    cells = hashed.select(F.explode(F.array(F.pmod("h", F.lit(BITS)), F.pmod(F.shiftright("h", 26), F.lit(BITS)))).alias("cell"))
    words = cells.select(F.shiftright("cell", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(cell % 64 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(BITS >> 6, np.int64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return bits


def parted(rows: DataFrame, key: Column, keys: DataFrame, other: Column) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``key`` is perhaps an ``other`` of ``keys``, and those where it is none; a null key is a key like
    others. Only the key's hash leaves the JVM."""
    shared = rows.sparkSession.sparkContext.broadcast(bits_of(keys, other))

    @F.arrow_udf("boolean")
    def hit(hashed: pa.Array) -> pa.Array:
        bits, h = shared.value, hashed.to_numpy(zero_copy_only=False)
        a, b = h % BITS, (h >> 26) % BITS
        return pa.array((bits[a >> 6] >> (a & 63)) & (bits[b >> 6] >> (b & 63)) & 1 == 1)

    found = hit(F.xxhash64(key))
    return rows.where(found), rows.where(~found)


def perhaps_among(rows: DataFrame, key: Column, keys: DataFrame, other: Column) -> DataFrame:
    """``rows`` without most of those whose ``key`` is no ``other`` of ``keys``."""
    return parted(rows, key, keys, other)[0]
