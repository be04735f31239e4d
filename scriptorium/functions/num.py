"""Rounding as results are stored: half away from zero on the scaled double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, places: int) -> Column:
    """``x`` to ``places`` decimals. Spark's own ``round(x, n)`` goes by the decimal expansion, which differs at ties."""
    scale = F.lit(float(10**places))
    return F.round(x * scale) / scale
