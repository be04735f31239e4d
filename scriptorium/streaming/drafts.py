"""Scoring a stream of drafts: the batch operators, row by row of the stream, against profiles that stand still."""

from __future__ import annotations

from pyspark.sql import DataFrame

from scriptorium.operators import lint


def score_stream(drafts: DataFrame, features: DataFrame, stats: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, distance) for a batch or a stream of drafts with ``text``.

    The profile's features are one array, read once; the sum over them stays within the row, so the stream needs no state
    and no watermark. Drafts without words are at distance 0."""
    return lint.score_rows(drafts, features, stats, keep)
