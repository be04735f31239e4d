"""Recall of the vector search against brute force: ``python -m scriptorium.llm.recall FOLDER`` (with ``embeddings.parquet``).

Prints the share of the true nearest that the search finds, counting equal distances as equal.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .vamana import search, valid


def recall(vectors: DataFrame, queries: DataFrame, k: int = 10) -> float:
    """Over all queries; every vector is read by the driver, so for tables that it can hold."""
    rows = valid(vectors, "vec_id", "embedding").toArrow()
    ids, points = rows.column("id").to_numpy(), np.array(rows.column("v").to_pylist())
    found: dict[int, list[float]] = {}
    for r in search(vectors, queries, k).collect():
        found.setdefault(r.query_id, []).append(r.score)
    hits = total = 0
    for name, at in zip(*(valid(queries, "vec_id", "embedding").toArrow().column(c).to_pylist() for c in ("id", "v"))):
        far = np.sort(np.sqrt(((points[ids != name] - np.array(at)) ** 2).sum(1)))[:k]
        hits += sum(score <= far[-1] * (1 + 1e-12) for score in found.get(name, [])) if len(far) else 0
        total += len(far)
    return hits / total if total else 1.0


if __name__ == "__main__":
    session = SparkSession.builder.getOrCreate()
    table = session.read.parquet(f"{sys.argv[1]}/embeddings.parquet")
    print(f"recall {recall(table, table.where('vec_id % 100 = 0')):.4f}")
