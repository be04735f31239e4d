"""Approximate nearest neighbours by a robustly pruned directed graph in each shard.

Vectors are dealt to shards by hash: as many as there are task slots, or more where a shard would be too large to build
in one task. A shard's graph is built by greedy searches: what the search for a vector visits is
proposed as its neighbours, and relaxed distance pruning keeps the diverse ones (a candidate goes when a kept neighbour is
nearer to it, by a factor, than the vector is). Queries walk every shard's graph by beam search, in blocks; the nearest of
all shards are the answer, with distances of the original vectors in double precision.

Searches of a batch of vectors run in lockstep, so numpy does the distances of a whole batch at once. Distances are sums
of squared differences in double precision of vectors scaled by a power of two, so neither size nor offset of the numbers
matters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    """``least_rows`` to ``most_rows`` vectors a shard (as the slots have it), ``degree`` edges a vector, beams of ``build_beam`` and ``beam``, ``entries`` points where searches begin, relaxation ``alpha``,
    ``batch`` vectors inserted at a time, ``query_block`` queries a task."""

    least_rows: int = 4096
    most_rows: int = 65_536
    degree: int = 32
    build_beam: int = 64
    beam: int = 160
    entries: int = 48
    alpha: float = 1.2
    batch: int = 256
    query_block: int = 16_384

    def shards(self, n: int, slots: int) -> int:
        rows = min(self.most_rows, max(self.least_rows, -(-n // max(1, slots))))
        return max(1, -(-n // rows))


def _scaled(points: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
    """Arrays multiplied by the power of two that brings the points' largest number to between 1/2 and 1 (exactly so, but
    for what is so much smaller that its square is nothing)."""
    exponent = int(np.frexp(np.abs(points).max())[1]) if points.size else 0
    return [np.ldexp(x, -exponent) for x in (points, *more)]


def _squared(points: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its own row of ids."""
    apart = points[ids] - queries[:, None, :]
    return np.einsum("ijk,ijk->ij", apart, apart)


class Graph:
    """``out[i]`` lists the neighbours of point i, filled up with -1; searches begin at ``entries``: the point nearest to the
    mean, then always the one farthest from those before, so that separate clusters are all reached."""

    def __init__(self, points: np.ndarray, params: Params) -> None:
        self.points, self.params = np.ascontiguousarray(points, np.float64), params
        n = len(points)
        self.out = np.full((n, params.degree), -1, np.int32)
        self.entries = self.spread()
        order = np.random.default_rng(7).permutation(n)
        order = np.concatenate((self.entries, order[~np.isin(order, self.entries)]))
        for alpha in (1.0, params.alpha):
            at = 0
            while at < n:
                size = min(params.batch, n - at)
                self._insert(order[at : at + size], alpha)
                at += size

    def spread(self) -> np.ndarray:
        apart = self.points - self.points.mean(0)
        found = [int(np.einsum("ij,ij->i", apart, apart).argmin())]
        far = np.full(len(self.points), np.inf)
        for _ in range(self.params.entries - 1):
            apart = self.points - self.points[found[-1]]
            far = np.minimum(far, np.einsum("ij,ij->i", apart, apart))
            if far.max() <= 0:
                break
            found.append(int(far.argmax()))
        return np.array(found)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """For each query, the beam's ids (-1: none) and squared distances, nearest first, and the expanded points."""
        n, rows = len(self.points), len(queries)
        ids = np.full((rows, beam), -1, np.int64)
        dist = np.full((rows, beam), np.inf)
        open_ = np.zeros((rows, beam), bool)
        seen = np.zeros((rows, n), bool)
        begin = np.broadcast_to(self.entries, (rows, len(self.entries)))
        far = _squared(self.points, begin, queries)
        keep = np.argsort(far, 1, kind="stable")[:, :beam]
        width = keep.shape[1]
        ids[:, :width], dist[:, :width], open_[:, :width] = np.take_along_axis(begin, keep, 1), np.take_along_axis(far, keep, 1), True
        seen[:, self.entries] = True
        expanded: list[np.ndarray] = []
        active = np.arange(rows)
        while len(active):
            first = open_[active].argmax(1)  # beams are in order, so this is the nearest open one
            now = ids[active, first]
            open_[active, first] = False
            step = np.full(rows, -1, np.int64)
            step[active] = now
            expanded.append(step)
            nxt = self.out[now].astype(np.int64)
            safe = np.where(nxt < 0, 0, nxt)
            fresh = ~seen[active[:, None], safe] & (nxt >= 0)
            seen[np.broadcast_to(active[:, None], safe.shape)[fresh], safe[fresh]] = True
            far = np.where(fresh, _squared(self.points, safe, queries[active]), np.inf)
            every = np.concatenate((dist[active], far), 1)
            keep = np.argsort(every, 1, kind="stable")[:, :beam]
            dist[active] = np.take_along_axis(every, keep, 1)
            ids[active] = np.take_along_axis(np.concatenate((ids[active], np.where(fresh, nxt, -1)), 1), keep, 1)
            open_[active] = np.take_along_axis(np.concatenate((open_[active], fresh), 1), keep, 1)
            active = active[open_[active].any(1)]
        return ids, dist, expanded

    def _prune(self, of: np.ndarray, candidates: np.ndarray, alpha: float) -> np.ndarray:
        """Neighbours for each of ``of`` among its candidates (-1: none): the nearest, then the nearest of those that no
        kept one is nearer to by ``alpha``, and so on."""
        rows, width = candidates.shape
        order = np.sort(candidates, 1)
        again = np.zeros(order.shape, bool)
        again[:, 1:] = order[:, 1:] == order[:, :-1]
        candidates = np.where(again | (order == of[:, None]), -1, order)
        safe = np.where(candidates < 0, 0, candidates)
        far = np.where(candidates < 0, np.inf, _squared(self.points, safe, self.points[of]))
        keep = np.argsort(far, 1, kind="stable")[:, : min(width, 3 * self.params.build_beam)]
        candidates, far = np.take_along_axis(candidates, keep, 1), np.take_along_axis(far, keep, 1)
        safe = np.where(candidates < 0, 0, candidates)
        vectors = self.points[safe] - self.points[of][:, None, :]  # about the vector itself: little is cancelled
        norms = np.einsum("ijk,ijk->ij", vectors, vectors)
        alive = candidates >= 0
        out = np.full((rows, self.params.degree), -1, np.int32)
        every = np.arange(rows)
        for k in range(self.params.degree):
            some = alive.any(1)
            if not some.any():
                break
            pick = alive.argmax(1)
            out[some, k] = candidates[every, pick][some]
            between = norms + norms[every, pick][:, None] - 2 * np.matmul(vectors, vectors[every, pick][:, :, None])[:, :, 0]
            alive &= ~((alpha * alpha * between <= far) & some[:, None])
            alive[every, pick] = False
        return out

    def _insert(self, batch: np.ndarray, alpha: float) -> None:
        _, _, expanded = self.search(self.points[batch], self.params.build_beam)
        seen = np.stack(expanded, 1)
        width = int((seen >= 0).sum(1).max())
        seen = np.sort(seen, 1)[:, ::-1][:, :width]
        self.out[batch] = self._prune(batch, np.concatenate((seen, self.out[batch].astype(np.int64)), 1), alpha)
        # Edges back: each target takes its new sources in, and is pruned if it has too many.
        source = np.repeat(batch, self.params.degree)
        target = self.out[batch].ravel().astype(np.int64)
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        names, begins, counts = np.unique(target, return_index=True, return_counts=True)
        for lo in range(0, len(names), self.params.batch):
            own, b, c = names[lo : lo + self.params.batch], begins[lo : lo + self.params.batch], counts[lo : lo + self.params.batch]
            new = np.full((len(own), int(c.max())), -1, np.int64)
            row = np.repeat(np.arange(len(own)), c)
            new[row, np.arange(len(row)) - np.repeat(np.cumsum(c) - c, c)] = source[b[0] : b[0] + len(row)]
            both = np.concatenate((self.out[own].astype(np.int64), new), 1)
            full = (both >= 0).sum(1) > self.params.degree
            packed = np.sort(both, 1)[:, ::-1][:, : self.params.degree].astype(np.int32)
            again = np.zeros(packed.shape, bool)
            again[:, 1:] = packed[:, 1:] == packed[:, :-1]
            self.out[own[~full]] = np.where(again, -1, packed)[~full]
            if full.any():
                self.out[own[full]] = self._prune(own[full], both[full], alpha)


def valid(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v): rows that take part. Null ids, and vectors that are null, empty, zero or hold nulls or numbers that are not
    finite, take none."""
    v = F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0))  # + 0.0: no negative zeros
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.when(good, v).alias("v")).where("id is not null and v is not null")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, params: Params = Params(), vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest found of each query: query_id, rank (from 1), vec_id, score (Euclidean distance, double), nearest
    first, ties to the smaller vec_id; a query's own row is left out.

    ``queries`` has the same columns; its rows are rows of ``vectors``. Every row is a candidate: rows that share an id are
    so each with its vector, and none is a candidate of its own id; a query id asks once, with its least vector. Vectors
    are compared with those of equal length only. Rows that take no part are named in :func:`valid`. Equal vectors are one
    point of the graph with its k + 1 least ids, which are all that can be among k nearest. No vectors or no queries give
    no rows.

    Every shard is asked by every query: shards and blocks of queries are as large as a task can hold, which keeps the
    copies of either few."""
    rows = valid(vectors, vec_id, vector)
    asked = valid(queries, vec_id, vector).groupBy("id").agg(F.min("v").alias("v"))
    n, n_queries = rows.count(), asked.count()
    shards, blocks = params.shards(n, vectors.sparkSession.sparkContext.defaultParallelism), max(1, -(-n_queries // params.query_block))

    by_vector = Window.partitionBy("v").orderBy("id")
    first = rows.distinct().withColumn("place", F.row_number().over(by_vector)).where(F.col("place") <= k + 1)
    points = first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # k + 1 ids at most
    points = points.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards))).withColumn("size", F.size("v"))

    def index(table: pa.Table) -> pa.Table:
        v = _matrix(table.column("v"))
        graph = Graph(_scaled(v)[0], params)
        made = pa.FixedSizeListArray.from_arrays(pa.array(graph.out.ravel(), pa.int32()), params.degree).cast(pa.list_(pa.int32()))
        place = pa.array(np.arange(len(v)), pa.int32())
        return pa.table({"shard": table.column("shard"), "size": table.column("size"), "place": place, "v": table.column("v").cast(pa.list_(pa.float64())), "ids": table.column("ids").cast(pa.list_(pa.int64())), "near": made})

    schema = "shard bigint, size int, place int, v array<double>, ids array<bigint>, near array<int>"
    graphs = points.select("shard", "size", "v", "ids").groupBy("shard", "size").applyInArrow(index, schema)

    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = graphs.withColumn("block", each)
    right = asked.select("id", "v", F.size("v").alias("size"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    right = right.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>")))

    def walk(graph_rows: pa.Table, query_rows: pa.Table) -> pa.Table:
        found: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if graph_rows.num_rows and query_rows.num_rows:
            order = np.argsort(graph_rows.column("place").to_numpy())
            v = _matrix(graph_rows.column("v"))[order]
            ids = graph_rows.column("ids").to_pylist()
            ids = [ids[i] for i in order]
            graph = Graph.__new__(Graph)
            asked_v = _matrix(query_rows.column("v"))
            (graph.points, scaled), graph.params = _scaled(v, asked_v), params
            graph.out = _matrix(graph_rows.column("near")).astype(np.int32)[order]
            graph.entries = graph.spread()
            names = query_rows.column("id").to_numpy()
            for lo in range(0, len(names), 256):
                part = asked_v[lo : lo + 256]
                beams, _, _ = graph.search(scaled[lo : lo + 256], params.beam)
                for name, q, beam in zip(names[lo : lo + 256], part, beams):
                    beam = beam[beam >= 0]
                    exact = np.sqrt(((v[beam] - q) ** 2).sum(1))
                    hits = sorted((d, i) for d, b in zip(exact[: k + 1 + params.beam], beam) for i in ids[b] if i != name)[:k]
                    found["query_id"] += [name] * len(hits)
                    found["vec_id"] += [i for _, i in hits]
                    found["score"] += [d for d, _ in hits]
        return pa.table({"query_id": pa.array(found["query_id"], pa.int64()), "vec_id": pa.array(found["vec_id"], pa.int64()), "score": pa.array(found["score"], pa.float64())})

    keys = ["shard", "size", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(walk, "query_id bigint, vec_id bigint, score double")
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists as rows."""
    rows = column.combine_chunks()
    if isinstance(rows, pa.ChunkedArray):
        rows = rows.chunk(0)
    values = rows.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(rows), -1)
