"""Approximate nearest neighbours by learned partitions.

A neighbour graph over a bounded sample of the vectors is cut into parts of equal size so that few edges cross: parts
are grown from seeds and vectors then change places between parts as long as that saves edges. A small softmax
classifier learns a vector's part from the vector. Every vector is indexed under its most probable part; a query goes
to its most probable parts, as many as the sample needs for the wanted recall, and what it meets there is ranked by
exact inner products.

The number of parts grows with the number of vectors, as far as the sample gives each part enough of them. Parts are
cut into cells of bounded size, by hash, on the side of the vectors and on that of the queries, and every pair of cells
of a part is one unit of work; so a part that holds a third of all vectors is spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackforge.llm.durable import materialise

SAMPLE = 6_000  # vectors for graph and classifier
PARTS = 16  # at least, if there are vectors enough
PART_ROWS = 4_096  # vectors of a part that the number of parts aims at
PART_SAMPLE = 50  # sampled vectors of each part at least
GRAPH_DEGREE = 16
WANTED_RECALL = 0.97
CELL = 16_384  # vectors of a unit of work
QUERY_CELL = 4_096
BLOCK = 256  # queries that are ranked at once


def exact_top(vectors: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k nearest of vectors, itself left out, for each of those that at numbers."""
    k = min(k, len(vectors) - 1)
    out = np.empty((len(at), k), np.int64)
    for i in range(0, len(at), BLOCK):
        some = at[i : i + BLOCK]
        scores = vectors[some] @ vectors.T
        scores[np.arange(len(some)), some] = -np.inf
        out[i : i + BLOCK] = np.argpartition(scores, len(vectors) - k, axis=1)[:, len(vectors) - k :]
    return out


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """A part for each vertex, sizes at most one apart. graph: neighbours of each vertex."""
    n = len(graph)
    rng = np.random.default_rng(seed)
    part = np.full(n, -1)
    room = np.full(parts, n // parts) + (np.arange(parts) < n % parts)
    frontier = [[int(v)] for v in rng.permutation(n)[:parts]]
    rest = iter(rng.permutation(n).tolist())
    left = n
    while left:  # parts grow in turn
        for p in range(parts):
            if not room[p]:
                continue
            v = next((x for x in iter(lambda: frontier[p].pop(0) if frontier[p] else None, None) if part[x] < 0), None)
            if v is None:
                v = next((x for x in rest if part[x] < 0), None)
            if v is None:
                continue
            part[v] = p
            room[p] -= 1
            left -= 1
            frontier[p] += [int(x) for x in graph[v] if part[x] < 0]
    both = np.concatenate([np.stack([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()], 1), np.stack([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])], 1)])
    for _ in range(20):  # pairs of vertices change places where that saves edges
        links = np.zeros((n, parts))
        np.add.at(links, (both[:, 0], part[both[:, 1]]), 1)
        own = links[np.arange(n), part]
        moved = 0
        for p in range(parts):
            for q in range(p + 1, parts):
                a, b = np.flatnonzero(part == p), np.flatnonzero(part == q)
                a, b = a[np.argsort(own[a] - links[a, q])], b[np.argsort(own[b] - links[b, p])]
                m = min(len(a), len(b))
                gain = (links[a[:m], q] - own[a[:m]]) + (links[b[:m], p] - own[b[:m]])
                take = int(np.count_nonzero(np.cumprod(gain > 2)))
                if take:
                    part[a[:take]], part[b[:take]] = q, p
                    moved += take
                    own[a[:take]], own[b[:take]] = np.inf, np.inf  # once in a round
                    links[a[:take]], links[b[:take]] = -np.inf, -np.inf
        if moved < n // 500:
            break
    return part


class Router:
    """Softmax regression from vectors to parts."""

    def __init__(self, dims: int, parts: int) -> None:
        self.dims, self.weights = dims, np.zeros((dims + 1, parts))
        self.scale = 1.0

    def inputs(self, vectors: np.ndarray) -> np.ndarray:
        return np.concatenate([vectors * self.scale, np.ones((len(vectors), 1))], axis=1)

    def fit(self, vectors: np.ndarray, parts: np.ndarray, rounds: int = 300) -> None:
        self.scale = 1 / max(1e-12, float(np.sqrt((vectors**2).mean())))
        x = self.inputs(vectors)
        wanted = np.eye(self.weights.shape[1])[parts]
        m, v = np.zeros_like(self.weights), np.zeros_like(self.weights)
        for t in range(1, rounds + 1):
            p = x @ self.weights
            p = np.exp(p - p.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = x.T @ (p - wanted) / len(x) + 1e-4 * self.weights
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            self.weights -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)

    def order(self, vectors: np.ndarray) -> np.ndarray:
        """Parts of each vector, most probable first."""
        return np.argsort(-(self.inputs(vectors) @ self.weights), axis=1, kind="stable")


def learn(vectors: np.ndarray, k: int, parts: int = PARTS, wanted: float = WANTED_RECALL) -> tuple[Router, int]:
    """The router, and the number of parts that queries need. vectors: a sample."""
    parts = max(1, min(parts, len(vectors) // PART_SAMPLE))
    router = Router(vectors.shape[1], parts)
    if parts == 1:
        return router, 1
    near = exact_top(vectors, np.arange(len(vectors)), GRAPH_DEGREE)
    router.fit(vectors, balanced_parts(near, parts))
    order = router.order(vectors)
    home = order[:, 0]
    probes = np.random.default_rng(11).permutation(len(vectors))[:500]
    place = np.argsort(order[probes], axis=1)  # rank of each part for each query
    rank = np.take_along_axis(place, home[exact_top(vectors, probes, k)], axis=1)
    recall = [(rank < m).mean() for m in range(1, parts + 1)]
    return router, next(m for m, r in enumerate(recall, 1) if r >= wanted or m == parts)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows that take part, as vec_id and v; not those that are null, zero, or hold null or non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce((x == x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))) & F.exists(v, lambda x: x != 0)
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _routed(router: Router | None, probes: int) -> "callable":
    """vec_id, v -> part, vec_id, v: a row for each of the vector's probes most probable parts.

    Vectors that the router can't read, for their length, have a part of their own length, below 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            fits = sizes == (router.dims if router else -1)
            for at in filter(len, (np.flatnonzero(fits), np.flatnonzero(~fits))):
                rows = batch.take(pa.array(at))
                if fits[at[0]]:
                    part = router.order(_matrix(rows.column(1)))[:, :probes]
                    rows = rows.take(pa.array(np.repeat(np.arange(len(at)), part.shape[1])))
                else:
                    part = -sizes[at]
                yield pa.RecordBatch.from_arrays([pa.array(part.ravel().astype(np.int32)), rows.column(0), rows.column(1)], names=["part", "vec_id", "v"])

    return run


def in_order_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up component by component."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def _ranked(k: int) -> "callable":
    """(vectors of a cell, queries of a cell) -> query_id, vec_id, score of the k best of the cell for each query."""

    def best(queries: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, ...]:
        scores = q @ v.T
        scores[queries[:, None] == ids[None, :]] = -np.inf
        keep = min(k, len(ids))
        bar = np.partition(scores, len(ids) - keep, axis=1)[:, len(ids) - keep]
        bar -= 1e-9 * (1 + np.abs(np.where(np.isfinite(bar), bar, 0)))  # these products may be summed in another order
        at, of = np.nonzero((scores >= bar[:, None]) & (scores > -np.inf))
        exact = in_order_products(q[at], v[of])
        order = np.lexsort((ids[of], -exact, at))
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        chosen = order[rank < k]
        return queries[at[chosen]], ids[of[chosen]], exact[chosen]

    def run(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if vectors.num_rows and asked.num_rows:
            (ids, v), (queries, q) = ((t.column("vec_id").to_numpy(), _matrix(t.column("v").combine_chunks())) for t in (vectors, asked))
            found += [best(queries[i : i + BLOCK], q[i : i + BLOCK], ids, v) for i in range(0, len(queries), BLOCK)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), (np.concatenate(x) for x in zip(*found, strict=True)), strict=True)))

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, parts: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest that were found for each query, ties to the smaller vec_id.

    Rows that are null, zero, or hold null or non-finite components take no part on either side; a query is not its
    own candidate (rows with its id aren't). With at most 100 vectors the search is exact. Vectors of different lengths
    have no inner product: queries meet vectors of their own length, by the learned parts for the most frequent length
    (the smaller, of two), else all of them. A query id that comes twice is asked once, with its smaller vector;
    candidate rows that come twice count twice. Empty tables give no rows; columns other than id and vector aren't
    read. parts: by default one for each PART_ROWS vectors, but at least PARTS; at most one for each PART_SAMPLE
    sampled vectors.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    length = rows.groupBy(F.size("v").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "length").first()
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    chosen = rows.where(F.size("v") == length.length).orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).select("v").toArrow()
    router, probes = learn(_matrix(chosen.column("v").combine_chunks()), k, parts or max(PARTS, length.n // PART_ROWS))
    schema = "part int, vec_id long, v array<double>"
    asked = usable(queries, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v"))
    held, sought = (materialise(x.mapInArrow(_routed(router, n), schema)) for x, n in ((rows, 1), (asked, probes)))
    cells = held.groupBy("part").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cells"))
    query_cells = sought.groupBy("part").agg(F.ceil(F.count("*") / QUERY_CELL).cast("int").alias("query_cells"))
    grid = F.broadcast(cells.join(query_cells, "part"))  # a row for each part, of which there are at most sample / PART_SAMPLE, and for each other length
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.col(n)).cast("int")
    held = held.join(grid, "part").select("part", own("cells").alias("cell"), every("query_cells").alias("query_cell"), "vec_id", "v")
    sought = sought.join(grid, "part").select("part", every("cells").alias("cell"), own("query_cells").alias("query_cell"), "vec_id", "v")
    unit = ("part", "cell", "query_cell")
    found = held.groupBy(*unit).cogroup(sought.groupBy(*unit)).applyInArrow(_ranked(k), "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
