"""Approximate nearest neighbours by Euclidean distance.

Vectors are projected to a few dimensions by a matrix of independent normal values. The square of a
projected distance, divided by that of the true one, follows a chi-square law with as many degrees of
freedom as there are dimensions. A kd-tree over the projections has two parts. The upper one, from a bounded sample,
cuts the projected space into boxes; each vector lies in one, and boxes are what tasks hold. The lower one is made of
a task's own vectors; leaves come in the order of their distance from the projected query, and their vectors are
verified by the true distance. The search stops when a vector as near as the k-th best so far would, with probability
``confidence``, have had a projection nearer than all that is left.

Each query first searches the box it lies in. Its k-th best distance there is the bound that it takes to all others:
boxes that the test rules out aren't met at all, and in the rest the search starts with the bound.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..shared import written
from ._grid import matrix, merged, usable

BLOCK, SHARD_VALUES, LEAF = 1024, 1 << 20, 64
#: Boxes of the upper tree at most; vectors of the sample it is made from, for each box.
BOXES, SAMPLE = 1024, 16
#: Projected dimensions (even), probability of the stopping test, seed of the projection.
DIMENSIONS, CONFIDENCE, SEED = 8, 0.8, 20240917


def chi_square(x: float, freedom: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, freedom // 2):
        term *= half / i
        total += term
    return 1.0 - math.exp(-half) * total if half < 700 else 1.0


def stop_ratio(confidence: float, freedom: int) -> float:
    """The smallest x with chi_square(x) >= confidence."""
    low, high = 0.0, 1000.0
    while high - low > 1e-9:
        mid = (low + high) / 2
        low, high = (low, mid) if chi_square(mid, freedom) >= confidence else (mid, high)
    return high


class Tree:
    """A kd-tree: each node halves its points along the widest dimension; leaves hold up to LEAF points."""

    def __init__(self, points: np.ndarray):
        self.points, self.order = points, np.arange(len(points))
        self.low, self.high, self.kids, self.span = [], [], [], []
        self._grow(0, len(points))

    def _grow(self, a: int, z: int) -> int:
        here, own = len(self.kids), self.points[self.order[a:z]]
        low, high = own.min(axis=0), own.max(axis=0)
        self.low.append(low)
        self.high.append(high)
        self.span.append((a, z))
        self.kids.append(None)
        if z - a > LEAF:
            axis, mid = int(np.argmax(high - low)), (z - a) // 2
            self.order[a:z] = self.order[a:z][np.argpartition(own[:, axis], mid)]
            self.kids[here] = self._grow(a, a + mid), self._grow(a + mid, z)
        return here

    def nearest_leaves(self, q: np.ndarray):
        """(square of the distance to the leaf's box, its points), nearest first."""
        low, high = np.array(self.low), np.array(self.high)
        gap = np.maximum(0, np.maximum(low - q, q - high))
        least = np.einsum("ij,ij->i", gap, gap).tolist()
        heap = [(least[0], 0)]
        while heap:
            d, at = heapq.heappop(heap)
            if self.kids[at] is None:
                a, z = self.span[at]
                yield d, self.order[a:z]
            else:
                for kid in self.kids[at]:
                    heapq.heappush(heap, (least[kid], kid))


def search(q_ids: np.ndarray, q: np.ndarray, bounds: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, dimensions: int, confidence: float, seed: int, verified: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's ``k`` nearest found among a task's vectors, by true distance, not beyond its bound; candidates' ids ascend.

    ``verified`` takes the number of vectors whose true distance each query has computed.
    """
    plane = _plane(c.shape[1], dimensions, seed)
    tree, projected, ratio = Tree(c @ plane), q @ plane, stop_ratio(confidence, dimensions)
    out = []
    for own, vector, point, bound in zip(q_ids, q, projected, bounds, strict=True):
        best_d, best_i, looked = np.zeros(0), np.zeros(0, np.int64), 0
        slack = 1e-12 * float(point @ point)  # equal vectors may be projected a rounding apart
        for least, members in tree.nearest_leaves(point):
            limit = min(bound, best_d[-1]) if len(best_d) == k else bound
            if least > ratio * limit**2 + slack:
                break
            members = members[c_ids[members] != own]
            looked += len(members)
            d = np.sqrt(((c[members] - vector) ** 2).sum(axis=1))
            near = d <= limit
            d, members = d[near], members[near]
            if len(d):
                d, i = np.concatenate((best_d, d)), np.concatenate((best_i, members))
                first = np.lexsort((i, d))[:k]
                best_d, best_i = d[first], i[first]
        if verified is not None:
            verified.append(looked)
        out.append((np.full(len(best_i), own), c_ids[best_i], best_d))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _plane(length: int, dimensions: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((length, dimensions))


class Boxes:
    """The upper tree: projected space cut at medians of a sample, the widest side first, into ``number`` boxes (a power of two)."""

    def __init__(self, sample: np.ndarray, number: int, dimensions: int):
        self.low, self.high, self.cuts = [], [], []
        self._cut(sample, np.full(dimensions, -np.inf), np.full(dimensions, np.inf), number)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _cut(self, points: np.ndarray, low: np.ndarray, high: np.ndarray, number: int) -> None:
        if number == 1:
            self.low.append(low)
            self.high.append(high)
            return
        axis = int(np.argmax(points.max(axis=0) - points.min(axis=0))) if len(points) else 0
        at = float(np.median(points[:, axis])) if len(points) else 0.0
        for side in (0, 1):
            mine = points[(points[:, axis] >= at) == bool(side)]
            lo, hi = low.copy(), high.copy()
            (lo if side else hi)[axis] = np.clip(at, low[axis], high[axis])
            self._cut(mine, lo, hi, number // 2)

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Square of the distance of each point to each box."""
        gap = np.maximum(0, np.maximum(self.low[None] - points[:, None], points[:, None] - self.high[None]))
        return (gap**2).sum(axis=2)

    def home(self, points: np.ndarray) -> np.ndarray:
        """The box each point lies in, the last of those it touches."""
        return self.distances(points).shape[1] - 1 - np.argmin(self.distances(points)[:, ::-1], axis=1)


def _by_length(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of a batch's vectors, a length at a time."""
    v = batch.column(column)
    sizes = v.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        yield rows, v.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), n)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, dimensions: int = DIMENSIONS, confidence: float = CONFIDENCE, seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each query the ``k`` rows of ``vectors`` nearest by Euclidean distance that are found, a row of the same id excepted.

    Returns query_id, rank (from 1), vec_id, score, the distance in double precision; ties go to the smaller id. Both
    tables need ``id_col`` and ``vec_col``; other columns are left aside. Rows whose vector is null, empty, zero, or
    holds null or non-finite components, and rows without an id, take no part. An id stands for one vector; if it
    repeats, the smallest vector counts. Vectors of different lengths don't meet. Empty tables give no rows.
    ``dimensions`` is even.
    """
    if dimensions % 2:
        raise ValueError("dimensions must be even")
    spark = vectors.sparkSession
    q, c = (written(usable(x, id_col, vec_col, nonzero=True), "vectors") for x in (queries, vectors))
    n, longest = c.agg(F.count("*"), F.max(F.size("v"))).first()
    number = 1 << min(BOXES.bit_length() - 1, max(0, (-(-n * (longest or 1) // SHARD_VALUES) - 1).bit_length()))
    # at most BOXES * SAMPLE vectors, for the cuts only
    sample = c.orderBy(F.xxhash64("id")).limit(number * SAMPLE if number > 1 else 0).select("v").collect()
    boxes = Boxes(np.array([np.array(r[0]) @ _plane(len(r[0]), dimensions, seed) for r in sample]).reshape(-1, dimensions), number, dimensions)
    ratio = stop_ratio(confidence, dimensions)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.zeros(batch.num_rows, np.int32)
            for rows, m in _by_length(batch, 1):
                for a in range(0, len(rows), 256):
                    at[rows[a : a + 256]] = boxes.home(m[a : a + 256] @ _plane(m.shape[1], dimensions, seed))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=["id", "v", "box"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bound, home = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy()
            for rows, m in _by_length(batch, 1):
                for a in range(0, len(rows), 256):
                    own = rows[a : a + 256]
                    points = m[a : a + 256] @ _plane(m.shape[1], dimensions, seed)
                    near = boxes.distances(points) <= ratio * bound[own, None] ** 2 + 1e-12 * (points**2).sum(axis=1)[:, None]
                    near[np.arange(len(own)), home[own]] = False
                    which, box = np.nonzero(near)
                    at = pa.array(own[which])
                    yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(3)), pa.array(box.astype(np.int32))], names=["id", "v", "bound", "box"])

    placed = written(c.mapInArrow(place, "id long, v array<double>, box int"), "placed")
    sizes = {r[0]: -(-r[1] * (longest or 1) // SHARD_VALUES) for r in placed.groupBy("box").count().collect()}
    most = max(sizes.values(), default=1)

    def met(asking: DataFrame) -> DataFrame:
        """Lists of the queries (id, v, bound, box) from the boxes they ask."""
        blocks = {r[0]: -(-r[1] // BLOCK) for r in asking.groupBy("box").count().collect()}
        # a row for each box
        plan = F.broadcast(spark.createDataFrame([(b, blocks[b], m) for b, m in sizes.items() if b in blocks], "box int, blocks int, shards int"))
        deal = lambda m: F.pmod(F.xxhash64("id"), F.col(m)).cast("int")
        each = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
        left = asking.join(plan, "box").select("id", "v", "bound", F.size("v").alias("dim"), "box", deal("blocks").alias("block"), each("shards").alias("shard"))
        right = placed.join(plan, "box").select("id", "v", F.size("v").alias("dim"), "box", each("blocks").alias("block"), deal("shards").alias("shard"))
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("node", pa.int32())])

        def cell(key, a: pa.Table, b: pa.Table) -> pa.Table:
            if not len(a) or not len(b):
                return schema.empty_table()
            a = a.sort_by("id")
            ids, d, s = search(*matrix(a), a["bound"].to_numpy(), *matrix(b), k, dimensions, confidence, seed)
            return pa.table([ids, d, s, np.full(len(ids), key[1].as_py() * most + key[3].as_py(), np.int32)], schema=schema)

        keys = ("dim", "box", "block", "shard")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, "query_id long, vec_id long, score double, node int")

    asking = written(q.mapInArrow(place, "id long, v array<double>, box int").withColumn("bound", F.lit(float("inf"))), "asking")
    first = written(met(asking.select("id", "v", "bound", "box")), "lists")
    bound = merged(first, k, F.asc, number * most).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    again = asking.join(bound, "id", "left").select("id", "v", F.coalesce("kth", "bound").alias("bound"), "box")
    more = met(written(again.mapInArrow(others, "id long, v array<double>, bound double, box int"), "asking"))
    return merged(first.unionByName(more), k, F.asc, number * most)


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hundredth embedding's ten nearest found among all others."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)
