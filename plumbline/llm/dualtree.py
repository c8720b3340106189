"""Centroid clustering by Lloyd's rounds over two trees.

Vectors are cut into blocks, one matrix each; a cover tree over each block is built once and stored with it. In a round
every task meets the tree of its blocks with a tree over the centroids: a pair of nodes is left out when the least
distance that its radii allow is more than the greatest distance to another centroid that is certain. Pairs of leaves are
compared exactly, in whole numbers. Sums for the new centroids leave a task as one row for each cluster and component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..shared import written

#: Clusters, rounds, components of a vector, scale, seed of the first centroids.
CLUSTERS, ROUNDS, LENGTH, SCALE, SEED = 16, 3, 64, 64.0, 1
#: Vectors of a block; vectors of a leaf; ratio of the radii of a node and its children.
BLOCK, LEAF, BASE = 4096, 32, 2.0


class CoverTree:
    """Nodes (centre, radius, first kid, end of kids, first vector, end of vectors) over the rows of a matrix.

    A node's kids have centres among its vectors, more than its reach divided by BASE apart; each vector is its nearest
    kid's. A leaf has few vectors or equal ones. ``order`` lists rows so that each node has a slice of it.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points), dtype=np.int32)
        x = points.astype(np.float64)
        centre, radius, spans, kids = [0] if len(points) else [], [], [(0, len(points))] if len(points) else [], []
        at = 0
        while at < len(spans):
            a, z = spans[at]
            mine = self.order[a:z]
            away = np.sqrt(((x[mine] - x[centre[at]]) ** 2).sum(axis=1))
            radius.append(float(away.max()))
            if z - a <= leaf or radius[-1] == 0:
                kids.append((0, 0))
                at += 1
                continue
            least, owner, nets = away, np.zeros(z - a, np.int64), [centre[at]]
            while (k := int(np.argmax(least))) >= 0 and least[k] > radius[-1] / BASE:
                d = np.sqrt(((x[mine] - x[mine[k]]) ** 2).sum(axis=1))
                owner[d < least] = len(nets)
                least = np.minimum(least, d)
                nets.append(int(mine[k]))
            by = np.argsort(owner, kind="stable")
            self.order[a:z] = mine[by]
            bounds = np.searchsorted(owner[by], np.arange(len(nets) + 1))
            kept = [(c, a + s, a + e) for c, s, e in zip(nets, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True) if e > s]
            kids.append((len(spans), len(spans) + len(kept)))
            centre += [c for c, *_ in kept]
            spans += [(s, e) for _, s, e in kept]
            at += 1
        self.centre, self.radius = np.array(centre, np.int32), np.array(radius, np.float64)
        self.kids, self.spans = np.array(kids, np.int32).reshape(-1, 2), np.array(spans, np.int32).reshape(-1, 2)

    def pack(self) -> dict[str, bytes]:
        return {"tree_order": self.order.tobytes(), "centre": self.centre.tobytes(), "radius": self.radius.tobytes(), "kids": self.kids.tobytes(), "spans": self.spans.tobytes()}

    @classmethod
    def unpack(cls, row: dict[str, bytes]) -> CoverTree:
        self = cls.__new__(cls)
        self.order, self.centre = np.frombuffer(row["tree_order"], np.int32), np.frombuffer(row["centre"], np.int32)
        self.radius = np.frombuffer(row["radius"], np.float64)
        self.kids, self.spans = np.frombuffer(row["kids"], np.int32).reshape(-1, 2), np.frombuffer(row["spans"], np.int32).reshape(-1, 2)
        return self


def _expanded(pairs: np.ndarray, kids: np.ndarray, side: int) -> np.ndarray:
    """Pairs with the node at ``side`` replaced by its kids; leaves stay."""
    own = kids[pairs[:, side]]
    n = own[:, 1] - own[:, 0]
    inner = n > 0
    many = np.where(inner, n, 1)
    out = np.repeat(pairs, many, axis=0)
    step = np.arange(len(out)) - np.repeat(np.cumsum(many) - many, many)
    moved = np.repeat(inner, many)
    out[moved, side] = (np.repeat(own[:, 0], many) + step)[moved]
    return out


def nearest_centroids(x: np.ndarray, tree: CoverTree, centroids: np.ndarray, compared: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, squared distance) of each row of ``x``; of equally near ones the smallest number.

    ``compared`` takes the number of pairs of a vector and a centroid whose distance was computed exactly.
    """
    number, distance = np.full(len(x), -1, np.int64), np.full(len(x), np.iinfo(np.int64).max)
    if not len(x) or not len(centroids):
        return number, distance
    other = CoverTree(centroids, leaf=1)
    xs, cs = x.astype(np.float64), centroids.astype(np.float64)
    pairs, seen = np.zeros((1, 2), np.int64), 0
    while len(pairs):
        a, b = pairs.T
        d = np.sqrt(((xs[tree.centre[a]] - cs[other.centre[b]]) ** 2).sum(axis=1))
        room = tree.radius[a] + other.radius[b]
        # what is certain for every vector of a: its distance to the centroid at b's centre
        sure = np.full(len(tree.centre), np.inf)
        np.minimum.at(sure, a, d + tree.radius[a])
        pairs = pairs[(d - room) * (1 - 1e-9) - 1e-6 <= sure[a]]
        a, b = pairs.T
        leaves = (tree.kids[a, 1] == 0) & (other.kids[b, 1] == 0)
        met = pairs[leaves][np.argsort(a[leaves], kind="stable")]
        cuts = [*np.flatnonzero(np.diff(met[:, 0], prepend=-1)).tolist(), len(met)]
        for k, until in zip(cuts[:-1], cuts[1:], strict=True):
            rows = tree.order[slice(*tree.spans[met[k, 0]])]
            mine = np.sort(np.concatenate([other.order[slice(*other.spans[n])] for n in met[k:until, 1].tolist()]))
            exact = ((x[rows][:, None, :] - centroids[mine][None, :, :]) ** 2).sum(axis=2)
            seen += exact.size
            best = exact.argmin(axis=1)
            found = exact[np.arange(len(rows)), best]
            better = (found < distance[rows]) | (found == distance[rows]) & (mine[best] < number[rows])
            number[rows] = np.where(better, mine[best], number[rows])
            distance[rows] = np.where(better, found, distance[rows])
        pairs = _expanded(_expanded(pairs[~leaves], tree.kids, 0), other.kids, 1)
    if compared is not None:
        compared.append(seen)
    return number, distance


def _blocks(whole: DataFrame, length: int) -> DataFrame:
    """``whole`` (id, v) as blocks: ids, matrix, tree; a row each."""
    fields = ("ids", "matrix", "tree_order", "centre", "radius", "kids", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(waiting)
            waiting.clear()
            m = pa.concat_arrays([c.flatten() for c in table["v"].chunks]).to_numpy(zero_copy_only=False).reshape(-1, length)
            row = {"matrix": m.tobytes()} | CoverTree(m).pack()
            return pa.RecordBatch.from_arrays([pa.array([table["id"].to_pylist()], pa.list_(pa.int64())), *(pa.array([row[f]], pa.binary()) for f in fields[1:])], names=list(fields))

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, BLOCK - sum(x.num_rows for x in waiting))
                waiting.append(part)
                at += part.num_rows
                if sum(x.num_rows for x in waiting) == BLOCK:
                    yield block()
        if waiting:
            yield block()

    return whole.mapInArrow(cut, "ids array<long>, matrix binary, tree_order binary, centre binary, radius binary, kids binary, spans binary")


def _each_block(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[list, np.ndarray, CoverTree]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {f: batch.column(n)[k] for n, f in enumerate(batch.schema.names)}
            packed = {f: row[f].as_py() for f in batch.schema.names if f != "ids"}
            yield row["ids"].as_py(), np.frombuffer(packed["matrix"], np.int64).reshape(-1, length), CoverTree.unpack(packed)


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, length: int = LENGTH, scale: float = SCALE, seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector after ``rounds`` rounds.

    Vectors without exactly ``length`` components, all of them finite numbers, take no part. Components become floor(scale
    * x), in double precision; one whose squared distances could need more than 64 bits raises. The first centroids are the vectors whose ids have the smallest sha256
    of "seed:id"; of equal or null ids (which come last) the smallest vector's. Fewer vectors than ``clusters`` give as
    many centroids. Each round assigns all vectors to the nearest centroid (ties: the smaller number) and moves each centroid to
    the floor of its vectors' mean; one without vectors stays. A repeated row is a vector of its own. Distances are squared.
    Inertias are sums of distances; a sum beyond 64 bits raises. Other columns are left aside; an empty table gives no rows.

    ``clusters * length`` numbers come to the driver and go to every task.
    """
    spark, v, largest = vectors.sparkSession, F.col(vec_col), math.isqrt((2**63 - 1) // length) // 2
    fit = (F.size(v) == length) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    big = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    whole = vectors.where(F.coalesce(fit, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")).alias("v"), F.exists(big, lambda x: F.abs(x) > largest).alias("big"))
    checked = whole.withColumn("v", F.when(F.col("big"), F.raise_error(F.lit("a component is too large"))).otherwise(F.col("v"))).select("id", "v")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    # ``clusters`` rows
    first = checked.orderBy(name.asc_nulls_last(), "v").limit(clusters).collect()
    centroids = np.array([r["v"] for r in first], np.int64).reshape(-1, length)
    blocks = written(_blocks(checked, length), "blocks")

    def sums(at: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros(at.shape, object), np.zeros(len(at), np.int64)
            for _, x, tree in _each_block(batches, length):
                number, _ = nearest_centroids(x, tree, at)
                for k in np.unique(number).tolist():
                    total[k] = total[k] + x[number == k].sum(axis=0)
                    count[k] += int((number == k).sum())
            for k in np.flatnonzero(count).tolist():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(length, k, np.int32)), pa.array(np.arange(length, dtype=np.int32)), pa.array([int(s) for s in total[k]], pa.decimal128(38, 0)), pa.array(np.full(length, count[k]))], names=["cluster", "component", "total", "n"])

        return run

    for _ in range(rounds if len(centroids) else 0):
        part = blocks.mapInArrow(sums(centroids), "cluster int, component int, total decimal(38,0), n long")
        # ``clusters * length`` rows
        found = part.groupBy("cluster", "component").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
        centroids = centroids.copy()
        for r in found:
            centroids[r["cluster"], r["component"]] = int(r["total"]) // r["n"]

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, tree in _each_block(batches, length):
            number, distance = nearest_centroids(x, tree, centroids)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(number.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    assigned = written(blocks.mapInArrow(last, "vec_id long, cluster int, distance long"), "assigned")
    # ``clusters`` rows
    inertia = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    if sum(inertia.values()) >= 2**63:
        raise OverflowError("the inertia has more than 64 bits")
    rows = [(k, s, sum(inertia.values()), ",".join(map(str, centroids[k].tolist()))) for k, s in inertia.items()]
    per = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid string")
    return assigned.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings of 64 components in sixteen clusters after three rounds."""
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    steps = [
        """
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e, row_number() OVER () AS r
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT r, unnest(generate_series(1, 64)) AS i, unnest(e) AS x FROM v
), c0 AS MATERIALIZED (
  SELECT k, unnest(generate_series(1, 64)) AS i, unnest(e) AS x
  FROM (SELECT e, row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, e) - 1 AS k FROM v) WHERE k < 16
)"""
    ]
    for n in range(ROUNDS + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT r, k, d FROM (
    SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, k) AS o
    FROM (SELECT r, k, CAST(sum((p.x - c.x) * (p.x - c.x)) AS BIGINT) AS d FROM p JOIN c{n} c ON c.i = p.i GROUP BY r, k)
  ) WHERE o = 1
)""")
        if n < ROUNDS:
            steps.append(f"""c{n + 1} AS MATERIALIZED (
  SELECT c.k, c.i, CASE WHEN m.n IS NULL THEN c.x ELSE CAST((m.s - ((m.s % m.n) + m.n) % m.n) // m.n AS BIGINT) END AS x
  FROM c{n} c LEFT JOIN (SELECT k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM p JOIN a{n} a USING (r) GROUP BY k, i) m ON m.k = c.k AND m.i = c.i
)""")
    return ",\n".join(steps) + f"""
SELECT v.vec_id, CAST(a.k AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, s.h AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (r) JOIN (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c{ROUNDS} GROUP BY k) s ON s.k = a.k"""


ORACLE_SQL = {"op13_centroid_clustering": _sql()}
