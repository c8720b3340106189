"""Hard negatives by a pivot table.

Vectors get one more component, so that all have the same length; an anchor gets a zero there. The higher the inner product
of an anchor and a vector, the smaller then their Euclidean distance. A few pivots are chosen from a bounded sample, and each
vector is stored with its distances to them. By the triangle inequality an anchor's own distances bracket its distance
to a vector, and so their score; only vectors whose bracket meets the scores asked for are checked exactly.

Brackets rule out at three levels. A ring is what lies near one pivot, at distances between two cuts; tasks hold rings, cut
into shards where they are large. An anchor first meets its own ring, which bounds what it asks of the others; rings
whose bracket is out aren't met at all. Within a shard the same holds for tiles, then for single vectors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..shared import written
from ._grid import FAN_IN
from .topk import _product

#: Pivots, vectors of the sample they are chosen from, rings of a pivot at most.
PIVOTS, SAMPLE, RINGS = 16, 2048, 32
#: Vectors of a ring before there is another, and of a shard; anchors of a block; vectors of a tile.
SHARD_ROWS, BLOCK, TILE = 1 << 14, 256, 128
NO_SCORE = -(2**63)


def farthest_first(points: np.ndarray, number: int) -> np.ndarray:
    """``number`` rows, each the farthest from those before; fewer if no others differ."""
    if not len(points):
        return points
    chosen, least = [0], ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < number and least.max() > 0:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


@dataclass
class Pivots:
    """Pivots with their last component; ``top`` is the largest square of a vector's length."""

    points: np.ndarray
    top: float

    @classmethod
    def of(cls, sample: list[list[int]], top: int, number: int = PIVOTS) -> Pivots:
        width = max(map(len, sample), default=1)
        m = np.zeros((len(sample), width + 1))
        for k, v in enumerate(sample):
            m[k, : len(v)] = v
        m[:, -1] = np.sqrt(np.maximum(0.0, top - (m**2).sum(axis=1)))
        found = farthest_first(m, number)
        return cls(found if len(found) else np.zeros((1, width + 1)), float(top))

    def distances(self, v: np.ndarray, anchors: bool = False) -> np.ndarray:
        """Of each row to each pivot; vectors shorter than the longest count as if zeros followed."""
        x = v.astype(np.float64)
        square = (x**2).sum(axis=1)
        last = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(0.0, self.top - square))
        n = min(x.shape[1], self.points.shape[1] - 1)
        dots = x[:, :n] @ self.points[:, :n].T + last[:, None] * self.points[None, :, -1]
        return np.sqrt(np.maximum(0.0, (square + last**2)[:, None] + (self.points**2).sum(axis=1)[None] - 2 * dots))

    def bracket(self, low: np.ndarray, high: np.ndarray, anchor: np.ndarray, square: float) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of an anchor (its distances, the square of its length) with vectors whose distances lie between ``low`` and ``high``."""
        base = square + self.top
        near = np.maximum(0.0, np.maximum(low - anchor, anchor - high)).max(axis=1)
        far = (anchor + high).min(axis=1)
        # distances are rounded; the slack covers some hundred roundings of the largest number met
        slack = 1e-12 * base * len(self.points) + 1e-6 * math.sqrt(base) + 1.0
        return (base - far**2) / 2 - slack, (base - near**2) / 2 + slack


class Shard:
    """Vectors of one task, by their distance from the nearest pivot, in tiles with the range of their distances."""

    def __init__(self, table: pa.Table, pivots: Pivots):
        self.pivots = pivots
        ids, v = table["id"].to_numpy(), _matrix(table["v"])
        away = _matrix(table["away"])
        order = np.lexsort((ids, away.min(axis=1)))
        self.ids, self.v, self.away = ids[order], v[order], away[order]
        self.labels = table["label"].to_numpy()[order]
        starts = np.arange(0, len(ids), TILE)
        self.low, self.high, self.starts = np.minimum.reduceat(self.away, starts), np.maximum.reduceat(self.away, starts), starts

    def within(self, anchor: np.ndarray, square: float, least: float, most: float) -> np.ndarray:
        """Rows that a score from ``least`` to ``most`` isn't ruled out for."""
        s, t = self.pivots.bracket(self.low, self.high, anchor, square)
        tiles = np.flatnonzero((t >= least) & (s <= most))
        rows = (self.starts[tiles][:, None] + np.arange(TILE)[None]).ravel()
        rows = rows[rows < len(self.ids)]
        s, t = self.pivots.bracket(self.away[rows], self.away[rows], anchor, square)
        return rows[(t >= least) & (s <= most)]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _by_length(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    v = batch.column(column)
    sizes = v.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        yield rows, v.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), n)


def best_positives(anchor: tuple, shard: Shard, k: int, checked: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the ``k`` highest scores of a shard of the anchor's label, from its bound on."""
    own, vector, away, square, least = anchor
    rows = shard.within(away, square, float(least), math.inf)
    rows = rows[shard.ids[rows] != own]
    if checked is not None:
        checked.append(len(rows))
    s = _product(vector[None], shard.v[rows])[0]
    good = s >= least
    rows, s = rows[good], s[good]
    first = np.lexsort((shard.ids[rows], ~s))[:k]
    return shard.ids[rows[first]], s[first]


def best_negatives(anchor: tuple, label, windows: list[tuple[int, int]], shard: Shard, k: int, checked: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores) for each window (least, most): the ``k`` highest scores within, of vectors with another label."""
    own, vector, away, square = anchor
    open_ = [w for w in windows if w[0] <= w[1]]
    rows = shard.within(away, square, float(min(w[0] for w in open_)), float(max(w[1] for w in open_))) if open_ else np.zeros(0, np.int64)
    rows = rows[(shard.labels[rows] != label) & (shard.ids[rows] != own)]
    if checked is not None:
        checked.append(len(rows))
    s = _product(vector[None], shard.v[rows])[0]
    order = np.lexsort((shard.ids[rows], ~s))
    ids, falling = shard.ids[rows[order]], s[order]
    out = []
    for least, most in windows:
        a = int(np.searchsorted(~falling, ~np.int64(most), side="left"))
        z = int(np.searchsorted(~falling, ~np.int64(least), side="right"))
        out.append((ids[a : min(z, a + k)], falling[a : min(z, a + k)]) if least <= most else (ids[:0], falling[:0]))
    return out


def _first(lists: DataFrame, keys: list[str], k: int, nodes: int) -> DataFrame:
    """The ``k`` first rows of each key by score, then id; lists of nodes merge in a tree."""
    lists = lists.withColumn("rank", F.lit(0))
    while True:
        nodes = -(-nodes // FAN_IN)
        order = Window.partitionBy(*keys, "node").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("node", F.floor(F.col("node") / FAN_IN).cast("int")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if nodes <= 1:
            return lists.drop("node")


def _rows(df: DataFrame, scale: float, id_col: str, label_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad)
    kind = df.select(label_col).dtypes[0][1]
    label = F.col(label_col).cast("long" if kind in ("tinyint", "smallint", "int", "bigint") else "string")
    whole = good.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")).alias("v"))
    return whole.withColumn("square", F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x))


def hard_negatives(
    vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0,
    id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", pivots: int = PIVOTS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of each anchor and positive.

    Components become floor(scale * x), in double precision; a score is an integer inner product with the anchor. An
    anchor's positives are the ``positives`` highest scores among ``vectors`` of its label; for each, the ``negatives``
    highest scores among other labels that are from ``low`` to ``high`` hundredths of the positive's. Ties go to the smaller id;
    ranks start at 1; fewer are fewer rows. A negative score of a positive leaves no such range.

    Rows without an id, a label or a vector, with an empty vector, or with null or non-finite components take no part. Rows of
    the anchor's own id are neither its positives nor its negatives. Of several anchors of one id the one of smallest label
    and vector counts; other repeated rows stay, each for itself. Vectors of different lengths don't meet. A square or score
    beyond 64 bits raises. Other columns are left aside; empty tables give no rows. ``low`` and ``high`` aren't negative.
    """
    spark = vectors.sparkSession
    whole = written(_rows(vectors, scale, id_col, label_col, vec_col), "vectors")
    asked = _rows(anchors, scale, id_col, label_col, vec_col).groupBy("id").agg(F.min(F.struct("label", "v", "square")).alias("m")).select("id", "m.*")
    top = whole.agg(F.max("square")).first()[0] or 0
    # SAMPLE vectors
    sample = whole.orderBy(F.xxhash64("id"), "v").limit(SAMPLE).select("v").collect()
    table = Pivots.of([r["v"] for r in sample], top, pivots)
    kind = whole.schema["label"].dataType.simpleString()

    def measure(as_anchors: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                away = np.zeros((batch.num_rows, len(table.points)))
                near = np.zeros(batch.num_rows, np.int32)
                for rows, v in _by_length(batch, "v"):
                    away[rows] = table.distances(v, as_anchors)
                    near[rows] = table.distances(v).argmin(axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, away.size + 1, away.shape[1], dtype=np.int32)), pa.array(away.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(near)], names=[*batch.schema.names, "away", "near"])

        return run

    schema = f"id long, label {kind}, v array<long>, square long, away array<double>, near int"
    found = written(whole.mapInArrow(measure(False), schema), "measured")
    # rings: cuts of the distances from the nearest pivot, a row for each pivot
    own = F.element_at("away", F.col("near") + 1)
    cuts = {}
    for r in found.groupBy("near").agg(F.count("*").alias("n"), F.percentile_approx(own, [k / RINGS for k in range(1, RINGS)], 1000).alias("cuts")).collect():
        n = min(RINGS, -(-r["n"] // SHARD_ROWS))
        cuts[r["near"]] = [r["cuts"][round(k * RINGS / n) - 1] for k in range(1, n)]
    edges = F.lit(0)
    for near, at in cuts.items():
        edges = F.when(F.col("near") == near, sum((F.when(own >= c, 1).otherwise(0) for c in at), F.lit(0))).otherwise(edges)
    ringed = lambda df: df.withColumn("ring", (F.col("near") * RINGS + edges).cast("int"))
    found = ringed(found)
    ends = [f(F.col("away")[k]) for f in (F.min, F.max) for k in range(len(table.points))]
    # at most PIVOTS * RINGS rows
    summary = found.groupBy("ring").agg(F.count("*").alias("n"), F.array(*ends).alias("ends")).orderBy("ring").collect()
    rings = np.array([r["ring"] for r in summary], np.int32)
    ranges = np.array([r["ends"] for r in summary]).reshape(len(summary), 2, len(table.points))
    shards = {r["ring"]: -(-r["n"] // SHARD_ROWS) for r in summary}
    most = max(shards.values(), default=1)
    nodes = len(table.points) * RINGS * most
    start = written(ringed(asked.mapInArrow(measure(True), schema)), "anchors")

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors (with least, most: the scores that matter) for each ring that may hold such a score, but their own."""
        for batch in batches:
            away, square = _matrix(pa.chunked_array([batch.column("away")])) if batch.num_rows else np.zeros((0, 1)), batch.column("square").to_pylist()
            least, upper = batch.column("least").to_numpy(), batch.column("most").to_numpy()
            home = batch.column("ring").to_numpy()
            which, to = [], []
            for k in range(batch.num_rows):
                s, t = table.bracket(ranges[:, 0], ranges[:, 1], away[k], float(square[k]))
                good = rings[(t >= float(least[k])) & (s <= float(upper[k])) & (rings != home[k])]
                which.append(np.full(len(good), k))
                to.append(good)
            if which:
                at = pa.array(np.concatenate(which).astype(np.int64))
                columns = {n: batch.column(n).take(at) for n in batch.schema.names} | {"ring": pa.array(np.concatenate(to).astype(np.int32))}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def met(asking: DataFrame, work: Callable, kind: str, labelled: bool) -> DataFrame:
        """``work(anchors, shard)`` for each block of anchors and shard of a ring that they ask."""
        blocks = {r[0]: -(-r[1] // BLOCK) for r in asking.groupBy("ring").count().collect()}
        # a row for each ring
        plan = F.broadcast(spark.createDataFrame([(r, blocks[r], n) for r, n in shards.items() if r in blocks], "ring int, blocks int, shards int"))
        deal = lambda m: F.pmod(F.xxhash64("id"), F.col(m)).cast("int")
        each = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
        left = asking.join(plan, "ring").withColumn("dim", F.size("v")).withColumn("block", deal("blocks")).withColumn("shard", each("shards"))
        right = found.join(plan, "ring").select("id", "label", "v", "away", "ring", F.size("v").alias("dim"), each("blocks").alias("block"), deal("shards").alias("shard"))
        keys = ["dim", "ring", "block", "shard", *(["label"] if labelled else [])]

        def cell(key, a: pa.Table, b: pa.Table) -> pa.Table:
            node = key[1].as_py() * most + key[3].as_py()
            columns: list[list] = [[] for _ in kind.split(",")]
            if len(a) and len(b):
                work(a, Shard(b, table), node, columns)
            types = [pa.int32() if x.split()[1] == "int" else pa.int64() for x in kind.split(",")]
            return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in kind.split(",")])

        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, kind)

    def parts(a: pa.Table) -> Iterator[tuple]:
        v, away = _matrix(a["v"]), _matrix(a["away"])
        for k, (own_id, square) in enumerate(zip(a["id"].to_pylist(), a["square"].to_pylist(), strict=True)):
            yield own_id, v[k], away[k], float(square)

    def near_ones(a: pa.Table, shard: Shard, node: int, columns: list[list]) -> None:
        for part, least in zip(parts(a), a["least"].to_pylist(), strict=True):
            ids, s = best_positives((*part, least), shard, positives)
            for c, x in zip(columns, ([part[0]] * len(ids), ids.tolist(), s.tolist(), [node] * len(ids)), strict=True):
                c += x

    def far_ones(a: pa.Table, shard: Shard, node: int, columns: list[list]) -> None:
        for part, label, those in zip(parts(a), a["label"].to_pylist(), a["pairs"].to_pylist(), strict=True):
            windows = [(p["least"], p["most"]) for p in those]
            for p, (ids, s) in zip(those, best_negatives(part, label, windows, shard, negatives), strict=True):
                for c, x in zip(columns, ([part[0]] * len(ids), [p["no"]] * len(ids), ids.tolist(), s.tolist(), [node] * len(ids)), strict=True):
                    c += x

    def spread(asking: DataFrame) -> DataFrame:
        return written(asking.mapInArrow(others, asking.schema), "asking")

    lists = "query_id long, vec_id long, score long, node int"
    free = start.withColumn("least", F.lit(NO_SCORE)).withColumn("most", F.lit(2**63 - 1))
    home = written(met(free, near_ones, lists, True), "lists")
    bound = _first(home, ["query_id"], positives, nodes).where(F.col("rank") == positives).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    again = start.join(bound, "id", "left").withColumn("least", F.coalesce("kth", F.lit(NO_SCORE))).drop("kth").withColumn("most", F.lit(2**63 - 1))
    near = written(_first(home.unionByName(met(spread(again), near_ones, lists, True)), ["query_id"], positives, nodes), "positives")

    # of equal rows of a positive one is enough; at most ``positives`` in a list
    hundredths = lambda n: F.col("score").cast("decimal(20,0)") * n / 100
    pairs = near.groupBy("query_id", "vec_id", "score").agg(F.min("rank").alias("no"))
    pairs = written(pairs.select("query_id", "no", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.ceil(hundredths(low)).cast("long").alias("least"), F.floor(hundredths(high)).cast("long").alias("most")).where("least <= most"), "pairs")

    def asking(open_: DataFrame) -> DataFrame:
        each = open_.groupBy(F.col("query_id").alias("id")).agg(F.collect_list(F.struct("no", "least", "most")).alias("pairs"), F.min("least").alias("least"), F.max("most").alias("most"))
        return start.join(each, "id")

    triples = "query_id long, no long, vec_id long, score long, node int"
    home = written(met(asking(pairs), far_ones, triples, False), "lists")
    kth = _first(home, ["query_id", "no"], negatives, nodes).where(F.col("rank") == negatives).select("query_id", "no", F.col("score").alias("kth"))
    open_ = pairs.join(kth, ["query_id", "no"], "left").withColumn("least", F.greatest("least", "kth"))
    lists = home.unionByName(met(spread(asking(open_)), far_ones, triples, False))
    best = _first(lists, ["query_id", "no"], negatives, nodes).withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score")
    return best.join(pairs, ["query_id", "no"]).select(F.col("query_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def relabelled(vec_id: Column, label: Column) -> Column:
    """The label, moved on by one of ten where the id is divisible by seven."""
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of five positives of each fiftieth embedding."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = vectors.withColumn("label", relabelled(F.col("vec_id"), F.col("label")))
    return hard_negatives(vectors, vectors.where(F.col("vec_id") % 50 == 0))


ORACLE_SQL = {
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same,
         CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON c.vec_id <> a.vec_id AND len(c.e) = len(a.e)
  WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same
  ) WHERE k <= 5
), n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
""",
}
