"""Exact search for the highest inner products.

Vectors of floats become vectors of integers; a query's score with a candidate is an integer inner
product. Cells of the grid are worked through in tiles: a matrix product, then a partial selection of each
query's ``k`` best of the tile. Lists of a query merge within the cell and then up a tree of shards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..shared import written
from ._grid import cells, merged, usable

#: Queries in a block, candidates in a tile, components in a shard (64 MB).
BLOCK, TILE, SHARD_VALUES = 2048, 4096, 1 << 23


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer matrix product; floating point where it is exact, else 64-bit integers. Raises if a score needs more."""
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if largest < 2**24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if largest < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if largest < 2**63:
        return q @ c.T
    whole = q.astype(object) @ c.astype(object).T
    if whole.size and max(whole.max(), -whole.min()) >= 2**63:
        raise OverflowError("a score has more than 64 bits")
    return whole.astype(np.int64)


def best_of_tiles(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's ``k`` best candidates, itself excepted; ids ascend. The order of the rows is free."""
    out = []
    for a in range(0, len(q_ids), 512):
        mine = slice(a, a + 512)
        rows = np.arange(len(q_ids[mine]))[:, None]
        kept_s = np.zeros((len(rows), 0), np.int64)
        kept_i = np.zeros((len(rows), 0), np.int64)
        for z in range(0, len(c_ids), TILE):
            s = _product(q[mine], c[z : z + TILE])
            i = np.broadcast_to(np.arange(z, z + s.shape[1]), s.shape)
            own = q_ids[mine][:, None] == c_ids[z : z + TILE][None, :]
            s, i = np.concatenate((kept_s, s), 1), np.concatenate((kept_i, i), 1)
            own = np.concatenate((kept_i < 0, own), 1)
            if s.shape[1] > k:
                # one number orders by score, then by place, which follows the id
                low, span = int(s.min()), len(c_ids) + 2
                if (int(s.max()) - low + 2) * span < 2**62:
                    key = np.where(own, -1, (s - low) * span + (span - 2 - i))
                    best = np.argpartition(key, -k, axis=1)[:, -k:]
                else:
                    best = np.lexsort((i, ~s, own), axis=1)[:, :k]
                s, i, own = s[rows, best], i[rows, best], own[rows, best]
            kept_s, kept_i = s, np.where(own, -1, i)
        good = kept_i >= 0
        ids = np.broadcast_to(q_ids[mine][:, None], good.shape)
        out.append((ids[good], c_ids[kept_i[good]], kept_s[good]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each query the ``k`` rows of ``vectors`` of highest inner product, a row of the same id excepted.

    Components become floor(scale * x), in double precision. Returns query_id, rank (from 1), vec_id, score;
    ties go to the smaller id. Both tables need ``id_col`` and ``vec_col``. Rows whose vector is null, empty,
    or holds null or non-finite components, and rows without an id, take no part. An id stands for one
    vector; if it repeats, the smallest vector counts. Vectors of different lengths don't meet. A score
    beyond 64 bits raises. Empty tables give no rows.
    """
    whole = lambda df: df.withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long")))
    # both are counted, then dealt out; the grouping behind them happens once
    q, c = (written(whole(usable(x, id_col, vec_col)), "vectors") for x in (queries, vectors))
    search = lambda *cell: best_of_tiles(*cell, k)
    lists, shards = cells(q, c, search, "score long", BLOCK, SHARD_VALUES, TILE)
    return merged(lists, k, F.desc, shards)


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each twentieth embedding's 20 highest scores among all others."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_inner_products(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


ORACLE_SQL = {
    "op2_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score
  FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
""",
}
