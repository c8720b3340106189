"""Blocks of queries against shards of candidates.

Each cell of the grid is one task's work: a block of queries and a shard of candidates, both of bounded
size. Vectors are copied once for each block or shard that they meet; nothing is broadcast and no pairs
are made. Both sides are dealt out by a hash of the id, so hot vectors spread.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

#: Lists merged at once on the way up the tree.
FAN_IN = 16


def usable(df: DataFrame, id_col: str, vec_col: str, nonzero: bool = False) -> DataFrame:
    """(id, v): one row for each id. Vectors that are null or empty, or hold null or non-finite components, and rows without an id go; of several vectors of one id the smallest stays. ``nonzero`` drops zero vectors."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = df.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad)
    if nonzero:
        good = good.where(F.exists(v, lambda x: x != 0))
    return good.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(v.cast("array<double>")).alias("v"))


def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a cell's side, by id."""
    ids = table["id"].to_numpy()
    values = pa.concat_arrays([c.flatten() for c in table["v"].chunks]).to_numpy(zero_copy_only=False) if len(ids) else np.zeros(0)
    order = np.argsort(ids, kind="stable")
    return ids[order], values.reshape(len(ids), -1)[order]


def cells(queries: DataFrame, candidates: DataFrame, search: Callable, kind: str, block: int, cell_values: int, least: int) -> tuple[DataFrame, int]:
    """``search(query ids, query vectors, candidate ids, candidate vectors)`` for each cell, with a column ``node``, the shard; and the number of shards.

    Vectors meet only vectors of their own length. ``cell_values`` bounds a shard's components. Shards are smaller, down to
    ``least`` vectors, where there would be fewer cells than shuffle partitions; the lists that merge are the same.
    """
    n_queries = queries.count()
    n, longest = candidates.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, -(-n_queries // block))
    wanted = -(-int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks)
    shards = max(1, -(-n * (longest or 1) // cell_values), min(wanted, -(-n // least)))
    deal = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    left = queries.select("id", "v", F.size("v").alias("dim"), deal(blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("node"))
    right = candidates.select("id", "v", F.size("v").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), deal(shards).alias("node"))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64() if "score long" in kind else pa.float64()), ("node", pa.int32())])

    def cell(key, a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return schema.empty_table()
        q, c, s = search(*matrix(a), *matrix(b))
        return pa.table([q, c, s, np.full(len(q), key[2].as_py(), np.int32)], schema=schema)

    keys = ("dim", "block", "node")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, f"query_id long, vec_id long, {kind}, node int"), shards


def merged(lists: DataFrame, k: int, best: Callable, shards: int) -> DataFrame:
    """Each query's first ``k`` by ``best(score)``, ties to the smaller id; lists of shards merge in a tree."""
    lists = lists.withColumn("rank", F.lit(0))
    while True:
        shards = -(-shards // FAN_IN)
        order = Window.partitionBy("query_id", "node").orderBy(best("score"), "vec_id")
        lists = lists.withColumn("node", F.floor(F.col("node") / FAN_IN).cast("int")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if shards <= 1:
            return lists.select("query_id", "rank", "vec_id", "score")
