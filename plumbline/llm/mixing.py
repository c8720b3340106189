"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are cut into blocks. With weight w, its share of all weights, block j of a source (from 0) is released at
slot floor(j / w) and due by slot ceil((j + 1) / w); of the released blocks the one due first takes the slot. At every
slot each source with blocks left has had its weight's share, less than one block off. A source that has run
out leaves its slots empty; what is left keeps its order and its ratios.

Weights are the exact values of their floating-point numbers, and releases and deadlines follow from them in whole numbers
of any length, so nothing is rounded and nothing adds up. Sources of one weight and as many blocks are a class: what the scheduler
sees is classes, each with the weight of its members together, and the members take turns. With m members, turns are at most
1 - 1/m of a block off the class's blocks / m, and the class is less than one block off its own share, of which
a member has 1/m; so each member is less than one block off.

The plan has a row for each block. Blocks are as long as needed to be SLOTS or fewer, besides one for each source.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..shared import written
from ._ranks import ranked

#: Least rows of a block, whole blocks of a plan at most, exponent of a source's size.
BLOCK_ROWS, SLOTS, EXPONENT = 64, 1 << 18, 0.5
#: Plans of more rows are joined by a shuffle. A row has three longs.
BROADCAST_ROWS = 1 << 19


def whole(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the ratios of the weights, which are all above zero and finite."""
    exact = [Fraction(w) for w in weights]
    if any(w <= 0 for w in exact):
        raise ValueError("a weight isn't above zero")
    common = math.lcm(*(w.denominator for w in exact))
    out = [int(w * common) for w in exact]
    divisor = math.gcd(*out) or 1
    return [x // divisor for x in out]


def schedule(weights: list[int], blocks: list[int]) -> Iterator[tuple[int, int, int]]:
    """(slot, source, block), in turn, by earliest deadline among released blocks; sources with ``blocks`` each."""
    total = sum(weights)
    waiting = [(0, s, 0) for s, n in enumerate(blocks) if n]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    t = 0
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[s]), s, j))
        due, s, j = heapq.heappop(ready)
        assert due > t
        yield t, s, j
        t += 1
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, ((j + 1) * total // weights[s], s, j + 1))


def size_weights(docs: DataFrame, source_col: str = "source", exponent: float = EXPONENT) -> DataFrame:
    """(source, weight): for every source, null too, its rows to the power ``exponent``."""
    sizes = docs.groupBy(F.col(source_col).cast("string").alias("source")).count()
    return sizes.select("source", F.pow("count", F.lit(exponent)).alias("weight"))


def _members(docs: DataFrame, weights: DataFrame, source_col: str, block_rows: int | None) -> tuple[DataFrame, int]:
    """(_source, _weight, _blocks) of every source in ``docs``, as a table; and the rows of a block."""
    worst, least, top = weights.agg(F.min("weight"), F.min(F.when(F.col("weight") > 0, F.col("weight"))), F.max("weight")).first()
    if worst is not None and (worst < 0 or least is None or not math.isfinite(top)):
        raise ValueError("weights must be finite, none negative, not all zero")
    given = weights.where("weight > 0").select(F.col("source").cast("string").alias("_name"), F.col("weight").cast("double").alias("_weight"))
    sources = written(docs.groupBy(F.col(source_col).cast("string").alias("_source")).agg(F.count("*").alias("_rows")), "sizes")
    if block_rows is None:
        block_rows = max(BLOCK_ROWS, -(-(sources.agg(F.sum("_rows")).first()[0] or 0) // SLOTS))
    found = sources.join(given, F.col("_source").eqNullSafe(F.col("_name")), "left")
    blocks = F.ceil(F.col("_rows") / block_rows).cast("long")
    return written(found.select("_source", F.coalesce("_weight", F.lit(float(least or 1.0))).alias("_weight"), blocks.alias("_blocks")), "sources"), block_rows


def mix(docs: DataFrame, weights: DataFrame | list[tuple[str | None, float]], block_rows: int | None = None, source_col: str = "source") -> DataFrame:
    """``docs`` with ``mix_block`` (within its source), ``mix_slot`` and ``mix_place`` (within the block).

    Order by slot, then place, is the mixed order. Every row stays, once, and every source is one of its own.
    ``weights`` is a table (source, weight), each source once, or a list of such pairs. Sources without a weight, or of weight zero, null
    among them unless it has one, each have the least weight above zero. ``block_rows`` is BLOCK_ROWS, or more where there would be more than
    SLOTS whole blocks. Within a source, rows come in an order that hashes of their contents give. ``docs`` must read the same each time,
    as a table does; all its columns are kept, those of the new names replaced. Repeated rows stay. An empty table stays empty.
    """
    spark = docs.sparkSession
    if not isinstance(weights, DataFrame):
        weights = spark.createDataFrame([(s, float(w)) for s, w in weights], "source string, weight double")
    members, block_rows = _members(docs, weights, source_col, block_rows)
    members, sizes = ranked(members, "_weight", "_blocks")
    # a row for each weight and number of blocks
    classes = sorted((r["_weight"], r["_blocks"], r["_m"]) for r in sizes.groupBy("_weight", "_blocks").agg(F.sum("_n").alias("_m")).collect())
    table = spark.createDataFrame([(k, *c) for k, c in enumerate(classes)], "_class long, _w double, _b long, _m long")
    members = members.join(F.broadcast(table), (F.col("_weight") == F.col("_w")) & (F.col("_blocks") == F.col("_b"))).select("_source", "_class", F.col("_rank").alias("_turn"), "_m")
    keep = [c for c in docs.columns if c not in ("mix_block", "mix_slot", "mix_place")]
    found, _ = ranked(docs.select(F.struct(*(f"`{c}`" for c in keep)).alias("_row"), F.col(source_col).cast("string").alias("_source")), "_source", also=members)
    found = found.withColumn("mix_block", F.floor(F.col("_rank") / block_rows)).withColumn("mix_place", (F.col("_rank") % block_rows).cast("int"))
    found = found.withColumn("_i", F.col("mix_block") * F.col("_m") + F.col("_turn"))
    shares = [w * m for w, (*_, m) in zip(whole([w for w, *_ in classes]) if classes else [], classes, strict=True)]
    at, own, number = array("q"), array("q"), array("q")
    for t, s, j in schedule(shares, [b * m for _, b, m in classes]):
        at.append(t)
        own.append(s)
        number.append(j)
    plan = spark.createDataFrame(pa.table({"_s": pa.array(own, pa.int64()), "_j": pa.array(number, pa.int64()), "mix_slot": pa.array(at, pa.int64())}))
    placed = found.join(F.broadcast(plan) if len(at) <= BROADCAST_ROWS else plan, (F.col("_class") == F.col("_s")) & (F.col("_i") == F.col("_j")))
    return placed.select("_row.*", "mix_block", "mix_slot", "mix_place")


def in_order(mixed: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows of ``mixed`` in their order, over partitions that each hold a range of slots."""
    spark = mixed.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(parts, "mix_slot", "mix_place").sortWithinPartitions("mix_slot", "mix_place")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in a mix of the sources."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix(docs, size_weights(docs))
