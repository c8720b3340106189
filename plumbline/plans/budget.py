"""A token budget spent over sorted modules, without a loop over them.

What a stretch of sorted modules does is a function from the budget left before to the budget left after it: on
ranges of budgets it takes off a constant. Each stretch is summarised as such a function by the task that sorts it. The
functions are composed up a tree, the budget goes down the tree again, and each stretch, told what it starts with, chooses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..shared import written

#: Functions composed at once.
FAN_IN = 64
NEVER = 2**62


class Spend:
    """Budget left after a stretch, by budget left before: ``x - off[i]`` for x from ``start[i]`` up to the next start.

    ``start`` begins with 0; budgets above ``most`` don't occur.
    """

    def __init__(self, most: int, start: np.ndarray | None = None, off: np.ndarray | None = None):
        self.most = most
        self.start = np.zeros(1, np.int64) if start is None else start
        self.off = np.zeros(1, np.int64) if off is None else off

    def __call__(self, x: int) -> int:
        return x - int(self.off[np.searchsorted(self.start, x, side="right") - 1])

    def highest(self) -> np.ndarray:
        """The greatest budget that each range leaves."""
        return np.append(self.start[1:], self.most + 1) - 1 - self.off

    def then(self, start: np.ndarray, off: np.ndarray) -> Spend:
        """This, and after it the function of ``start`` and ``off``."""
        low, high = self.start - self.off, self.highest()
        first = np.searchsorted(start, low, side="right") - 1
        many = np.searchsorted(start, high, side="right") - first
        own = np.repeat(np.arange(len(low)), many)
        at = np.repeat(first, many) + np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
        return Spend(self.most, np.maximum(low[own], start[at]) + self.off[own], self.off[own] + off[at])._joined()

    def _joined(self) -> Spend:
        new = np.append(True, np.diff(self.off) != 0)
        return Spend(self.most, self.start[new], self.off[new])

    def item(self, full: int, short: int) -> Spend:
        """This, and after it a module: ``full`` if it fits, else ``short`` if that fits."""
        less = min(full, short)
        starts = [0, *([short] if 0 < short < full else []), *([full] if 0 < full <= self.most else [])]
        offs = [0 if 0 < less else (full if full == 0 else short), *([short] if 0 < short < full else []), *([full] if 0 < full <= self.most else [])]
        return self.then(np.array(starts, np.int64), np.array(offs, np.int64))

    @classmethod
    def of(cls, full: np.ndarray, short: np.ndarray, times: np.ndarray, most: int) -> Spend:
        """Modules one after another, each ``times`` times."""
        self, at, less = cls(most), 0, np.minimum(full, short)
        while at < len(less):
            top = int(self.highest().max())
            fits = np.flatnonzero(less[at:] <= top)
            if not len(fits):
                break
            at += int(fits[0])
            for _ in range(int(times[at])):
                before = self
                self = self.item(int(full[at]), int(short[at]))
                if len(before.off) == len(self.off) and (before.off == self.off).all():
                    break
            at += 1
        return self

    def pack(self) -> bytes:
        return self.start.tobytes() + self.off.tobytes()

    @classmethod
    def unpack(cls, raw: bytes, most: int) -> Spend:
        both = np.frombuffer(raw, np.int64).reshape(2, -1)
        return cls(most, both[0], both[1])


def choices(full: np.ndarray, short: np.ndarray, times: np.ndarray, left: int) -> Iterator[tuple[int, str, int]]:
    """(index, choice, times) of the modules that go in, in turn."""
    less, at = np.minimum(full, short), 0
    while at < len(less):
        fits = np.flatnonzero(less[at:] <= left)
        if not len(fits):
            return
        at += int(fits[0])
        n = int(times[at])
        for size, choice in ((int(full[at]), "full"), (int(short[at]), "short")):
            here = (n if size == 0 else min(n, left // size)) if size <= left else 0
            if here:
                yield at, choice, here
                left, n = left - here * size, n - here
        at += 1


def token_pack(modules: DataFrame, budget: int, reserve: int = 800) -> DataFrame:
    """(path, choice) of modules (rank, path, full, short) that go into a token budget.

    In order of rank, then path, full and short, a module goes in whole if its ``full`` tokens fit into what is left, else
    ``short`` if those fit, else not; later, smaller ones may still fit. A null rank or path comes last. A null size
    doesn't fit, one below zero counts as zero, and zero always fits. Repeated rows are taken one after another. A budget
    of ``reserve`` or less leaves room for sizes of zero only. Other columns are left aside.
    """
    most = max(0, budget - reserve)
    size = lambda c: F.greatest(F.lit(0), F.coalesce(F.col(c).cast("long"), F.lit(NEVER))).alias(c)
    sizes = modules.select("rank", "path", size("full"), size("short")).where(F.least("full", "short") <= most)
    each = sizes.groupBy("rank", "path", "full", "short").agg(F.count("*").alias("times"))
    order = [F.col("rank").asc_nulls_last(), F.col("path").asc_nulls_last(), F.col("full"), F.col("short")]
    parts = max(1, int(modules.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind = "part int, at int, paths array<string>, full array<long>, short array<long>, times array<long>, spend binary"

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each batch of sorted modules as one row, with its function."""
        for number, batch in enumerate(b for b in batches if b.num_rows):
            full, short, times = (batch.column(k).to_numpy() for k in (2, 3, 4))
            spend = Spend.of(full, short, times, most).pack()
            lists = [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(k)) for k in (1, 2, 3, 4)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(0, 1), pa.array([number], pa.int32()), *lists, pa.array([spend], pa.binary())], names=[x.split()[0] for x in kind.split(", ")])

    ordered = each.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), F.col("path").cast("string").alias("path"), "full", "short", "times")
    rows = written(ordered.mapInArrow(stretches, kind), "stretches")
    # a number for each partition
    before, total = {}, 0
    for r in rows.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        before[r["part"]], total = total, total + r["n"]
    starts = modules.sparkSession.createDataFrame(list(before.items()), "part int, before long")
    rows = rows.join(F.broadcast(starts), "part").withColumn("node", F.col("before") + F.col("at"))

    levels, nodes = [rows.select("node", "spend")], total

    def composed(key, table):
        table = table.sort_by("node")
        done = Spend(most)
        for raw in table["spend"].to_pylist():
            later = Spend.unpack(raw, most)
            done = done.then(later.start, later.off)
        return pa.table({"node": [key[0].as_py()], "spend": pa.array([done.pack()], pa.binary())})

    def entered(key, table):
        table = table.sort_by("node")
        left, out = table["left"][0].as_py(), []
        for raw in table["spend"].to_pylist():
            out.append(left)
            left = Spend.unpack(raw, most)(left)
        return pa.table({"node": table["node"], "left": pa.array(out, pa.int64())})

    above = F.floor(F.col("node") / FAN_IN).cast("long")
    while nodes > FAN_IN:
        levels.append(written(levels[-1].withColumn("up", above).groupBy("up").applyInArrow(composed, "node long, spend binary"), "spends"))
        nodes = -(-nodes // FAN_IN)
    entry = modules.sparkSession.createDataFrame([(0, most)], "up long, left long")
    for level in reversed(levels):
        entry = level.withColumn("up", above).join(entry, "up").groupBy("up").applyInArrow(entered, "node long, left long").withColumnRenamed("node", "up")
        if level is not levels[0]:
            entry = written(entry, "entries")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                full, short, times = (batch.column(n)[k].values.to_numpy() for n in (1, 2, 3))
                found = list(choices(full, short, times, batch.column(4)[k].as_py()))
                at, choice, n = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0)[k].values.take(pa.array(at, pa.int64())), pa.array(choice, pa.string()), pa.array(n, pa.int64())], names=["path", "choice", "times"])

    told = rows.join(entry.select(F.col("up").alias("node"), "left"), "node").select("paths", "full", "short", "times", "left")
    chosen = told.mapInArrow(choose, "path string, choice string, times long")
    return chosen.select("path", "choice", F.explode(F.sequence(F.lit(1), "times"))).select("path", "choice")
