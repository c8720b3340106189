"""The longest simple paths, without writing down all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..shared import written
from .graph import strong_components

#: Paths that growth keeps at first; more are kept, eightfold each time, until the result is certain; beyond WIDE, all are.
BEAM, WIDE = 64, 1 << 15
JOIN = " > "


def rest(steps: DataFrame, most: int, components: DataFrame | None = None) -> DataFrame:
    """(path, rest): vertices that a simple path from each vertex can have at most, up to ``most``.

    With ``components`` (path, component), strong components are condensed, each weighing its vertices; without, each vertex
    stands for itself. The heaviest way on from each grows by rounds of max-plus, at least one vertex in each, so that ``most`` rounds
    are enough.
    """
    every = steps.select(F.col("src").alias("path")).union(steps.select("dst")).distinct()
    if components is None:
        links, weight = steps.select(F.col("src").alias("from"), F.col("dst").alias("c")), written(every.select(F.col("path").alias("c"), F.lit(1).alias("w")), "weights")
    else:
        named = written(every.join(components.select("path", "component"), "path", "left").select("path", F.coalesce("component", "path").alias("c")), "condensed")
        weight = written(named.groupBy("c").agg(F.least(F.count("*"), F.lit(most)).cast("int").alias("w")), "weights")
        a, b = named.select(F.col("path").alias("src"), F.col("c").alias("from")), named.select(F.col("path").alias("dst"), F.col("c").alias("c"))
        links = written(steps.join(a, "src").join(b, "dst").select("from", "c").where(F.col("from") != F.col("c")).distinct(), "links")
    best, rounds = weight.select("c", F.col("w").alias("r")), 1
    while rounds < most:
        for _ in range(min(4, most - rounds)):
            on = links.join(best, "c").groupBy(F.col("from").alias("c")).agg(F.max("r").alias("on"))
            best = weight.join(on, "c", "left").select("c", F.least(F.col("w") + F.coalesce("on", F.lit(0)), F.lit(most)).alias("r"))
            rounds += 1
        best = written(best, "rest")
    return best.select(F.col("c").alias("path"), F.col("r").alias("rest")) if components is None else written(named.join(best, "c").select("path", F.col("r").alias("rest")), "rest")


def chains(edges: DataFrame, longer_than: int, keep: int = 10, components: DataFrame | None = None) -> DataFrame:
    """(chain, length, nodes): the ``keep`` longest simple paths of more than ``longer_than`` and at most ``longer_than + 4`` nodes.

    Longest first, then by the path as text. Edges from a vertex to itself and null ends take no part; repeated edges are one.

    Paths of each length grow from the smallest text on; one that can't become long enough (``rest``) goes. Only the
    first few are kept at each step. As each path's text starts with that of the path it grew from, the result is certain once the last path
    found doesn't come after the first one let go. Where it isn't, ``rest`` is taken again over condensed components, those of
    ``components`` if given, as ways around a small cycle promise more than it has; then more paths are kept.
    """
    most = longer_than + 4
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    steps = written(edges.where("src <> dst").select("src", "dst").distinct(), "steps")

    def bounded(own: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        bound = rest(steps, most, own)
        onward = steps.join(bound.select(F.col("path").alias("dst"), "rest"), "dst").select("src", "dst", "rest")
        return bound, written(onward.repartitionByRange("src").sortWithinPartitions("src"), "onward")

    bound, onward = bounded(components)
    found: list[tuple] = []
    n = min(most, bound.agg(F.max("rest")).first()[0] or 0)
    while n > longer_than and len(found) < keep:
        part = _smallest(bound, onward, n, keep - len(found), patient=components is not None)
        if part is None:
            components = strong_components(steps)
            bound, onward = bounded(components)
            n = min(n, bound.agg(F.max("rest")).first()[0] or 0)
            continue
        found += [(text, n, nodes) for text, nodes in part]
        n -= 1
    return spark.createDataFrame(found, f"chain string, length int, nodes array<{kind}>").orderBy(F.desc("length"), "chain")


def _smallest(bound: DataFrame, onward: DataFrame, n: int, keep: int, patient: bool) -> list[tuple[str, list]] | None:
    """The ``keep`` simple paths of exactly ``n`` nodes with the smallest texts; None if the first try isn't certain and ``patient`` is false."""
    spark, beam = bound.sparkSession, BEAM
    kind = onward.schema["src"].dataType.simpleString()
    last = F.element_at("nodes", -1)
    while True:
        whole, first_gone = beam > WIDE, None
        start = bound.where(F.col("rest") >= n).select(F.array("path").alias("nodes"), F.col("path").cast("string").alias("text"))
        frontier = written(start, "paths") if whole else None
        rows, m = [] if whole else start.orderBy(F.concat("text", F.lit(JOIN))).limit(beam + 1).collect(), 1
        while True:
            if len(rows) > beam:
                gone = rows[beam]["text"] + (JOIN if m < n else "")
                first_gone = min(first_gone or gone, gone, key=str.encode)
                rows = rows[:beam]
            if m == n or not whole and not rows:
                break
            if not whole:
                frontier = F.broadcast(spark.createDataFrame(rows, f"nodes array<{kind}>, text string"))  # at most ``beam`` rows
            near = onward if whole else onward.where(F.col("src").isin(sorted({r["nodes"][-1] for r in rows})))
            for _ in range(min(1 if whole else 2, n - m)):  # two steps in a job
                m += 1
                frontier = near.join(frontier, near["src"] == last).where((F.col("rest") >= n - m + 1) & ~F.array_contains("nodes", F.col("dst")))
                frontier = frontier.select(F.array_append("nodes", F.col("dst")).alias("nodes"), F.concat("text", F.lit(JOIN), F.col("dst").cast("string")).alias("text"))
                near = onward
            if whole:
                frontier = written(frontier, "paths")
            else:
                rows = frontier.orderBy(F.concat("text", F.lit(JOIN)) if m < n else F.col("text"), "nodes").limit(beam + 1).collect()
        if whole:
            return [(r["text"], r["nodes"]) for r in frontier.orderBy("text", "nodes").limit(keep).collect()]
        if first_gone is None or len(rows) >= keep and rows[keep - 1]["text"].encode() <= first_gone.encode():
            return [(r["text"], r["nodes"]) for r in rows[:keep]]
        if not patient:
            return None
        beam *= 8
