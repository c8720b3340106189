"""Pointer doubling: lists, runs of a graph and trees in logarithmically many rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window, functions as F

from ..shared import dropped, written

#: A layer's floor where nothing is known; no layer is below zero.
NONE = -(2**60)
#: Rows of a block that sums run over, at least, and blocks, at most.
BLOCK, BLOCKS = 2**12, 2**12


def doubled(links: DataFrame) -> DataFrame:
    """(node, end, a, b, least, ring) from ``links`` (node, to, a, b), one row for each node.

    A link is the function x -> max(a, x + b) of what stands at ``to``. Links are followed until ``end`` is no node with a
    link; ``a`` and ``b`` are those of all functions on the way together, so b adds up and, with b = 1, counts steps. ``least`` is
    the smallest of what follows on the way. A node on a ring has no end: ``ring`` is true, and least is the ring's smallest.
    If links have a column ``c``, it adds up as b does.

    A round follows each link's link, so rounds are as many as the logarithm of the longest way, or ring: a node that
    follows itself as the smallest is on a ring, and so is every node on whose way it is the smallest of all.
    """
    sums = [x for x in ("b", "c") if x in links.columns]
    table = written(links.select("node", F.col("to").alias("end"), F.col("a").cast("long").alias("a"), *(F.col(x).cast("long").alias(x) for x in sums), F.col("to").alias("least"), F.lit(False).alias("ring"), F.lit(True).alias("open")), "links")
    rounds = 0

    def kept(new: DataFrame) -> tuple[DataFrame, dict]:
        seen = Observation()
        own = F.col("open") & (F.col("least") == F.col("node"))
        new = written(new.observe(seen, F.count_if("open").alias("open"), F.count_if(own).alias("own"), F.count("*").alias("nodes")), "links")
        return new, {"open": 0, "own": 0, "nodes": 0} | seen.get

    while True:
        next_ = table.select(F.col("node").alias("end"), F.col("end").alias("far"), F.col("a").alias("fa"), *(F.col(x).alias(f"f{x}") for x in sums), F.col("least").alias("fl"))
        # nodes whose way has ended don't ask again
        met = table.where("open").join(next_, "end", "left")
        on = F.col("far").isNotNull()
        a = F.when(on, F.greatest("a", F.col("fa") + F.col("b"))).otherwise(F.col("a"))
        moved = met.select("node", F.coalesce("far", "end").alias("end"), a.alias("a"), *(F.when(on, F.col(x) + F.col(f"f{x}")).otherwise(F.col(x)).alias(x) for x in sums), F.least("least", "fl").alias("least"), "ring", on.alias("open"))
        new, seen = kept(table.where("NOT open").unionByName(moved))
        dropped(table)
        table, rounds = new, rounds + 1
        if seen["own"] and (rounds > 2 or seen["own"] == seen["open"]):
            heads = table.where(F.col("open") & (F.col("least") == F.col("node"))).select(F.col("node").alias("least"), F.lit(True).alias("head"))
            marked = table.join(heads, "least", "left").withColumn("ring", F.col("ring") | F.col("open") & F.col("head").isNotNull()).withColumn("open", F.col("open") & F.col("head").isNull()).drop("head")
            new, seen = kept(marked.select(table.columns))
            dropped(table)
            table = new
        if not seen["open"] or 2 ** (rounds - 1) > seen["nodes"]:  # a way that ends has been told so by then
            return table.select("node", "end", "a", *sums, "least", (F.col("ring") | F.col("open")).alias("ring"))


def with_degrees(edges: DataFrame) -> DataFrame:
    """(path, ins, outs) of the vertices of ``edges`` (src, dst)."""
    both = edges.select(F.col("src").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(edges.select("dst", F.lit(1), F.lit(0)))
    return both.groupBy("path").agg(F.sum("i").alias("ins"), F.sum("o").alias("outs"))


def _with_next(parents: DataFrame) -> DataFrame:
    """``parents`` with ``next``, the sibling that follows; sorted over ranges, so that a parent may have any number of children."""
    spark = parents.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    p = written(parents.repartitionByRange(parts, "parent", "path").withColumn("part", F.spark_partition_id()), "parents")
    row = F.struct("parent", "path")
    # a row for each partition
    firsts = [(r["part"], r["f"]) for r in p.groupBy("part").agg(F.min(row).alias("f")).orderBy("part").collect()]
    edge = spark.createDataFrame([(a, tuple(f)) for (a, _), (_, f) in zip(firsts, firsts[1:])], p.select("part", row.alias("over")).schema)
    follows = F.coalesce(F.lead(row).over(Window.partitionBy("part").orderBy("parent", "path")), F.col("over"))
    found = p.join(F.broadcast(edge), "part", "left").withColumn("f", follows)
    return written(found.select(*parents.columns, F.when(F.col("f")["parent"].eqNullSafe(F.col("parent")), F.col("f")["path"]).alias("next")), "siblings")


def _sizes(trees: DataFrame) -> DataFrame:
    """(path, size) of trees (path, parent, w), the sum of w of a vertex and all below it; null on a ring, below one or below a parent that isn't there.

    The Euler tour of a tree goes down into each vertex and up out of it. Its steps are a list: down goes on to the first
    child or up again, up goes on to the next sibling or up out of the parent. The steps' ranks from the list's end come
    by doubling; sizes follow from the weights of the downward steps left.
    """
    p = _with_next(trees)
    first = p.where("parent IS NOT NULL").groupBy(F.col("parent").alias("path")).agg(F.min("path").alias("child"))
    each = p.join(first, "path", "left")
    end = F.struct(F.lit(None).cast(p.schema["path"].dataType).alias("path"), F.lit("end").alias("way"))
    at = lambda c, way: F.struct(F.col(c).alias("path"), F.lit(way).alias("way"))
    down = each.select(at("path", "down").alias("node"), F.when(F.col("child").isNotNull(), at("child", "down")).otherwise(at("path", "up")).alias("to"), F.col("w").alias("b"))
    up = each.select(at("path", "up").alias("node"), F.when(F.col("next").isNotNull(), at("next", "down")).when(F.col("parent").isNotNull(), at("parent", "up")).otherwise(end).alias("to"), F.lit(0).alias("b"))
    ranks = doubled(down.unionByName(up).select("node", "to", F.lit(NONE).alias("a"), "b"))
    b = F.when((~F.col("ring")) & (F.col("end")["way"] == "end"), F.col("b"))
    way = F.col("node")["way"]
    return ranks.groupBy(F.col("node")["path"].alias("path")).agg((F.max(F.when(way == "down", b)) - F.max(F.when(way == "up", b))).alias("size"))


def _placed(parents: DataFrame) -> tuple[DataFrame, int]:
    """The different rows of ``parents`` with ``at``, their place by parent and path, and how many they are; sorted over ranges, so that a parent may have any number of children."""
    spark = parents.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # an id holds the partition above 33 bits and the place in it
    p = written(parents.repartitionByRange(parts, "parent", "path").distinct().sortWithinPartitions("parent", "path").withColumn("id", F.monotonically_increasing_id()), "parents")
    p = p.withColumn("part", F.shiftright("id", 33))
    below, n = [], 0
    for part, count in sorted(tuple(r) for r in p.groupBy("part").count().collect()):  # a row for each partition
        below.append((part, (part << 33) - n))
        n += count
    return p.join(F.broadcast(spark.createDataFrame(below, "part long, off long")), "part").select("path", "parent", (F.col("id") - F.col("off")).alias("at")), n


def _running(marks: DataFrame, n: int, others: DataFrame | None = None) -> DataFrame:
    """``marks`` (at, kind, add, size, head and others) and ``others``, which add nothing, with sums up to each row by ``at`` and ``kind``.

    ``sum`` is of ``add``, the row's own included; ``head`` is the last one that isn't null; ``own`` is the size in the row before. Sums
    run over blocks of ``at``, which is below ``n``; a row for each block, of kind -1, brings what stands before it.
    """
    wide = max(BLOCK, -(-n // BLOCKS))
    block = (F.col("at") - F.col("at") % wide).alias("block")
    told = marks.groupBy(block).agg(F.sum("add").alias("add"), F.max_by("head", F.when(F.col("head").isNotNull(), F.col("at"))).alias("head"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    starts = marks.sparkSession.range(0, n, wide).withColumnRenamed("id", "block").join(told, "block", "left")
    starts = starts.select(F.col("block").alias("at"), F.lit(-1).alias("kind"), F.coalesce(F.sum("add").over(before), F.lit(0)).alias("add"), F.last("head", True).over(before).alias("head"))
    rows = marks.unionByName(starts, True)
    rows = rows.unionByName(others, True) if others else rows
    w = Window.partitionBy("block").orderBy("at", "kind")
    return rows.withColumn("block", block).select("*", F.sum("add").over(w).alias("sum"), F.last("head", True).over(w).alias("last_head"), F.lag("size").over(w).alias("own"))


def preorder(parents: DataFrame) -> DataFrame:
    """(path, parent, position, depth, size, last) of trees ``parents`` (path, parent), a null parent for a root.

    Children stand in the order of their paths, roots too. ``position`` counts from 0 over all trees; ``depth`` is 0 at a
    root; ``size`` counts a vertex and all below it; ``last`` marks the last of its parent's children. Rows on a ring or below one, and those whose parent isn't there, have neither position, depth nor size.

    Vertices with nothing below are taken off in rounds, their sizes added to their parents, while a round takes a quarter
    of what is left; the rest, trees of long ways, is told by ``_sizes`` and ``doubled``. Sorted by parent and path, a row has
    before it, summed up, the sizes of its earlier siblings: its position is that sum and a shift that all children of its
    parent share, which comes from the parent's sum and shift. So all rows are sorted once, asked once for their
    children and summed up once; all else is done with the vertices that have children.
    """
    p, n = _placed(parents.select("path", "parent"))
    kids = written(p.groupBy("parent").agg(F.min("at").alias("first"), F.count("*").alias("kids")), "kids")
    inner = written(p.join(kids.where("parent IS NOT NULL").withColumnRenamed("parent", "path"), "path"), "inner")
    among = inner.groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("below"))
    below = F.coalesce("below", F.lit(0))
    live = inner.join(among, "path", "left").select("path", "parent", (1 + F.col("kids") - below).alias("w"), below.alias("below"))
    rounds, bare = [], F.col("below") == 0
    while True:
        seen = Observation()
        live = written(live.observe(seen, F.count_if(bare).alias("bare"), F.count("*").alias("all")), "live")
        found = {"bare": 0, "all": 0} | seen.get
        deep = 4 * found["bare"] < found["all"]
        if found["all"]:
            rounds.append(_sizes(live.select("path", "parent", "w")) if deep else live.where(bare).select("path", F.col("w").alias("size")))
        if deep or found["bare"] == found["all"]:
            break
        told = live.groupBy(F.col("parent").alias("path")).agg(F.sum(F.when(bare, F.col("w"))).alias("gain"), F.count_if(~bare).alias("still"))
        live = live.where(~bare).join(told, "path").select("path", "parent", (F.col("w") + F.coalesce("gain", F.lit(0))).alias("w"), F.col("still").alias("below"))

    sizes = live.select("path", F.lit(0).cast("long").alias("size"), F.lit(-1).alias("round")).limit(0)
    for k, r in enumerate(rounds):
        sizes = sizes.unionByName(r.select("path", "size", F.lit(k).alias("round")))
    add = F.coalesce(F.col("size") - 1, F.lit(0)).alias("add")
    sized = written(inner.join(sizes, "path").select("path", "parent", "at", "first", "size", add, "round"), "sized")
    vertex = ["path", "parent", "round"]
    none = F.lit(None).cast("long")
    heads = sized.select(F.col("first").alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("add"), *vertex)
    sums = _running(heads.unionByName(sized.select("at", F.lit(1).alias("kind"), "add", *vertex)).withColumns({"size": none, "head": none}), n)
    # what stands before the vertex, less what stands before its first child
    shift = F.sum(F.when(F.col("kind") == 1, F.col("at") + F.col("sum") - F.col("add") + 1).otherwise(-F.col("at") - F.col("sum"))).alias("shift")
    shifts = sums.where("kind >= 0").groupBy(*vertex).agg(shift).select("path", "parent", "shift", "round")
    shifts = written(shifts.hint("rebalance", "round"), "shifts", "round")

    known = sized.select("path", F.col("at").alias("shift"), F.col("at").alias("depth")).limit(0)
    for k in reversed(range(len(rounds))):
        here = shifts.where(F.col("round") == k)
        if deep and k == len(rounds) - 1:
            # a root leads to a struct of null, which is an end to count to
            ways = doubled(here.select(F.struct("path").alias("node"), F.struct(F.col("parent").alias("path")).alias("to"), F.lit(NONE).alias("a"), F.col("shift").alias("b"), F.lit(1).alias("c")))
            found = ways.where("end.path IS NULL AND NOT ring").select(F.col("node")["path"].alias("path"), F.col("b").alias("shift"), (F.col("c") - 1).alias("depth"))
        else:
            above = known.select(F.col("path").alias("parent"), F.col("shift").alias("more"), "depth")
            root = F.col("parent").isNull()
            found = here.join(above, "parent", "left").select("path", (F.col("shift") + F.when(root, 0).otherwise(F.col("more"))).alias("shift"), F.when(root, 0).otherwise(F.col("depth") + 1).alias("depth"))
        known = known.unionByName(written(found, "known"))

    root = F.col("parent").isNull()
    head = F.struct(F.when(root, 0).otherwise(F.col("shift")).alias("shift"), F.when(root, 0).otherwise(F.col("depth") + 1).alias("depth"), (F.col("first") + F.col("kids") - 1).alias("last"))
    heads = kids.join(known.withColumnRenamed("path", "parent"), "parent", "left").select(F.col("first").alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("add"), none.alias("size"), head.alias("head"))
    own = sized.select("at", F.lit(1).alias("kind"), "add", "size", F.lit(None).cast(heads.schema["head"].dataType).alias("head"))
    sums = _running(written(heads.unionByName(own), "marks"), n, p.withColumn("kind", F.lit(2))).where("kind = 2")
    size, head = F.coalesce("own", F.lit(1)), F.col("last_head")
    position = F.col("at") + F.col("sum") - (size - 1) + head["shift"]
    return sums.select("path", "parent", position.alias("position"), F.when(position.isNotNull(), head["depth"]).cast("int").alias("depth"), F.when(position.isNotNull(), size.cast("long")).alias("size"), (F.col("at") == head["last"]).alias("last"))
