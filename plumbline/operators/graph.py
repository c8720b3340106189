"""Graph operators over ``edges`` (src, dst), a multigraph, and ``nodes`` (path).

Iterative ones keep a frontier and write each round's state to the shared folder; nothing but counts comes to
the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..shared import bucketed, dropped, written
from .lists import doubled, with_degrees


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, fan_in, fan_out, fan_in_distinct): edges that arrive and leave, zero if none; and different sources.

    A column ``n`` of ``edges`` says how often an edge stands; without it, each row is one.
    """
    times = F.sum("n") if "n" in edges.columns else F.count("*")
    arrive = edges.groupBy(F.col("dst").alias("path")).agg(times.alias("fan_in"), F.countDistinct("src").alias("fan_in_distinct"))
    leave = edges.groupBy(F.col("src").alias("path")).agg(times.alias("fan_out"))
    found = nodes.select("path").join(arrive, "path", "left").join(leave, "path", "left")
    return found.select("path", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("fan_in", "fan_out", "fan_in_distinct")))


def dependents(edges: DataFrame, path) -> DataFrame:
    """Sources of the edges to ``path``, with repeats."""
    return edges.where(F.col("dst") == path).select("src")


def impact(edges: DataFrame, targets: DataFrame, depth: int | None = None) -> DataFrame:
    """(path, depth): what depends on ``targets`` (path), directly (1) or not, by the shortest way.

    Edges are bucketed once; a round takes two steps, moves the frontier only and writes it.
    """
    with bucketed(edges.select(F.col("dst").alias("path"), F.col("src").alias("next")).distinct(), "back", "path") as back:
        return _reached(back, targets, depth)


def _reached(back: DataFrame, targets: DataFrame, depth: int | None) -> DataFrame:
    """``impact`` over ``back`` (path, next); every round's rows are written."""
    seen = written(targets.select("path", F.lit(0).alias("depth")).distinct(), "seen")
    level, frontier, parts = 0, seen, 0

    def step(reached: DataFrame, at: int, *known: DataFrame) -> DataFrame:
        new = back.join(reached.select("path"), "path").select(F.col("next").alias("path")).distinct()
        for x in known:
            new = new.join(x, "path", "left_anti")
        return new.select("path", F.lit(at).alias("depth"))

    while depth is None or level < depth:
        one = step(frontier, level + 1, seen)
        both = one if depth == level + 1 else one.unionByName(step(one, level + 2, seen, one))
        new = written(both, "frontier")
        if new.isEmpty():
            break
        level, parts = level + 2, parts + 1
        frontier, seen = new.where(F.col("depth") == level), seen.unionByName(new)
        if parts % 8 == 0:
            seen = written(seen, "seen")
    return seen.where("depth > 0")


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, layer): sources come before what they point to; layer is null for nodes on a cycle and all behind one.

    A layer is the longest way from a source. Each round contracts runs, nodes with one way in and one way out, to one
    edge as long as they are, by doubling; then it takes off the sources. Layers within runs follow at the end
    from that of the node they start behind. So a path has two rounds, however long it is.
    """
    edges = edges.select("src", "dst").distinct()
    every = nodes.select("path").union(edges.select("src")).union(edges.select("dst")).distinct()
    edges = written(edges.withColumn("w", F.lit(1).cast("long")), "edges")
    left = written(every.select("path", F.lit(0).cast("long").alias("v")), "left")
    done, inside = None, []
    while True:
        if not edges.isEmpty():
            edges, left, within = _contracted(edges, left)
            inside += [within] if within is not None else []
        arrive = edges.select(F.col("dst").alias("path")).distinct()
        free = written(left.join(arrive, "path", "left_anti"), "layer")
        if free.isEmpty():
            break
        done = free if done is None else done.unionByName(free)
        taken = edges.join(free.select(F.col("path").alias("src"), "v"), "src").groupBy(F.col("dst").alias("path")).agg(F.max(F.col("v") + F.col("w")).alias("n"))
        held = left.join(free, "path", "left_anti").join(taken, "path", "left").select("path", F.greatest("v", "n").alias("v"))
        left = written(held, "left")
        edges = written(edges.join(free.select(F.col("path").alias("src")), "src", "left_anti"), "edges")
        if left.isEmpty():
            break
    known = left.select("path", F.lit(None).cast("long").alias("v"))
    known = known if done is None else done.unionByName(known)
    for within in reversed(inside):
        at = within.join(known.select(F.col("path").alias("end"), F.col("v").alias("x")), "end", "left")
        known = written(known.unionByName(at.select("path", F.when(F.col("x").isNotNull(), F.greatest("a", F.col("x") + F.col("b"))).alias("v"))), "known")
    return nodes.select("path").distinct().join(known, "path").select("path", F.col("v").cast("int").alias("layer"))


def _contracted(edges: DataFrame, left: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Edges (src, dst, w) and nodes (path, v) without the nodes that have one way in and one out; and (path, end, a, b) of those: v = max(a, v of the end + b).

    Rings of such nodes have no end; theirs is null.
    """
    inner = written(with_degrees(edges).where("ins = 1 AND outs = 1").select("path"), "inner")
    if inner.isEmpty():
        return edges, left, None
    links = edges.join(inner.select(F.col("path").alias("dst")), "dst").join(left.select(F.col("path").alias("dst"), "v"), "dst").select(F.col("dst").alias("node"), F.col("src").alias("to"), F.col("v").alias("a"), F.col("w").alias("b"))
    run = doubled(links)
    within = run.select(F.col("node").alias("path"), F.when(~F.col("ring"), F.col("end")).alias("end"), "a", "b")
    at_src = within.where("end IS NOT NULL").select(F.col("path").alias("src"), "end", "a", "b")
    inner_dst = inner.select(F.col("path").alias("dst"))
    # the edge out of a run's last node
    out = written(edges.join(at_src, "src").join(inner_dst, "dst", "left_anti").select(F.col("end").alias("src"), "dst", (F.col("b") + F.col("w")).alias("w"), (F.col("a") + F.col("w")).alias("n")), "runs")
    kept = edges.join(inner.select(F.col("path").alias("src")), "src", "left_anti").join(inner_dst, "dst", "left_anti")
    new = written(kept.select("src", "dst", "w").unionByName(out.select("src", "dst", "w")).groupBy("src", "dst").agg(F.max("w").alias("w")), "edges")
    floor = out.groupBy(F.col("dst").alias("path")).agg(F.max("n").alias("n"))
    held = left.join(inner, "path", "left_anti").join(floor, "path", "left").select("path", F.greatest("v", "n").alias("v"))
    return new, written(held, "left"), within


def acyclic_layers(nodes: DataFrame, edges: DataFrame) -> DataFrame | None:
    """``layers``, or None if there is a cycle."""
    found = written(layers(nodes, edges), "layers")
    return None if found.where("layer IS NULL").limit(1).count() else found


def contains(nodes: DataFrame, path) -> bool:
    """Whether ``path`` is one of ``nodes``."""
    return not nodes.where(F.col("path") == path).isEmpty()


def _trimmed(edges: DataFrame, rounds: int = 2) -> DataFrame:
    """Edges without those of nodes that nothing reaches or that reach nothing, ``rounds`` times."""
    for _ in range(rounds):
        edges = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
    return written(edges, "trim")


def _ends(edges: DataFrame) -> DataFrame:
    """(path, c, d): the smallest node that leads to each node, and the smallest that it leads to, itself included.

    A round takes one step along the edges and then the label of the label, so that steps double.
    """
    own = F.col("path")
    label = written(edges.select(F.col("src").alias("path")).union(edges.select("dst")).distinct().select("path", own.alias("c"), own.alias("d")), "label")
    while True:
        from_src = edges.join(label.select(own.alias("src"), "c"), "src").groupBy(F.col("dst").alias("path")).agg(F.min("c").alias("nc"))
        from_dst = edges.join(label.select(own.alias("dst"), "d"), "dst").groupBy(F.col("src").alias("path")).agg(F.min("d").alias("nd"))
        near = label.select("path", F.col("c").alias("oc"), F.col("d").alias("od")).join(from_src, "path", "left").join(from_dst, "path", "left")
        near = near.select("path", "oc", "od", F.least("oc", "nc").alias("mc"), F.least("od", "nd").alias("md"))
        far = near.join(label.select(own.alias("mc"), F.col("c").alias("uc")), "mc", "left").join(label.select(own.alias("md"), F.col("d").alias("ud")), "md", "left")
        c, d = F.least("mc", "uc"), F.least("md", "ud")
        far = written(far.select("path", c.alias("c"), d.alias("d"), ((c < F.col("oc")) | (d < F.col("od"))).alias("moved")), "label")
        dropped(label)
        label = far.select("path", "c", "d")
        if far.where("moved").isEmpty():
            return label


def strong_components(edges: DataFrame) -> DataFrame:
    """(path, component) of nodes on a cycle, one edge to itself among them; the smallest path names a component.

    Runs, nodes with one way in and one way out, are contracted first, by doubling; a ring of them is a component. Then
    rounds of colouring from both sides: nodes whose smallest ancestor is their smallest descendant are that node's
    component and go; an edge between nodes that differ in either is on no cycle and goes too. A run belongs to the
    component that both nodes at its ends are of.
    """
    kind = edges.schema["src"].dataType.simpleString()
    loops = edges.where("src = dst").select(F.col("src").alias("path")).distinct()
    edges = written(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    inner = written(with_degrees(edges).where("ins = 1 AND outs = 1").select("path"), "inner")
    runs = rings = None
    if not inner.isEmpty():
        at_src, at_dst = inner.select(F.col("path").alias("src")), inner.select(F.col("path").alias("dst"))
        run = written(doubled(edges.join(at_dst, "dst").select(F.col("dst").alias("node"), F.col("src").alias("to"), F.lit(0).alias("a"), F.lit(1).alias("b"))), "run")
        rings = run.where("ring").select(F.col("node").alias("path"), F.col("least").alias("component"))
        open_ = run.where("NOT ring").select(F.col("node").alias("path"), F.col("end").alias("head"))
        # every node of a run: its head, and the tail by the run's last node, which is farthest behind the head on the way there
        back = doubled(edges.join(at_src, "src").join(run.where("NOT ring").select(F.col("node").alias("src")), "src").select(F.col("src").alias("node"), F.col("dst").alias("to"), F.lit(0).alias("a"), F.lit(1).alias("b")))
        runs = written(open_.join(back.select(F.col("node").alias("path"), F.col("end").alias("tail")), "path"), "runs")
        kept = edges.join(at_src, "src", "left_anti").join(at_dst, "dst", "left_anti").select("src", "dst")
        edges = written(kept.unionByName(runs.select(F.col("head").alias("src"), F.col("tail").alias("dst"))).distinct(), "edges")
    # a run from a node back to it makes a component of both
    tied = edges.where("src = dst").select(F.col("src").alias("path"), F.col("src").alias("component"))
    edges = _trimmed(edges.where("src <> dst"))
    found = None
    while not edges.isEmpty():
        both = _ends(edges)
        part = both.where("c = d").select("path", F.col("c").alias("component"))
        found = part if found is None else found.unionByName(part)
        open_ = both.where("c <> d").select("path", F.struct("c", "d").alias("k"))
        a, b = open_.select(F.col("path").alias("src"), F.col("k").alias("ks")), open_.select(F.col("path").alias("dst"), F.col("k").alias("kd"))
        edges = _trimmed(written(edges.join(a, "src").join(b, "dst").where("ks = kd").select("src", "dst"), "edges"))
    alone = loops.select("path", F.col("path").alias("component"))
    if found is not None:
        large = found.join(found.groupBy("component").count().where("count > 1").select("component"), "component").select("path", "component")
        tied = large.unionByName(tied.join(large, "path", "left_anti"))
    if runs is not None:
        tied = written(tied, "tied")
        ends = runs.join(tied.select(F.col("path").alias("head"), "component"), "head").join(tied.select(F.col("path").alias("tail"), F.col("component").alias("other")), "tail")
        tied = tied.unionByName(ends.where(F.col("component") == F.col("other")).select("path", "component"))
        # names again, as a node of a run may be the smallest
        named = tied.groupBy("component").agg(F.min("path").alias("name"))
        tied = tied.join(named, "component").select("path", F.col("name").alias("component")).unionByName(rings)
    tied = written(tied, "components")
    return tied.unionByName(alone.join(tied, "path", "left_anti")).select(F.col("path").cast(kind), F.col("component").cast(kind))
