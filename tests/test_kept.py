"""Kept results equal those of a full run after random edits, and touch few buckets."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import graph
from plumbline.plans.detect import Thresholds
from plumbline.streaming.kept import KeptGraph

LIMIT = Thresholds(coupling_fanin=4)


def rows(df):
    return sorted(map(tuple, df.collect()))


def whole(spark, edges):
    """Everything from the start."""
    df = spark.createDataFrame(edges, "src string, dst string")
    nodes = df.select(F.col("src").alias("path")).union(df.select("dst")).distinct()
    degrees, components = graph.degrees(nodes, df), graph.strong_components(df)
    issues = components.select(F.lit("CircularDependency"), "path").union(degrees.where("fan_in >= 4").select(F.lit("HighCoupling"), "path"))
    return rows(degrees.select("path", "fan_in", "fan_out", "fan_in_distinct")), rows(components), rows(issues)


def test_random_edits(spark):
    rng = random.Random(2)
    edge = lambda: (f"m{rng.randrange(14)}", f"m{rng.randrange(14)}")
    edges = [edge() for _ in range(16)]
    kept = KeptGraph(spark.createDataFrame(edges + [(None, "x")], "src string, dst string"), LIMIT, 8)
    before = set(rows(kept.issues()))
    for _ in range(2):
        gone = rng.sample(edges, 3)
        new = [edge() for _ in range(3)]
        for e in gone:
            edges.remove(e)
        edges += new
        changes = spark.createDataFrame([(*e, -1) for e in gone] + [(*e, 1) for e in new], "src string, dst string, n long")
        told = rows(kept.apply(changes))
        degrees, components, issues = whole(spark, edges)
        assert rows(kept.degrees()) == degrees and rows(kept.components()) == components and rows(kept.issues()) == issues
        assert set(told) == {(*i, "new") for i in set(issues) - before} | {(*i, "resolved") for i in before - set(issues)}
        before = set(issues)
    with pytest.raises(ValueError):
        kept.apply(spark.createDataFrame([("none", "none", -1)], "src string, dst string, n long"))
    assert kept.apply(changes.limit(0)).count() == 0


def test_small_changes_touch_few_buckets(spark):
    edges = spark.range(2000).select(F.format_string("m%d", F.col("id")).alias("src"), F.format_string("m%d", F.col("id") + 1 - F.when(F.col("id") % 10 == 9, 5).otherwise(0)).alias("dst"))
    kept = KeptGraph(edges, LIMIT, 16)
    tables = (kept._by_src, kept._by_dst, kept._degrees, kept._components, kept._issues)
    before = [dict(t.where) for t in tables]
    kept.apply(spark.createDataFrame([("m19", "m20", 1)], "src string, dst string, n long"))
    changed = [sum(t.where.get(b) != p for b, p in old.items()) for t, old in zip(tables, before, strict=True)]
    assert changed[0] == changed[1] == 1 and changed[2] <= 2 and max(changed[3:]) <= 12
