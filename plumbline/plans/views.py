"""The graph as nodes, links and totals, and advice on issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths
from ..operators.graph import degrees


def nodes(modules: DataFrame, edges: DataFrame, issues: DataFrame, root: str) -> DataFrame:
    """(path, fan_in, fan_out, issue_count, category) of modules (path, imports); fan_out counts all imports."""
    found = issues.groupBy("path").agg(F.count("*").alias("n"))
    met = modules.select("path", F.size("imports").cast("long").alias("fan_out")).join(degrees(modules, edges).select("path", "fan_in"), "path").join(found, "path", "left")
    return met.select("path", "fan_in", "fan_out", F.coalesce("n", F.lit(0)).alias("issue_count"), paths.category(paths.relative(F.col("path"), root)).alias("category"))


def links(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(source, target, n, is_cycle): edges with their number; on a cycle if both ends are in one strong component."""
    each = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    a = components.select(F.col("path").alias("src"), F.col("component").alias("ca"))
    b = components.select(F.col("path").alias("dst"), F.col("component").alias("cb"))
    return each.join(a, "src", "left").join(b, "dst", "left").select(F.col("src").alias("source"), F.col("dst").alias("target"), "n", F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)).alias("is_cycle"))


#: What to do about an issue, by its kind.
ADVICE = {"CircularDependency": "DECOUPLE", "GodObject": "EXTRACT", "HighCoupling": "INTERFACE", "BoundaryViolation": "CENTRALIZE", "DeepDependencyChain": "FLATTEN", "LowCohesion": "FOCUS", "FatModule": "EXTRACT"}


def advice(kind: Column) -> Column:
    found = F.lit(None).cast("string")
    for k, text in ADVICE.items():
        found = F.when(kind == k, text).otherwise(found)
    return found
