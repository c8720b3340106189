"""Snapshots of a code base and the difference of two."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def issue_counts(issues: DataFrame) -> DataFrame:
    """(kind, severity, n) of ``issues`` (kind, severity)."""
    return issues.groupBy("kind", "severity").agg(F.count("*").alias("n"))


def metrics(modules: DataFrame, edges: DataFrame, issues: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """One row of totals: modules, lines, dependencies, mean and largest fan-in over targets, issues; with ``components`` (path, component) also cycles.

    A column ``n`` of ``edges`` says how often an edge stands; without it, each row is one.
    """
    fan = edges.groupBy("dst").agg((F.sum("n") if "n" in edges.columns else F.count("*")).alias("count"))
    a = modules.agg(F.count("*").alias("total_modules"), F.coalesce(F.sum("lines"), F.lit(0)).alias("total_lines"))
    b = fan.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total_dependencies"), F.round(F.coalesce(F.avg("count"), F.lit(0.0)), 6).alias("avg_coupling"), F.coalesce(F.max("count"), F.lit(0)).alias("max_coupling"))
    c = issues.agg(F.count("*").alias("total_issues"))
    one = F.lit(1).alias("_one")  # three single rows side by side
    found = a.select("*", one).join(b.select("*", one), "_one").join(c.select("*", one), "_one")
    if components is not None:
        found = found.join(components.agg(F.countDistinct("component").alias("total_cycles"), one), "_one")
    return found.drop("_one")


def module_changes(base: DataFrame, now: DataFrame) -> DataFrame:
    """(path, status, lines_delta) of modules (path, hash, lines) that were added, removed or changed."""
    a, b = base.select("path", F.col("hash").alias("h0"), F.col("lines").alias("l0")), now.select("path", F.col("hash").alias("h1"), F.col("lines").alias("l1"))
    both = a.join(b, "path", "full")
    status = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").when(F.col("h0") != F.col("h1"), "changed")
    return both.withColumn("status", status).where(F.col("status").isNotNull()).select("path", "status", (F.coalesce("l1", F.lit(0)) - F.coalesce("l0", F.lit(0))).cast("long").alias("lines_delta"))


def list_changes(base: DataFrame, now: DataFrame, column: str) -> DataFrame:
    """(path, added, removed): entries of a list column that modules in both snapshots gained and lost."""
    both = base.select("path", F.col(column).alias("a")).join(now.select("path", F.col(column).alias("b")), "path")
    text = lambda x: F.array_join(F.array_sort(x), ",")
    found = both.select("path", text(F.array_except("b", "a")).alias("added"), text(F.array_except("a", "b")).alias("removed"))
    return found.where("added <> '' OR removed <> ''")


def dependency_changes(base: DataFrame, now: DataFrame) -> DataFrame:
    """(src, dst, status): dependencies, each once, that were added or removed."""
    a, b = base.select("src", "dst"), now.select("src", "dst")
    return b.subtract(a).withColumn("status", F.lit("added")).unionByName(a.subtract(b).withColumn("status", F.lit("removed")))


def issue_id(issues: DataFrame) -> DataFrame:
    """Adds ``issue_id``, a digest of the kind and the sorted paths."""
    return issues.withColumn("issue_id", F.md5(F.concat_ws("|", F.col("kind"), F.array_join(F.array_sort("paths"), ","))))


def issue_changes(base: DataFrame, now: DataFrame) -> DataFrame:
    """(issue_id, kind, status) of issues that are new or resolved; repeats stay."""
    new = now.join(base.select("issue_id").distinct(), "issue_id", "left_anti").select("issue_id", "kind", F.lit("new").alias("status"))
    gone = base.join(now.select("issue_id").distinct(), "issue_id", "left_anti").select("issue_id", "kind", F.lit("resolved").alias("status"))
    return new.unionByName(gone)


def metric_changes(base: DataFrame, now: DataFrame) -> DataFrame:
    """One row with the differences of two rows of metrics."""
    names = [c for c in base.columns if c in now.columns]
    a = base.select(*(F.col(c).alias(f"_{c}") for c in names), F.lit(1).alias("_one"))
    return now.withColumn("_one", F.lit(1)).join(a, "_one").select(*(F.round(F.col(c) - F.col(f"_{c}"), 6).alias(f"{c}_delta") for c in names))


def file_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, status) from two lists of (path, mtime): added, modified or deleted."""
    both = before.select("path", F.col("mtime").alias("a")).join(now.select("path", F.col("mtime").alias("b")), "path", "full")
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "modified")
    return both.select("path", status.alias("status")).where(F.col("status").isNotNull())
