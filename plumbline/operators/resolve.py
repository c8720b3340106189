"""From imports to edges: suffix and name matches as equality joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import paths


def import_rows(modules: DataFrame) -> DataFrame:
    """(src, pos, imported): one row for each import of ``modules`` (path, imports)."""
    return modules.select(F.col("path").alias("src"), F.posexplode("imports").alias("pos", "imported"))


def by_path(modules: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """(src, dst, pos): imports from the own crate, resolved by the importing path's first segments.

    A module is known by its stem, by its folder if it is mod.rs, and by folder and stem together; the smallest
    path wins. Imports that resolve to nothing give no edge. ``imports`` (src, pos, imported) are those of ``modules``
    unless given as rows.
    """
    p = F.lower("path")
    rs = modules.where(F.endswith(p, F.lit(".rs"))).select("path", p.alias("p"))
    two = F.regexp_extract("p", r"([^/]+/[^/]+)\.rs$", 1)
    keys = rs.select(F.regexp_extract("p", r"([^/]+)\.rs$", 1).alias("key"), "path")
    keys = keys.union(rs.where(F.endswith("p", F.lit("/mod.rs"))).select(F.regexp_extract("p", r"([^/]+)/mod\.rs$", 1), "path")).union(rs.select(two, "path"))
    target = keys.where("key <> ''").groupBy("key").agg(F.min("path").alias("dst"))
    s = F.split("imported", "::")
    rows = (import_rows(modules) if imports is None else imports).where(F.element_at(s, 1) == "crate").select("src", "pos", "imported")
    # each text is resolved once, however often it is imported
    asked = rows.select("imported").distinct().select("imported", F.lower(F.try_element_at(s, F.lit(2))).alias("a"), F.lower(F.try_element_at(s, F.lit(3))).alias("b"))
    each = asked.select("imported", F.explode(F.array_distinct(F.array("a", F.concat_ws("/", "a", "b")))).alias("key"))
    return rows.join(each.join(target, "key").groupBy("imported").agg(F.min("dst").alias("dst")), "imported").select("src", "dst", "pos")


def by_name(modules: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """(src, dst, pos): imports whose first segment, the second after crate, is a module's name; the smallest path wins.

    ``imports`` as for ``by_path``.
    """
    s = F.split("imported", "::")
    first = F.element_at(s, 1)
    key = F.when(first == "crate", F.try_element_at(s, F.lit(2))).when(~first.isin("super", "self"), first)
    target = modules.groupBy(F.col("name").alias("key")).agg(F.min("path").alias("dst"))
    return (import_rows(modules) if imports is None else imports).select("src", "pos", key.alias("key")).join(target, "key").select("src", "dst", "pos")
