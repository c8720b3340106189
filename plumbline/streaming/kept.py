"""Results kept up to date by differences: degrees, strong components and issues of a graph whose edges change.

Tables lie in the shared folder in buckets by a hash of their key. A change is a set of edges with signs. It is joined to
the buckets it falls into, no others, and writes these anew. Components are taken again only where an edge came in or
went: on what lies between the heads and the tails of new edges, and within components that lost an edge. Issues
that are gone or new follow from anti-joins of the issues of changed modules, before and after.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.graph import impact, strong_components
from ..plans.detect import Thresholds
from ..shared import forget, place, written

#: Buckets of a table.
BUCKETS = 64


class Table:
    """A table in buckets by ``key``; a bucket's rows lie in the folder that wrote it last."""

    def __init__(self, spark: SparkSession, schema: str, key: str, buckets: int = BUCKETS):
        self.spark, self.schema, self.key, self.buckets = spark, schema, key, buckets
        self.where: dict[int, str] = {}

    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(self, only: list[int] | None = None) -> DataFrame:
        """Its rows, or those of some buckets."""
        paths = [f"{p}/_b={b}" for b, p in sorted(self.where.items()) if only is None or b in set(only)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets, at most as many as there are, that hold the keys of ``keys``."""
        return sorted(r[0] for r in keys.select(self.bucket()).distinct().collect())

    def write(self, rows: DataFrame, only: list[int] | None = None) -> None:
        """Replaces the buckets ``only``, or all, by ``rows``, which all belong there."""
        path = place(self.spark, "kept")
        rows.withColumn("_b", self.bucket()).repartition("_b").write.partitionBy("_b").parquet(path)
        mine = range(self.buckets) if only is None else only
        full = {r[0] for r in self.spark.read.parquet(path).select("_b").distinct().collect()} if self._any(path) else set()
        before = {b: self.where.pop(b) for b in mine if b in self.where}
        self.where |= {b: path for b in full}
        for b, old in before.items():
            forget(self.spark, f"{old}/_b={b}")

    def _any(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return any(x.isDirectory() for x in where.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(where))


class KeptGraph:
    """Edges with how often each stands, and what follows from them.

    ``edges()`` (src, dst, n), ``degrees()`` (path, fan_in, fan_out, fan_in_distinct) of modules with edges, ``components()`` (path,
    component), ``issues()`` (kind, path): CircularDependency for each module on a cycle, HighCoupling.
    """

    def __init__(self, edges: DataFrame, thresholds: Thresholds = Thresholds(), buckets: int = BUCKETS):
        """``edges`` (src, dst), a row for each time an edge stands; null ends take no part."""
        self.spark, self.limit = edges.sparkSession, thresholds.coupling_fanin
        kind = edges.schema["src"].dataType.simpleString()
        table = lambda schema, key: Table(self.spark, schema.replace("K", kind), key, buckets)
        # edges lie by source and by target, so that both ways read few buckets
        self._by_src, self._by_dst = table("src K, dst K, n long", "src"), table("src K, dst K, n long", "dst")
        self._degrees = table("path K, fan_in long, fan_out long, fan_in_distinct long", "path")
        self._components, self._issues = table("path K, component K", "path"), table("kind string, path K", "path")
        counted = written(edges.where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst").agg(F.count("*").alias("n")), "edges")
        self._by_src.write(counted)
        self._by_dst.write(counted)
        self._degrees.write(self._signed(counted.select("src", "dst", "n", F.lit(1).cast("long").alias("new"))))
        self._components.write(strong_components(counted))
        self._issues.write(self._found(self._degrees.read(), self._components.read()))

    def edges(self) -> DataFrame:
        return self._by_src.read()

    def degrees(self) -> DataFrame:
        return self._degrees.read()

    def components(self) -> DataFrame:
        return self._components.read()

    def issues(self) -> DataFrame:
        return self._issues.read()

    @staticmethod
    def _signed(changes: DataFrame) -> DataFrame:
        """(path, fan_in, fan_out, fan_in_distinct), with signs, of changes (src, dst, n, new): new is 1 for an edge that comes in, -1 for one that goes."""
        zero = F.lit(0).cast("long")
        ends = changes.select(F.col("dst").alias("path"), F.col("n").alias("fan_in"), zero.alias("fan_out"), F.col("new").alias("fan_in_distinct"))
        ends = ends.unionByName(changes.select(F.col("src").alias("path"), zero.alias("fan_in"), F.col("n").alias("fan_out"), zero.alias("fan_in_distinct")))
        return ends.groupBy("path").agg(*(F.sum(c).alias(c) for c in ("fan_in", "fan_out", "fan_in_distinct")))

    def _found(self, degrees: DataFrame, components: DataFrame) -> DataFrame:
        coupled = degrees.where(F.col("fan_in") >= self.limit).select(F.lit("HighCoupling").alias("kind"), "path")
        return components.select(F.lit("CircularDependency").alias("kind"), "path").unionByName(coupled)

    def apply(self, changes: DataFrame) -> DataFrame:
        """Takes ``changes`` (src, dst, n): n more of an edge, or fewer if it is negative; (kind, path, status) of issues, new or resolved.

        Repeated rows add up. Taking away more than there are raises; null ends take no part. Other columns are left aside.
        """
        delta = written(changes.where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst").agg(F.sum("n").cast("long").alias("d")).where("d <> 0"), "delta")
        if delta.isEmpty():
            return self.spark.createDataFrame([], self._issues.schema).withColumn("status", F.lit(""))
        counts = {}
        for table in (self._by_src, self._by_dst):
            at = table.touched(delta)
            both = table.read(at).join(delta, ["src", "dst"], "full")
            counts[table.key] = at, written(both.select("src", "dst", F.coalesce("n", F.lit(0)).alias("before"), (F.coalesce("n", F.lit(0)) + F.coalesce("d", F.lit(0))).alias("n")), "counts")
        at, now = counts["src"]
        if not now.where("n < 0").isEmpty():
            raise ValueError("an edge is taken away more often than it stands")
        moved = written(now.where("n <> before").select("src", "dst", (F.col("n") - F.col("before")).alias("n"), (F.sign("n") - F.sign("before")).cast("long").alias("new")), "moved")
        for table in (self._by_src, self._by_dst):
            at, now = counts[table.key]
            table.write(now.where("n > 0").select("src", "dst", "n"), at)

        shift = written(self._signed(moved), "shift")
        at = self._degrees.touched(shift)
        both = self._degrees.read(at).unionByName(shift).groupBy("path").agg(*(F.sum(c).alias(c) for c in ("fan_in", "fan_out", "fan_in_distinct")))
        self._degrees.write(written(both.where("fan_in > 0 OR fan_out > 0"), "degrees"), at)
        again = self._components_of(moved.where("new = 1").select("src", "dst"), moved.where("new = -1").select("src", "dst"))

        # issues of the modules whose degrees or components may differ
        paths = written(shift.select("path").union(again.select("path")).distinct(), "paths")
        at = self._issues.touched(paths)
        old = written(self._issues.read(at), "issues")
        mine = lambda df: df.join(paths, "path", "left_semi")
        new = written(self._found(mine(self._degrees.read(self._degrees.touched(paths))), mine(self._components.read(self._components.touched(paths)))).select("kind", "path"), "issues")
        kept = old.join(paths, "path", "left_anti").select("kind", "path")
        self._issues.write(kept.unionByName(new), at)
        before, key = mine(old).select("kind", "path"), ["kind", "path"]
        status = lambda a, b, s: a.join(b, key, "left_anti").withColumn("status", F.lit(s))
        return written(status(new, before, "new").unionByName(status(before, new, "resolved")), "changes")

    def _components_of(self, came: DataFrame, went: DataFrame) -> DataFrame:
        """Takes components again where edges came or went; the modules (path) looked at.

        A new cycle goes through a new edge: its modules are reached from an edge's head and reach an edge's tail. One that
        is gone lay in a component that lost an edge. Either set holds its old components whole.
        """
        edges = self._by_src.read()
        ends = came.where("src <> dst")
        region = ends.select(F.col("src").alias("path")).limit(0)
        if not ends.isEmpty():
            heads, tails = ends.select(F.col("dst").alias("path")).distinct(), ends.select(F.col("src").alias("path")).distinct()
            reach = lambda e, start: impact(e, start).select("path").union(start).distinct()
            on = written(reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), heads), "on")
            # what lies between needs no edges outside of what the heads reach
            inner = edges.join(on.select(F.col("path").alias("src")), "src", "left_semi").join(on.select(F.col("path").alias("dst")), "dst", "left_semi")
            region = written(reach(inner, tails.join(on, "path", "left_semi")).join(on, "path", "left_semi"), "region")
        loops = came.where("src = dst").unionByName(went.where("src = dst")).select(F.col("src").alias("path"))
        lost = went.where("src <> dst")
        if not lost.isEmpty():
            known = self._components.read(self._components.touched(lost.select(F.col("src").alias("path")).union(lost.select("dst"))))
            a, b = known.select(F.col("path").alias("src"), F.col("component").alias("c")), known.select(F.col("path").alias("dst"), F.col("component").alias("d"))
            names = lost.join(a, "src").join(b, "dst").where("c = d").select(F.col("c").alias("component")).distinct()
            region = region.union(self._components.read().join(names, "component", "left_semi").select("path"))
        region = written(region.union(loops).distinct(), "region")
        if region.isEmpty():
            return region
        src, dst = region.select(F.col("path").alias("src")), region.select(F.col("path").alias("dst"))
        found = written(strong_components(edges.join(src, "src", "left_semi").join(dst, "dst", "left_semi")), "found")
        at = self._components.touched(region)
        rest = self._components.read(at).join(region, "path", "left_anti")
        self._components.write(written(rest.select("path", "component").unionByName(found), "components"), at)
        return region
