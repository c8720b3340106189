"""Connected components of a graph given by its links, by alternating star operations.

Each round links every node to the smallest of its neighbours, first for larger neighbours, then for
smaller ones, until the links are stars around the smallest node of each component. A round is a partial
aggregation and a join that adaptive execution can split where a star's centre is hot; its links are written
to the shared folder, so lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..shared import forget, place


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v), which may repeat and hold loops; root is the smallest node of its component."""
    spark = links.sparkSession
    edge = lambda a, b: F.struct(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    kind = links.schema["u"].dataType.simpleString()
    now, seen, old = links.where("u <> v").select(edge(F.col("u"), F.col("v")).alias("e")).select("e.*").distinct(), None, None
    while True:
        path = place(spark, "links")
        now.write.parquet(path)
        now = spark.read.schema(f"u {kind}, v {kind}").parquet(path)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if old:
            forget(spark, old)
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v")).distinct()
        seen, old = state, path
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        now = large.join(least, "u").select(F.explode(F.array(edge(F.col("v"), F.col("m")), edge(F.col("u"), F.col("m")))).alias("e")).select("e.*").where("u <> v").distinct()
