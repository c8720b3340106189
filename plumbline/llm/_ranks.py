"""Ranks within groups, of which one may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def ranked(rows: DataFrame, *group: str, also: DataFrame | None = None, order: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``_rank``, from 0 within each group; and the number ``_n`` of rows by group and bucket.

    Rows of a group are dealt over buckets by a hash of their contents, ranked within the bucket, and moved
    by the sizes of the buckets before; no task sees a group as a whole. ``rows`` must give the same rows
    each time it is read. Ranks follow from the contents, so a task that runs again ranks alike; equal rows
    are interchangeable. Null is a group too. ``also`` has a row for each group and adds its other columns; it
    meets the counts, which have a row for each bucket, so that a large group's rows are not dealt out by group.
    ``order`` names two columns that rows are ranked by instead; values of the first are the buckets.
    """
    buckets = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    content = [F.to_json(F.struct(c)) if "map<" in kind or "variant" in kind else F.col(c) for c, kind in rows.dtypes]
    first = F.col(order[1]) if order else F.xxhash64(*content)
    rows = rows.withColumn("_h", first).withColumn("_bucket", F.col(order[0]) if order else F.pmod("_h", F.lit(buckets)))
    counts = rows.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*(F.col(g).alias(f"_g{k}") for k, g in enumerate(group)), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    if also is not None:
        match = F.lit(True)
        for k, g in enumerate(group):
            match = match & F.col(f"_g{k}").eqNullSafe(F.col(f"_a{k}"))
        starts = starts.join(also.withColumnsRenamed({g: f"_a{k}" for k, g in enumerate(group)}), match).drop(*(f"_a{k}" for k in range(len(group))))
    within = Window.partitionBy(*group, "_bucket").orderBy("_h", *content)
    same = F.col("_bucket") == F.col("_b")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    found = rows.withColumn("_k", F.row_number().over(within) - 1).join(starts, same)
    return found.withColumn("_rank", (F.col("_k") + F.col("_before")).cast("long")).drop("_h", "_b", "_bucket", "_k", "_before", *(f"_g{k}" for k in range(len(group)))), counts
