"""Which globs of a table match which paths of another.

Neither side is compiled into the plan, so both may be large. A glob can only match a path that holds each of its literal
pieces; so it is looked up by one n-gram of these, the one that the fewest paths hold, and what is found is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.paths import glob_regex, literals
from ..shared import written

#: Longest n-gram by which globs are looked up.
GRAM = 4


def matched(paths: DataFrame, globs: DataFrame) -> DataFrame:
    """(path, glob): each different path of ``paths`` (path) with each different glob of ``globs`` (glob) that matches it.

    Null paths and globs take no part, nor do globs that aren't UTF-8; other columns are left aside. An empty glob fits what is empty or ends in a slash,
    as ``glob_regex`` says. A glob without literals, such as ``**``, is verified against every path. Empty tables give no rows.
    """
    every = paths.select("path").where("path IS NOT NULL").distinct()
    asked = globs.select("glob").where("is_valid_utf8(glob)").distinct().mapInPandas(_read, "glob string, regex string, grams array<string>")
    grams = asked.select("glob", "regex", F.explode("grams").alias("gram"))
    # n-grams of paths that any glob asks for; each path holds each once
    p, most = F.col("path"), F.length("path")
    cut = lambda n: F.when(most >= n, F.transform(F.sequence(F.lit(1), F.greatest(most - (n - 1), F.lit(1))), lambda i: F.substring(p, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    held = every.select("path", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *(cut(n) for n in range(1, GRAM + 1))))).alias("gram"))
    held = written(held.join(grams.select("gram").distinct(), "gram", "left_semi"), "grams")
    often = held.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("glob").orderBy("n", "gram")
    # an n-gram that no path holds: its glob matches none
    known = grams.join(often, "gram", "left").withColumn("turn", F.row_number().over(rarest)).where("turn = 1 AND n IS NOT NULL")
    return held.join(known.select("glob", "regex", "gram"), "gram").where(F.regexp_like("path", F.col("regex"))).select("path", "glob")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(glob, regex, grams): grams of the longest length, up to GRAM, that the glob's pieces have; the empty one if there is none."""
    for batch in batches:
        out = []
        for glob in batch["glob"]:
            pieces = literals(glob)
            n = min(GRAM, max(map(len, pieces), default=0))
            out.append((glob, glob_regex(glob), sorted({x[k : k + n] for x in pieces for k in range(len(x) - n + 1)}) if n else [""]))
        yield pd.DataFrame(out, columns=["glob", "regex", "grams"])
