"""Globs of a table against each glob's own expression."""

import random
import re

from plumbline.functions import paths
from plumbline.operators import globs


def brute(names, patterns):
    fits = [(g, re.compile(paths.glob_regex(g).replace(r"\z", r"\Z"))) for g in set(patterns)]
    return sorted((p, g) for p in set(names) for g, r in fits if r.search(p))


def run(spark, names, patterns):
    p = spark.createDataFrame([(x, 1, 2) for x in names], "path string, glob int, gram int")
    g = spark.createDataFrame([(x, 1) for x in patterns], "glob string, path int")
    return sorted(tuple(r) for r in globs.matched(p, g).collect())


def test_thousand_globs(spark):
    rng = random.Random(5)
    part = lambda: rng.choice(["db", "io", "src", "api", "x", "é", "a.b", "mod"]) + rng.choice(["", "", str(rng.randrange(60))])
    names = ["/".join(part() for _ in range(rng.randint(1, 5))) + rng.choice([".rs", ".py", ""]) for _ in range(400)] + ["a/b/", "/"]
    any_part = lambda: rng.choice(["**", "*", part(), part() + "*", "*" + part()])
    patterns = ["/".join(any_part() for _ in range(rng.randint(1, 4))) + rng.choice(["", "", ".rs", "*"]) for _ in range(1500)]
    patterns += ["**", "*", "", "a", "***", "+(", "é"]
    assert len(set(patterns)) > 1000
    assert run(spark, names * 2, patterns * 2) == brute(names, patterns)


def test_nothing_to_match(spark):
    assert run(spark, [], ["**"]) == run(spark, ["a"], []) == []
    assert run(spark, [None, "a/b"], [None, "b", "c"]) == [("a/b", "b")]
    assert run(spark, [""], ["", "**", "a"]) == [("", ""), ("", "**")]


def test_odd_bytes(spark):
    odd = spark.sql("SELECT CAST(X'61FF' AS STRING) AS path, CAST(X'61FF' AS STRING) AS glob UNION ALL SELECT 'a/b', 'b'")
    assert [tuple(r) for r in globs.matched(odd, odd).where("is_valid_utf8(path)").collect()] == [("a/b", "b")]
