"""Queries against their SQL on the smallest tables, and rules on hand-made rows."""

import random
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline import catalog
from plumbline.functions import paths
from plumbline.operators import graph, resolve
from plumbline.plans import budget as budgets
from plumbline.plans import detect
from plumbline.shared import settings

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()
QUICK = [n for n in catalog.ORACLE_SQL if n != "any_error"]  # the rows of issues_of_all_kinds, counted


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
@pytest.mark.parametrize("name", QUICK)
def test_same_rows(spark, duck, name):
    df, want = catalog.QUERIES[name](spark, str(DATA)), duck.sql(catalog.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def brute_components(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: {b for a, b in edges if a == n} for n in nodes}
    for k in nodes:
        for n in nodes:
            if k in reach[n]:
                reach[n] |= reach[k]
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes if n in reach[n]}


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(14), rng.randrange(14)) for _ in range(18)]
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {r.path: r.component for r in graph.strong_components(df).collect()} == brute_components(edges)


def test_impact_and_layers(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("d", "d"), ("d", "e")], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "path string")
    target = spark.createDataFrame([("c",)], "path string")
    assert {r.path: r.depth for r in graph.impact(edges, target).collect()} == {"b": 1, "a": 2}
    assert {r.path: r.depth for r in graph.impact(edges, target, 1).collect()} == {"b": 1}
    assert {r.path: r.layer for r in graph.layers(nodes, edges).collect()} == {"a": 0, "b": 1, "c": 2, "d": None, "e": None, "f": 0}
    assert {r.path: (r.fan_in, r.fan_in_distinct) for r in graph.degrees(nodes, edges).collect()}["b"] == (2, 1)


def test_resolution(spark):
    rows = [("src/a/mod.rs", "mod", ["crate::b::X", "super::b", "serde::X", "crate::a::c"]), ("src/b.rs", "b", ["crate::{a, b}", "pub use crate::a", "b::X"]), ("src/a/b.rs", "b", [])]
    m = spark.createDataFrame(rows, "path string, name string, imports array<string>")
    assert {(r.src, r.dst) for r in resolve.by_path(m).collect()} == {("src/a/mod.rs", "src/a/b.rs"), ("src/a/mod.rs", "src/a/mod.rs")}
    assert {(r.src, r.dst, r.pos) for r in resolve.by_name(m).collect()} == {("src/a/mod.rs", "src/a/b.rs", 0), ("src/b.rs", "src/a/b.rs", 2)}


@pytest.mark.parametrize(
    ("glob", "path", "fits"),
    [
        ("**/db/**", "src/mydb/x.rs", True), ("**/fs.rs", "src/myfs.rs", True), ("src/*.rs", "src/a.rs", True), ("src/*.rs", "src/a/b.rs", False),
        ("a.rs", "src/a.rs", True), ("a.rs", "src/ba.rs", False), ("src/**", "src/a/b", True), ("src/**", "lib/src", False), ("**/x/*.rs", "a/x/b.rs", True),
    ],
)
def test_globs(glob, path, fits):
    assert bool(re.search(paths.glob_regex(glob).replace(r"\z", r"\Z"), path)) is fits


def test_expressions(spark):
    df = spark.createDataFrame([("a\nb\n",), ("",), ("a\r\nb",)], "t string")
    assert [r[0] for r in df.select(paths.line_count(F.col("t"))).collect()] == [2, 0, 2]
    tests = [f"pkg{x}deep/unit.py" for x in paths.TEST_FOLDERS] + [f"{x}unit.py" for x in paths.TEST_STARTS] + [f"lib/unit{x}" for x in paths.TEST_ENDS]
    others = ["lib/contest.py", "lib/attest_all.rs", "latests/x.rs", "lib/testing_ground.rs"]
    df = spark.createDataFrame([(x,) for x in [*tests, *others]], "p string")
    assert [r[0] for r in df.select(paths.is_test(F.col("p"))).collect()] == [True] * len(tests) + [False] * len(others)


def test_token_pack_skips(spark):
    m = spark.createDataFrame([(1, "a", 8, 3), (2, "b", 50, 5), (3, "c", 2, 1)], "rank int, path string, full long, short long")
    assert {r.path: r.choice for r in detect.token_pack(m, 810).collect()} == {"a": "full", "c": "full"}


def brute_pack(rows, budget):
    """Rows in order, nulls last; each in full, else short, else not at all."""
    left, out = max(0, budget - 800), []
    last = lambda x: (x is None, x)
    size = lambda x: 2**62 if x is None else max(0, x)
    for _, path, full, short in sorted(rows, key=lambda r: (last(r[0]), last(r[1]), size(r[2]), size(r[3]))):
        for n, choice in ((size(full), "full"), (size(short), "short")):
            if n <= left:
                left -= n
                out.append((path, choice))
                break
    return sorted(out, key=repr)


@pytest.mark.parametrize(("fan_in", "batch", "budget"), [(64, 10_000, 900), (2, 3, 900), (2, 3, 800), (3, 7, 3000), (2, 5, 0)])
def test_token_pack(spark, monkeypatch, fan_in, batch, budget):
    monkeypatch.setattr(budgets, "FAN_IN", fan_in)
    rng = random.Random(budget + batch)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice(["a", "b", "c", "d", None]), rng.choice([0, 5, 20, 90, 400, None, -1]), rng.choice([0, 1, 3, 9, 40, None])) for _ in range(150)]
    rows += [(2, "zero", 0, 0)] * 20 + [(1, "same", 7, 2)] * 5
    m = spark.createDataFrame(rows, "rank int, path string, full long, short long")
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(batch)):
        got = sorted(map(tuple, detect.token_pack(m, budget).collect()), key=repr)
    assert got == brute_pack(rows, budget)
    assert detect.token_pack(m.limit(0), 900).count() == 0


def test_boundaries(spark):
    src = spark.createDataFrame([("a.rs", 'x("SELECT 1")\nSELECT 2\nfetch(1)'), ("db/b.rs", "SELECT 1"), ("c.rs", "SELECT 1\nSELECT 2")], "path string, content string")
    hits = detect.boundary_hits(src, detect.BOUNDARIES)
    assert {(r.boundary, r.path, r.line) for r in hits.collect()} == {("Persistence", "a.rs", 2), ("Network", "a.rs", 3), ("Persistence", "c.rs", 1), ("Persistence", "c.rs", 2)}
    assert {(r.boundary, r.modules, r.hits) for r in detect.boundary_violations(hits, detect.BOUNDARIES).collect()} == set()  # c.rs owns the boundary, one module is left


def plain_hits(rows, boundaries):
    """Each line against each indicator in turn."""
    out = set()
    for path, content in rows:
        for n, text in enumerate((content or "").split("\n"), 1):
            for b in boundaries:
                if path is None or any(re.search(paths.glob_regex(g).replace(r"\z", r"\Z"), path) for g in b.allowed_in):
                    continue
                fits = [i for i in b.indicators if i and i in text and text.partition(i)[0].rstrip(" ")[-1:] not in list("'\"`")]
                if fits:
                    out.add((b.name, path, n, fits[0]))
    return out


def test_a_thousand_indicators(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab.:('` ") for _ in range(n))
    boundaries = [detect.Boundary(f"B{k}", [word(rng.randint(1, 6)) for _ in range(100)] + ["", "a\nb"], ["**/ab/**"] if k % 2 else []) for k in range(10)]
    rows = [(f"{rng.choice(['x', 'ab', 'db'])}/{k}.rs", "\n".join(word(rng.randint(0, 25)) for _ in range(rng.randint(0, 8)))) for k in range(60)]
    rows += [(None, "aaa"), ("n.rs", None), ("e.rs", ""), rows[0], ("long.rs", "ab" * 50_000)]
    src = spark.createDataFrame(rows, "path string, content string")
    got = detect.boundary_hits(src, boundaries)
    assert {tuple(r) for r in got.collect()} == plain_hits(rows, boundaries)
    assert got.where("path = 'x/0.rs' OR path = 'ab/0.rs' OR path = 'db/0.rs'").count() == 2 * len(plain_hits(rows[:1], boundaries))
    plan = lambda b: len(detect.boundary_hits(src, b)._jdf.queryExecution().executedPlan().toString())
    assert plan(boundaries) == plan(boundaries[:1])
    assert detect.boundary_hits(src, []).count() == 0
    odd = spark.sql("SELECT 'x.rs' AS path, cast(unhex('FF6162FE') AS STRING) AS content")
    assert detect.boundary_hits(odd, [detect.Boundary("B", ["ab"])]).collect() == [("B", "x.rs", 1, "ab")]
