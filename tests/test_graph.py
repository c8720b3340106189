"""Graph operators against brute-force versions."""

import random
import time

import pytest
from pyspark.sql import functions as F

from plumbline.operators import chains, graph, lists


def brute_layers(nodes, edges):
    into = {n: {a for a, b in edges if b == n} for n in nodes}
    layer, left = {}, set(nodes)
    while free := [n for n in left if into[n] <= layer.keys()]:
        for n in free:
            layer[n] = max((layer[a] + 1 for a in into[n]), default=0)
        left -= set(free)
    return layer | dict.fromkeys(left)


def brute_components(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: {b for a, b in edges if a == n} for n in nodes}
    for k in nodes:
        for n in nodes:
            if k in reach[n]:
                reach[n] |= reach[k]
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes if n in reach[n]}


def brute_chains(edges, longer_than, keep):
    out = {a: {d for c, d in edges if c == a} for a, _ in edges}
    paths, found = [[a] for a in {x for e in edges for x in e}], []
    for n in range(2, longer_than + 5):
        paths = [[*p, d] for p in paths for d in out.get(p[-1], ()) if d not in p]
        found += [(-n, " > ".join(p)) for p in paths if n > longer_than]
    return [(t, -n) for n, t in sorted(found, key=lambda x: (x[0], x[1].encode()))[:keep]]


def rings_and_runs(rng):
    """Runs that end in the middle of other runs, rings, rings with tails."""
    edges = {(rng.randrange(10), rng.randrange(10)) for _ in range(rng.randint(0, 14))}
    for base in (100, 200, 300):
        n = rng.randint(1, 7)
        edges |= {(base + k, base + k + 1) for k in range(n)}
        edges |= {(base + n, base)} if rng.random() < 0.4 else set()
        edges |= {(rng.randrange(10), base)} if rng.random() < 0.5 else set()
        edges |= {(base + n, rng.randrange(10))} if rng.random() < 0.5 else set()
    return sorted(edges)


@pytest.mark.parametrize("seed", [1])
def test_layers_and_components(spark, seed):
    rng = random.Random(seed)
    edges = [e for k in range(6) for e in ((a + 1000 * k, b + 1000 * k) for a, b in rings_and_runs(rng))]  # six graphs at once
    nodes = sorted({x for e in edges for x in e} | {99_999})
    df = spark.createDataFrame(edges + edges[:5], "src long, dst long")
    assert {r.path: r.component for r in graph.strong_components(df).collect()} == brute_components(edges)
    got = graph.layers(spark.createDataFrame([(n,) for n in nodes], "path long"), df)
    assert {r.path: r.layer for r in got.collect()} == brute_layers(nodes, edges)


def test_a_path_of_ten_thousand(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(lists, "written", lambda df, name, f=lists.written: rounds.append(name) or f(df, name))
    n = 10_000
    edges = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = graph.layers(spark.range(n).toDF("path"), edges)
    assert got.where("layer = path").count() == n
    assert rounds.count("links") <= 16
    ring = edges.unionByName(spark.createDataFrame([(n - 1, 0)], "src long, dst long"))
    assert graph.strong_components(ring).where("component = 0").count() == n


def test_empty_graphs(spark):
    none = spark.createDataFrame([], "src string, dst string")
    nodes = spark.createDataFrame([("a",)], "path string")
    assert graph.layers(nodes, none).collect() == [("a", 0)] and graph.strong_components(none).count() == 0
    assert chains.chains(none, 5).count() == 0 and lists.preorder(nodes.limit(0).withColumn("parent", F.col("path"))).count() == 0


@pytest.mark.parametrize(("seed", "beam"), [(1, 64), (2, 1), (3, 2)])
def test_chains(spark, monkeypatch, seed, beam):
    monkeypatch.setattr(chains, "BEAM", beam)
    rng = random.Random(seed)
    names = [f"n{k}" for k in range(9)] + ["a", "a > n1", "a\t", "a!", "n1 > n2"]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(26)]
    df = spark.createDataFrame(edges, "src string, dst string")
    got = [(r.chain, r.length) for r in chains.chains(df, 3, 7).collect()]
    assert got == brute_chains({e for e in edges if e[0] != e[1]}, 3, 7)


def test_chains_with_every_path_kept(spark, monkeypatch):
    monkeypatch.setattr(chains, "BEAM", 1)
    monkeypatch.setattr(chains, "WIDE", 4)
    # within one component, most ways end before they are long enough
    edges = [(f"{a}", f"{b}") for a in range(5) for b in range(5) if a != b] + [("0", "x"), ("x", "0"), ("y", "3"), ("4", "z"), ("z", "y")]
    df = spark.createDataFrame(edges, "src string, dst string")
    assert [(r.chain, r.length) for r in chains.chains(df, 4, 12).collect()] == brute_chains(set(edges), 4, 12)


def test_chains_on_a_thousand_modules(spark):
    rng = random.Random(5)
    edges = [(f"m{a}.rs", f"m{rng.randrange(1000)}.rs") for a in range(1000) for _ in range(3)]
    df = spark.createDataFrame(edges, "src string, dst string").cache()
    df.count()
    began = time.perf_counter()
    found = chains.chains(df, 5).collect()
    print("seconds", time.perf_counter() - began)
    assert len(found) == 10 and {r.length for r in found} == {9}


def test_preorder(spark):
    rng = random.Random(6)
    parent = {k: rng.randrange(k) if k > 3 else None for k in range(60)} | {100: 101, 101: 100, 102: 101, 103: 999}
    df = spark.createDataFrame(list(parent.items()), "path int, parent int")
    got = {r.path: (r.position, r.depth, r.size) for r in lists.preorder(df).collect()}
    order: list = []

    def walk(n, depth):
        at = len(order)
        order.append(n)
        for kid in sorted(k for k, p in parent.items() if p == n):
            walk(kid, depth + 1)
        want[n] = (at, depth, len(order) - at)

    want: dict = {100: (None,) * 3, 101: (None,) * 3, 102: (None,) * 3, 103: (None,) * 3}
    for root in sorted(k for k, p in parent.items() if p is None):
        walk(root, 0)
    assert got == want


def brute_preorder(rows):
    kids: dict = {}
    for path, above in set(rows):
        kids.setdefault(above, []).append(path)
    found = {path: (above, None, None, None, path == max(kids[above])) for path, above in rows}
    order: list = []

    def walk(path, above, depth):
        at = len(order)
        order.append(path)
        for kid in sorted(kids.get(path, [])):
            walk(kid, path, depth + 1)
        found[path] = (above, at, depth, len(order) - at, path == max(kids[above]))

    for root in sorted(kids.get(None, [])):
        walk(root, None, 0)
    return found


@pytest.mark.parametrize("back", [150, 3])
def test_preorder_of_many_kinds_of_trees(spark, monkeypatch, back):
    """Bushy and long ones, in blocks of a few rows, beside rings, what hangs below them or a missing parent, and rows that stand twice."""
    monkeypatch.setattr(lists, "BLOCK", 7)
    rng = random.Random(back)
    ids = rng.sample(range(1500), 150)
    rows = [(ids[k], ids[rng.randrange(max(0, k - back), k)] if k > 3 else None) for k in range(150)]
    rows += [(-1, -2), (-2, -3), (-3, -1), (-4, -1), (-5, -4), (-9, -9), (-10, -9), (-6, -999), (-7, -6), (-8, -7), (-11, -999)] + rows[:20]
    rows = [(f"é{a}", None if b is None else f"é{b}") for a, b in rows]
    got = lists.preorder(spark.createDataFrame(rows, "path string, parent string")).collect()
    assert len(got) == len(set(rows)) and {r.path: tuple(r)[1:] for r in got} == brute_preorder(rows)


def test_preorder_of_flat_trees_takes_no_doubling(spark, monkeypatch):
    """Trees of many rows and four levels: the work is some passes, not a round for each doubling of the tour."""
    tables = []
    plain = lists.written
    monkeypatch.setattr(lists, "written", lambda df, name, *by: tables.append(name) or plain(df, name, *by))
    rows = [(k, None) for k in range(3)] + [(10 + k, k % 3) for k in range(20)] + [(100 + 2 * k, 10 + k % 20) for k in range(500)] + [(101 + 2 * k, 100 + 2 * (k * 7 % 400)) for k in range(6000)]
    got = lists.preorder(spark.createDataFrame(rows, "path long, parent long")).collect()
    assert {r.path: tuple(r)[1:] for r in got} == brute_preorder(rows)
    assert "links" not in tables and tables.count("live") == 3
