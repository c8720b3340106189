"""Tiered packing, hard negatives and centroid clustering against brute-force versions, and on awkward rows."""

import hashlib
import random
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import dualtree, pivots, registry, tiers
from plumbline.llm.packing import tokenizer_path
from plumbline.llm.tokens import Encoder

DATA = Path("/root/testdata/sf0.001")
BYTES = tokenizer_path("byte_bpe_50k.json")


def test_byte_level_encoder_is_the_library():
    encoder = Encoder(BYTES)
    assert encoder.plain
    rng = random.Random(2)
    odd = ["it's I'LL don't 's 'sx ''s a'll !'d it'reabc 'x' '", "<|endoftext|> hi", "", " ", "🙂 ok", "x" * 300_000 + " y", "ab cd " * 100_000, "a  b\n\nc \n d\t\te  ", "\n's \t'll", "  'tis  's", "é à  ñ'd", "日本 x"]
    odd += ["".join(rng.choice(" '\n\tabstmdrevl19.,!é") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for text, ids in zip(odd, encoder.encode(odd), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.whole.encode(text, add_special_tokens=False).ids


def test_words_of_one_hash(monkeypatch):
    from plumbline.llm import tokens

    monkeypatch.setattr(tokens, "polynomial", lambda data, first, end: np.zeros(len(first), np.uint64))
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encoder = Encoder(tokenizer_path(name))
        for text, ids in zip(x := ["one two", "two", "three one", "one"], encoder.encode(x), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == encoder.whole.encode(text, add_special_tokens=False).ids


def check_plan(histogram, windows):
    runs = tiers.plan(histogram, windows)
    assert sum(r.window * r.count for r in runs) == sum(k * v for k, v in histogram.items())
    sequences, items = {}, {}
    for size, a, z, start, length, each, at, window, first in tiers.rules(runs):
        for k in range(z - a):
            sequences.setdefault((first + k // each, window), []).append((at + k % each * length, length))
            items.setdefault((size, a + k), []).append((start, length))
    for (_, window), x in sequences.items():
        x.sort()
        assert [a for a, _ in x] == [sum(n for _, n in x[:k]) for k in range(len(x))] and sum(n for _, n in x) == window
    assert len(sequences) == len({s for s, _ in sequences}) == sum(r.count for r in runs)
    assert {k for k in items} == {(n, r) for n, count in histogram.items() for r in range(count)}
    for (size, _), x in items.items():
        x.sort()
        assert [a for a, _ in x] == [sum(n for _, n in x[:k]) for k in range(len(x))] and sum(n for _, n in x) == size
    return runs


def test_plan_fills_every_window():
    rng = random.Random(1)
    for _ in range(120):
        windows = rng.choice([(4, 8, 16), (128, 256, 512, 1024), (1, 2), (8,), (16, 64)])
        sizes = Counter(rng.randint(1, windows[-1]) for _ in range(rng.randint(0, 200)))
        check_plan({n: c * rng.choice([1, 1, 3, 20]) for n, c in sizes.items()}, windows)
    whole = check_plan({900: 2, 124: 2, 400: 1, 112: 1}, (128, 256, 512, 1024))
    assert all(p.start == 0 and p.length == p.size for r in whole for p in r.parts)  # nothing is cut where whole items fill


SCHEMA = "doc_id long, text string, lang string, window string, item_ids string"


def rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    out = [(k, " ".join(word() for _ in range(int(2 ** rng.uniform(0, 10)))), "en", "w", "i") for k in range(150)]
    out += [(200, "the same text again " * 30, None, None, None)] * 25
    return out + [(None, None, None, None, None), (300, None, "en", "x", "y"), (301, "", "en", "x", "y"), (302, " \n", "en", "x", "y"), (303, "word " * 40_000, "en", "x", "y")]


def test_tiers(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    found = tiers.pack_tiers(docs, BYTES, with_ids=True, keep=("lang", "window", "item_ids"))
    assert found.columns == [*(c for c in tiers.RESULT if c != "step_group"), "ids", "lang", "step_group"]
    got = found.toPandas()
    encoder = Encoder(BYTES).whole
    want = Counter((r[0] if r[0] is not None else -1, *encoder.encode(r[1] or "", add_special_tokens=False).ids, 0) for r in rows())
    parts: dict = {}
    for r in got.itertuples():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        parts.setdefault(-1 if np.isnan(r.doc_id) else int(r.doc_id), []).append((r.start, r.doc_tokens, ids))
    for key, x in parts.items():  # repeated rows may be cut at different places
        alike = [d for d in want for _ in range(want[d]) if d[0] == key]
        at = sorted((s, i) for s, _, ids in x for i in enumerate(ids, s))
        assert Counter(i for _, i in at) == Counter(i for d in alike for i in enumerate(d[1:])) and {n for _, n, _ in x} == {len(d) - 1 for d in alike}
    for _, x in got.groupby("sequence_id"):
        x = x.sort_values("offset")
        assert (x.offset == x.length.cumsum() - x.length).all() and (x.window == x.length.sum()).all()
        assert x.step_group.nunique() == 1 and x.window.iloc[0] in (1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024)
    groups = got.groupby("step_group").agg(window=("window", "nunique"), tokens=("length", "sum"))
    assert (groups.window == 1).all() and groups.tokens.max() <= tiers.STEP_TOKENS and sorted(groups.index) == list(range(len(groups)))
    assert tiers.pack_tiers(docs.limit(0), BYTES).count() == 0
    odd = spark.sql("SELECT 1L AS doc_id, cast(unhex('41FF42') AS STRING) AS text")
    assert tiers.pack_tiers(odd, BYTES).agg(F.sum("length")).first()[0] == len(encoder.encode("A�B").ids) + 1


def test_step_groups_share_the_work(spark):
    rng = random.Random(9)
    runs = tiers.plan({rng.randint(1, 1024): rng.randint(1, 60) for _ in range(300)})
    table = spark.range(sum(r.count for r in runs)).toDF("sequence_id").selectExpr("*", f"{tiers._group(tiers.step_groups(runs))} AS g")
    group = {r[0]: r[1] for r in table.collect()}
    assert set(group.values()) == set(range(sum(g for *_, g in tiers.step_groups(runs))))
    work: dict = {}
    for size, a, z, _, length, each, _, window, first in tiers.rules(runs):
        for k in range(z - a):
            work.setdefault(window, Counter())[group[first + k // each]] += length**2
    sizes = Counter(group.values())
    full = {w: [v / sizes[g] for g, v in c.items()] for w, c in work.items()}
    assert max(full[1024]) < 1.1 * min(full[1024])


def vectors(spark, dim=8, n=300):
    rng = np.random.default_rng(7)
    out = [(k, [float(x) for x in rng.normal(size=dim)], int(rng.integers(4)), k) for k in range(n)]
    out += [(n + k, [0.5] * dim, 1, 0) for k in range(60)] + [(n + 100 + k, [0.5] * dim, 2, 0) for k in range(5)]  # ties
    out += [(out[3][0], out[3][1], out[3][2], 9)] * 2  # repeated rows
    out += [(None, [1.0] * dim, 1, 0), (900, None, 1, 0), (901, [1.0, None] + [0.0] * (dim - 2), 1, 0), (902, [float("nan")] * dim, 1, 0), (903, [float("inf")] * dim, 1, 0), (904, [0.0] * dim, 1, 0), (905, [], 1, 0), (906, [1.0] * (dim - 1), 1, 0), (907, [1.0] * dim, None, 0)]
    return spark.createDataFrame(out, "vec_id long, embedding array<float>, label int, rank int"), out


def brute_negatives(out, every, k=5, m=3):
    good = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int), label) for i, v, label, _ in out if i is not None and label is not None and v and None not in v and np.isfinite(v).all()]
    found = []
    for a, q, own in {i: (i, q, label) for i, q, label in good if i % every == 0}.values():
        s = sorted((-int(q @ c), i, label) for i, c, label in good if i != a and len(c) == len(q))
        for p, ps in dict.fromkeys((i, -x) for x, i, label in [t for t in s if t[2] == own][:k]):
            fit = [(i, -x) for x, i, label in s if label != own and 50 * ps <= -100 * x <= 95 * ps]
            found += [(a, p, n, i, ps, x) for n, (i, x) in enumerate(fit[:m], 1)]
    return sorted(found)


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, monkeypatch, small):
    if small:  # many rings, shards, blocks and tiles
        for name, value in (("SHARD_ROWS", 90), ("BLOCK", 8), ("TILE", 4), ("SAMPLE", 50), ("PIVOTS", 5)):
            monkeypatch.setattr(pivots, name, value)
    df, out = vectors(spark)
    df = df.repartition(3)
    got = pivots.hard_negatives(df, df.where("vec_id % 15 = 0"), pivots=pivots.PIVOTS)
    assert sorted(map(tuple, got.collect())) == brute_negatives(out, 15)
    if small:
        text = df.withColumn("label", F.col("label").cast("string"))
        assert sorted(map(tuple, pivots.hard_negatives(text, text.where("vec_id % 15 = 0")).collect())) == brute_negatives(out, 15)
        assert pivots.hard_negatives(df.limit(0), df.limit(0)).count() == 0
        assert pivots.hard_negatives(df, df.limit(0)).count() == 0


def test_brackets_hold_and_prune():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16)) * 200
    v = np.floor(centres[rng.integers(30, size=6000)] + rng.normal(size=(6000, 16)) * 8).astype(np.int64)
    square = (v**2).sum(axis=1)
    table = pivots.Pivots.of(v[:500].tolist(), int(square.max()))
    away = table.distances(v)
    open_ = []
    for k in range(0, 6000, 600):
        low, high = table.bracket(away, away, table.distances(v[k : k + 1], True)[0], float(square[k]))
        s = v @ v[k]
        assert (low <= s).all() and (s <= high).all()
        open_.append((high >= np.sort(s)[-5]).mean())  # what is left to check exactly
    assert np.mean(open_) < 0.6


def brute_clusters(out, n, rounds, length):
    good = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v, *_ in out if v and len(v) == length and None not in v and np.isfinite(v).all()]
    name = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest())
    at = [v for _, v in sorted(good, key=lambda r: (*name(r[0]), r[1].tolist()))[:n]]
    near = lambda v: min((int(((v - c) ** 2).sum()), k) for k, c in enumerate(at))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in good]
        at = [np.array([int(s) // own.count(k) for s in sum(v for (_, v), o in zip(good, own, strict=True) if o == k)]) if k in own else c for k, c in enumerate(at)]
    found = [(i, *near(v)) for i, v in good]
    total = sum(d for _, d, _ in found)
    per = {k: sum(d for _, d, o in found if o == k) for *_, k in found}
    sha = lambda k: hashlib.sha256(",".join(map(str, at[k].tolist())).encode()).hexdigest()
    return sorted(((i, k, d, per[k], total, sha(k)) for i, d, k in found), key=repr)


@pytest.mark.parametrize(("block", "leaf"), [(4096, 32), (50, 1), (7, 3)])
def test_clusters(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(dualtree, "BLOCK", block)
    monkeypatch.setattr(dualtree.CoverTree.__init__, "__defaults__", (leaf,))
    df, out = vectors(spark)
    got = dualtree.cluster(df.repartition(3), 16, 3, 8)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_clusters(out, 16, 3, 8)
    if block == 7:
        few = df.where("vec_id < 5 OR vec_id IS NULL")
        assert sorted(map(tuple, dualtree.cluster(few, 16, 2, 8).collect()), key=repr) == brute_clusters([r for r in out if r[0] is None or r[0] < 5], 16, 2, 8)
        assert dualtree.cluster(df.limit(0), 16, 3, 8).count() == 0 and dualtree.cluster(df, 16, 3, 9).count() == 0


def test_trees_prune():
    rng = np.random.default_rng(5)
    centres = rng.integers(-3000, 3000, (16, 12))
    x = centres[rng.integers(16, size=4000)] + rng.integers(-40, 41, (4000, 12))
    compared: list[int] = []
    number, distance = dualtree.nearest_centroids(x, dualtree.CoverTree(x), centres, compared)
    exact = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (number == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert compared[0] < 0.2 * exact.size
    assert dualtree.nearest_centroids(x[:5], dualtree.CoverTree(x[:5]), x[[7, 7, 7]])[0].tolist() == [0] * 5  # ties


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_centroid_clustering"])
def test_queries_are_their_sql(spark, name):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    df, want = registry.QUERIES[name](spark, str(DATA)), duck.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.select(", ".join(df.columns)).fetchall()))
