"""Each operator against a brute-force version, and on awkward rows."""

import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import ann, licenses, lines, mixing, packing, quality, simhash, topk, urls
from plumbline.llm.tokens import Encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, length string"
LONG = "shared passage of words that is long enough to count as a line"


def rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    out = []
    for k in range(120):
        text = " ".join(word() for _ in range(rng.randint(1, 60)))
        if k % 6 == 0:
            text += f"\n  {LONG.upper()} \n" + " ".join(word() for _ in range(5))
        out.append((k, text, "en", f"s{k % 3}" if k % 4 else "hot", len(text), "x", "y"))
    same = "one two three four five six seven eight nine ten " * 8
    out += [(200 + k, same, None, None, None, None, None) for k in range(30)]
    out += [(200, same, None, None, None, None, None)] * 2  # repeated rows
    out += [(None, None, None, None, None, None, None), (300, None, "en", "s1", 0, "x", "y"), (301, "", "en", "s1", 0, "x", "y"), (302, " \t\n", "en", "s1", 3, "x", "y"), (None, LONG, "en", "s1", 1, "x", "y")]
    out += [(303, "word " * 60_000, "en", "s1", 1, "x", "y")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_encoder_is_the_library():
    path = packing.tokenizer_path()
    encoder = Encoder(path)
    odd = ["Σας ΟΔΟΣ Σ", "İstanbul ß ẞ", "a\x1cb\x85c d", "it's I'LL don't 's 'sx ''s a'll !'d it'reabc 'x' '", "日本語 テスト", "<|endoftext|> hi", "", " ", "🙂 ok", "a_b__c 12 3", "x" * 600_000 + " y", "ab cd " * 200_000]
    for text, ids in zip(odd + [r[1] or "" for r in rows()], encoder.encode(odd + [r[1] or "" for r in rows()]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.whole.encode(text, add_special_tokens=False).ids


def brute_bins(sizes, capacity):
    rooms = []
    for n in sorted(sizes, reverse=True):
        fit = min((r, k) for k, r in enumerate(rooms + [capacity]) if r >= n)
        if fit[1] == len(rooms):
            rooms.append(capacity)
        rooms[fit[1]] -= n
    return len(rooms)


def test_best_fit_plan():
    rng = random.Random(1)
    for capacity in (1, 7, 64):
        for _ in range(40):
            sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
            rules = packing.best_fit_decreasing({n: sizes.count(n) for n in set(sizes)}, capacity)
            used = {}
            for length, a, z, first, each, at in rules:
                for r in range(z - a):
                    used.setdefault(first + r // each, []).append((at + r % each * length, length))
            assert sorted(n for x in used.values() for _, n in x) == sorted(sizes)
            for x in used.values():
                x.sort()
                assert [a for a, _ in x] == [sum(n for _, n in x[:k]) for k in range(len(x))] and sum(n for _, n in x) <= capacity
            assert len(used) == brute_bins(sizes, capacity)


def test_packing(docs, none):
    path = packing.tokenizer_path()
    got = packing.pack(packing.token_pieces(docs, path, with_ids=True)).toPandas()
    encoder = Encoder(path).whole
    want = sorted((r[0] if r[0] is not None else -1, *encoder.encode(r[1] or "", add_special_tokens=False).ids, 1) for r in rows())
    whole, pending = [], {}
    for r in got.itertuples():
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) and r.start == r.piece * 4096
        key = -1 if np.isnan(r.doc_id) else int(r.doc_id)
        if r.length == 4096 or r.piece:
            pending.setdefault(key, []).append((r.piece, list(r.ids)))
        else:
            whole.append((key, *r.ids))
    whole += [(k, *[i for _, x in sorted(v) for i in x]) for k, v in pending.items()]
    assert sorted(whole) == want
    for _, x in got.groupby("sequence_id"):
        x = x.sort_values("offset")
        assert (x.offset == x.length.cumsum() - x.length).all() and x.length.sum() <= 4096
    assert packing.pack(packing.token_pieces(none, path)).count() == 0


VECTORS = "vec_id long, embedding array<float>, rank int"


def vectors(spark):
    rng = np.random.default_rng(5)
    out = [(k, [float(x) for x in rng.normal(size=6)], 0) for k in range(100)]
    out += [(100 + k, [1.0, 0.5, 0.0, 0.0, 0.0, 0.25], 0) for k in range(40)]  # ties
    out += [(3, out[3][1], 0)] * 2 + [(None, [1.0] * 6, 0), (500, None, 0), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (502, [float("nan")] * 6, 0), (503, [float("inf")] * 6, 0), (504, [0.0] * 6, 0), (505, [], 0), (506, [1.0, 2.0], 0)]
    return spark.createDataFrame(out, VECTORS), out


def usable(out, zero):
    return {k: np.array(v, np.float32).astype(float) for k, v, _ in out if k is not None and v and None not in v and np.isfinite(v).all() and (zero or np.any(v))}


@pytest.mark.parametrize("small", [False, True])
def test_top_k(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(topk, "BLOCK", 4)
        monkeypatch.setattr(topk, "SHARD_VALUES", 30)
    df, out = vectors(spark)
    got = {}
    for r in topk.top_inner_products(df, df.where("vec_id % 20 = 0"), 5).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = {k: np.floor(64 * v).astype(int) for k, v in usable(out, True).items()}
    for q in [k for k in whole if k % 20 == 0]:
        best = sorted((-int(whole[q] @ v), k) for k, v in whole.items() if k != q and len(v) == len(whole[q]))[:5]
        assert got.get(q, []) == [(n + 1, k, -s) for n, (s, k) in enumerate(best)]


def test_large_scores_fall_back():
    q = np.array([[2**40, 1]]), np.array([[2**62, -(2**62)]])
    assert topk._product(q[0], np.array([[2, 3]]))[0, 0] == 2**41 + 3
    with pytest.raises(OverflowError):
        topk._product(np.array([[2**40]]), np.array([[2**40]]))
    got = topk.best_of_tiles(np.array([9]), q[0], np.array([1, 2, 3]), np.array([[1, 0], [1, 0], [-(2**22), 0]]), 2)
    assert got[1].tolist() == [1, 2] or sorted(got[1].tolist()) == [1, 2]


@pytest.mark.parametrize("small", [False, True])
def test_nearest(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(ann, "BLOCK", 4)
        monkeypatch.setattr(ann, "SHARD_VALUES", 100)
    df, out = vectors(spark)
    assert ann.nearest(df.limit(0), df, 3).count() == ann.nearest(df, df.limit(0), 3).count() == 0
    good = usable(out, False)
    hit = total = 0
    for r in ann.nearest(df, df.where("vec_id % 10 = 0"), 10).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("l")).collect():
        best = sorted((float(np.sqrt(((good[r.query_id] - v) ** 2).sum())), k) for k, v in good.items() if k != r.query_id and len(v) == len(good[r.query_id]))[:10]
        hit += len({k for _, k in best} & {x.vec_id for x in r.l})
        total += len(best)
        for x in r.l:
            assert x.score == pytest.approx(float(np.sqrt(((good[r.query_id] - good[x.vec_id]) ** 2).sum())), rel=1e-12)
    assert hit / total >= 0.9
    assert ann.chi_square(ann.stop_ratio(0.9, 8), 8) == pytest.approx(0.9)


def test_nearest_prunes_clusters():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(60, 32)) * 8
    c = centres[rng.integers(60, size=12_000)] + rng.normal(size=(12_000, 32))
    ids, q = np.arange(12_000), np.arange(0, 12_000, 300)
    looked = []
    got = ann.search(ids[q], c[q], np.full(len(q), np.inf), ids, c, 10, ann.DIMENSIONS, ann.CONFIDENCE, ann.SEED, looked)
    hit = 0
    for k in q:
        d = ((c - c[k]) ** 2).sum(axis=1)
        d[k] = np.inf
        hit += len(set(np.argsort(d)[:10].tolist()) & set(got[1][got[0] == k].tolist()))
    assert hit >= 0.9 * 10 * len(q) and sum(looked) <= 0.2 * len(q) * len(c)
    # boxes: each point is in one, and a box's distance is never more than that of its points
    points = c @ ann._plane(32, ann.DIMENSIONS, ann.SEED)
    boxes = ann.Boxes(points[::10], 16, ann.DIMENSIONS)
    home, apart = boxes.home(points), boxes.distances(points[q])
    assert len(np.unique(home)) == 16
    for k, row in zip(q, apart, strict=True):
        assert (row[home] <= ((points - points[k]) ** 2).sum(axis=1) + 1e-9).all()
    assert (apart <= ann.stop_ratio(ann.CONFIDENCE, ann.DIMENSIONS) * 64).mean() < 0.9


def components(pairs, nodes):
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("bucket", [8192, 2])
def test_near_duplicates(spark, docs, none, bucket):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows())
    import xxhash

    def brute(text):
        w = (text or "").encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    want = sorted((r[0] if r[0] is not None else -1, f"{brute(r[1]):016x}") for r in rows())
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint) for r in got) == want
    near = sorted({int(f, 16) for _, f in want})
    rng = random.Random(2)
    near += [x for x in {rng.choice(near) ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(40)} if x not in near]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fps = spark.createDataFrame([(signed(x),) for x in near], "fp long")
    pairs = [(r.u % (1 << 64), r.v % (1 << 64)) for r in simhash.links(fps, 3, bucket).collect()]
    every = [(a, b) for a in near for b in near if a < b and (a ^ b).bit_count() <= 3]
    assert components(pairs, near) == components(every, near) and all((a ^ b).bit_count() <= 64 for a, b in pairs)
    assert simhash.near_duplicates(none).count() == 0
    if bucket > 2:
        kept = simhash.representatives(docs)
        assert kept.columns == docs.columns and kept.count() == len({r.class_fp for r in got})


def test_lines(docs, none):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_lines, r.n_dropped, r.kept_text) for r in lines.drop_shared_lines(docs).collect())
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    held = {}
    for d, text, *_ in rows():
        for k in {key(x) for x in (text or "").split("\n")}:
            held.setdefault(k, set()).update({d} - {None})
    bad = {k: max(v) for k, v in held.items() if len(k) >= 40 and len(v) >= 5}
    want = []
    for d, text, *_ in rows():
        d = -1 if d is None else d
        every = (text or "").split("\n")
        kept = [x for x in every if not (key(x) in bad and bad[key(x)] != d)]
        want.append((d, len(every), len(every) - len(kept), "\n".join(kept)))
    assert got == sorted(want) and len(bad) >= 2
    assert lines.drop_shared_lines(none).count() == 0
    assert set(docs.columns) - {"text"} <= set(lines.drop_shared_lines(docs).columns)
    assert lines.key_of("é".encode() * 39) is None and lines.key_of("é".encode() * 40)


def test_line_runs(spark):
    store = lines.LineRuns(spark, fan_in=2)
    for k in range(5):
        batch = spark.createDataFrame([(k, b"a"), (k, b"a"), (10 + k, b"b"), (k, bytes([k])), (None, b"a")], "doc_id long, h binary")
        assert store.unseen(batch.where("doc_id < 10").distinct()).count() == (2 if k == 0 else 1)
        store.add(batch)
        every = [bytes(r.h) for run in store.runs() for r in run.collect()]
        assert len(every) == len(set(every)) == 3 + k
    assert [len(x) for x in store.levels] == [1, 0, 1]
    assert sorted((bytes(r.h), r.last) for r in store.shared(5).collect()) == [(b"a", 4), (b"b", 14)]
    plan = store.unseen(store.runs()[0])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Exchange" not in plan
    store.close()


def test_lines_anti_join_is_on_the_path(spark, docs, monkeypatch):
    calls = []
    unseen = lines.LineRuns.unseen
    monkeypatch.setattr(lines.LineRuns, "unseen", lambda self, x: calls.append(len(self.runs())) or unseen(self, x))
    assert lines.drop_shared_lines(docs).count() == len(rows()) and len(calls) == lines.BATCHES - 1 and min(calls) > 0


def test_line_query_is_its_sql(spark, tmp_path):
    import duckdb

    from plumbline.llm import registry

    data = [(k, f"own {k}\n{LONG}\n{LONG}") for k in range(4)] + [(3, LONG)] * 2 + [(None, LONG + "\nend")] * 2 + [(9, None), (9, "")]
    data += [(20 + k, f"x\n {LONG}, twice\t") for k in range(6)] + [(25, LONG.upper() + ", TWICE")] * 2
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(map(str, duck.sql(registry.ORACLE_SQL["op4_line_dedup"]).fetchall()))
    assert sorted(str(tuple(r)) for r in registry.QUERIES["op4_line_dedup"](spark, str(tmp_path)).collect()) == want


def test_quality(spark, none):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["the", "of", "rain", "falls", "on", "hills", "and"]) for _ in range(40))
    junk = lambda: " ".join(rng.choice(["$$$", "buy", "###", "now"]) for _ in range(40))
    data = [(k, good() if k % 2 else junk(), k % 2) for k in range(200)]
    docs = spark.createDataFrame([(k, t, "z") for k, t, _ in data] + [(None, None, "z"), (900, "", "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, q) for k, _, q in data] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    scored = {r.doc_id: r for r in quality.score(docs, *model).collect()}
    assert len(scored) == 202 and all(0 <= r.score <= 1 for r in scored.values())
    held = [k for k, _, _ in data if zlib.crc32(str(k).encode()) % 5 == 0]
    assert held and sum(scored[k].predicted == k % 2 for k in held) >= 0.95 * len(held)
    zero = quality.train(none, labels.limit(0))
    assert quality.score(none, *zero).count() == 0 and not zero[0].any()


def test_mixing(docs, none, spark):
    for weights in ([1.0], [5, 3, 1, 0.5], [1e-6, 1.0], [0.2] * 7, [1 / 3.0001, 0.123457, 0.777771]):
        slots, total = mixing.whole(weights), sum(Fraction(w) for w in weights)
        assert [Fraction(x, sum(slots)) for x in slots] == [Fraction(w) / total for w in weights]
        blocks = [int(w / sum(weights) * 2000) + 1 for w in weights]
        done = [0] * len(slots)
        for t, s, j in mixing.schedule(slots, blocks):
            assert j == done[s]
            done[s] += 1
            assert all(n == b or abs(n * sum(slots) - (t + 1) * w) < sum(slots) for n, b, w in zip(done, blocks, slots, strict=True))
        assert done == blocks
    for w in ([0.0, 1.0], [-1.0]):
        with pytest.raises(ValueError):
            mixing.whole(w)
    got = mixing.mix(docs, mixing.size_weights(docs), block_rows=4)
    found = got.collect()
    assert len(found) == len(rows()) and len({(r.mix_slot, r.mix_place) for r in found}) == len(found)
    by = {}
    for r in found:
        by.setdefault(r.mix_slot, set()).add((r.source, r.mix_block))
    assert all(len(x) == 1 for x in by.values())
    assert mixing.mix(none, mixing.size_weights(none)).count() == 0
    assert sorted(map(str, mixing.in_order(got).select(*docs.columns).collect())) == sorted(map(str, docs.collect()))


def on_time(got, exact, blocks):
    """No source is ever a block off its exact share, until it has run out. By hand over all slots, before and after each."""
    total, done = sum(exact.values()), dict.fromkeys(exact, 0)
    assert len({t for t, *_ in got}) == len(got)
    for t, s, j in sorted(got, key=lambda r: r[0]):
        w = exact[s] / total
        assert j == done[s] and abs(j - w * t) < 1 and abs(j + 1 - w * (t + 1)) < 1
        done[s] += 1
    assert done == blocks


def test_mixing_many_sources(spark):
    # 150 sources of 1 row, 100 of 4, one of 1600
    sizes = {**{f"a{k}": 1 for k in range(150)}, **{f"b{k}": 4 for k in range(100)}, "c": 1600}
    docs = spark.createDataFrame([(k, s) for s, n in sizes.items() for k in range(n)], "doc_id long, source string")
    got = [(r.mix_slot, r.source, r.mix_block) for r in mixing.mix(docs, mixing.size_weights(docs), block_rows=1).collect()]
    on_time(got, {s: Fraction(n**0.5) for s, n in sizes.items()}, sizes)
    # sources of equal size take turns
    even = spark.createDataFrame([(k, f"s{s}") for s in range(200) for k in range(3)], "doc_id long, source string")
    assert {(r.mix_slot // 200, r.mix_block) for r in mixing.mix(even, mixing.size_weights(even), block_rows=1).collect()} == {(0, 0), (1, 1), (2, 2)}
    # a list, with sources that it does not name and null, each a source of its own
    odd = spark.createDataFrame([(k, s) for s in ("x", "y", "z", None) for k in range(2)], "doc_id long, source string")
    assert {(r.mix_slot // 4, r.mix_block) for r in mixing.mix(odd, [("x", 1.0)], block_rows=1).collect()} == {(0, 0), (1, 1)}


def test_mixing_keeps_exact_weights(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 100)
    given = [(f"s{k}", w) for k, w in enumerate([17, 5, 3, 2.5, 0.1, 2**0.5, 1 / 3.0001, *[7] * 40, *[11] * 5])]
    rows = [(k, s) for s, w in given for k in range(int(w * 100))]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    got = [(r.mix_slot, r.source, r.mix_block) for r in mixing.mix(docs, given, block_rows=1).collect()]
    on_time(got, {s: Fraction(w) for s, w in given}, {s: int(w * 100) for s, w in given})


def test_mixing_awkward_weights_over_many_slots():
    weights = [1 / 3.0001, 0.123457, 0.777771]
    slots, total = mixing.whole(weights), sum(map(Fraction, weights))
    blocks = [int(120_000 * Fraction(w) / total) for w in weights]
    got = list(mixing.schedule(slots, blocks))
    assert len(got) == sum(blocks) > 119_990
    for t, s, j in got:
        assert abs(j * sum(slots) - slots[s] * t) < sum(slots) and abs((j + 1) * sum(slots) - slots[s] * (t + 1)) < sum(slots)


def test_mixing_three_hundred_thousand_sources(spark):
    # 270 000 sources of one row, 30 000 of three and one of a million
    docs = spark.range(1_360_000).select(F.when(F.col("id") < 270_000, F.concat(F.lit("a"), "id")).when(F.col("id") < 360_000, F.concat(F.lit("b"), F.col("id") % 30_000)).otherwise("c").alias("source"))
    got = mixing.mix(docs, mixing.size_weights(docs))
    total = 270_000 + 30_000 * 3**0.5 + 1000
    weight = F.when(F.startswith("source", F.lit("a")), 1.0).when(F.startswith("source", F.lit("b")), 3**0.5).otherwise(1000.0)
    off = F.abs(F.col("mix_block") - F.col("mix_slot") * weight / total)
    rows, slots, worst = got.agg(F.count("*"), F.countDistinct("mix_slot", "mix_place"), F.max(off)).first()
    assert rows == slots == 1_360_000 and worst < 1


def test_quality_against_plain_follow_the_leader(spark):
    """Features in dictionaries, one coordinate at a time, one example at a time."""
    rng = random.Random(12)
    data = [(k, " ".join(rng.choice("alpha Beta g4mma, d-e é the of a".split()) for _ in range(rng.randint(0, 25))), k % 2) for k in range(60)] + [(70, None, 1), (71, "", 0)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in data] + [(3, "zzz " * 9)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in data], "doc_id long, quality int")
    bits = 10
    weights, bias = quality.train(docs, labels, bits)

    def plain(text):
        w = [int(x) for x in quality.words((text or "").encode())[0]]
        low = (text or "").encode().lower().split()
        assert len(low) == len(w) and len(set(low)) == len(set(w))
        pair = lambda a, b: int(quality.pair(np.array([a], np.uint64), np.array([b], np.uint64))[0])
        shape = []
        for k, x in enumerate(low):
            same = next((back for back in (1, 2, 3) if k >= back and low[k - back] == x), 0)
            letters, digits = sum(c > 127 or chr(c).isalpha() for c in x), sum(chr(c) in "0123456789" for c in x)
            shape.append(int(quality.mix(np.array([same * 64 + min(3, len(x) - letters - digits) * 16 + min(1, digits) * 8 + min(7, len(x).bit_length()) + 1_000_003], np.uint64))[0]))
        two = lambda s: [pair(a, b) for a, b in zip(s, s[1:])]  # noqa: B905, E731
        out = {}
        for sort in (w, two(w), shape, two(shape), [pair(a, b) for a, b in zip(two(shape), shape[2:])]):  # noqa: B905
            for x in sort:
                out[x >> (64 - bits)] = out.get(x >> (64 - bits), 0) + 1 / len(sort)
        return {k: v**0.5 for k, v in out.items()}

    order = {(r.doc_id, r.quality): r.o for r in labels.select("doc_id", "quality", F.xxhash64("doc_id", "quality").alias("o")).collect()}
    chosen = {k: t for k, t, _ in data}
    as_bytes = lambda f: np.array(sorted(f), np.int32).tobytes()
    chosen[3] = min(chosen[3], "zzz " * 9, key=lambda t: as_bytes(plain(t)))
    examples = sorted((order[k, y], y, k) for k, _, y in data if zlib.crc32(str(k).encode()) % 5)
    z, n, b, bn = {}, {}, 0.0, 0.0
    weight = lambda k: 0.0 if abs(z.get(k, 0)) <= quality.L1 else -(z[k] - (quality.L1 if z[k] > 0 else -quality.L1)) / ((quality.BETA + n[k] ** 0.5) / quality.ALPHA + quality.L2)
    for _ in range(quality.PASSES):
        for _, y, k in examples:
            x = {p: float(np.float32(v)) for p, v in plain(chosen[k]).items()}
            g0 = 1 / (1 + np.exp(-(sum(weight(p) * v for p, v in x.items()) + b))) - y
            for p, v in x.items():
                w, old, g = weight(p), n.get(p, 0.0), g0 * v
                z[p] = z.get(p, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / quality.ALPHA * w
                n[p] = old + g * g
            bn += g0 * g0
            b -= quality.ALPHA * g0 / (quality.BETA + bn**0.5)
    assert np.allclose(weights, [weight(k) for k in range(1 << bits)], atol=1e-5) and abs(bias - b) < 1e-6
    got = {(r.doc_id, r.text): r.score for r in quality.score(docs, weights, bias).collect()}
    assert len(got) == len(data) + 1
    for (_, t), x in got.items():
        assert abs(x - 1 / (1 + np.exp(-(sum(weights[p] * v for p, v in plain(t).items()) + bias)))) < 1e-6
    # a bound on features takes whole examples in the order of their hashes; none fits into nothing
    assert not quality.train(docs, labels, bits, max_features=0)[0].any()
    first = next(k for _, _, k in examples)
    one = quality.train(docs, labels, bits, max_features=len(plain(chosen[first])))
    alone = quality.train(docs, labels.where(F.col("doc_id") == first), bits)
    assert np.array_equal(one[0], alone[0]) and one[1] == alone[1]


def test_url_trees_against_plain(spark):
    """Rules by prefixes, features by counting, trees by walking; and held-out URLs."""
    import json
    import math
    from collections import Counter

    rng = random.Random(5)
    hosts = ["a.com", "b.example.com", "c.net", "x.example.net", "d.org", "e.io", "Sub.F.io"]
    data = [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'es'])}/{rng.choice(['7', '8', ''])}{rng.randint(0, 999)}{rng.choice(['', '?q=1&r=2', '#x', '/deep/é'])}" for _ in range(900)]
    data += ["", "none", "http://" + "9" * 5000 + ".io/en/", None]
    pages = spark.createDataFrame(list(enumerate(data)), "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    host, path = urls.parts(F.col("url"))
    rule, verdict = urls.ruled(host, path, urls.RULES)
    labelled = pages.select("url", host.alias("host"), path.alias("path"), (verdict == "block").alias("bad")).where(rule.isNotNull())
    model = json.loads(json.dumps(urls.train(labelled)))

    def plain(url):
        url = url or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        rest = rest.split("#")[0] if "?" not in rest.split("#")[0] else rest.split("?")[0]
        host, slash, path = rest.partition("/")
        host, path = host.lower(), slash + path
        fits = [(len(h + p), h + p, what) for what, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            return host, path, *max(fits)[1:]
        data, size = url.encode(), max(1, len(url))
        entropy = -sum(n / len(data) * math.log2(n / len(data)) for n in Counter(data).values())
        x = [len(url), len(host), len(path), path.count("/"), sum(c.isdigit() for c in url) / size, sum(not c.isalnum() for c in url) / size, entropy, url[url.find("?") :].count("=") if "?" in url else 0, host.count(".")]
        x.append(model["rates"].get(host.split(".")[-1], model["rate"]))
        f = model["base"]
        for tree in model["trees"]:
            while "v" not in tree:
                tree = tree["l"] if x[tree["j"]] <= tree["t"] else tree["r"]
            f += tree["v"]
        return host, path, None, "block" if f >= 0 else "allow"

    assert model["trees"]
    for k, url in enumerate(data):
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == plain(url), url
    # labels that hang on what a URL looks like: trees that learn from four fifths judge the rest
    looks = [f"http://h{rng.choice(['', '1', '22333'])}.io/{'x' * rng.randint(0, 9)}{rng.randint(0, 10 ** rng.randint(0, 9))}{rng.choice(['', '?a=1', '?a=1&b=2&c=3'])}" for _ in range(1500)]
    bad = lambda u: (sum(c.isdigit() for c in u) > 9) != (u.count("=") > 1)
    rows = spark.createDataFrame([(u, bad(u)) for u in sorted(set(looks))], "url string, bad boolean")
    rows = rows.select("url", host.alias("host"), path.alias("path"), "bad", (F.crc32(F.col("url").cast("binary")) % 5 == 0).alias("out"))
    model = urls.train(rows.where("NOT out").drop("out"))
    held = rows.where("out").toPandas()
    x = urls._with_suffix(urls.lexical(held.url.tolist(), held.host.tolist(), held.path.tolist()), held.host.tolist(), model["rates"], model["rate"])
    assert len(held) > 100 and ((urls.Trees(model).probability(x) >= 0.5) == held.bad).mean() > 0.9


def test_urls(spark):
    bad = ["http://a.com/en/1", "http://COM/en/", "https://x.example.com/en/72", "http://example.net/de/81?x", "http://b.net/de/8", "http://xcom/en/1", None, "no host", "", "ftp://a.org/es/#y", "http://a.org?/es/"]
    pages = spark.createDataFrame([(k, u, "old") for k, u in enumerate(bad)] + [(50, bad[0], "old")], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages).collect()}
    assert got[0] == ("a.com", "/en/1", "com/en/", "block") and got[1] == ("com", "/en/", "com/en/", "block")
    assert got[2] == ("x.example.com", "/en/72", "example.com/en/7", "allow") and got[3][2:] == ("example.net/de/8", "block") and got[4][2:] == ("net/de/", "allow")
    assert got[5][2] is None and got[6][:3] == ("", "", None) and got[7][:2] == ("", "") and got[9][2:] == ("org/es/", "block") and got[10][:2] == ("a.org", "")
    assert {x[3] for x in got.values()} <= {"allow", "block"}
    assert urls.judge(pages.limit(0)).count() == 0
    x = np.random.default_rng(0).normal(size=(600, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = urls.Trees.fit(x[:400], y[:400])
    assert ((model.probability(x[400:]) > 0.5) == y[400:]).mean() > 0.9


def test_licenses(spark, none):
    mit = licenses.TEMPLATES["MIT"]
    changed = " ".join(w for k, w in enumerate(mit.split()) if k % 15)
    docs = spark.createDataFrame([(1, "éé intro " + mit + " end"), (2, changed), (3, mit[: len(mit) // 3]), (4, None), (5, ""), (6, "x released UNDER the mit   license! y " * 2), (6, "")], "doc_id long, text string")
    got = {}
    for r in licenses.scan(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [(r.license, r.coverage) for r in got[1]] == [("MIT", 1.0)] and ("éé intro " + mit)[got[1][0].start : got[1][0].end + 1] == mit
    assert got[2][0].license == "MIT" and 0.9 < got[2][0].coverage < 1 and 3 not in got and set(got) == {1, 2, 6}
    assert sorted((r.license, r.start) for r in got[6]) == [("MIT-statement", 2), ("MIT-statement", 40)]
    assert licenses.scan(none).count() == 0
    h = np.array([5, 3, 9, 3, 8, 7], np.uint64)
    assert licenses.winnowed(h, 3).tolist() == [1, 3, 3][:1] + [3] + ([5] if min(h[3:6]) != 3 else [])


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    data = [(k, " ".join(rng.choice(["the", "of", "rain", "falls", "on", "hills", "and", "wind"]) for _ in range(60)) if k % 5 else "$$$ ### " * 30, "en", f"s{k % 3}", 1) for k in range(400)]
    data += [(500 + k, data[1][1], "en", "s1", 1) for k in range(5)] + [(600, None, None, None, None)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 5 > 0), 0) for k in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    ids = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # the copies' one line stays in the largest id only; the emptied ones are one class with the null text
    assert 1 in ids and ids & {500, 501, 502, 503, 504} == {504} and not ids & {k for k in range(0, 400, 5)}


def test_pipeline_packs_in_mixed_order(spark, tmp_path):
    import corpus_pipeline

    data = [(k, f"text {k}", "en", f"s{k % 3}", 5) for k in range(300)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    got = {}
    for name, frame in (("up", docs.orderBy("doc_id")), ("down", docs.orderBy(F.desc("doc_id")))):
        frame.repartitionByRange(4, "doc_id" if name == "up" else F.desc("doc_id")).sortWithinPartitions("doc_id" if name == "up" else F.desc("doc_id")).write.parquet(f"{tmp_path}/{name}")
        rows = corpus_pipeline.packed(spark, spark.read.parquet(f"{tmp_path}/{name}"), str(tmp_path)).orderBy("sequence_id", "offset").collect()
        assert sorted(r.doc_id for r in rows) == list(range(300))
        # equal lengths come in the order of the files
        by = {}
        for r in rows:
            by.setdefault(r.length, []).append(r.doc_id)
        assert all(x == sorted(x, reverse=name == "down") for x in by.values())
        got[name] = [r.doc_id for r in rows]
    assert got["up"] != got["down"]
    assert corpus_pipeline.packed(spark, docs, str(tmp_path)).count() == 300


def test_clashing_names(spark):
    names = ["mix_slot", "_h", "_rank", "_source", "_name", "_length", "row", "whole", "_r1", "_null", "n_lines", "_text", "rank", "key", "file", "_0"]
    columns = ", ".join(f"`{n}` long" for n in names)
    docs = spark.createDataFrame([(k, f"text {k % 2}", "en", f"s{k % 2}", 5, *[k] * len(names)) for k in range(6)], f"doc_id long, text string, lang string, source string, n_chars long, {columns}")
    mixed = mixing.mix(docs, mixing.size_weights(docs))
    assert mixed.count() == 6 and len(set(mixed.columns)) == len(mixed.columns)
    packed = packing.pack(docs.withColumn("length", F.lit(2000).cast("long")).withColumn("offset", F.lit("x")))
    assert packed.columns[-2:] == ["sequence_id", "offset"] and packed.columns.count("offset") == 1
    for n in names:
        assert sorted(r[0] for r in packed.select(n).collect()) == list(range(6))
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns and sorted(kept.select(*names).distinct().collect()) == [(k,) * len(names) for k in (0, 1)]
    assert lines.drop_shared_lines(docs).select("_h").count() == 6


def test_short_licences_against_every_diagonal(spark):
    rng = random.Random(6)
    short = {n: t for n, t in licenses.TEMPLATES.items() if n.endswith("statement")}
    data = []
    for name, text in short.items():
        w = text.split()
        data += [f"x y {' '.join(w[:k] + w[k + 1 :])} z" for k in range(len(w))] + [f"x {' '.join(w[:k] + ['an'] + w[k + 1 :])} z" for k in range(len(w))]
    data += [" ".join(rng.choice("released under the mit license licensed apache version work is a of".split()) for _ in range(30)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    got = {(r.doc_id, r.license) for r in licenses.scan(docs, short).collect()}
    index, missed, want = licenses.Index(short), set(), set()
    for d, text in enumerate(data):
        w = licenses.words(text.encode(), licenses.PUNCTUATION)[0]
        for k, name in enumerate(short):
            own = index.band(k, licenses.BAND)
            best = max(licenses.align(index.words[k], w, at, own)[0] for at in range(-len(index.words[k]), len(w)))
            if best >= licenses.COVERAGE * len(index.words[k]):
                want.add((d, name))
    changed = {x for x in want if x[0] < len(data) - 40}
    assert got <= want and changed <= got
    assert len(want & got) >= 0.9 * len(want)


def test_odd_bytes(spark):
    docs = spark.sql("SELECT 1L AS doc_id, string(unhex('61FF20FE0A62')) AS text, 'a' AS source")
    assert packing.token_pieces(docs, packing.tokenizer_path()).count() == 1
    assert [r.n for r in lines.drop_shared_lines(docs).select(F.hex("kept_text").alias("n")).collect()] == ["61FF20FE0A62"]
    assert simhash.near_duplicates(docs).count() == 1 and licenses.scan(docs).count() == 0
    pages = spark.sql("SELECT 1L AS page_id, string(unhex('687474703A2F2F61FF2E636F6D2F656E2F')) AS url UNION ALL SELECT 2L, string(unhex('FF3A2F2F622E696F2FFE'))")
    got = {r.page_id: (r.h, r.rule, r.verdict) for r in urls.judge(pages).select("page_id", F.hex("host").alias("h"), "rule", "verdict").collect()}
    assert got[1] == ("61EFBFBD2E636F6D", "com/en/", "block") and got[2][:2] == ("622E696F", None)


def test_every_suffix_has_its_rate(spark):
    """More suffixes than any cap on them, each with labels of its own."""
    rows = spark.range(4800).select(F.concat(F.lit("http://h.s"), F.col("id") % 800, F.lit("/x")).alias("url"), F.concat(F.lit("h.s"), F.col("id") % 800).alias("host"), F.lit("/x").alias("path"), (F.col("id") % 800 % 2 == 0).alias("bad"))
    rates = urls.train(rows)["rates"]
    assert len(rates) == 800 and all((rates[f"s{k}"] > 0.5) == (k % 2 == 0) for k in range(800))
