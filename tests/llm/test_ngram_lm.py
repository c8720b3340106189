"""Stupid backoff against counts in dictionaries."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import ngram_lm, registry

SCHEMA = "doc_id long, text string, h long, part int, key string"


def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 2)))
    out = [(k, " ".join(word() for _ in range(rng.randint(1, 40)))) for k in range(90)]
    out += [(100 + k, "One two\tthree four five six") for k in range(7)]
    out += [(100, "one two three four five six")] * 2 + [(None, None), (None, "one two"), (8, ""), (9, " \n"), (10, "word " * 9000)]
    return [(d, t, 1, 2, "x") for d, t in out]


def brute(docs, order, corpus=None, backoff=0.4):
    """log scores of the texts of ``docs`` under those of ``corpus``, or each word under all other words of ``docs``."""
    split = lambda x: [(t or "").encode().lower().split() for t in x]
    grams = lambda w: Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    rows, every = split(docs), split(docs if corpus is None else corpus)
    known, off = sum((grams(w) for w in every), Counter()), int(corpus is None)
    total = max(1, sum(map(len, every)) - off)
    c = lambda g: known[g] - off
    out = []
    for w in rows:
        score = 0.0
        for i in range(len(w)):
            n = min(i + 1, order)
            while n and c(tuple(w[i - n + 1 : i + 1])) <= 0:
                score, n = score + math.log(backoff), n - 1
            g = tuple(w[i - n + 1 : i + 1])
            score += math.log(c(g) / (c(g[:-1]) if n > 1 else total)) if n else -math.log(total)
        out.append((len(w), score))
    return out


def same(got, docs, want):
    key = lambda x: (x[0] if x[0] is not None else -1, x[1], round(x[2], 2))
    a = sorted(key((r.doc_id, r.n_words, r.log_score)) for r in got)
    b = sorted(key((d, n, float(x))) for d, (n, x) in zip(docs, want, strict=True))
    assert [x[:2] for x in a] == [x[:2] for x in b] and np.allclose([x[2] for x in a], [x[2] for x in b], atol=0.011)


@pytest.mark.parametrize(("order", "hot"), [(1, 1 << 17), (3, 1), (3, 30), (4, 1 << 40)])
def test_left_out(spark, order, hot):
    rows = texts()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    same(ngram_lm.backoff_scores(docs, order, hot=hot).collect(), [r[0] for r in rows], brute([r[1] for r in rows], order))


def test_other_corpus(spark):
    rows, other = texts(), ["one two three", "a b a b é", None, "", "word word"]
    corpus = spark.createDataFrame([(t,) for t in other], "text string")
    docs = spark.createDataFrame(rows, SCHEMA)
    same(ngram_lm.backoff_scores(docs, 3, corpus=corpus).collect(), [r[0] for r in rows], brute([r[1] for r in rows], 3, other))


def test_empty_and_alone(spark):
    docs = spark.createDataFrame(texts(), SCHEMA)
    assert ngram_lm.backoff_scores(docs.limit(0)).count() == 0
    same(ngram_lm.backoff_scores(spark.createDataFrame([(1, "a b a")], "doc_id long, text string")).collect(), [1], brute(["a b a"], 3))


def test_repartitioned_files_and_odd_bytes(spark, tmp_path):
    spark.createDataFrame(texts(), SCHEMA).union(spark.sql("SELECT 70L, string(unhex('61FF20FE')), 1L, 2, 'x'")).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    key = lambda df: sorted(map(str, df.select("doc_id", "n_words", F.round("log_score", 3)).collect()))
    assert key(ngram_lm.backoff_scores(docs)) == key(ngram_lm.backoff_scores(docs.repartition(5)))


def test_query_is_its_sql(spark, tmp_path):
    import duckdb

    data = ["a b a c a b d", "a c a b a b d", "a b a c a b d", "", None, "A\tx y", "a b d"]
    spark.createDataFrame(list(enumerate(data)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.log_score, r.word_score) for r in registry.QUERIES["op10_lm_scoring"](spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert {r[0]: r[1:] for r in duck.sql(registry.ORACLE_SQL["op10_lm_scoring"]).fetchall()} == {k: (n, pytest.approx(x, abs=1e-3), pytest.approx(m, abs=1e-5)) for k, (n, x, m) in got.items()}
    assert got[0][1] == got[2][1] > got[1][1]


def test_hashes_are_the_functions(spark):
    x = np.array([0, 1, 2**63, 2**64 - 1], np.uint64)
    rows = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "a long").select(F.xxhash64("a", F.lit(5).cast("long"))).collect()
    assert [r[0] for r in rows] == ngram_lm.xxhash64([x, np.full(4, 5, np.uint64)]).view(np.int64).tolist()


def test_lists_travel_packed(spark, monkeypatch):
    """No table has a row for each n-gram, and the driver gathers no n-grams: a group has a row for each partition at most."""
    rng, tables, write = random.Random(5), [], ngram_lm.written
    data = [(k, " ".join(str(rng.randint(0, 4000)) for _ in range(4000))) for k in range(8)]
    docs = spark.createDataFrame(data, "doc_id long, text string").coalesce(2)
    monkeypatch.setattr(ngram_lm, "written", lambda df, name, *by: tables.append((name, write(df, name, *by))) or tables[-1][1])
    monkeypatch.setattr(ngram_lm, "dropped", lambda df: None)
    monkeypatch.setattr(type(docs), "toPandas", None)
    got = ngram_lm.backoff_scores(docs).collect()
    same(got, range(8), brute([t for _, t in data], 3))
    assert max(df.count() for _, df in tables) <= 2 * 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
