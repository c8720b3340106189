"""URL filter: listed rules first, then gradient-boosted trees on what a URL looks like.

The trees learn from labelled URLs, which are those that the rules decide: a bounded sample of them. Features are
lengths, depth, shares of digits and signs, entropy, numbers of parameters and labels, and statistics of the
host's suffix. Training takes place in one task on the sample; every URL is then judged where it lies.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: (verdict, host, path) of the contract.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Labelled URLs that training takes at most, trees, depth, bins, rate, penalty.
MAX_TRAINING_ROWS, TREES, DEPTH, BINS, RATE, PENALTY = 20_000, 40, 3, 32, 0.2, 1.0
#: Parts of the training rows; a row's suffix rate comes from the other parts.
FOLDS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for a null or one without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does; of equally long ones the first."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def lexical(urls: list[str | None], hosts: list[str], paths: list[str]) -> np.ndarray:
    """One row of features for each URL; a null counts as empty."""
    out = np.zeros((len(urls), 9))
    for k, (url, host, path) in enumerate(zip(urls, hosts, paths, strict=True)):
        url = url or ""
        n = max(1, len(url))
        _, counts = np.unique(np.frombuffer(url.encode(), np.uint8), return_counts=True)
        share = counts / max(1, counts.sum())
        out[k] = len(url), len(host), len(path), path.count("/"), sum(map(str.isdigit, url)) / n, sum(not c.isalnum() for c in url) / n, -(share * np.log2(share)).sum(), url.partition("?")[2].count("="), host.count(".")
    return out


def suffix(host: str) -> str:
    return host.rpartition(".")[2]


class Trees:
    """Gradient-boosted trees for logistic loss, over quantile bins."""

    def __init__(self, model: dict):
        self.model = model

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray) -> Trees:
        rate = (y.sum() + 1) / (len(y) + 2)
        base = float(np.log(rate / (1 - rate)))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T] if len(x) else []
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1) if len(x) else x
        f, trees = np.full(len(y), base), []
        for _ in range(TREES if 0 < y.sum() < len(y) else 0):
            p = 1 / (1 + np.exp(-f))
            tree = Trees._grow(binned, edges, y - p, p * (1 - p), np.arange(len(y)), DEPTH)
            trees.append(tree)
            f += Trees._walk(tree, x)
        return Trees({"base": base, "trees": trees})

    @staticmethod
    def _grow(binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int) -> dict:
        gs, hs = g[rows].sum(), h[rows].sum()
        best = None
        for j, e in enumerate(edges if depth and len(rows) > 20 else []):
            gl = np.cumsum(np.bincount(binned[rows, j], g[rows], len(e) + 1))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, j], h[rows], len(e) + 1))[:-1]
            gain = gl**2 / (hl + PENALTY) + (gs - gl) ** 2 / (hs - hl + PENALTY) - gs**2 / (hs + PENALTY)
            if len(gain) and (k := int(np.argmax(gain))) >= 0 and gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                best = gain[k], j, k
        if best is None:
            return {"v": float(RATE * gs / (hs + PENALTY))}
        _, j, k = best
        left = binned[rows, j] <= k
        return {"j": j, "t": float(edges[j][k]), "l": Trees._grow(binned, edges, g, h, rows[left], depth - 1), "r": Trees._grow(binned, edges, g, h, rows[~left], depth - 1)}

    @staticmethod
    def _walk(tree: dict, x: np.ndarray) -> np.ndarray:
        if "v" in tree:
            return np.full(len(x), tree["v"])
        return np.where(x[:, tree["j"]] <= tree["t"], Trees._walk(tree["l"], x), Trees._walk(tree["r"], x))

    def probability(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.model["base"])
        for tree in self.model["trees"]:
            f += Trees._walk(tree, x)
        return 1 / (1 + np.exp(-f))


def suffix_rates(hosts: list[str], y: np.ndarray, base: float) -> dict[str, float]:
    """The rate of bad rows of every suffix, drawn towards ``base`` as by ten more rows."""
    each = pd.DataFrame({"s": [suffix(h) for h in hosts], "y": y}).groupby("s")["y"].agg(["sum", "count"])
    return ((each["sum"] + 10 * base) / (each["count"] + 10)).to_dict()


def _with_suffix(x: np.ndarray, hosts: list[str], rates: dict[str, float], base: float) -> np.ndarray:
    return np.column_stack([x, [rates.get(suffix(h), base) for h in hosts]])


def train(labelled: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> dict:
    """A model from (url, host, path, bad) rows: the ``max_rows`` of smallest hash. Without rows, or of one sort only, it gives their rate.

    Bytes that aren't UTF-8 count as U+FFFD.
    """

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        urls, hosts, paths, y = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [], [])
        y = np.array(y, dtype=np.float64)
        base = (y.sum() + 1) / (len(y) + 2)
        fold = np.arange(len(y)) % FOLDS
        x, own = lexical(urls, hosts, paths), np.full(len(y), base)
        for k in range(FOLDS):  # a row's own label has no part in its suffix's rate
            others, mine = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            known = suffix_rates([hosts[n] for n in others], y[others], base)
            own[mine] = [known.get(suffix(hosts[n]), base) for n in mine]
        rates = suffix_rates(hosts, y, base)
        model = Trees.fit(np.column_stack([x, own]), y).model
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(model | {"rates": rates, "rate": float(base)})])], names=["model"])

    sample = labelled.orderBy(F.xxhash64("url"), "url").limit(max_rows).repartition(1)
    row = sample.select(*(F.make_valid_utf8(c).alias(c) for c in ("url", "host", "path")), F.col("bad").cast("int").alias("bad")).mapInArrow(fit, "model string").first()
    return json.loads(row["model"]) if row else {"base": 0.0, "trees": [], "rates": {}, "rate": 0.5}


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, max_rows: int = MAX_TRAINING_ROWS, url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """``pages`` with host, path, rule and verdict; columns of ``pages`` of these names are replaced.

    A rule's verdict holds where one fits; else the trees block at a probability of ``threshold`` or more. A
    null or malformed URL has empty parts and is judged by the trees as an empty one. Bytes that aren't UTF-8 count as U+FFFD, in host
    and path too. Rows are kept as they are.
    """
    host, path = parts(F.col(url_col))
    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    found = pages.select(*rest, host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    found = found.withColumn("rule", rule).withColumn("verdict", verdict)
    labelled = found.where(F.col("verdict").isNotNull()).select(F.col(url_col).alias("url"), "host", "path", (F.col("verdict") == "block").alias("bad"))
    model = train(labelled, max_rows)
    trees, rates, base = Trees({"base": model["base"], "trees": model["trees"]}), model["rates"], model["rate"]

    @F.pandas_udf("double")
    def bad(open_: pd.Series, url: pd.Series, host: pd.Series, path: pd.Series) -> pd.Series:
        out, open_ = np.zeros(len(url)), open_.to_numpy(dtype=bool)
        hosts = host[open_].tolist()
        x = lexical([u if isinstance(u, str) else None for u in url[open_]], hosts, path[open_].tolist())
        out[open_] = trees.probability(_with_suffix(x, hosts, rates, base))
        return pd.Series(out)

    valid = [F.make_valid_utf8(c) for c in (F.col(url_col), F.col("host"), F.col("path"))]
    unruled = F.when(bad(F.col("verdict").isNull(), *valid) >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return found.withColumn("verdict", F.coalesce("verdict", unruled))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")
