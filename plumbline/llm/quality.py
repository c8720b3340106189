"""Quality scores by logistic regression on hashed word n-grams.

Features of a text are its words, pairs of words and the same n-grams over the words' shapes (length, signs,
digits, same as one of the last three words), hashed to a fixed number of places; a feature's value is its
share of the text's n-grams of that sort, under a square root. Training follows the regularised leader, one
example at a time, on a bounded sample of labelled rows; scoring is a sparse dot product with the weights.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ._words import mix, pair, texts, words

#: Places of the hash, labelled rows that training takes at most, features that these have together at most, passes over them.
BITS, MAX_TRAINING_ROWS, MAX_TRAINING_FEATURES, PASSES = 18, 6_000, 1 << 25, 5
#: Rates and penalties of follow-the-regularised-leader.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
THRESHOLD = 0.3

_LETTER = np.zeros(256, dtype=np.int64)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_DIGIT = np.zeros(256, dtype=np.int64)
_DIGIT[48:58] = 1


def _shapes(text: bytes, h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    data = np.frombuffer(text, dtype=np.uint8)
    letters, digits = (np.append(0, np.cumsum(t[data])) for t in (_LETTER, _DIGIT))
    size = last - first
    a, d = letters[last] - letters[first], digits[last] - digits[first]
    signs = size - a - d
    same = np.zeros(len(h), dtype=np.int64)
    for back in (3, 2, 1):
        same[back:][h[back:] == h[:-back]] = back
    code = same * 64 + np.minimum(signs, 3) * 16 + np.minimum(d, 1) * 8 + np.minimum(np.frexp(size.astype(np.float64))[1], 7)
    return mix(code.astype(np.uint64) + np.uint64(1_000_003))


def features(text: bytes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of one text, places ascending and distinct; none for a text without words."""
    h, first, last = words(text)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0)
    s = _shapes(text, h, first, last)
    sorts = [h, pair(h[:-1], h[1:]), s, pair(s[:-1], s[1:]), pair(pair(s[:-2], s[1:-1]), s[2:])]
    sorts = [x for x in sorts if len(x)]
    at = np.concatenate([x >> np.uint64(64 - bits) for x in sorts]).astype(np.int64)
    share = np.concatenate([np.full(len(x), 1 / len(x)) for x in sorts])
    if len(at) > 1 << (bits - 2):
        total = np.bincount(at, share, 1 << bits)
        at = np.flatnonzero(total)
        return at, np.sqrt(total[at])
    each, back = np.unique(at, return_inverse=True)
    return each, np.sqrt(np.bincount(back, share))


class Leader:
    """Logistic regression by follow-the-regularised-leader, per coordinate; the bias has no penalty."""

    def __init__(self, bits: int = BITS):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.bias = self.bias_n = 0.0

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g0 = _logistic(float(w @ x) + self.bias) - y
        g = g0 * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g
        self.bias_n += g0 * g0
        self.bias -= ALPHA * g0 / (BETA + self.bias_n**0.5)


def _logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


def held_out(id_col: str):
    """Whether a row takes no part in training: crc32 of the id as text is divisible by 5. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, bits: int = BITS, max_rows: int = MAX_TRAINING_ROWS, max_features: int = MAX_TRAINING_FEATURES) -> tuple[np.ndarray, float]:
    """(weights, bias) from the rows of ``labels`` (doc_id, quality 0 or 1) that aren't held out.

    The ``max_rows`` of smallest hash are taken, whatever the table's size; their features, not their texts,
    meet in one task, in the order of the hashes as long as they are at most ``max_features`` together. A label teaches
    once: of several documents of its id, one is taken, the one whose features' bytes are the smallest. Rows without a label, an id or a document teach nothing. Without any, all is zero.
    """
    sample = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .select(F.col("doc_id").cast("long").alias("key"), F.col("quality").cast("int").alias("y"), F.xxhash64("doc_id", "quality").alias("order"))
        .distinct().orderBy("order", "key", "y").limit(max_rows)
    )
    found = docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("binary").alias("text")).join(F.broadcast(sample), "key").select("order", "y", "text")  # at most max_rows

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(x, bits) for x in texts(batch.column(2))]
            at = pa.array([a.astype(np.int32).tobytes() for a, _ in got], pa.binary())
            x = pa.array([v.astype(np.float32).tobytes() for _, v in got], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), at, x], names=["order", "y", "at", "x"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(o, y, np.frombuffer(a, np.int32), np.frombuffer(x, np.float32).astype(np.float64)) for b in batches for o, y, a, x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        rows.sort(key=lambda r: (r[0], r[1], r[2].tobytes()))
        model = Leader(bits)
        for _ in range(PASSES):
            for _, y, at, x in rows:
                model.learn(at, x, y)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype(np.float32).tobytes()], pa.binary()), pa.array([model.bias])], names=["w", "bias"])

    examples = found.mapInArrow(extract, "order long, y int, at binary, x binary").groupBy("order", "y").agg(F.min(F.struct("at", "x")).alias("f")).select("order", "y", "f.*")
    so_far = F.sum(F.octet_length("at") / 4).over(Window.orderBy("order", "y").rowsBetween(Window.unboundedPreceding, 0))  # max_rows rows at most
    row = examples.withColumn("so_far", so_far).where(F.col("so_far") <= max_features).drop("so_far").repartition(1).mapInArrow(fit, "w binary, bias double").first()
    return (np.frombuffer(row["w"], np.float32), row["bias"]) if row else (np.zeros(1 << bits, np.float32), 0.0)


def score(docs: DataFrame, weights: np.ndarray, bias: float, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``. Every other column is kept; columns of these names are replaced.

    Scores depend on the text alone, taken whole; a null text scores as an empty one, which has the bias
    only. The weights have a fixed size, whatever the input.
    """
    bits = len(weights).bit_length() - 1
    weights = weights.astype(np.float64)
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    kind = StructType([*(docs.schema[c] for c in names), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_logistic(float(weights[at] @ x) + bias) for at, x in (features(t, bits) for t in texts(batch.column(0)))]
            yield pa.RecordBatch.from_arrays([*batch.column(1).flatten(), pa.array(got, pa.float64())], names=[*names, "score"])

    scored = docs.select(F.col(text_col).cast("binary").alias("_text"), F.struct(*names).alias("_row")).mapInArrow(run, kind)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by a classifier of ``labels.quality``."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    own = docs.select("doc_id", "text")
    scored = score(own, *train(own, labels.select("doc_id", "quality")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
