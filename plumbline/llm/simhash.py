"""Near duplicates by SimHash.

Fingerprints link at a few differing bits. Links are found among distinct fingerprints only, copies share
one. Distribution: of ``d + 1`` blocks of bits, two fingerprints within ``d`` bits agree on one, so rows are
dealt out by (block, its bits). A bucket that is too large for one task is dealt out again by the bits that
its fingerprints don't yet share, which is exact at each level and ends as the bits run out.

Within a bucket: fingerprints in the order of their Gray rank; runs that share the leading bits of the rank
share those bits of the fingerprint, so nodes of the index are runs, and a node's pattern is the bits under
its level's mask. A search takes all nodes against each other level by level, adds up the differing bits of
each level's mask and drops pairs of whole groups once the sum passes the limit. Only a spanning forest of
the links found leaves a task, one link for each fingerprint at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..shared import written
from ._components import components
from ._words import mix, pair, texts

DISTANCE, SHINGLE, SEED = 3, 3, 42
#: Fingerprints that a task takes together.
BUCKET = 8_192
#: Leading bits of the Gray rank at each level of the index.
LEVELS = (8, 16, 24, 32, 40, 48, 64)


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of one text's word shingles; zero without a word. Works on 65536 words at a time."""
    found = text.lower().split()  # of bytes: A-Z, and white space \x20 \x09-\x0D
    if not found:
        return 0
    if len(found) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(found), seed)
    ones, total = np.zeros(64, np.int64), len(found) - shingle + 1
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, 65_536):
        part = found[at : at + 65_536 + shingle - 1]
        if shingle == 3:
            h = [digest(b"%b %b %b" % x, seed) for x in zip(part, part[1:], part[2:])]
        else:
            h = [digest(b" ".join(part[i : i + shingle]), seed) for i in range(len(part) - shingle + 1)]
        ones += np.unpackbits(np.array(h, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, text_col: str = "text") -> DataFrame:
    """Adds ``fp`` (long, the fingerprint's bits) to ``docs`` and drops the text."""
    keep = [c for c in docs.columns if c != text_col]
    kind = docs.select(*keep).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.fromiter((fingerprint(x, shingle, seed) for x in texts(batch.column(0))), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(bits.view(np.int64))], names=[*keep, "fp"])

    return docs.select(F.col(text_col).cast("binary").alias("_text"), *keep).mapInArrow(run, kind)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The number whose Gray code is x."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def _crossed(sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of groups all (pair, place in a, place in b)."""
    n = sizes_a * sizes_b
    pair = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
    return pair, k // sizes_b[pair], k % sizes_b[pair]


class GrayIndex:
    """Distinct (bucket, fingerprint) rows, searched for pairs of a bucket within ``distance`` bits."""

    #: Pairs of nodes held at a time.
    STEP = 1 << 19

    def __init__(self, buckets: np.ndarray, fps: np.ndarray, distance: int):
        rank = gray_rank(fps)
        self.order = np.lexsort((rank, buckets))
        self.fps, rank, self.distance = fps[self.order], rank[self.order], distance
        new = np.append(True, buckets[self.order][1:] != buckets[self.order][:-1]) if len(fps) else np.zeros(0, bool)
        self.starts, self.masks = [np.flatnonzero(new)], [np.uint64(0)]
        for bits in LEVELS:
            lead = rank >> np.uint64(64 - bits)
            new = new | np.append(True, lead[1:] != lead[:-1]) if len(fps) else new
            self.starts.append(np.flatnonzero(new))
            self.masks.append(np.uint64((1 << 64) - (1 << (64 - bits))))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places, by the caller's order, of pairs within the distance; a pair comes once."""
        roots = np.arange(len(self.starts[0]))
        for a in range(0, len(roots), 4096):
            yield from self._below(0, roots[a : a + 4096], roots[a : a + 4096], np.zeros(len(roots[a : a + 4096]), np.uint8))

    def _below(self, level: int, a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if level == len(LEVELS):
            one, two = self.starts[level][a], self.starts[level][b]
            yield self.order[one[one != two]], self.order[two[one != two]]
            return
        up, down = self.starts[level], self.starts[level + 1]
        kids = np.searchsorted(down, np.append(up, len(self.fps)))
        sizes = kids[1:] - kids[:-1]
        work = np.cumsum(sizes[a].astype(np.int64) * sizes[b])
        at = 0
        while at < len(a):
            end = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + self.STEP, side="right")))
            pair, i, j = _crossed(sizes[a[at:end]], sizes[b[at:end]])
            x, y, sofar = kids[a[at:end]][pair] + i, kids[b[at:end]][pair] + j, apart[at:end][pair]
            mine = self.masks[level + 1] & ~self.masks[level]
            sofar = sofar + np.bitwise_count((self.fps[down[x]] ^ self.fps[down[y]]) & mine)
            good = (x <= y) & (sofar <= self.distance)
            if good.any():
                yield from self._below(level + 1, x[good], y[good], sofar[good])
            at = end


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest place that each place is linked with, directly or not."""
    root = np.arange(n)
    for a, b in pairs:
        while len(a):
            a, b = root[a], root[b]
            apart = a != b
            a, b = np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart])
            np.minimum.at(root, a, b)
            while (root != root[root]).any():
                root = root[root]
    return root


def _local_links(buckets: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    root = _forest(len(fps), GrayIndex(buckets, fps, distance).pairs())
    linked = np.flatnonzero(root != np.arange(len(fps)))
    return fps[linked], fps[root[linked]]


def links(fps: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(u, v): links that connect the same fingerprints as all pairs of ``fps`` (distinct, ``fp`` long) within ``distance`` bits do.

    ``bucket`` bounds the fingerprints that one task takes at a time.
    """
    spark = fps.sparkSession
    # bits: those that the bucket's fingerprints share, as a mask
    rows = fps.select("fp", F.lit(0).cast("long").alias("shared"), F.lit(0).cast("long").alias("bucket"))
    found = None
    while True:
        rows = written(_dealt(rows, distance), "buckets")
        sizes = rows.groupBy("bucket").count()
        large = written(sizes.where(F.col("count") > bucket).select("bucket"), "large")
        more = not large.isEmpty()
        small = rows.join(large, "bucket", "left_anti") if more else rows
        part = _searched(small, distance)
        found = part if found is None else found.unionByName(part)
        if not more:
            return found
        rows = rows.join(large, "bucket", "left_semi")


def _dealt(rows: DataFrame, distance: int) -> DataFrame:
    """Each row once for each block of the bits that its bucket doesn't share yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, shared, old = (batch.column(k).to_numpy().view(np.uint64) for k in range(3))
            for mask in np.unique(shared).tolist():
                mine = shared == mask
                free = [i for i in range(64) if not mask >> i & 1]
                for cut in np.array_split(free, min(distance + 1, max(1, len(free)))):
                    block = sum(1 << int(i) for i in cut)
                    both = np.uint64(mask | block)
                    key = _mixed(old[mine], fp[mine] & both, both)
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (fp[mine], np.full(int(mine.sum()), both, np.uint64), key)], names=["fp", "shared", "bucket"])

    return rows.select("fp", "shared", "bucket").mapInArrow(run, "fp long, shared long, bucket long")


def _mixed(old: np.ndarray, bits: np.ndarray, mask: np.uint64) -> np.ndarray:
    """A bucket's number. Two buckets of one number are searched together, which adds no wrong link."""
    return pair(pair(old, bits), np.full(len(bits), mix(np.array([mask], np.uint64))[0]))


def _searched(rows: DataFrame, distance: int) -> DataFrame:
    """Links within the buckets of ``rows``; a task takes whole buckets, about BUCKET rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def done(b: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            u, v = _local_links(b, f, distance)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
            if sum(len(b) for b, _ in held) < 4 * BUCKET:
                continue
            b, f = (np.concatenate(x) for x in zip(*held, strict=True))
            last = int(np.searchsorted(b, b[-1]))  # the last bucket may go on
            if last:
                yield done(b[:last], f[:last])
            held = [(b[last:], f[last:])]
        if held:
            yield done(*(np.concatenate(x) for x in zip(*held, strict=True)))

    sorted_rows = rows.select("bucket", "fp").repartition("bucket").sortWithinPartitions("bucket")
    return sorted_rows.mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id, class_fp) for each row of ``docs``.

    ``component_id`` is the smallest id among documents reachable over links of ``distance`` bits or fewer;
    ``class_fp``, the smallest fingerprint there, names the class too. Null and empty texts have fingerprint
    zero. Rows with a null id are kept; they count in no minimum, and a class without ids has none. Repeated
    rows stay. Texts are taken whole; other columns are left aside.
    """
    own = written(fingerprints(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), shingle, seed), "fingerprints")
    return own.join(_classes(own, distance), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "class_fp")


def _classes(own: DataFrame, distance: int) -> DataFrame:
    """(fp, class_fp, component_id) for the fingerprints of ``own`` (doc_id, fp)."""
    first = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(first.select("fp"), distance))
    classes = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("class_fp"))
    smallest = classes.groupBy("class_fp").agg(F.min("first").alias("component_id"))
    return written(classes.join(smallest, "class_fp").select("fp", "class_fp", "component_id"), "classes")


def representatives(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, text and any columns) with one row of each class: that of the smallest id.

    Of rows that share that id, or of a class without ids, the one whose contents hash least stays. Null and empty texts
    are one class; an empty table stays empty. Texts meet the decisions by a hash of id and text, so a hot class moves in one piece only as far as it stays.
    """
    row = [F.xxhash64("doc_id", "text").alias("_r1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("_r2")]
    own = written(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row, "text"), shingle, seed), "fingerprints")
    known = own.join(_classes(own, distance), "fp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_r1", "_r2")).alias("first")
    kept = known.groupBy("class_fp").agg(first).select("first._r1", "first._r2")
    whole = docs.select(F.struct(*docs.columns).alias("row"), *row)
    return whole.join(kept, ["_r1", "_r2"], "left_semi").dropDuplicates(["_r1", "_r2"]).select("row.*")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("class_fp")
