"""Removal of lines that many documents share.

Lines are known by 128-bit hashes of their keys. The store keeps levelled sorted runs of hashes: each batch
of documents is merge-anti-joined with the runs; its new hashes form a run of their own at level 0, its known ones
are counts to add to those of the run that has them. ``FAN_IN`` runs of a level are merged into one of the next, with
what there is to add. Runs are tables bucketed and sorted by hash in the shared folder, so that no join of a batch
with them shuffles; they hold the number of documents and the largest id for each hash.

A decision on a line needs its hash only, so texts are shuffled once, to meet their lists of lines to drop.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..shared import forget, place, settings, written

#: Code points that a key has at least; documents that hold it at least, for its lines to go.
MIN_LENGTH, MIN_DOCS = 40, 5
#: Runs of a level that are merged into one; batches that a whole table is taken in.
FAN_IN, BATCHES = 3, 4
#: Spark 4.1 takes a union of bucketed tables for partitioned where it isn't, and would group wrongly.
UNION = {"spark__sql__unionOutputPartitioning": "false"}
BLANK = b" \t\n\x0b\x0c\r"


def key_of(line: bytes, min_length: int = MIN_LENGTH) -> bytes | None:
    """The hash of a line's key, None if the key is too short. Lengths are in code points of UTF-8."""
    key = line.strip(BLANK)
    if len(key) < min_length or len(key) < 4 * min_length and len(key.decode("utf-8", "replace")) < min_length:
        return None
    return xxhash.xxh3_128_digest(key.lower())


def _row_key() -> list:
    """Two longs that stand for a row's id and text."""
    return [F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("r2")]


def line_hashes(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, r1, r2, h): one row for each row of ``docs`` (doc_id, text) and each different long line of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, hashes = [], []
            for k, text in enumerate(batch.column(3)):
                raw = text.as_py() or b""
                found = {h for x in raw.split(b"\n") if len(x) >= min_length and (h := key_of(x, min_length))}
                places += [k] * len(found)
                hashes += found
            at = pa.array(places, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(3)), pa.array(hashes, pa.binary())], names=["doc_id", "r1", "r2", "h"])

    return docs.select("doc_id", *_row_key(), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, r1 long, r2 long, h binary")


class LineRuns:
    """Levelled sorted runs of (h, docs, last): a line's hash, the documents that hold it, the largest id. Each hash is in one run.

    ``close`` deletes all that the store has written.
    """

    def __init__(self, spark: SparkSession, fan_in: int = FAN_IN):
        self.spark, self.fan_in = spark, fan_in
        self.buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.levels: list[list[DataFrame]] = []
        self.more: list[DataFrame] = []
        self.paths: list[str] = []

    def _run(self, rows: DataFrame) -> DataFrame:
        """``rows`` as a table of its own, bucketed and sorted by hash."""
        path = place(self.spark, "run")
        name = "run_" + path.rsplit("-", 1)[1]
        with settings(self.spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true", **UNION):
            rows.repartition(self.buckets, "h").write.bucketBy(self.buckets, "h").sortBy("h").option("path", path).saveAsTable(name)
        self.paths.append(path)
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        return [x for level in self.levels for x in level]

    def unseen(self, hashes: DataFrame) -> DataFrame:
        """Rows of ``hashes`` whose ``h`` no run holds: a merge-anti-join with each run."""
        for run in self.runs():
            hashes = hashes.join(run.select("h").hint("merge"), "h", "left_anti")
        return hashes

    def add(self, hashes: DataFrame) -> None:
        """Adds a batch (doc_id, h), whose ids no other batch has; compacts full levels. Rows without an id don't count."""
        each = hashes.where(F.col("doc_id").isNotNull()).select("h", "doc_id").distinct()
        batch = self._run(each.groupBy("h").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last")))
        run = batch
        if self.runs():
            run = self._run(self.unseen(batch))
            self.more.append(self._run(batch.join(run.select("h").hint("merge"), "h", "left_anti")))
        level = 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fan_in:
                return
            run = self._merged(self.levels[level])
            self.levels[level] = []
            level += 1

    @staticmethod
    def _union(runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for x in runs[1:]:
            out = out.unionByName(x)
        return out

    @staticmethod
    def _summed(runs: list[DataFrame]) -> DataFrame:
        return LineRuns._union(runs).groupBy("h").agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """One run of several, with the counts to add for their hashes; what is to add to other runs waits on."""
        if not self.more:
            return self._run(self._union(runs))
        more = self._run(self._summed(self.more))
        own = self._run(self._union(runs))
        extra = more.select("h", F.col("docs").alias("more"), F.col("last").alias("later"))
        merged = own.join(extra.hint("merge"), "h", "left").select("h", (F.col("docs") + F.coalesce("more", F.lit(0))).alias("docs"), F.greatest("last", "later").alias("last"))
        self.more = [self._run(more.join(own.select("h").hint("merge"), "h", "left_anti"))]
        return self._run(merged)

    def shared(self, min_docs: int) -> DataFrame:
        """(h, last) of the hashes that ``min_docs`` documents hold, over all runs, as a table."""
        with settings(self.spark, **UNION):
            return written(self._summed([*self.runs(), *self.more]).where(F.col("docs") >= min_docs).select("h", "last"), "shared")

    def close(self) -> None:
        for path in self.paths:
            self.spark.sql(f"DROP TABLE IF EXISTS run_{path.rsplit('-', 1)[1]}")
            forget(self.spark, path)


def drop_shared_lines(docs: DataFrame, min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_lines`` (before), ``n_dropped`` and ``kept_text``; the text column goes.

    A line's key is the line without white space at both ends, A-Z lower-cased. Lines whose key has at least
    ``min_length`` code points and is found under at least ``min_docs`` different ids go, but for those of the
    largest id that holds the key; rows that share that id all keep their lines. A null id isn't counted, and is never
    the largest. Null and empty texts are one empty line. Each row is returned, repeated ones too. Bytes that aren't
    UTF-8 stay as they are. ``docs`` needs ``id_col`` (long) and ``text_col``; all other columns are kept as they are,
    those of the new names replaced. An empty table stays empty.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped", "kept_text")]
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(*keep).alias("row"))
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    hashes = written(line_hashes(own, min_length).withColumn("batch", batch), "lines", "batch")
    store = LineRuns(spark)
    for k in range(batches):
        store.add(hashes.where(F.col("batch") == k))
    # a hot line is many rows against one; adaptive execution splits a join of two tables, as of this written one
    shared = store.shared(min_docs)
    store.close()
    drops = hashes.join(shared, "h").where(~F.col("doc_id").eqNullSafe(F.col("last"))).groupBy("r1", "r2").agg(F.collect_set("h").alias("drops"))
    kind = docs.select(*keep).schema.add("n_lines", "long").add("n_dropped", "long").add("kept_text", "binary")

    def rewrite(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n, gone, texts = [], [], []
            for text, hashed in zip(part.column(0), part.column(1), strict=True):
                raw = text.as_py()
                if hashed.is_valid:
                    every, bad = raw.split(b"\n"), set(hashed.as_py())
                    kept = [x for x in every if len(x) < min_length or key_of(x, min_length) not in bad]
                    n.append(len(every))
                    gone.append(len(every) - len(kept))
                    texts.append(b"\n".join(kept))
                else:
                    n.append(raw.count(b"\n") + 1)
                    gone.append(0)
                    texts.append(raw)
            rows = part.column(2).flatten() if keep else []
            yield pa.RecordBatch.from_arrays([*rows, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.binary())], names=[*keep, "n_lines", "n_dropped", "kept_text"])

    met = own.select("row", "text", *_row_key()).join(drops, ["r1", "r2"], "left")
    return met.select(F.col("text").cast("binary").alias("text"), "drops", "row").mapInArrow(rewrite, kind).withColumn("kept_text", F.col("kept_text").cast("string"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document before and after, and the kept text's digest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_shared_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = {
    "op4_line_dedup": r"""
WITH l AS (
  SELECT row, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k
  FROM (SELECT *, row_number() OVER () AS row FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), shared AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT keyed.*, (shared.key IS NOT NULL AND keyed.doc_id IS DISTINCT FROM shared.last) AS gone
  FROM keyed LEFT JOIN shared ON keyed.key = shared.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row, doc_id
""",
}
