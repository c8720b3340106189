"""Best-fit packing of documents into sequences of a fixed capacity.

Best-fit decreasing needs only how many pieces there are of each length, and lengths are bounded by the
capacity. So the plan is made on the driver from a histogram of at most ``capacity`` rows, whatever the
input's size: a segment tree over remaining capacities finds the tightest open bin for a run of equal
pieces in logarithmic time. The plan is a bounded list of rules (length, ranks from, to) -> (sequence,
place). Each piece then finds its rule by its rank among the pieces of its length, which a two-level count
over hash buckets gives without bringing all pieces of one length into one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from ..shared import written
from ._ranks import ranked
from .tokens import Encoder

CAPACITY = 4096
#: Rules above this count are joined by a shuffle. A rule has six longs.
BROADCAST_RULES = 200_000

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Cuts each text's ids, ``end_id`` appended, into pieces of ``capacity`` ids; the last may be shorter.

    ``docs`` needs ``id_col`` (long) and ``text_col``; of other columns, those of ``keep`` stay. A null text counts as
    empty and gives one piece of one id. A null or repeated id is kept: each row is packed for itself.
    Bytes that aren't UTF-8 count as U+FFFD. ``with_ids`` adds the ids as ``array<int>``. Texts are taken whole.
    """
    kind = PIECE + ", ids array<int>" * with_ids
    extra = docs.select(*keep).schema.fields if keep else []
    full = StructType([*docs.sparkSession.createDataFrame([], kind).schema.fields, *extra])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(tokenizer), int(end_id).to_bytes(4, "little")
        names = [x.split()[0] for x in PIECE.split(", ")] + ["ids"] * with_ids
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids

        def done(batch: pa.RecordBatch, rows: list[tuple], at: list[int]) -> pa.RecordBatch:
            own = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays([*own, *(c.take(pa.array(at)) for c in batch.columns[2:])], names=[*names, *keep])

        for batch in batches:
            rows: list[tuple] = []
            where: list[int] = []
            for number, (key, ids) in enumerate(_encoded(batch, encoder)):
                raw = ids + end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    row = key, k, at // 4, len(part) // 4, zlib.crc32(part)
                    rows.append((*row, memoryview(part).cast("i").tolist()) if with_ids else row)
                    where.append(number)
                if len(rows) >= 20_000 or with_ids and len(rows) >= 500:
                    yield done(batch, rows, where)
                    rows, where = [], []
            if rows:
                yield done(batch, rows, where)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), *keep).mapInArrow(cut, full)


def _encoded(batch: pa.RecordBatch, encoder: Encoder) -> Iterator[tuple[int | None, bytes]]:
    for at in range(0, batch.num_rows, 500):
        part = batch.slice(at, 500)
        yield from zip(part.column(0).to_pylist(), encoder.encode([(x or b"").decode("utf-8", "replace") for x in part.column(1).to_pylist()]), strict=True)


class _Tree:
    """Which remaining capacities have open bins; finds the smallest that is large enough."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)

    def set(self, at: int, on: bool) -> None:
        at += self.size
        self.open[at] = int(on)
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] | self.open[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        at = least + self.size
        if self.open[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at + (not self.open[2 * at])
                return at - self.size
            at //= 2
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """The rules of the plan: (length, first rank, end rank, first sequence, pieces per sequence, offset).

    Piece number r of a length goes, by the rule whose ranks hold r, to sequence ``first sequence +
    (r - first rank) // pieces per sequence``, at ``offset + (r - first rank) % pieces per sequence *
    length``. Bins of equal remaining capacity are kept as ranges of sequence numbers, so the work depends
    on the capacity, not on the number of pieces.
    """
    tree, bins, rules, sequences = _Tree(capacity), {}, [], 0

    def put(room: int, first: int, count: int) -> None:
        if room and count:
            bins.setdefault(room, []).append((first, count))
            tree.set(room, True)

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of length {length} does not fit")
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, count = capacity, sequences, -(-left // (capacity // length))
                sequences += count
            else:
                first, count = bins[room].pop()
                if not bins[room]:
                    tree.set(room, False)
            each = room // length
            full = min(count, left // each)
            if full:
                rules.append((length, rank, rank + full * each, first, each, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < count and left:
                rules.append((length, rank, rank + left, first + full, left, capacity - room))
                put(room - left * length, first + full, 1)
                full, left = full + 1, 0
            put(room, first + full, count - full)
    return rules


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, str] | None = None) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``pieces``, packed by best-fit decreasing over all of them.

    Needs a column ``length`` from 1 to ``capacity``, nowhere null; every other column is kept, columns of the new
    names are replaced. Equal lengths are ranked by the rows' contents, so a task that runs again ranks alike; equal
    rows are interchangeable. ``order`` names two columns instead, first the coarse one (such as a file's name), then
    a finer one (such as a row's number): equal lengths are taken in this order, sequences are numbered, from 0, by
    their first piece in it, and the two columns go. An empty table stays empty.
    """
    spark = pieces.sparkSession
    pieces = written(pieces.drop("sequence_id", "offset"), "pieces")
    if pieces.where(F.col("length").isNull()).limit(1).count():
        raise ValueError("a piece has no length")
    found, counts = ranked(pieces.select(F.struct(*pieces.columns).alias("whole"), "length", *(F.col(c).alias(f"_{k}") for k, c in enumerate(order or ()))), "length", order=order and ("_0", "_1"))
    # at most ``capacity`` rows, whatever the input
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}
    rules = best_fit_decreasing(histogram, capacity)
    plan = spark.createDataFrame(rules, "_length long, _from long, _to long, _first long, _each long, _at long")
    if len(rules) <= BROADCAST_RULES:
        plan = F.broadcast(plan)
    placed = found.join(plan, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    index = F.col("_rank") - F.col("_from")
    sequence, offset = F.col("_first") + F.floor(index / F.col("_each")), F.col("_at") + index % F.col("_each") * F.col("length")
    placed = placed.select("whole", *(["_0", "_1"] if order else []), sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))
    if order is None:
        return placed.select("whole.*", "sequence_id", "offset")
    placed = written(placed, "placed")
    first = placed.groupBy("sequence_id").agg(F.min(F.struct("_0", "_1")).alias("m")).select("sequence_id", "m.*")
    start = Window.orderBy("_0").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each value of the coarse column
    starts = first.groupBy("_0").count().select("_0", F.coalesce(F.sum("count").over(start), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("_0").orderBy("_1", "sequence_id")) - 1
    numbered = first.withColumn("k", number).join(starts, "_0").select("sequence_id", (F.col("k") + F.col("before")).cast("long").alias("new"))
    return placed.join(numbered, "sequence_id").select("whole.*", F.col("new").alias("sequence_id"), "offset").drop(*order)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(token_pieces(docs, tokenizer_path()))
