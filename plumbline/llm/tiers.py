"""Packing into windows of several lengths.

Documents are routed by their length to tiers, each with a window of its own; what a document has beyond the longest
window fills windows of that length. From the longest tier down, each item opens a window of its tier; the gap is
filled by the longest items of shorter tiers that fit, and where none fits, by a part cut from the longest of them. So
windows are full, and only the last tokens, less than the shortest window, are left; they are cut into powers of two.

The plan needs only how many items there are of each length, at most as many numbers as the longest window has tokens. It
is made on the driver, for runs of equal windows at a time, and is a bounded list of rules. Each item then finds its
rules by its rank among the items of its length.

Sequences of a tier stand in the order of the work they make for attention (squares of their parts' lengths), so that
dealing them out forth and back gives step groups of one window, of as many tokens each and of about equal work.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..shared import written
from ._ranks import ranked
from .packing import BROADCAST_RULES, _encoded, _encoder, tokenizer_path

#: Windows of the tiers, tokens of a step group.
WINDOWS, STEP_TOKENS = (128, 256, 512, 1024), 8192

ITEM = "doc_id long, doc_tokens long, item_start long, size long, item_crc32 long, item_ids binary"
RESULT = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group")


@dataclass(frozen=True)
class Part:
    """Items of ``size`` whose ranks start at ``rank``: from ``start``, ``length`` tokens, ``each`` of them in a sequence, from ``at``."""

    size: int
    rank: int
    start: int
    length: int
    each: int
    at: int


@dataclass(frozen=True)
class Run:
    """``count`` equal sequences of ``window`` tokens."""

    window: int
    count: int
    parts: tuple[Part, ...]

    @property
    def work(self) -> int:
        return sum(p.each * p.length**2 for p in self.parts)


class _Items:
    """What isn't placed yet: by length, runs of (size, first rank, end rank, start)."""

    def __init__(self, histogram: dict[int, int]):
        self.runs, self.lengths, self.tokens = {}, [], 0
        for size, n in histogram.items():
            if n:
                self.put(size, 0, n, 0, size)

    def put(self, size: int, a: int, z: int, start: int, length: int) -> None:
        if a < z and length:
            if length not in self.runs:
                self.runs[length] = []
                insort(self.lengths, length)
            self.runs[length].append((size, a, z, start))
            self.tokens += (z - a) * length

    def take(self, length: int) -> tuple[int, int, int, int]:
        run = self.runs[length].pop()
        self.tokens -= (run[2] - run[1]) * length
        if not self.runs[length]:
            del self.runs[length]
            self.lengths.remove(length)
        return run

    def longest(self, most: int) -> int | None:
        """The greatest length that isn't above ``most``."""
        k = bisect_right(self.lengths, most)
        return self.lengths[k - 1] if k else None


def _later(p: Part, n: int) -> Part:
    """The part, for the sequences from the ``n``-th on."""
    return Part(p.size, p.rank + n * p.each, p.start, p.length, p.each, p.at)


def plan(histogram: dict[int, int], windows: tuple[int, ...] = WINDOWS) -> list[Run]:
    """Runs of sequences that hold every item of the histogram (length: number), each token once.

    All sequences are full. ``windows`` ascend and are powers of two.
    """
    if list(windows) != sorted(set(windows)) or any(w < 1 or w & (w - 1) for w in windows):
        raise ValueError("windows must be ascending powers of two")
    if any(not 0 < n <= windows[-1] for n in histogram):
        raise ValueError("an item is empty or longer than the longest window")
    items, done = _Items(histogram), []
    tiers = [*reversed(windows)]
    while tiers[-1] > 1:
        tiers.append(tiers[-1] // 2)
    for k, window in enumerate(tiers):
        # windows below the shortest tier only take the rest
        shorter = tiers[k + 1] if k + 1 < len(windows) else 0
        while items.tokens >= window and items.lengths and items.lengths[-1] > shorter:
            length = items.lengths[-1]
            size, a, z, start = items.take(length)
            # as many as all that is left can fill
            n = min(z - a, (items.tokens + (z - a) * length) // window)
            items.put(size, a + n, z, start, length)
            if length > window:
                items.put(size, a, a + n, start + window, length - window)
            part = Part(size, a, start, min(length, window), 1, 0)
            _fill(items, [(n, window - part.length, (part,))], window, shorter, done)
    return done


def _fill(items: _Items, open_: list[tuple[int, int, tuple[Part, ...]]], window: int, shorter: int, done: list[Run]) -> None:
    """Fills runs of (number, gap, parts): the longest items that fit, else a part of one that doesn't, of a shorter tier if there is one."""
    while open_:
        n, gap, parts = open_.pop()
        if not gap:
            done.append(Run(window, n, parts))
            continue
        fits = items.longest(gap)
        length = fits or items.longest(shorter) or items.lengths[-1]
        size, a, z, start = items.take(length)
        each, used = (min(gap // length, z - a), length) if fits else (1, gap)
        full = min(n, (z - a) // each)
        end = a + full * each
        items.put(size, end, z, start, length)
        if not fits:
            items.put(size, a, end, start + gap, length - gap)
        if full < n:
            open_.append((n - full, gap, tuple(_later(p, full) for p in parts)))
        open_.append((full, gap - each * used, (*parts, Part(size, a, start, used, each, window - gap))))


def rules(runs: list[Run]) -> list[tuple[int, ...]]:
    """(size, first rank, end rank, start, length, each, offset, window, first sequence) of each part; sequences of a window stand together, those of most work first."""
    out, at = [], 0
    for run in sorted(runs, key=lambda r: (-r.window, -r.work, [(p.size, p.rank, p.start) for p in r.parts])):
        out += [(p.size, p.rank, p.rank + run.count * p.each, p.start, p.length, p.each, p.at, run.window, at) for p in run.parts]
        at += run.count
    return out


def step_groups(runs: list[Run], step_tokens: int = STEP_TOKENS) -> list[tuple[int, int, int, int]]:
    """(window, first sequence, sequences, step groups) of each tier, the longest window first."""
    number: dict[int, int] = {}
    for r in runs:
        number[r.window] = number.get(r.window, 0) + r.count
    out, at = [], 0
    for window, n in sorted(number.items(), reverse=True):
        out.append((window, at, n, -(-n // max(1, step_tokens // window))))
        at += n
    return out


def _group(tiers: list[tuple[int, int, int, int]]) -> str:
    """SQL for the step group of ``sequence_id``: forth and back over the groups of its tier; groups of all tiers stand evenly mixed."""
    cases = []
    for order, (_, first, n, groups) in enumerate(tiers):
        at, turn = f"((sequence_id - {first}) % {groups})", f"((sequence_id - {first}) div {groups})"
        k = f"if({turn} % 2 = 0, {at}, {groups - 1} - {at})"
        # groups of the other tiers whose place (k + 1/2) / groups comes before; of equal places the longer window's
        before = [f"greatest(0, least({g}, ((2 * {k} + 1) * {g} + {groups if o < order else groups - 1}) div {2 * groups}))" for o, (*_, g) in enumerate(tiers) if o != order]
        cases.append(f"WHEN sequence_id < {first + n} THEN {' + '.join([k, *before])}")
    return f"CAST(CASE {' '.join(cases)} END AS LONG)" if cases else "CAST(NULL AS LONG)"


def items(docs: DataFrame, tokenizer: str, longest: int = WINDOWS[-1], end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each text's ids, ``end_id`` appended, in items of ``longest`` ids and one of the rest, with the columns ``keep``.

    A null text counts as empty, which is one id. Bytes that aren't UTF-8 count as U+FFFD. Texts are taken whole. Rows
    with a null or repeated id are kept, each for itself. Ids, packed, stand in ``item_ids`` if an item may be cut or ``with_ids``.
    """
    extra = docs.select(*(f"`{c}`" for c in keep)).schema.fields if keep else []
    schema = StructType([*docs.sparkSession.createDataFrame([], ITEM).schema.fields, *extra])
    names = [x.split()[0] for x in ITEM.split(", ")]
    types = [pa.int64()] * 5 + [pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(tokenizer), int(end_id).to_bytes(4, "little")

        def done(batch: pa.RecordBatch, rows: list[tuple], at: list[int]) -> pa.RecordBatch:
            own = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays([*own, *(c.take(pa.array(at)) for c in batch.columns[2:])], names=[*names, *keep])

        for batch in batches:
            rows: list[tuple] = []
            where: list[int] = []
            for number, (key, ids) in enumerate(_encoded(batch, encoder)):
                raw = ids + end
                for at in range(0, len(raw), 4 * longest):
                    part = raw[at : at + 4 * longest]
                    rows.append((key, len(raw) // 4, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids or len(part) < 4 * longest else None))
                    where.append(number)
                    if len(rows) >= 2000:
                        yield done(batch, rows, where)
                        rows, where = [], []
            if rows:
                yield done(batch, rows, where)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), *(f"`{c}`" for c in keep)).mapInArrow(cut, schema)


def pack_tiers(docs: DataFrame, tokenizer: str, windows: tuple[int, ...] = WINDOWS, step_tokens: int = STEP_TOKENS, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """All texts in sequences of ``windows`` tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, step_group.

    A row is a piece: ``length`` ids of its document from ``start`` on, of ``doc_tokens`` in all, ids_crc32 the CRC-32 of its
    ids as unsigned 32-bit little-endian numbers. Pieces of a sequence stand gapless from 0. Every sequence is as long
    as its ``window``: one of ``windows``, or a smaller power of two for the rest of less than the shortest window. ``with_ids`` adds
    ``ids``, packed. A step group holds sequences of one window, ``step_tokens`` together (the groups of a tier differ by
    one sequence at most); their numbers are an order for training in which tiers alternate.

    Texts and ids as in ``items``. Of equal lengths, rows are ranked by content, so a task that runs again ranks alike; repeated rows
    are interchangeable, and each is packed. Columns of ``keep`` stay, but those named like a result's. An empty table gives no rows.
    """
    spark = docs.sparkSession
    keep = tuple(c for c in keep if c not in (*RESULT, "ids", *(x.split()[0] for x in ITEM.split(", "))))
    found = written(items(docs, tokenizer, windows[-1], end_id, id_col, text_col, with_ids, keep), "items")
    ranks, counts = ranked(found.select(F.struct(*(f"`{c}`" for c in found.columns)).alias("whole"), "size"), "size")
    # at most as many rows as the longest window has tokens
    runs = plan({r[0]: r[1] for r in counts.groupBy("size").agg(F.sum("_n")).collect()}, tuple(windows))
    table = rules(runs)
    part = spark.createDataFrame(table, "_size long, _from long, _to long, _start long, _length long, _each long, _at long, window long, _first long")
    if len(table) <= BROADCAST_RULES:
        part = F.broadcast(part)
    placed = ranks.join(part, (F.col("size") == F.col("_size")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    index = F.col("_rank") - F.col("_from")
    w, sequence = F.col("whole"), F.col("_first") + F.floor(index / F.col("_each"))
    mine = F.when(F.col("_length") == F.col("size"), w["item_ids"]).otherwise(F.substring(w["item_ids"], (4 * F.col("_start") + 1).cast("int"), (4 * F.col("_length")).cast("int")))
    crc = F.when(F.col("_length") == F.col("size"), w["item_crc32"]).otherwise(F.crc32(mine))
    pieces = placed.select(
        w["doc_id"].alias("doc_id"), (w["item_start"] + F.col("_start")).alias("start"), F.col("_length").alias("length"), crc.alias("ids_crc32"), w["doc_tokens"].alias("doc_tokens"),
        sequence.cast("long").alias("sequence_id"), (F.col("_at") + index % F.col("_each") * F.col("_length")).cast("long").alias("offset"),
        F.col("window").cast("int").alias("window"), *([mine.alias("ids")] if with_ids else []), *(w[c].alias(c) for c in keep),
    )
    return pieces.withColumn("step_group", F.expr(_group(step_groups(runs, step_tokens))))


def op11_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 ids, all of them full."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_tiers(docs, tokenizer_path("byte_bpe_50k.json"))
