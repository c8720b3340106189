"""Language-model scores by stupid backoff, from counts of the corpus itself.

Texts are cut into words once, in groups of rows that lie together; a group is a row with its words' hashes. Counts are
partitioned by the hash of the n-gram: a group asks each partition for its n-grams there, every one once with its number,
so a frequent n-gram is one entry of a group. The partition adds up what all groups have, and its counts return to the
groups, whose words then get their scores, summed for each document. A word is scored under the counts of all other
words (leaving one out): its own occurrence is taken off every count, or each n-gram would be found.

An n-gram is only found if both n-grams of a word less within it are. So from three words on, lengths follow one after the
other, and a group asks for what can still be found. Lists travel packed, a row for each group and partition.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..shared import dropped, written
from ._words import texts, words

#: Words of an n-gram, weight of a step back.
ORDER, BACKOFF = 3, 0.4
#: Bytes of text in a group, words for each partition of the counts at most.
GROUP, PART = 1 << 22, 1 << 21

STATE = "gid long, counted boolean, scored boolean, n_words long, ids array<long>, sizes binary, words binary, at binary, found array<binary>"
ANSWER = "gid long, part int, found binary"
SCORE = "doc_id long, n_words long, log_score double"

#: Multipliers of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def xxhash64(columns: list[np.ndarray], seed: int | np.ndarray = 42) -> np.ndarray:
    """What the SQL function of this name gives for columns of longs; with hashes as ``seed``, of theirs and these together."""
    h = np.asarray(seed, np.uint64)
    with np.errstate(over="ignore"):
        for x in columns:
            h = _turned((h + _P5 + np.uint64(8)) ^ (_turned(x * _P2, 31) * _P1), 27) * _P1 + _P4
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            h = h ^ (h >> np.uint64(32))
    return h


def _packed(x: np.ndarray) -> bytes:
    """The numbers by byte, compressed."""
    data = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, len(raw) // size).T).view(kind).ravel()


def _pieces(x: np.ndarray, ends: np.ndarray) -> pa.Array:
    """x cut at ``ends``, each piece packed."""
    return pa.array([_packed(x[a:z]) for a, z in zip(_before(ends).tolist(), ends.tolist(), strict=True)], pa.binary())


def _before(x: np.ndarray) -> np.ndarray:
    """What stands one place earlier; zero at the first."""
    return np.concatenate((np.zeros(1, x.dtype), x))[: len(x)]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts of rows that are taken together: GROUP bytes, or one longer text."""
    ids: list = []
    held: list[bytes] = []
    size = 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
            if held and size + len(text) > GROUP:
                yield ids, held
                ids, held, size = [], [], 0
            ids.append(key)
            held.append(text)
            size += len(text)
    if held:
        yield ids, held


def _encoded(rows: DataFrame, counted: bool, scored: bool) -> DataFrame:
    """Groups of rows (doc_id, text)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, group in _groups(batches):
            w, first, _ = words(b" ".join(group))
            sizes = np.diff(np.searchsorted(first, np.cumsum([len(x) + 1 for x in group])), prepend=0).astype("<i8")
            each, at, n = np.unique(w, return_inverse=True, return_counts=True)
            # frequent words get small numbers; differences of ascending hashes are small too
            order = np.argsort(-n, kind="stable")
            number = np.empty(len(order), "<u4")
            number[order] = np.arange(len(order))
            row = {
                "gid": uuid.uuid4().int >> 65, "counted": counted, "scored": scored, "n_words": len(w), "ids": ids if scored else [],
                "sizes": sizes.tobytes(), "words": _packed(each[order] - _before(each[order])), "at": _packed(number[at]), "found": [],
            }
            yield pa.RecordBatch.from_pylist([row], schema=ARROW)

    return rows.mapInArrow(encode, STATE)


_KINDS = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}
ARROW = pa.schema([(name, _KINDS[kind]) for name, kind in (x.split(" ") for x in STATE.split(", "))])


def _places(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Of each word of a group, its text's number and its place in it."""
    sizes = np.frombuffer(row["sizes"], "<i8")
    doc = np.repeat(np.arange(len(sizes)), sizes)
    return doc, np.arange(len(doc)) - (np.cumsum(sizes) - sizes)[doc]


def _known(row: dict) -> list[np.ndarray]:
    """The counts that a group has, for each of its words; single words' are held once for each different word."""
    found = [_unpacked(x, "<i8") for x in row["found"]]
    return [x if k else x[_unpacked(row["at"], "<u4")] for k, x in enumerate(found)]


def ngrams(row: dict, lengths: range) -> list[tuple[np.ndarray, np.ndarray]]:
    """A group's n-grams of each length that can still be found: the words they end at, and hashes."""
    known = _known(row)
    w, place = np.cumsum(_unpacked(row["words"], "<u8"))[_unpacked(row["at"], "<u4")], _places(row)[1]
    h, out = np.full(len(w), 42, np.uint64), []
    for n in range(1, lengths[-1] + 1):
        h = xxhash64([w], h if n == 1 else _before(h))
        if n in lengths:
            mine = place >= n - 1
            if 1 < n <= len(known) + 1:
                shorter = known[n - 2] > 0
                mine &= shorter & _before(shorter)
            at = np.flatnonzero(mine)
            out.append((at, h[at]))
    return out


def _counts(groups: DataFrame, lengths: range, parts: int, off: int) -> DataFrame:
    """(gid, part, found): the counts, less ``off``, of what each group asks a partition for, by ascending hash."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                h, n = np.unique(np.concatenate([x for _, x in ngrams(row, lengths)]), return_counts=True)
                part = ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                last = np.flatnonzero(np.append(part[1:] != part[:-1], True)[: len(part)])
                steps = h - _before(h)
                starts = _before(last + 1)
                steps[starts] = h[starts]
                n = n.astype("<u4") if row["counted"] else np.zeros(len(h), "<u4")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(last), row["gid"])), pa.array(part[last].astype(np.int32)), _pieces(steps, last + 1), _pieces(n, last + 1)], names=["gid", "part", "h", "n"])

    def count(table: pa.Table) -> pa.Table:
        lists = [np.cumsum(_unpacked(x, "<u8")) for x in table["h"].to_pylist()]
        n = np.concatenate([_unpacked(x, "<u4") for x in table["n"].to_pylist()])
        _, back = np.unique(np.concatenate(lists), return_inverse=True)
        found = np.maximum(np.bincount(back, n).astype("<i8") - off, 0)[back]
        return pa.table({"gid": table["gid"], "part": table["part"], "found": _pieces(found, np.cumsum([len(x) for x in lists]))})

    asked = groups.mapInArrow(ask, "gid long, part int, h binary, n binary")
    return written(asked.groupBy("part").applyInArrow(count, ANSWER), "counts")


def _found(row: dict, answers: pa.Table, lengths: range) -> list[np.ndarray]:
    """For each length so far, the count of the n-gram that ends at each word of a group, or zero."""
    asked = ngrams(row, lengths)
    got = sorted(zip(answers["part"].to_pylist(), answers["found"].to_pylist(), strict=True))
    found = np.concatenate([np.zeros(0, "<i8"), *(_unpacked(x, "<i8") for _, x in got)])
    h, back = np.unique(np.concatenate([x for _, x in asked]), return_inverse=True)
    assert len(found) == len(h)
    each = np.split(found[back], np.cumsum([len(at) for at, _ in asked])[:-1])
    out = _known(row)
    for (at, _), x in zip(asked, each, strict=True):
        out.append(np.zeros(row["n_words"], "<i8"))
        out[-1][at] = x
    return out


def _taken(groups: DataFrame, answers: DataFrame, lengths: range) -> DataFrame:
    """The groups, with counts of these lengths."""

    def take(own: pa.Table, got: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        at, found = _unpacked(row["at"], "<u4"), _found(row, got, lengths)
        single = np.zeros(int(at.max(initial=0)) + 1, "<i8")
        single[at] = found[0]
        return pa.Table.from_pylist([row | {"found": [_packed(x) for x in (single, *found[1:])]}], schema=ARROW)

    return written(groups.groupBy("gid").cogroup(answers.groupBy("gid")).applyInArrow(take, STATE), "groups")


def _scores(groups: DataFrame, answers: DataFrame, lengths: range, base: int, backoff: float) -> DataFrame:
    """Every row's score, once counts of the last lengths have come; ``base`` is the number of all words."""
    step = math.log(backoff)

    def score(own: pa.Table, got: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        if not row["scored"]:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "log_score": pa.array([], pa.float64())})
        found, (doc, place) = _found(row, got, lengths), _places(row)
        logs = np.where(found[0] > 0, np.log(np.maximum(found[0], 1)), step) - math.log(base)
        for n in range(2, len(found) + 1):
            here = found[n - 1] > 0
            logs += np.where(place >= n - 1, step, 0.0)
            logs[here] = np.log(found[n - 1][here] / _before(found[n - 2])[here])
        sizes = np.frombuffer(row["sizes"], "<i8")
        return pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "n_words": pa.array(sizes), "log_score": pa.array(np.bincount(doc, logs, len(sizes)).astype(float))})

    return groups.groupBy("gid").cogroup(answers.groupBy("gid")).applyInArrow(score, SCORE)


def backoff_scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, corpus: DataFrame | None = None, hot: int | None = None) -> DataFrame:
    """(doc_id, n_words, log_score): for each row of ``docs`` (doc_id long, text) the sum of its words' log scores.

    A word's score is count(n-gram) / count(n-gram without the word) for the longest n-gram ending at it, up to
    ``order`` words and not beyond the text's start, that the corpus holds, times ``backoff`` for each step back; at
    the end stands count(word) / number of words, and for unknown words ``backoff`` / number of words. Without
    ``corpus`` (text), the corpus is ``docs`` without the word in question: all counts are less by one.
    Whole texts count, in n-grams of all lengths and frequencies. Words are separated by ASCII white space, A-Z
    lower-cased. Null and empty texts have 0 words and score 0; an empty table has no rows. Rows with null or repeated
    ids are scored each for itself; other columns are left aside. Bytes that aren't UTF-8 are part of words. N-grams
    are told apart by 64-bit hashes. The n-grams of one text have to fit in a task. ``hot`` has no effect any more: no
    n-gram, however frequent, is more than one entry of a group.
    """
    off = int(corpus is None)
    text = F.col("text").cast("binary").alias("text")
    own = _encoded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text), corpus is None, True)
    # written once, and read from there: groups stay the same however the rows came
    groups = written(own if corpus is None else own.unionByName(_encoded(corpus.select(F.lit(None).cast("long").alias("doc_id"), text), True, False)), "groups")
    all_words, n_words = groups.agg(F.sum(F.when(F.col("counted"), F.col("n_words"))), F.sum("n_words")).first()
    tasks = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first = range(1, min(order, 2) + 1)
    parts = max(2 * tasks, -(-(n_words or 0) * len(first) // PART))
    lengths = [first, *(range(n, n + 1) for n in range(3, order + 1))]
    for now in lengths[:-1]:
        answers = _counts(groups, now, parts, off)
        last, groups = groups, _taken(groups, answers, now)
        dropped(last)
        dropped(answers)
    return _scores(groups, _counts(groups, lengths[-1], parts, off), lengths[-1], max(1, (all_words or 0) - off), backoff)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, and that for a word, under the counts of the other words of all documents."""
    scored = backoff_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).otherwise(F.lit(0.0))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round(mean, 6).alias("word_score"))


ORACLE_SQL = {
    "op10_lm_scoring": r"""
WITH t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), p AS (
  SELECT doc_id, unnest(w) AS c, unnest(list_prepend(NULL, w)[1:len(w)]) AS b,
         unnest(list_prepend(NULL, list_prepend(NULL, w))[1:len(w)]) AS a
  FROM t
), one AS (
  SELECT c, count(*) - 1 AS n FROM p GROUP BY c
), two AS (
  SELECT b, c, count(*) - 1 AS n FROM p WHERE b IS NOT NULL GROUP BY b, c
), three AS (
  SELECT a, b, c, count(*) - 1 AS n FROM p WHERE a IS NOT NULL GROUP BY a, b, c
), s AS (
  SELECT p.doc_id,
         CASE WHEN three.n > 0 THEN ln(three.n / ab.n)
              WHEN two.n > 0 THEN ln(two.n / b.n) + CASE WHEN p.a IS NULL THEN 0 ELSE ln(0.4) END
              ELSE CASE WHEN p.a IS NULL THEN 0 ELSE ln(0.4) END + CASE WHEN p.b IS NULL THEN 0 ELSE ln(0.4) END
                   + CASE WHEN c.n > 0 THEN ln(c.n) ELSE ln(0.4) END - ln(greatest((SELECT count(*) - 1 FROM p), 1)) END AS x
  FROM p JOIN one c ON c.c = p.c LEFT JOIN one b ON b.c = p.b
  LEFT JOIN two ON two.b = p.b AND two.c = p.c LEFT JOIN two ab ON ab.b = p.a AND ab.c = p.b
  LEFT JOIN three ON three.a = p.a AND three.b = p.b AND three.c = p.c
), r AS (
  SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, coalesce(sum(s.x), 0.0) AS total
  FROM t LEFT JOIN s ON s.doc_id = t.doc_id GROUP BY t.doc_id, len(t.w)
)
SELECT doc_id, n_words, round(total, 4) AS log_score,
       round(CASE WHEN n_words > 0 THEN total / n_words ELSE 0.0 END, 6) AS word_score
FROM r
""",
}
