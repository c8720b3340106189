"""Lines that hold one of many indicators, by one automaton over whole texts.

The automaton holds every indicator of every boundary, so a text is read once, whatever their number, and the plan has one
step. Boundaries are configuration, not data: they go to the tasks as they are.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import paths

HIT = "boundary string, path string, line long, indicator string"
QUOTES = ("'", '"', "`")


class Finder:
    """Finds the hits of ``boundaries`` (name, indicators, allowed_in) in a text."""

    def __init__(self, boundaries: list):
        self.names = [b.name for b in boundaries]
        # the matcher of the tasks writes the end of a text in another way than the JVM's
        self.allowed = [[re.compile(paths.glob_regex(g).replace(r"\z", r"\Z")) for g in b.allowed_in] for b in boundaries]
        self.asks: dict[str, list[tuple[int, int]]] = {}
        for b, boundary in enumerate(boundaries):
            for turn, mark in enumerate(boundary.indicators):
                if mark and "\n" not in mark:
                    self.asks.setdefault(mark, []).append((b, turn))
        self.automaton = ahocorasick.Automaton()
        for mark in self.asks:
            self.automaton.add_word(mark, mark)
        if self.asks:
            self.automaton.make_automaton()

    def hits(self, path: str | None, text: str) -> Iterator[tuple[str, int, str]]:
        """(boundary, line, indicator) by line; the first indicator of a boundary that the line holds counts, once.

        Of an indicator, the first place in the line decides whether a quote sign precedes it.
        """
        if not self.asks:
            return
        starts, seen, best = [0], set(), {}
        at = text.find("\n")
        while at >= 0:
            starts.append(at + 1)
            at = text.find("\n", at + 1)
        closed = [path is None or any(g.search(path) for g in globs) for globs in self.allowed]
        for end, mark in self.automaton.iter(text):
            first = end - len(mark) + 1
            line = bisect_right(starts, first) - 1
            if (line, mark) in seen:
                continue
            seen.add((line, mark))
            k = first
            while k > starts[line] and text[k - 1] == " ":
                k -= 1
            if k > starts[line] and text[k - 1] in QUOTES:
                continue
            for b, turn in self.asks[mark]:
                if not closed[b] and turn < best.get((line, b), (len(text) + 1 << 20,))[0]:
                    best[line, b] = turn, mark
        for (line, b), (_, mark) in sorted(best.items()):
            yield self.names[b], line + 1, mark


def marked_lines(sources: DataFrame, boundaries: list) -> DataFrame:
    """(boundary, path, line, indicator) of ``sources`` (path, content): lines with an indicator that no quote sign precedes.

    A line counts once for a boundary, with the first of its indicators that it holds. Paths that a boundary allows give no hits, nor do null paths. A
    null text has none, an empty indicator or one with a line break fits nowhere. Bytes that aren't UTF-8 fit no indicator.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(boundaries)
        for batch in batches:
            rows = [(b, path, line, mark) for path, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for b, line, mark in finder.hits(path and path.decode("utf-8", "surrogateescape"), (text.as_py() or b"").decode("utf-8", "surrogateescape"))]
            names, where, lines, marks = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(where, pa.binary()), pa.array(lines, pa.int64()), pa.array(marks, pa.string())], names=["boundary", "path", "line", "indicator"])

    found = sources.select(F.col("path").cast("binary"), F.col("content").cast("binary")).mapInArrow(run, HIT.replace("path string", "path binary"))
    return found.withColumn("path", F.col("path").cast("string"))
