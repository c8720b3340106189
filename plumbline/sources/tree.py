"""A source tree as a table: a Python data source, as Spark's own readers skip names that start with _ or a dot.

``spark.dataSource.register(SourceTree)``, then ``spark.read.format("source_tree").option("root", ...)``. The
tree must be visible under the same path on every machine. Hidden names, folders to leave out and, within a
repository, what its .gitignore files name are pruned while listing; files are read by the tasks.
"""

from __future__ import annotations

import os
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Extensions by language.
LANGUAGES = {"rust": ["rs"], "typescript": ["ts", "tsx", "js", "jsx"], "python": ["py"]}


#: In place of languages: files of any name.
EVERY = "*"


def extensions(languages: str) -> set[str] | None:
    """Extensions of the comma-separated languages; unknown ones don't count, and without a known one all do. None, for EVERY, is any."""
    if languages.strip() == EVERY:
        return None
    known = [x for x in (y.strip().lower() for y in languages.split(",")) if x in LANGUAGES]
    return {e for x in known or LANGUAGES for e in LANGUAGES[x]}


_GLOB = re.compile(r"/\*\*/|\*\*/|/\*\*|\*+|\?|\[!?[^\]]+\]|\\.|[^*?\[\\/]+|.")


def ignore_rules(text: str) -> list[tuple[re.Pattern, bool, bool]]:
    """What the lines of a .gitignore say: (paths below its folder, whether they are kept again, whether only folders count)."""
    special = {"/**/": "/(?:.*/)?", "**/": "(?:.*/)?", "/**": "/.*", "?": "[^/]"}
    rules = []
    for line in (x.rstrip() for x in text.splitlines()):
        keep, glob = line.startswith("!"), line.removeprefix("!")
        if not glob.strip("/") or line.startswith("#"):
            continue
        near = "" if "/" in glob.rstrip("/") else "(?:.*/)?"
        parts = []
        for x in _GLOB.findall(glob.strip("/")):
            if x in special:
                parts.append(special[x])
            elif x[0] == "*":
                parts.append("[^/]*")
            elif x[0] == "[" and len(x) > 1:
                parts.append("[^" + x[2:] if x[1] == "!" else x)
            else:
                parts.append(re.escape(x[1:] if x[0] == "\\" and len(x) > 1 else x))
        try:
            rules.append((re.compile(near + "".join(parts)), keep, glob.endswith("/")))
        except re.error:
            continue  # a class that is none
    return rules


def _rules_of(folder: str) -> list[tuple[str, list]]:
    try:
        return [(folder, ignore_rules(Path(folder, ".gitignore").read_text(encoding="utf-8", errors="replace")))]
    except OSError:
        return []


def _ignored(path: str, is_folder: bool, rules: list[tuple[str, list]]) -> bool:
    """Whether the last rule that fits ``path`` leaves it out; rules of inner folders come last."""
    out = False
    for folder, own in rules:
        below = os.path.relpath(path, folder)
        for pattern, keep, folders_only in own:
            if (is_folder or not folders_only) and pattern.fullmatch(below):
                out = not keep
    return out


def listed(root: str, languages: str = "", exclude: list[str] | None = None, top: set[str] | None = None) -> Iterator[str]:
    """Paths below ``root`` in order; a folder goes if its path ends in an excluded one or holds it.

    ``top`` restricts them to those below, or equal to, entries of ``root`` of these names. If ``root`` or a folder above it holds .git, the .gitignore files from there on count.
    """
    kinds, leave = extensions(languages), [x.strip("/") for x in exclude or [] if x.strip("/")]
    root = os.path.normpath(root)
    above = [Path(root).absolute(), *Path(root).absolute().parents]
    depth = next((k for k, x in enumerate(above) if (x / ".git").exists()), None)
    outer = [r for x in reversed(above[1 : depth + 1]) for r in _rules_of(str(x))] if depth is not None else []
    rules: dict[str, list] = {}
    for folder, folders, names in os.walk(root):
        own = rules[folder] = rules.get(os.path.dirname(folder), outer) + (_rules_of(folder) if depth is not None else [])
        inner = lambda x: f"/{os.path.relpath(os.path.join(folder, x), root)}/"  # noqa: B023, E731
        gone = lambda x, is_folder: x.startswith(".") or _ignored(os.path.join(folder, x), is_folder, own)  # noqa: B023, E731
        folders[:] = sorted(x for x in folders if not gone(x, True) and not any(f"/{e}/" in inner(x) for e in leave))
        if top is not None and folder == root:
            folders[:], names = [x for x in folders if x in top], [x for x in names if x in top]
        for x in sorted(names):
            if (kinds is None or x.rpartition(".")[2] in kinds) and not gone(x, False) and not any(inner(x).endswith(f"/{e}/") for e in leave):
                yield os.path.join(folder, x)


@dataclass
class _Part(InputPartition):
    paths: list[str]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.realpath(options["root"], strict=True)
        self.languages, self.exclude = options.get("languages", ""), options.get("exclude", "").split(",")
        self.each = int(options.get("files_per_task", "200"))

    def partitions(self) -> list[_Part]:
        every = list(listed(self.root, self.languages, self.exclude))
        return [_Part(every[k : k + self.each]) for k in range(0, len(every), self.each)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple[str, str, int]]:
        for path in partition.paths:
            try:
                with open(path, encoding="utf-8") as f:
                    yield path, f.read(), os.stat(path).st_mtime_ns // 1000
            except (OSError, UnicodeDecodeError):
                continue  # unreadable files are skipped, as while listing


class SourceTree(DataSource):
    """(path, content, mtime), mtime in microseconds since 1970. Options: root, languages, exclude, files_per_task."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, content string, mtime long"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


@dataclass
class _Entries(InputPartition):
    names: list[str]


class _ListingReader(DataSourceStreamReader):
    """Every scan is an offset, the time it began. Tasks list what lies below some entries of the root each.

    A scan that runs again after a failure may find a later state of the tree; who compares it with a state of their own,
    kept with the scan's results, sees each change once all the same.
    """

    def __init__(self, options: dict):
        self.root = os.path.realpath(options["root"], strict=True)
        self.languages, self.exclude = options.get("languages", ""), options.get("exclude", "").split(",")
        self.tasks = int(options.get("tasks", "8"))
        self.last = 0

    def initialOffset(self) -> dict:
        return {"scan": 0}

    def latestOffset(self) -> dict:
        self.last = max(self.last + 1, time.time_ns() // 1_000_000)
        return {"scan": self.last}

    def partitions(self, start: dict, end: dict) -> list[_Entries]:
        names = sorted(os.listdir(self.root))
        return [_Entries(names[k :: self.tasks]) for k in range(min(self.tasks, len(names)))] or [_Entries([])]

    def read(self, partition: _Entries) -> Iterator[tuple[str, int]]:
        for path in listed(self.root, self.languages, self.exclude, set(partition.names)):
            try:
                yield path, os.stat(path).st_mtime_ns // 1000
            except OSError:
                continue  # gone meanwhile

    def commit(self, end: dict) -> None:
        pass


class SourceTreeListing(DataSource):
    """A stream of whole listings, (path, mtime): each trigger lists the tree once. Options: root, languages (``*`` for files of any name), exclude, tasks."""

    @classmethod
    def name(cls) -> str:
        return "source_tree_listing"

    def schema(self) -> str:
        return "path string, mtime long"

    def streamReader(self, schema) -> _ListingReader:
        return _ListingReader(self.options)
