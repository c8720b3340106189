"""Expressions on paths, names and texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def glob_regex(glob: str) -> str:
    """The regular expression of a glob: ** spans folders, * stays in one, a plain path matches as a suffix of whole parts."""
    glob = glob.replace("\\", "/")

    def rest(g: str) -> str:
        if "**" in g:
            before, after = g.split("**", 1)
            return re.escape(before) + r"[\s\S]*" + (rest(after.removeprefix("/")) + r"\z" if after.removeprefix("/") else "")
        if "*" in g:
            before, after = g.split("*", 1)
            return re.escape(before) + "[^/]*" + rest(after)
        return r"(?:[\s\S]*/)?" + re.escape(g) + r"\z"

    return "^" + rest(glob)


def literals(glob: str) -> list[str]:
    """Texts that every path that ``glob`` matches holds, as ``glob_regex`` reads it."""
    glob, found = glob.replace("\\", "/"), []
    while True:
        mark = "**" if "**" in glob else "*"
        before, wild, glob = glob.partition(mark)
        found += [before] if before else []
        if not wild:
            return found
        if mark == "**":
            glob = glob.removeprefix("/")


def matches_any(path: Column, globs: list[str]) -> Column:
    """Whether any glob matches; none in the list, no match."""
    found = F.lit(False)
    for g in globs:
        found = found | path.rlike(glob_regex(g))
    return found


def line_count(text: Column) -> Column:
    """Lines of a text; a line break at the end starts none."""
    return F.when(text == "", 0).otherwise(F.size(F.split(text, "\n", -1)) - F.endswith(text, F.lit("\n")).cast("int")).cast("long")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]+$", 0)


def stem(path: Column) -> Column:
    """The file's name without its last extension; ``unknown`` if there is none."""
    name = F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")
    return F.when(name == "", "unknown").otherwise(name)


def package(path: Column) -> Column:
    """The name of the folder that holds the file, else ``root``."""
    name = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    return F.when(name == "", "root").otherwise(name)


def relative(path: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(root)), F.substring(path, len(root) + 1, 1_000_000)).otherwise(path)


#: What marks a test file's path.
TEST_FOLDERS = ["/tests/", "/test/", "/__tests__/"]
TEST_STARTS = ["tests/", "test/"]
TEST_ENDS = ["_test.rs", "_tests.rs", "/tests.rs", ".test.ts", ".spec.ts", "_test.py", "test_.py"]

#: A file's category by the first of these whose text its path holds.
CATEGORIES = [
    ("test", ["test"]),
    ("index", ["mod.rs", "lib.rs"]),
    ("entry", ["main.rs"]),
    ("config", ["config"]),
    ("model", ["model", "types"]),
    ("cli", ["cli", "args"]),
    ("output", ["output", "format"]),
    ("parser", ["parser", "parse"]),
    ("analysis", ["analysis", "check"]),
]


def _any(hits: list[Column]) -> Column:
    found = F.lit(False)
    for x in hits:
        found = found | x
    return found


def is_test(path: Column) -> Column:
    """Whether the path looks like a test file's."""
    return _any([F.contains(path, F.lit(x)) for x in TEST_FOLDERS] + [F.startswith(path, F.lit(x)) for x in TEST_STARTS] + [F.endswith(path, F.lit(x)) for x in TEST_ENDS])


def category(path: Column) -> Column:
    """The category of a path relative to the project; ``module`` if nothing fits."""
    found = F.lit("module")
    for name, parts in reversed(CATEGORIES):
        found = F.when(_any([F.contains(path, F.lit(x)) for x in parts]), name).otherwise(found)
    return found


def crate(imported: Column) -> Column:
    """The outside package that an import names; the standard libraries are one."""
    first = F.element_at(F.split(imported, "::"), 1)
    outside = F.when(first.isin("std", "core", "alloc"), "std").otherwise(first)
    near = F.when(imported.rlike(r"^\.\.?/"), "relative").when(first.isin("super", "self", "crate") & imported.contains("::"), "crate")
    return F.coalesce(near, outside)


def is_relative(imported: Column) -> Column:
    return imported.rlike(r"^(super::|self::|crate::|\./|\.\./)")


def escape_xml(text: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def truncated(text: Column, most: int) -> Column:
    """The first ``most`` code points."""
    return F.left(text, F.lit(most))


def delta(n: Column) -> Column:
    """A change with its sign; 0 without."""
    return F.when(n > 0, F.concat(F.lit("+"), n.cast("string"))).otherwise(n.cast("string"))


def quoted_before(line: Column, mark: str) -> Column:
    """Whether the text before the first ``mark`` ends in a quote sign."""
    return F.rtrim(F.substring_index(line, mark, 1)).rlike("[\"'`]$")
