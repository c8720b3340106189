"""Queries on a fixed tree of sources, with the rows they must give written out by hand."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline import engine
from plumbline.functions import paths
from plumbline.operators import graph, resolve
from plumbline.sources import config, parse

#: The tree: a cycle, a hub, a chain, crossed boundaries, long, hiding and scattered modules, three languages, an error of syntax.
SOURCES = {
    "p/core.rs": "use crate::a::X;\npub fn f() {}\n",
    "p/a.rs": "use crate::core::f;\nuse crate::core::g;\n",
    "p/b.rs": "use crate::core::f;\nuse crate::core::g;\nfn q() { SELECT * }\n",
    "p/c.rs": "use crate::core::f;\nuse crate::core::g;\nfn q() { SELECT * }\n",
    "p/d.rs": "// SELECT 1\nuse crate::core::h;\nlet s = \"SELECT 2\";\n",
    **{f"p/k{k}.rs": f"use crate::k{k + 1}::X;\n" for k in range(1, 6)},
    "p/k6.rs": "",
    "p/wide.rs": "use serde::Y;\nuse tokio::Y;\nuse std::Y;\nuse rand::Y;\n",
    "p/fat.rs": "".join(f"fn p{k}() {{\n" + "\n" * 60 + "}\n" for k in range(9)),
    "p/god.rs": "struct S0;\nstruct S1;\nstruct S2;\nstruct S3;\ntrait T {}\n" + "\n" * 500,
    "p/bad.py": "import os, sys\ndef good(a: int):\n    pass\nclass _Hidden:\n    x = = 1\n\"\"\"\nimport no\n\"\"\"\n",
    "p/ok.py": "import a.b\nfrom .x import y\n@deco\nasync def go(n: int):\n    pass\n",
    "p/view.ts": 'import { x } from "./hub"\nexport function load(a: number): string {\n  return ""\n}\ninterface Shape { side: number }\n',
    "p/notes.txt": "use crate::core::f;\n",
}
CONFIG = 'expected_high_coupling = ["**/core.rs"]\n[thresholds]\ncoupling_fanin = 9\nfat_module_lines_per_export = 50.0\nunknown = 1\n[boundaries.network]\nindicators = ["net::"]\n[boundaries.queue]\nname = "Jobs"\nindicators = ["q::"]\nallowed_in = ["**/q/**"]\nownership_threshold = 0.25\n'
CHAIN = "p/k1.rs > p/k2.rs > p/k3.rs > p/k4.rs > p/k5.rs > p/k6.rs"
#: kind, severity, path, key, message
ISSUES = [
    ("CircularDependency", "error", "p/a.rs", "p/a.rs", "cycle: p/a.rs -> p/core.rs"),
    ("GodObject", "warn", "p/god.rs", "p/god.rs", "505 lines with structs,traits"),
    ("HighCoupling", "warn", "p/core.rs", "p/core.rs", "7 imports reach it"),
    ("BoundaryViolation", "warn", None, "Persistence", "Persistence is crossed in 3 modules"),
    ("DeepDependencyChain", "warn", "p/k1.rs", CHAIN, f"6 modules: {CHAIN}"),
    ("LowCohesion", "info", "p/wide.rs", "p/wide.rs", "score 0.20, 4 outside packages: rand,serde,std"),
    ("FatModule", "info", "p/fat.rs", "p/fat.rs", "558 lines, 9 private functions"),
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def values(columns: str, rows: list[tuple]) -> str:
    """SQL of a fixed table."""
    one = lambda x: "CAST(NULL AS VARCHAR)" if x is None else str(x).lower() if isinstance(x, bool) else f"CAST({x} AS BIGINT)" if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({columns})"


def query(columns: str, rows: list[tuple]):
    """Registers a query with the rows that it must give."""

    def register(f: Callable[[SparkSession], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf: f(spark)
        ORACLE_SQL[f.__name__] = values(columns, rows)
        return f

    return register


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SOURCES.items()), "path string, content string")


@cache
def _analysis(spark: SparkSession) -> engine.Analysis:
    return engine.analyze(sources(spark))


DEFINED = [
    ("p/core.rs", "f", "Function", 2, "Public"), ("p/b.rs", "q", "Function", 3, "Private"), ("p/c.rs", "q", "Function", 3, "Private"),
    *(("p/fat.rs", f"p{k}", "Function", 62 * k + 1, "Private") for k in range(9)), *(("p/god.rs", f"S{k}", "Struct", k + 1, "Private") for k in range(4)),
    ("p/god.rs", "T", "Trait", 5, "Private"), ("p/bad.py", "good", "Function", 2, "Public"), ("p/bad.py", "_Hidden", "Class", 4, "Private"),
    ("p/ok.py", "go", "Function", 4, "Public"), ("p/view.ts", "load", "Function", 2, "Public"), ("p/view.ts", "Shape", "Interface", 5, "Private"),
]


@query("path, name, kind, line, visibility", DEFINED)
def sample_definitions(spark):
    return parse.modules(sources(spark)).select("path", F.explode("definitions").alias("d")).select("path", "d.name", "d.kind", "d.line", "d.visibility")


@query("path, name, signature", [
    ("p/core.rs", "f", "pub fn f()"), ("p/b.rs", "q", "fn q()"), ("p/c.rs", "q", "fn q()"), *(("p/fat.rs", f"p{k}", f"fn p{k}()") for k in range(9)),
    ("p/bad.py", "good", "def good(a"), ("p/ok.py", "go", "async def go(n"), ("p/view.ts", "load", "function load(a: number): string"),
])
def sample_signatures(spark):
    each = parse.modules(sources(spark)).select("path", F.explode("definitions").alias("d"))
    return each.where("d.kind = 'Function'").select("path", "d.name", "d.signature")


@query("path, pos, imported", [
    ("p/core.rs", 0, "crate::a::X"), *((f"p/{x}.rs", k, f"crate::core::{y}") for x in "abc" for k, y in enumerate("fg")), ("p/d.rs", 0, "crate::core::h"),
    *((f"p/k{k}.rs", 0, f"crate::k{k + 1}::X") for k in range(1, 6)), *(("p/wide.rs", k, f"{x}::Y") for k, x in enumerate(("serde", "tokio", "std", "rand"))),
    ("p/bad.py", 0, "os"), ("p/bad.py", 1, "sys"), ("p/ok.py", 0, "a.b"), ("p/ok.py", 1, ".x"), ("p/view.ts", 0, "./hub"),
])
def sample_imports(spark):
    return resolve.import_rows(parse.modules(sources(spark))).select(F.col("src").alias("path"), F.col("pos").cast("long").alias("pos"), "imported")


@query("path, name, lines, exported", [
    ("p/core.rs", "core", 2, "f"), ("p/bad.py", "bad", 8, "good"), ("p/ok.py", "ok", 5, "go"), ("p/view.ts", "view", 5, "load"), ("p/a.rs", "a", 2, ""), ("p/b.rs", "b", 3, ""),
    ("p/c.rs", "c", 3, ""), ("p/d.rs", "d", 3, ""), *((f"p/k{k}.rs", f"k{k}", int(k < 6), "") for k in range(1, 7)), ("p/wide.rs", "wide", 4, ""), ("p/fat.rs", "fat", 558, ""), ("p/god.rs", "god", 505, ""),
])
def sample_modules(spark):
    return parse.modules(sources(spark)).select("path", "name", "lines", F.array_join("exports", ",").alias("exported"))


@query("src, dst, pos", [("p/core.rs", "p/a.rs", 0), *((f"p/{x}.rs", "p/core.rs", k) for x in "abc" for k in (0, 1)), ("p/d.rs", "p/core.rs", 0), *((f"p/k{k}.rs", f"p/k{k + 1}.rs", 0) for k in range(1, 6))])
def sample_edges(spark):
    return resolve.by_path(parse.modules(sources(spark))).select("src", "dst", F.col("pos").cast("long").alias("pos"))


@query("kind, severity, path, key, message", ISSUES)
def sample_issues(spark):
    return _analysis(spark).issues.select("kind", "severity", "path", "key", "message")


@query("kind, key, path", [
    *(("CircularDependency", "p/a.rs", f"p/{x}.rs") for x in ("a", "core")), *(("BoundaryViolation", "Persistence", f"p/{x}.rs") for x in "bcd"),
    *(("DeepDependencyChain", CHAIN, f"p/k{k}.rs") for k in range(1, 7)), *((kind, path, path) for kind, _, path, _, _ in ISSUES if kind in ("GodObject", "HighCoupling", "LowCohesion", "FatModule")),
])
def sample_locations(spark):
    return _analysis(spark).locations.select("kind", "key", "path")


@query("cycle_count, issues, errors, warnings", [(1, 7, 1, 4)])
def sample_totals(spark):
    severity = F.col("severity")
    return _analysis(spark).issues.agg(F.count_if(F.col("kind") == "CircularDependency").alias("cycle_count"), F.count("*").alias("issues"), F.count_if(severity == "error").alias("errors"), F.count_if(severity == "warn").alias("warnings"))


@query("kind_rank, pos, line", [
    *((k, 1, f"- **{kind}** {path or ''}: {message}") for k, (kind, _, path, _, message) in enumerate(ISSUES)), *((k, 0, f"\n## {kind} (1, {severity})\n") for k, (kind, severity, _, _, _) in enumerate(ISSUES)),
    *((k, 8, f"  - advice: {x}") for k, x in enumerate(("DECOUPLE", "EXTRACT", "INTERFACE", "CENTRALIZE", "FLATTEN", "FOCUS", "EXTRACT"))),
    (0, 2, "  - in p/a.rs"), (0, 3, "  - in p/core.rs"), *((3, k + 2, f"  - in p/{x}.rs") for k, x in enumerate("bcd")), *((4, k + 1, f"  - in p/k{k}.rs") for k in range(1, 6)), (4, 7, "  - and 1 more"),
])
def sample_report(spark):
    return engine.report_sections(_analysis(spark)).select(F.col("kind_rank").cast("long").alias("kind_rank"), F.col("pos").cast("long").alias("pos"), "line")


@query("path, depth", [(f"p/k{k}.rs", 6 - k) for k in range(1, 6)])
def sample_impact(spark):
    return engine.impact(sources(spark), "p/k6.rs").select("path", F.col("depth").cast("long").alias("depth"))


@query("path, depth", [("p/k5.rs", 1), ("p/k4.rs", 2)])
def sample_impact_two(spark):
    return engine.impact(sources(spark), "p/k6.rs", 2).select("path", F.col("depth").cast("long").alias("depth"))


@query("path, layer", [("p/k1.rs", 0), *((f"p/k{k}.rs", k - 1) for k in range(2, 7)), *((f"p/{x}", 0) for x in ("b.rs", "c.rs", "d.rs", "wide.rs", "fat.rs", "god.rs", "bad.py", "ok.py", "view.ts"))])
def sample_layers(spark):
    found = _analysis(spark)
    return graph.layers(found.modules, found.edges).where("layer IS NOT NULL").select("path", F.col("layer").cast("long").alias("layer"))


@query("name, value", [
    ("expected", "**/core.rs"), ("coupling_fanin", "9"), ("lines_per_export", "50.0"), ("god_object_lines", "500"), ("max_dependency_depth", "5"), ("min_cohesion", "0.3"), ("boundary_violation_min", "2"),
    ("fat_module_lines", "400"), ("fat_module_private_functions", "8"), ("Network", "net:: in **/client/**,**/api/**,**/http/**,**/network/** from 0.5"), ("Jobs", "q:: in **/q/** from 0.25"),
])
def sample_config(spark):
    c = config.parse(CONFIG)
    rows = [("expected", ",".join(c.expected_high_coupling)), *((k, str(x)) for k, x in vars(c.thresholds).items()), *((b.name, f"{','.join(b.indicators)} in {','.join(b.allowed_in)} from {b.ownership}") for b in c.boundaries)]
    return spark.createDataFrame(rows, "name string, value string")


TESTS = ["a/tests/x.rs", "tests/x.rs", "test/x.rs", "a/test/x.py", "a/__tests__/x.ts", "a_test.rs", "a_tests.rs", "a/tests.rs", "a.test.ts", "a.spec.ts", "a_test.py", "a/test_.py"]
OTHERS = ["a/testing/x.rs", "a/latest.rs", "tests.rs", "a/contests/x.rs", "a.test.tsx", "test_a.py", "attest/x.rs"]


@query("path, is_test", [*((x, True) for x in TESTS), *((x, False) for x in OTHERS)])
def sample_test_paths(spark):
    return spark.createDataFrame([(x,) for x in (*TESTS, *OTHERS)], "path string").select("path", paths.is_test(F.col("path")).alias("is_test"))


#: path, glob, whether it matches
GLOBS = [
    ("src/mydb/x.rs", "**/db/**", True), ("src/myfs.rs", "**/fs.rs", True), ("a/model/x/y.rs", "**/model/**", True), ("a/models.rs", "**/model/**", False), ("a/b/c.rs", "a/*.rs", False),
    ("a/c.rs", "a/*.rs", True), ("x/y/main.rs", "main.rs", True), ("x/domain.rs", "main.rs", False), ("a.rs", "b.rs", False),
]


@query("path, pattern, matches", GLOBS)
def sample_globs(spark):
    own = spark.createDataFrame([r[:2] for r in GLOBS], "path string, pattern string")
    hit = F.lit(False)
    for glob in sorted({r[1] for r in GLOBS}):
        hit = F.when(F.col("pattern") == glob, paths.matches_any(F.col("path"), [glob])).otherwise(hit)
    return own.withColumn("matches", hit)
