"""The whole analysis on a small tree of sources."""

import json

import pytest

from plumbline import engine


def test_analysis(spark):
    files = [("src/hub.rs", "use crate::a::X;\npub fn f() {}\n")]
    files += [(f"src/{x}.rs", "use crate::hub::f;\nuse crate::hub::g;\nfn q() { SELECT }\n// SELECT 1\n") for x in "abc"]
    files += [("src/wide.rs", "\n".join(f"use {x}::Y;" for x in ("serde", "tokio", "std", "rand"))), ("src/bad.py", "def (")]
    files += [("src/fat.rs", "".join(f"fn p{k}() {{\n{chr(10) * 60}}}\n" for k in range(9)))]
    src = spark.createDataFrame(files, "path string, content string")
    got = engine.analyze(src)
    found = {(r.kind, r.path) for r in got.issues.collect()}
    assert {("CircularDependency", "src/a.rs"), ("HighCoupling", "src/hub.rs"), ("LowCohesion", "src/wide.rs"), ("FatModule", "src/fat.rs"), ("BoundaryViolation", None)} == found
    lines = [r.line for r in engine.report_lines(got.issues, "warn").collect()]
    assert lines[0] == "- **CircularDependency** src/a.rs: cycle: src/a.rs -> src/hub.rs" and len(lines) == 3
    assert {json.loads(r.json)["kind"] for r in engine.report_json(got.issues).collect()} == {k for k, _ in found}
    assert {(r.path, r.depth) for r in engine.impact(src, "src/hub.rs", 1).collect()} == {("src/a.rs", 1), ("src/b.rs", 1), ("src/c.rs", 1)}
    with pytest.raises(engine.PathNotFound):
        engine.impact(src, "none.rs")


def test_commas_in_paths(spark):
    files = [("src/a,b.rs", "use crate::c > d::X;\n"), ("src/c > d.rs", "use crate::a,b::X;\n")]
    got = engine.analyze(spark.createDataFrame(files, "path string, content string"))
    assert {(r.kind, r.path) for r in got.locations.collect()} == {("CircularDependency", p) for p, _ in files}
    assert [r.line for r in engine.report_sections(got).collect()][2:4] == ["  - in src/a,b.rs", "  - in src/c > d.rs"]
