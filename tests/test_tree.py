"""The source tree reader and the watch on it."""

import os
import time

from plumbline.shared import settings
from plumbline.sources import parse, tree
from plumbline.streaming.watch import STORE, changes, tree_listings, watch


def test_tree_and_watch(spark, tmp_path):
    for name, text in {"src/a.rs": "fn f() {}", "src/__init__.py": "import x", "__tests__/b.ts": "", ".hidden/c.rs": "", "target/d.rs": "", "src/target2.rs": "", "n.txt": ""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    spark.dataSource.register(tree.SourceTree)
    read = lambda **o: spark.read.format("source_tree").options(root=str(tmp_path), exclude="target", **o).load()
    base = len(str(tmp_path)) + 1
    assert {r.path[base:] for r in read().collect()} == {"src/a.rs", "src/__init__.py", "__tests__/b.ts", "src/target2.rs"}
    assert {r.path[base:] for r in read(languages="python,cobol").collect()} == {"src/__init__.py"}
    assert {r.path[base:]: r.imports for r in parse.modules(read()).collect()}["src/__init__.py"] == ["x"]
    seen = []
    query = watch(spark, str(tmp_path), lambda changes, tick: seen.append({(r.path[base:], r.status) for r in changes.collect()}), exclude="target")
    try:
        until = time.time() + 60
        while time.time() < until and not (query.lastProgress and query.lastProgress["batchId"] >= 1):
            time.sleep(0.5)
        (tmp_path / "src/new.rs").write_text("")
        (tmp_path / "src/a.rs").unlink()
        while time.time() < until and len(set().union(*seen)) < 2:  # the changes may fall into two ticks
            time.sleep(0.5)
    finally:
        query.stop()
    assert set().union(*seen) >= {("src/new.rs", "added")} and {("src/a.rs", "deleted")} <= set().union(*seen)


def test_changes_are_given_once(spark, tmp_path):
    """The query stops and starts again from its checkpoint; a file sink takes each change once."""
    root, out, at = tmp_path / "tree", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for name in ("a/x.py", "b/y.py", "z.py", "n.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("")

    def run(*want: tuple[str, str]) -> None:
        with settings(spark, spark__sql__streaming__stateStore__providerClass=STORE):
            query = changes(tree_listings(spark, str(root))).writeStream.option("checkpointLocation", at).trigger(processingTime="0 seconds").start(out, "parquet")
        try:
            until = time.time() + 90
            while time.time() < until and query.isActive and not set(want) <= set(got()):
                time.sleep(0.5)
            assert query.exception() is None
        finally:
            query.stop()

    def got() -> list[tuple[str, str]]:
        try:
            return sorted((r.path[len(str(root)) + 1 :], r.status) for r in spark.read.schema("path string, status string, mtime long").parquet(out).collect())
        except Exception:  # nothing is written yet
            return []

    first = [("a/x.py", "added"), ("b/y.py", "added"), ("z.py", "added")]
    run(*first)
    assert got() == sorted(first)
    (root / "z.py").unlink()
    (root / "b/new.py").write_text("")
    os.utime(root / "a/x.py", (1, 1))
    later = [("z.py", "deleted"), ("b/new.py", "added"), ("a/x.py", "modified")]
    run(*later)
    assert got() == sorted(first + later)
    (root / "w.py").write_text("")
    run(("w.py", "added"))
    assert sorted(got()) == sorted([*first, *later, ("w.py", "added")])


def test_gitignore(tmp_path, monkeypatch):
    root = tmp_path / "repo/inner"
    ignored = "# build\n/out\n*.gen.rs\n!keep.gen.rs\nlogs/\n**/tmp/*.py\na/**/z.rs\n[!a]x.rs\n\\!odd.rs\n[\n"
    names = ["out/a.rs", "b/out/a.rs", "x.gen.rs", "keep.gen.rs", "c/logs/a.rs", "logs.rs", "d/tmp/a.py", "d/tmp/e/a.py", "a/z.rs", "a/b/c/z.rs", "ax.rs", "bx.rs", "!odd.rs", "own/skip.rs", "own/in/skip.rs"]
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("")
    (root / ".gitignore").write_text(ignored)
    (root / "own/.gitignore").write_text("/skip.rs\n")
    (root.parent / ".gitignore").write_text("bx.rs\nlogs.rs\n")
    got = lambda: {str(x)[len(str(root)) + 1 :] for x in tree.listed(str(root))}
    assert got() == set(names)
    (root.parent / ".git").mkdir()
    assert got() == {"b/out/a.rs", "keep.gen.rs", "d/tmp/e/a.py", "ax.rs", "own/in/skip.rs"}
    monkeypatch.chdir(root.parent)
    assert set(tree.listed("inner/")) == {f"inner/{x}" for x in got()}
