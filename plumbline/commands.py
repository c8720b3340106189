"""The command line: analyze (also without a command), ai, impact, snapshot, diff, graph, init and mcp."""

from __future__ import annotations

import argparse
import json
import sys
import webbrowser
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import engine
from .errors import PathNotFound, PlumblineError, ReadError
from .operators import resolve
from .plans import contexts, documents
from .sources import config, parse
from .sources.tree import EVERY, SourceTree
from .streaming.watch import watch

CONFIG = "plumbline.toml"
COMMANDS = ("analyze", "ai", "impact", "snapshot", "diff", "graph", "init", "mcp")


def session() -> SparkSession:
    """The session; on one machine with as many shuffle partitions as cores, unless they are set."""
    spark = SparkSession.builder.appName("plumbline").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.getConf().contains("spark.sql.shuffle.partitions"):
        spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    return spark


class Project:
    """A source tree, its configuration and its analysis."""

    def __init__(self, spark: SparkSession, root: str | Path, languages: str | None = None, exclude: Iterable[str] = ()):
        where = Path(root)
        if not where.exists():
            raise PathNotFound(str(root))
        self.spark, self.root, self.languages, self.exclude = spark, str(where.resolve()), languages or "", ",".join(exclude)
        self.config = config.load(where / CONFIG)
        spark.dataSource.register(SourceTree)

    def sources(self) -> DataFrame:
        return self.spark.read.format("source_tree").option("root", self.root).option("languages", self.languages).option("exclude", self.exclude).load()

    def watched(self, react):
        """A query that calls ``react(changes, tick)`` whenever a file of the tree changes, of any name: the configuration is one."""
        return watch(self.spark, self.root, react, languages=EVERY, exclude=self.exclude)

    def analysis(self, **limits) -> engine.Analysis:
        return engine.analyze(self.sources().select("path", "content"), self.config, **limits)

    def find(self, file: str) -> str:
        """The file's path as the tree's table has it, given from here or from the project's root."""
        for candidate in (Path(self.root) / file, Path(file)):
            if candidate.is_file():
                return str(candidate.resolve())
        raise PathNotFound(file)

    def report(self, found: engine.Analysis, form: str = "markdown", severity: str = "info") -> Iterator[str]:
        """The issues; as JSON all of them, whatever the severity."""
        if form == "json":
            yield "{\n" + f'  "project": {json.dumps(contexts.paths_name(self.root))},\n  "module_count": {found.modules.count()},\n'
            located = documents._located(found, self.root).drop("issue_id").select("*", F.to_json(F.struct("*")).alias("j")).orderBy("kind", "message")
            yield from documents._list("issues", (j for (j,) in contexts._rows(located, "j")), last=True)
            yield "}\n"
            return
        yield f"# Architecture of {contexts.paths_name(self.root)}\n\n"
        some = False
        for (line,) in contexts._rows(engine.report_sections(found, severity), "line"):
            some = True
            yield line.replace(self.root + "/", "") + "\n"
        if not some:
            yield "No issues.\n"
        if skipped := found.skipped.count():
            yield f"\n{skipped} files couldn't be parsed and are left out.\n"

    def context(self, form: str = "markdown", tokens: int | None = None, signatures: bool = False, topological: bool = True, vocabulary: str | None = None) -> Iterator[str]:
        made = contexts.Context(self.analysis(), self.root, signatures, topological)
        if form == "json":
            return contexts.as_json(made)
        if form == "xml":
            return contexts.as_xml(made)
        return contexts.markdown(made) if tokens is None else contexts.budgeted(made, tokens, vocabulary)

    def impact(self, file: str, depth: int | None = None, form: str = "markdown", tree: bool = False) -> Iterator[str]:
        target, sources = self.find(file), self.sources().select("path", "content")
        edges = resolve.by_path(parse.modules(sources).where("parse_error IS NULL"))
        return documents.impact_document(engine.impact(sources, target, depth), edges, target, self.root, form, tree)


@contextmanager
def _output(path: str | None):
    if path is None:
        yield sys.stdout
    else:
        try:
            f = open(path, "w", encoding="utf-8")  # noqa: SIM115
        except OSError as e:
            raise ReadError(str(e)) from e
        with f:
            yield f


def _write(pieces: Iterable[str], path: str | None = None) -> None:
    with _output(path) as f:
        for x in pieces:
            f.write(x)
        f.flush()


def analyze(a: argparse.Namespace) -> int:
    project = Project(session(), a.path, a.lang, a.exclude)

    def once() -> int:
        found = project.analysis(max_depth=a.max_depth, min_cohesion=a.min_cohesion)
        _write(project.report(found, a.format, a.min_severity), a.output)
        return int(not found.issues.where("severity = 'error'").isEmpty())

    code = once()
    if a.watch:
        project.watched(lambda changes, tick: once()).awaitTermination()
    return code


def ai(a: argparse.Namespace) -> int:
    _write(Project(session(), a.path, a.lang).context(a.format, a.tokens, a.signatures, a.topo_order, a.vocabulary), a.output)
    return 0


def impact(a: argparse.Namespace) -> int:
    _write(Project(session(), a.path, a.lang).impact(a.file, a.depth, a.format, a.tree), a.output)
    return 0


def snapshot(a: argparse.Namespace) -> int:
    project = Project(session(), a.path, a.lang)
    _write(documents.snapshot(project.analysis(), project.root), a.save)
    return 0


def diff(a: argparse.Namespace) -> int:
    """The present tree against a saved snapshot; its own snapshot lies in the shared folder meanwhile."""
    project = Project(session(), a.path, a.lang)
    base = documents.Saved(project.spark, Path(a.baseline).resolve(strict=True).as_uri())
    now = documents.Saved(project.spark, documents.kept(project.spark, documents.snapshot(project.analysis(), project.root)))
    found = documents.Difference(base, now)
    _write(found.as_json() if a.format == "json" else found.as_markdown(), a.output)
    return int(a.fail_on_regression and found.regressed())


def graph(a: argparse.Namespace) -> int:
    project = Project(session(), a.path, a.lang)
    text = lambda: "".join(documents.graph_json(project.analysis(), project.root))
    if a.export:
        _write([documents.page(text())], a.export)
    if a.serve or not a.export:
        from .serve import GraphServer

        server = GraphServer(text(), a.port)
        if a.watch:
            project.watched(lambda changes, tick: server.replace(text()))
        print(f"http://127.0.0.1:{server.port}/", file=sys.stderr)
        if a.open:
            webbrowser.open(f"http://127.0.0.1:{server.port}/")
        server.run()
    return 0


def init(a: argparse.Namespace) -> int:
    where = Path(a.path) / CONFIG
    try:
        with open(where, "x", encoding="utf-8") as f:
            f.write(config.template())
    except FileExistsError:
        print(f"{where} exists already", file=sys.stderr)
        return 1
    return 0


def mcp(a: argparse.Namespace) -> int:
    from .tools import manifest, serve

    if a.manifest:
        print(json.dumps(manifest(), indent=2))
        return 0
    serve(session(), a.path, sys.stdin, sys.stdout)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    subs = top.add_subparsers(dest="command", required=True)

    def add(name: str, f, path: bool = True, lang: bool = True, formats: tuple[str, ...] = ()) -> argparse.ArgumentParser:
        p = subs.add_parser(name)
        p.set_defaults(run=f)
        if lang:
            p.add_argument("--lang", help="languages, separated by commas")
        if formats:
            p.add_argument("-f", "--format", choices=formats, default="markdown")
            p.add_argument("-o", "--output")
        if path:
            p.add_argument("path", nargs="?", default=".")
        return p

    p = add("analyze", analyze, formats=("markdown", "json"))
    p.add_argument("--min-severity", choices=("info", "warn", "warning", "error"), default="info")
    p.add_argument("-w", "--watch", action="store_true")
    p.add_argument("--max-depth", type=int, default=5)
    p.add_argument("--min-cohesion", type=float, default=0.3)
    p.add_argument("-x", "--exclude", action="append", default=[], metavar="DIR")
    p = add("ai", ai, formats=("markdown", "json", "xml"))
    p.add_argument("--tokens", type=int)
    p.add_argument("--vocabulary", metavar="FILE", help="a tokenizer's JSON file; without it a token is four bytes")
    p.add_argument("--signatures", action="store_true")
    p.add_argument("--topo-order", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--priority", choices=("fan-in", "fan-out", "combined"), default="fan-in", help="accepted; the score is always the combined one")
    p = add("impact", impact, path=False, formats=("markdown", "json"))
    p.add_argument("file")
    p.add_argument("--path", default=".")
    p.add_argument("-d", "--depth", type=int)
    p.add_argument("--tree", action="store_true")
    p = add("snapshot", snapshot)
    p.add_argument("--save", required=True)
    p = add("diff", diff, path=False, formats=("markdown", "json"))
    p.add_argument("baseline")
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("--fail-on-regression", action="store_true")
    p = add("graph", graph)
    p.add_argument("--serve", action="store_true")
    p.add_argument("--port", type=int, default=3000)
    p.add_argument("--open", action="store_true")
    p.add_argument("-w", "--watch", action="store_true")
    p.add_argument("--export")
    add("init", init, lang=False)
    add("mcp", mcp, lang=False).add_argument("--manifest", action="store_true", help="print what the tools are and how to start them")
    return top


def main(arguments: list[str] | None = None) -> int:
    given = list(sys.argv[1:] if arguments is None else arguments)
    if not given or given[0] not in (*COMMANDS, "-h", "--help"):
        given.insert(0, "analyze")
    a = parser().parse_args(given)
    try:
        return a.run(a)
    except (PathNotFound, FileNotFoundError) as e:
        print(f"not found: {e}", file=sys.stderr)
    except (PlumblineError, OSError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
    return 2
