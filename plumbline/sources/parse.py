"""From source texts to modules: imports, exports and top-level definitions.

Rust items are found by blanking comments and literals and following brackets; Python's by its own syntax tree,
or line by line where the syntax is wrong; scripts have a module of their own. A definition's signature is the text up to its body for functions and impls, the
whole text for others.
Only the top level of a file counts. A text that can't be read keeps its lines and gets ``parse_error``.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions import paths
from .scripts import parse_script

MODULE = "path string, imports array<string>, exports array<string>, definitions array<struct<name:string,kind:string,line:bigint,visibility:string,signature:string>>, parse_error string, content string"

_LITERAL = re.compile(
    r"""//[^\n]*|(?P<block>/\*)|b?r(?P<hash>\#*)"[\s\S]*?"(?P=hash)|b?"(?:\\[\s\S]|[^"\\])*"|b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\])'"""
)
_ITEM = re.compile(r"(?P<seen>pub(?:\s*\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern(?:\s+\"?\s*\"?)?)\s+)*?(?P<what>use|fn|struct|enum|trait|impl|type|const|static|mod)\b\s*(?:mut\s+)?(?P<name>[A-Za-z_]\w*)?")
#: Kinds of Rust items.
_KINDS = {"fn": "Function", "struct": "Struct", "enum": "Enum", "trait": "Trait", "impl": "Impl", "type": "Type", "const": "Constant", "static": "Constant"}


def blanked(source: str) -> str:
    """The text with comments and literals as spaces, line breaks kept; block comments may nest."""
    out, at = [], 0
    while found := _LITERAL.search(source, at):
        end = found.end()
        if found["block"]:
            depth = 1
            while depth and (mark := re.compile(r"/\*|\*/").search(source, end)):
                depth += 1 if mark[0] == "/*" else -1
                end = mark.end()
            end = len(source) if depth else end
        out += [source[at : found.start()], re.sub(r"[^\n]", " ", source[found.start() : end])]
        at = end
    return "".join([*out, source[at:]])


_SIGN, _FIRST, _SQUARE = re.compile(r"[{}()\[\];]"), re.compile(r"\S"), re.compile(r"[\[\]]")
_ATTRIBUTE, _USE = re.compile(r"#!?\["), re.compile(r"(pub\b[^;]*?)?use\b")


def rust_items(source: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, blanked text) of each top-level item, attributes before it left out; goes from bracket to bracket."""
    code, end = blanked(source), 0
    while found := _FIRST.search(code, end):
        start, depth, end = found.start(), 0, len(code)
        attribute = _ATTRIBUTE.match(code, start)
        for sign in (_SQUARE if attribute else _SIGN).finditer(code, start):
            c = sign[0]
            depth += (c in "{([") - (c in "})]")
            if depth == 0 and (attribute or c == ";" or c == "}" and not _USE.match(code, start, sign.start())):
                end = sign.end()
                if not attribute:
                    yield start, end, code[start:end]
                break


def parse_rust(source: str) -> tuple[list, list, list]:
    imports, exports, definitions = [], [], []
    for a, z, code in rust_items(source):
        m = _ITEM.match(code)
        if not m:
            continue
        text, what, name = source[a:z], m["what"], m["name"]
        seen = (m["seen"] or "").strip()
        visibility = "Private" if not seen else "Crate" if "crate" in seen else "Public"
        if what == "use":
            imports.append(text.removeprefix("use ").rstrip(";").strip())
        elif what == "mod":
            if visibility == "Public" and name:
                exports.append(name)
        elif what == "impl":
            first = text.split("\n", 1)[0].split("{", 1)[0].strip()
            definitions.append((first.removeprefix("impl").strip(), "Impl", source.count("\n", 0, a) + 1, "Private", source[a : a + max(code.find("{"), 0)].strip()))
        elif name:
            brace = code.find("{")
            signature = source[a : a + brace].strip() if brace >= 0 else text.rstrip(";").strip()
            definitions.append((name, _KINDS[what], source.count("\n", 0, a) + 1, visibility, signature if what == "fn" else text))
            if visibility == "Public":
                exports.append(name)
    return imports, exports, definitions


_PY_LITERAL = re.compile(r"""#[^\n]*|(?P<q>\"{3}|'{3})[\s\S]*?(?:(?P=q)|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""")
_PY_ITEM = re.compile(r"^(?:import[ \t]+(?P<names>[^\n;]+)|from[ \t]+(?P<origin>[.\w]+)[ \t]+import\b|(?:async[ \t]+)?(?P<what>def|class)[ \t]+(?P<name>\w+))", re.M)


def scan_python(source: str) -> tuple[list, list, list]:
    """What lines that start with import, from, def or class say: for texts that Python itself can't read."""
    code = _PY_LITERAL.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)
    imports, exports, definitions = [], [], []
    for m in _PY_ITEM.finditer(code):
        if m["names"]:
            imports += [x.strip() for x in m["names"].split(",") if x.strip() and " as " not in x]
        elif m["origin"]:
            imports.append(m["origin"])
        else:
            visibility = "Private" if m["name"].startswith("_") else "Public"
            signature = source[m.start() :].split("\n", 1)[0].split(":", 1)[0].strip()
            definitions.append((m["name"], "Class" if m["what"] == "class" else "Function", source.count("\n", 0, m.start()) + 1, visibility, signature))
            if visibility == "Public":
                exports.append(m["name"])
    return imports, exports, definitions


def parse_python(source: str) -> tuple[list, list, list]:
    try:
        body = ast.parse(source).body
    except (SyntaxError, ValueError, RecursionError):
        return scan_python(source)
    imports, exports, definitions = [], [], []
    rows = source.split("\n")
    for node in body:
        if isinstance(node, ast.Import):
            imports += [x.name for x in node.names if not x.asname]
        elif isinstance(node, ast.ImportFrom):
            imports.append("." * node.level + (node.module or ""))
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            visibility = "Private" if node.name.startswith("_") else "Public"
            text = "\n".join(rows[node.lineno - 1 :])
            definitions.append((node.name, "Class" if isinstance(node, ast.ClassDef) else "Function", node.lineno, visibility, text.split(":", 1)[0].strip()))
            if visibility == "Public":
                exports.append(node.name)
    return imports, exports, definitions


#: Parsers by extension: a text's imports, exports and definitions (name, kind, line, visibility, signature). ``register_language`` adds others.
PARSERS = {"rs": parse_rust, "py": parse_python, **dict.fromkeys(("ts", "tsx", "js", "jsx"), parse_script)}


def register_language(extension: str, parser: Callable[[str], tuple[list, list, list]]) -> None:
    """From now on ``modules``, and ``source_definitions`` once it is registered again, read files with this extension.

    Queries take the parsers with them as they stand when the query is made. A parser gives imports, exports and definitions (name,
    kind, line, visibility, signature), and may raise SyntaxError, ValueError or RecursionError.
    """
    PARSERS[extension.removeprefix(".")] = parser


def register_sql(spark: SparkSession, name: str = "source_definitions") -> None:
    """A table function for SQL, ``source_definitions(TABLE(...))``: (path, name, kind, line, visibility, signature) of rows with columns path and content.

    Rows stay in the partitions they are in. Other columns are left aside, and so are files without a parser and texts that it can't read; a null text is empty.
    """
    parsers = dict(PARSERS)
    fields = ("name", "kind", "line", "visibility", "signature")

    class Definitions:
        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable or not {"path", "content"} <= set(rows.dataType.names):
                raise ValueError("source_definitions needs a TABLE with the columns path and content")
            schema = StructType().add("path", "string")
            for f in fields:
                schema.add(f, "long" if f == "line" else "string")
            return AnalyzeResult(schema)

        def eval(self, row):
            parser = parsers.get((row["path"] or "").rpartition(".")[2])
            if parser:
                try:
                    yield from ((row["path"], *d) for d in parser(row["content"] or "")[2])
                except (SyntaxError, ValueError, RecursionError):
                    return

    spark.udtf.register(name, udtf(Definitions))


def modules(sources: DataFrame) -> DataFrame:
    """(path, name, lines, imports, exports, definitions, parse_error, content) of ``sources`` (path, content) with a known extension, in one pass."""
    parsers = dict(PARSERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                error = None
                try:
                    got = parsers[path.rsplit(".", 1)[1]](content)
                except (SyntaxError, ValueError, RecursionError) as e:
                    got, error = ([], [], []), str(e)
                out.append((path, *got[:2], [dict(zip(("name", "kind", "line", "visibility", "signature"), d, strict=True)) for d in got[2]], error, content))
            yield pd.DataFrame(out, columns=["path", "imports", "exports", "definitions", "parse_error", "content"])

    known = sources.where(F.regexp_extract("path", r"\.([^./]+)$", 1).isin(*parsers)).select("path", F.coalesce("content", F.lit("")).alias("content"))
    parsed = known.mapInPandas(run, MODULE)
    return parsed.select("path", paths.stem(F.col("path")).alias("name"), paths.line_count(F.col("content")).alias("lines"), "imports", "exports", "definitions", "parse_error", "content")
