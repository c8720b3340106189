"""Parsers and configuration."""

import pytest

from plumbline.operators import resolve
from plumbline.sources import config, parse, scripts

RUST = '''
#![allow(x)]
use crate::model::Module;
pub use crate::m::{a, b};
/* fn no() { /* nested */ } */
#[derive(Debug)]
pub struct S { x: u32 }
fn private<'a>(x: &'a str) -> char { let c = '{'; let s = "}}"; c }
pub(crate) fn inner() {}
pub fn open(a: u8) -> Result<u8, E> { todo!() }
pub enum E { A, B }
trait T { fn m(&self); }
impl S { pub fn method(&self) {} }
pub const N: usize = 3;
static M: &str = r#"fn fake() { "#;
pub mod sub;
mod tests { fn t() {} }
'''


def test_rust():
    imports, exports, defs = parse.parse_rust(RUST)
    assert imports == ["crate::model::Module", "pub use crate::m::{a, b}"]
    assert [(d[0], d[1], d[3]) for d in defs] == [
        ("S", "Struct", "Public"), ("private", "Function", "Private"), ("inner", "Function", "Crate"), ("open", "Function", "Public"),
        ("E", "Enum", "Public"), ("T", "Trait", "Private"), ("S", "Impl", "Private"), ("N", "Constant", "Public"), ("M", "Constant", "Private"),
    ]
    assert exports == ["S", "open", "E", "N", "sub"] and defs[3][4] == "pub fn open(a: u8) -> Result<u8, E>" and defs[0][2] == 7


def test_python():
    imports, exports, defs = parse.parse_python("import os, a.b\nimport c as d\nfrom .x import y\n@deco\ndef f(a: int):\n    def g(): pass\nclass _C: pass\n")
    assert imports == ["os", "a.b", ".x"] and exports == ["f"]
    assert defs == [("f", "Function", 5, "Public", "def f(a"), ("_C", "Class", 7, "Private", "class _C")]


def test_python_with_errors():
    text = 'import os, sys as s\nfrom ..a import b\ndef f(a: int):\n    return (\nclass _C(X):\n  pass\n"""\nimport no\n"""\nasync def g(): pass\n'
    imports, exports, defs = parse.parse_python(text)
    assert imports == ["os", "..a"] and exports == ["f", "g"]
    assert defs == [("f", "Function", 3, "Public", "def f(a"), ("_C", "Class", 5, "Private", "class _C(X)"), ("g", "Function", 10, "Public", "async def g()")]
    assert parse.parse_python("import a\0") and parse.parse_python("(" * 5000) == ([], [], [])


def test_modules(spark):
    src = spark.createDataFrame([("src/a.rs", "use crate::b::X;\n"), ("src/b.rs", RUST), ("x.py", "def ("), ("y.txt", "z"), ("z.rs", None)], "path string, content string")
    m = parse.modules(src)
    got = {r.path: r for r in m.collect()}
    assert set(got) == {"src/a.rs", "src/b.rs", "x.py", "z.rs"} and got["x.py"].definitions == [] and got["x.py"].lines == 1 and got["z.rs"].lines == 0 and got["src/a.rs"].lines == 1
    assert [(r.src, r.dst) for r in resolve.by_path(m).collect()] == [("src/a.rs", "src/b.rs")]


def test_config(tmp_path):
    c = config.parse('expected_high_coupling = ["x"]\n[thresholds]\ncoupling_fanin = 9\nunknown = 1\n[boundaries.network]\nindicators = ["net"]\n[boundaries.queue]\nindicators = ["q"]\nallowed_in = ["**/q/**"]')
    assert c.thresholds.coupling_fanin == 9 and c.thresholds.god_object_lines == 500 and c.expected_high_coupling == ["x"]
    assert [(b.name, b.allowed_in[:1]) for b in c.boundaries] == [("Network", ["**/client/**"]), ("Queue", ["**/q/**"])]
    assert config.load(tmp_path / "none.toml") == config.Config()
    (tmp_path / "bad.toml").write_text("[")
    with pytest.warns(UserWarning):
        assert config.load(tmp_path / "bad.toml") == config.Config()


SCRIPT = """import React, {
  useState } from 'react'
import "./side.css";
import type { T } from "../types"
// function no() {}
/* class No {} */
const re = /["'`{]/g, n: Map<string, number> = new Map(), s = `a ${ `${"}"}` } {`
export const dropped = () => { function inner() {} }
export default async function load(a: { x: number }): Promise<{ y: string }> {
  const local = 1;
}
function* generated() { yield 1 }
function overload(a: string): void;
function plain(
  a: string,
) {
  return "function text() {"
}
export interface Shape<T> extends Base {
  side: T
}
export type Union =
  | "a"
  | "b"
type Own = { a: 1 }
class Hidden extends Base {
  method() {}
}
const { p, q } = load(), f = (x) => {
  return x
}
let late
export { plain } from './other'
if (late) { var deep = 2 }
const view = <p>Don't {late} stop</p>;
export class Last {}
"""


def test_script():
    imports, exports, defs = scripts.parse_script(SCRIPT)
    assert imports == ["react", "./side.css", "../types"]
    assert exports == ["load", "Shape", "Union", "Last"]
    assert [(d[0], d[1], d[3]) for d in defs] == [
        ("re", "Constant", "Private"), ("n", "Constant", "Private"), ("s", "Constant", "Private"), ("load", "Function", "Public"),
        ("plain", "Function", "Private"), ("Shape", "Interface", "Public"), ("Union", "Type", "Public"), ("Own", "Type", "Private"), ("Hidden", "Class", "Private"),
        ("{ p, q }", "Constant", "Private"), ("f", "Constant", "Private"), ("late", "Constant", "Private"), ("view", "Constant", "Private"), ("Last", "Class", "Public"),
    ]
    by_name = {d[0]: d for d in defs}
    assert by_name["plain"][2] == 14 and by_name["Own"][4] == "type Own = { a: 1 }" and by_name["load"][4] == "async function load(a:"


def test_script_edges():
    for text in ("", "\n", "}", "`", "'", "/*", "import", "export", "const", "import x from y", "a".join(["{"] * 50)):
        assert scripts.parse_script(text)[0] == []


def test_a_language_of_ones_own(spark, monkeypatch):
    """A registered parser works in the DataFrame API and from SQL."""
    monkeypatch.setattr(parse, "PARSERS", dict(parse.PARSERS))

    def rules(text):
        if "bad" in text:
            raise ValueError("bad")
        return [], [], [(line.removeprefix("rule "), "Function", n, "Public", line) for n, line in enumerate(text.split("\n"), 1) if line.startswith("rule ")]

    parse.register_language(".rules", rules)
    src = spark.createDataFrame([("a.rules", "x\nrule one\nrule two", 1), ("b.py", "def f():\n    pass\n", 2), ("c.rules", "bad", 3), ("d.rules", None, 4), ("e.txt", "rule no", 5), (None, "rule no", 6)], "path string, content string, other int")
    assert sorted((r.path, len(r.definitions), r.parse_error) for r in parse.modules(src).collect()) == [("a.rules", 2, None), ("b.py", 1, None), ("c.rules", 0, "bad"), ("d.rules", 0, None)]
    parse.register_sql(spark)
    got = spark.sql("SELECT * FROM source_definitions(TABLE(SELECT * FROM {src})) ORDER BY path, line", src=src)
    assert [tuple(r) for r in got.collect()] == [("a.rules", "one", "Function", 2, "Public", "rule one"), ("a.rules", "two", "Function", 3, "Public", "rule two"), ("b.py", "f", "Function", 1, "Public", "def f()")]
    with pytest.raises(Exception, match="path and content"):
        spark.sql("SELECT * FROM source_definitions(TABLE(SELECT other FROM {src}))", src=src).collect()
