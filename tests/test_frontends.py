"""Contexts, snapshots, graphs, impacts, the command line, the server and the tools on one small tree."""

import io
import json
import threading
import urllib.request
import xml.etree.ElementTree as ET

import pytest

from plumbline import commands, serve, tools
from plumbline.plans import contexts, documents
from plumbline.sources import config

FILES = {
    "src/hub.rs": "use crate::a::X;\npub fn f(a: u8) -> u8 {\n a\n}\npub struct S { x: u8 }\n",
    "src/a.rs": "use crate::hub::f;\nuse crate::hub::g;\nfn q() {}\n",
    "src/b.rs": "use crate::hub::f;\nuse crate::hub::g;\nuse crate::a;\nfn q() {}\n",
    "src/c.rs": "use crate::b::q;\nuse serde::X;\n",
    "web/view.ts": 'import { x } from "./y"\nexport class V<T> {}\n',
    "__init__.py": "",
}


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree") / "tree"
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return commands.Project(spark, root)


@pytest.fixture(scope="module")
def found(project):
    return project.analysis(max_depth=2)


@pytest.fixture(scope="module")
def context(found, project):
    return contexts.Context(found, project.root)


def test_contexts(found, project, context):
    doc = json.loads("".join(contexts.as_json(context)))
    assert doc["project"] == "tree" and doc["ordering"] == "topological"
    at = [m["path"] for m in doc["modules"]]
    assert at == ["__init__.py", "src/c.rs", "web/view.ts", "src/b.rs", "src/a.rs", "src/hub.rs"]
    assert [s["path"] for s in doc["refactoring_order"]] == at[::-1]
    hub = doc["modules"][-1]
    assert hub["signature"] == "use crate::a::X;\n\npub fn f(a: u8) -> u8 { ... }\n\npub struct S { x: u8 }\n\n"
    assert {d["name"]: d["kind"] for d in hub["definitions"]} == {"f": "Function", "S": "Struct"}
    actions = {r["path"]: r["actions"] for r in doc["recommendations"]}
    assert any(x.startswith("DECOUPLE") for x in actions["src/a.rs"]) and "web/view.ts" not in actions
    tree = ET.fromstring("".join(contexts.as_xml(context)))
    assert tree.find("modules").get("count") == "6" and tree.find(".//class").get("name") == "V" and len(tree.findall(".//step")) == 6
    plain = "".join(contexts.markdown(context))
    assert plain.startswith("# tree, module by module\n\nModules: 6\n") and "- Exports: f, S\n" in plain
    assert int(plain.rsplit("~", 1)[1].split()[0]) == len(plain[: plain.rindex("---\n")].encode()) // 4


def test_budget(context):
    text = "".join(contexts.budgeted(context, 800 + 40))
    used = int(text.split("Tokens: ")[1].split(" of ")[0])
    assert 800 < used <= 840 and "## By name: " in text or "## By their imports: " in text
    assert "## In full: 6" in "".join(contexts.budgeted(context, 5000))
    assert "Tokens: 800 of 10\n" in "".join(contexts.budgeted(context, 10))


def test_snapshots(spark, project, found, tmp_path):
    first = "".join(documents.snapshot(found, project.root, now=1))
    doc = json.loads(first)
    assert doc["created_at"] == "1" and doc["metrics"]["total_modules"] == 6 and doc["metrics"]["cycle_count"] == 1
    assert doc["dependencies"]["src/b.rs"] == ["src/a.rs", "src/hub.rs", "src/hub.rs"]
    doc["modules"] = [m for m in doc["modules"] if m["path"] != "src/c.rs"] + [{"path": "gone.rs", "name": "gone", "lines": 3, "imports": [], "exports": [], "content_hash": "x"}]
    doc["modules"][1] |= {"content_hash": "old", "imports": ["was"], "lines": 9}
    cycle = next(i for i in doc["issues"] if i["kind"] == "CircularDependency")
    cycle["issue_id"] = "other"
    changed = doc["modules"][1]["path"]
    (tmp_path / "base.json").write_text(json.dumps(doc))
    now = documents.Saved(spark, documents.kept(spark, [first]))
    d = documents.Difference(documents.Saved(spark, (tmp_path / "base.json").as_uri()), now)
    got = json.loads("".join(d.as_json()))
    assert got["added_modules"] == ["src/c.rs"] and got["removed_modules"] == ["gone.rs"] and d.regressed()
    assert [m["path"] for m in got["modified_modules"]] == [changed] and got["modified_modules"][0]["imports_removed"] == ["was"]
    assert [i["kind"] for i in got["new_issues"]] == ["CircularDependency"] == [i["kind"] for i in got["resolved_issues"]]
    text = "".join(d.as_markdown())
    assert "+1 added, -1 removed, 1 modified" in text and "## Issues that came: 1" in text
    same = documents.Difference(now, now)
    assert not same.regressed() and "- **Lines**: 0\n" in "".join(same.as_markdown())


def test_graph(project, found):
    text = "".join(documents.graph_json(found, project.root))
    doc = json.loads(text)
    assert len(doc["nodes"]) == 6 and {n["id"]: n["fan_out"] for n in doc["nodes"]}["src/b.rs"] == 3
    assert doc["metadata"]["total_dependencies"] == len(doc["links"]) == 7
    assert {(x["source"], x["target"]) for x in doc["links"] if x["is_cycle"]} == {("src/a.rs", "src/hub.rs"), ("src/hub.rs", "src/a.rs")}
    assert "__DATA__" not in documents.page(text) and "</script>" not in documents.page('{"x": "</script>"}').split("const given=")[1].split("\n")[0]


def test_impact(project):
    doc = json.loads("".join(project.impact("src/hub.rs", form="json")))
    assert doc["by_depth"] == [{"depth": 1, "files": ["src/a.rs", "src/b.rs"]}, {"depth": 2, "files": ["src/c.rs"]}]
    assert doc["tree"]["children"][1] == {"path": "src/b.rs", "depth": 1, "children": [{"path": "src/c.rs", "depth": 2, "children": []}]}
    text = "".join(project.impact("src/hub.rs", tree=True))
    assert "### One step: 2" in text and text.endswith("```\nsrc/hub.rs\n├── src/a.rs\n└── src/b.rs\n    └── src/c.rs\n```\n")
    assert "Nothing depends on it." in "".join(project.impact("web/view.ts"))


def test_commands(project, tmp_path, capsys):
    out = tmp_path / "o.json"
    assert commands.main([project.root, "-f", "json", "-o", str(out), "-x", "web"]) == 1
    assert json.loads(out.read_text())["module_count"] == 5
    assert commands.main(["analyze", "/none/here"]) == 2 and "not found" in capsys.readouterr().err
    assert commands.main(["snapshot", "--save", str(out), project.root]) == 0
    assert commands.main(["diff", str(out), project.root, "--fail-on-regression"]) == 0 and "# What changed" in capsys.readouterr().out
    assert commands.main(["init", str(tmp_path)]) == 0 and commands.main(["init", str(tmp_path)]) == 1
    assert config.load(tmp_path / commands.CONFIG) == config.Config()


def test_server():
    server = serve.GraphServer('{"nodes": []}', port=0)
    threading.Thread(target=server.run, daemon=True).start()
    base = f"http://127.0.0.1:{server.port}"
    with urllib.request.urlopen(f"{base}/api/graph", timeout=10) as r:
        assert r.read() == b'{"nodes": []}' and r.headers["Access-Control-Allow-Origin"] == "*"
    with urllib.request.urlopen(f"{base}/", timeout=10) as r:
        assert b"given=null" in r.read()
    with urllib.request.urlopen(f"{base}/api/events", timeout=10) as r:
        server.replace("{}")
        assert r.readline() == b"data: 1\n"
    server.stop()


def test_tools(spark, project):
    ask = lambda *messages: [json.loads(x) for x in _lines(spark, project.root, messages)]
    use = lambda n, name, **given: {"id": n, "method": "tools/call", "params": {"name": name, "arguments": given}}
    first, tool_list, impact, bad, missing, where, unknown = ask(
        {"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, use(3, "impact", file="src/hub.rs", depth=1),
        use(4, "analyze", format="yaml"), use(5, "impact"), use(6, "ai", path="/none/here"), {"id": 7, "method": "none"},
    )
    assert first["result"]["serverInfo"]["name"] == "plumbline" and tool_list["result"]["tools"] == tools.manifest()["tools"]
    assert json.loads(impact["result"]["content"][0]["text"])["summary"] == {"total_affected": 2, "max_chain_length": 1}
    assert bad["result"]["isError"] and missing["error"]["code"] == -32602 and where["result"]["isError"] and unknown["error"]["code"] == -32601


def _lines(spark, root, messages):
    sink = io.StringIO()
    tools.serve(spark, root, io.StringIO("".join(json.dumps(m) + "\n" for m in messages)), sink)
    return sink.getvalue().splitlines()
