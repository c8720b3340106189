"""Snapshots, differences, graphs and impacts as documents: JSON, Markdown and a page."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import paths
from ..operators import graph, resolve
from ..operators.lists import preorder
from ..shared import place, written
from . import snapshots, views
from .contexts import _list, _rows, paths_name

#: What a snapshot's document holds.
SNAPSHOT = (
    "version int, created_at string, project_name string,"
    " modules array<struct<path:string,name:string,lines:bigint,imports:array<string>,exports:array<string>,content_hash:string>>,"
    " issues array<struct<kind:string,severity:string,message:string,locations:array<string>,issue_id:string>>,"
    " dependencies map<string,array<string>>,"
    " metrics struct<total_modules:bigint,total_lines:bigint,total_dependencies:bigint,cycle_count:bigint,avg_coupling:double,max_coupling:bigint,issue_counts:map<string,bigint>>"
)
VERSION = 1


def _located(analysis, root: str) -> DataFrame:
    """(kind, severity, message, locations, issue_id) of every issue."""
    where = analysis.locations.groupBy("kind", "key").agg(F.array_sort(F.collect_set(paths.relative(F.col("path"), root))).alias("paths"))
    return snapshots.issue_id(analysis.issues.join(where, ["kind", "key"])).select("kind", "severity", "message", F.col("paths").alias("locations"), "issue_id")


def snapshot(analysis, root: str, now: int | None = None) -> Iterator[str]:
    """The pieces of a snapshot's document; its dependencies are those that names resolve to."""
    short = lambda c: paths.relative(F.col(c), root).alias(c)
    modules = analysis.modules.select(short("path"), "name", "lines", "imports", "exports", F.sha2("content", 256).alias("content_hash"))
    edges = written(resolve.by_name(analysis.modules).select(short("src"), short("dst")), "named")
    issues = written(_located(analysis, root), "located")
    m = snapshots.metrics(modules, edges, issues).first()
    kinds = {r["kind"]: r["count"] for r in issues.groupBy("kind").count().orderBy("kind").collect()}
    yield f'{{\n  "version": {VERSION},\n  "created_at": "{int(time.time()) if now is None else now}",\n  "project_name": {json.dumps(paths_name(root))},\n'
    yield from _list("modules", (j for (j,) in _rows(modules.select("path", F.to_json(F.struct("*")).alias("j")).orderBy("path"), "j")))
    yield from _list("issues", (j for (j,) in _rows(issues.select(F.to_json(F.struct("*")).alias("j"), "kind", "issue_id").orderBy("kind", "issue_id"), "j")))
    yield '  "dependencies": {'
    targets = edges.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("to")).orderBy("src")
    for k, (src, to) in enumerate(_rows(targets, "src", "to")):
        yield f"{',' if k else ''}\n    {json.dumps(src)}: {json.dumps(list(to))}"
    totals = {"total_modules": m["total_modules"], "total_lines": m["total_lines"], "total_dependencies": m["total_dependencies"], "cycle_count": kinds.get("CircularDependency", 0), "avg_coupling": m["avg_coupling"], "max_coupling": m["max_coupling"], "issue_counts": kinds}
    yield f'\n  }},\n  "metrics": {json.dumps(totals)}\n}}\n'


class Saved:
    """A snapshot that was read: one table for each of its members."""

    def __init__(self, spark: SparkSession, path: str):
        whole = written(spark.read.schema(SNAPSHOT).option("multiLine", True).option("mode", "FAILFAST").json(path), "snapshot")
        self.created_at, self.project = whole.select("created_at", "project_name").first()
        self.modules = whole.select(F.explode("modules").alias("m")).select("m.*").withColumnRenamed("content_hash", "hash")
        self.issues = whole.select(F.explode("issues").alias("i")).select("i.*")
        self.edges = whole.select(F.explode("dependencies").alias("src", "to")).select("src", F.explode("to").alias("dst")).distinct()
        self.metrics = whole.select("metrics.*").drop("issue_counts")


def kept(spark: SparkSession, pieces: Iterator[str]) -> str:
    """Writes a document to the shared folder, a piece a write; gives its path."""
    path = f"{place(spark, 'document')}.json"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    try:
        for x in pieces:
            out.write(bytearray(x.encode()))
    finally:
        out.close()
    return path


class Difference:
    """What changed from one snapshot to another."""

    def __init__(self, base: Saved, now: Saved):
        self.base, self.now = base, now
        changed = written(snapshots.module_changes(base.modules, now.modules), "changed")
        of = lambda status: changed.where(F.col("status") == status)
        self.added, self.removed = of("added").select("path"), of("removed").select("path")
        a = base.modules.select("path", F.col("lines").alias("old_lines"), F.col("imports").alias("i0"), F.col("exports").alias("e0"))
        b = now.modules.select("path", F.col("lines").alias("new_lines"), F.col("imports").alias("i1"), F.col("exports").alias("e1"))
        but = lambda x, y, name: F.array_except(x, y).alias(name)
        self.modified = of("changed").select("path").join(a, "path").join(b, "path").select("path", "old_lines", "new_lines", but("i1", "i0", "imports_added"), but("i0", "i1", "imports_removed"), but("e1", "e0", "exports_added"), but("e0", "e1", "exports_removed"))
        moved = written(snapshots.dependency_changes(base.edges, now.edges), "moved")
        self.edges = {k: moved.where(F.col("status") == k).select(F.col("src").alias("from"), F.col("dst").alias("to")) for k in ("added", "removed")}
        shown = ("kind", "severity", "message", "locations")
        self.new = now.issues.join(base.issues.select("issue_id").distinct(), "issue_id", "left_anti").select(*shown)
        self.resolved = base.issues.join(now.issues.select("issue_id").distinct(), "issue_id", "left_anti").select(*shown)
        self.metrics = snapshots.metric_changes(base.metrics, now.metrics).first().asDict()

    def regressed(self) -> bool:
        """Whether there are new issues."""
        return not self.new.isEmpty()

    def _summary(self) -> dict:
        d = self.metrics
        return {"module_count_delta": d["total_modules_delta"], "line_count_delta": d["total_lines_delta"], "dependency_count_delta": d["total_dependencies_delta"], "cycle_count_delta": d["cycle_count_delta"], "coupling_delta": d["avg_coupling_delta"], "new_issue_count": self.new.count(), "resolved_issue_count": self.resolved.count()}

    def as_json(self) -> Iterator[str]:
        docs = lambda df, *by: (j for (j,) in _rows(df.select("*", F.to_json(F.struct("*")).alias("j")).orderBy(*by), "j"))
        texts = lambda df: (json.dumps(p) for (p,) in _rows(df.orderBy("path"), "path"))
        yield f'{{\n  "baseline_created_at": {json.dumps(self.base.created_at)},\n  "current_created_at": {json.dumps(self.now.created_at)},\n  "summary": {json.dumps(self._summary())},\n'
        yield from _list("added_modules", texts(self.added))
        yield from _list("removed_modules", texts(self.removed))
        yield from _list("modified_modules", docs(self.modified, "path"))
        yield from _list("added_dependencies", docs(self.edges["added"], "from", "to"))
        yield from _list("removed_dependencies", docs(self.edges["removed"], "from", "to"))
        yield from _list("new_issues", docs(self.new, "kind", "message"))
        yield from _list("resolved_issues", docs(self.resolved, "kind", "message"), last=True)
        yield "}\n"

    def as_markdown(self) -> Iterator[str]:
        s, sign = self._summary(), lambda n: f"+{n}" if n > 0 else str(n)
        yield f"# What changed\n\nFrom the snapshot of {self.base.created_at} to that of {self.now.created_at}.\n\n"
        yield f"- **Modules**: {sign(s['module_count_delta'])} (+{self.added.count()} added, -{self.removed.count()} removed, {self.modified.count()} modified)\n- **Lines**: {sign(s['line_count_delta'])}\n"
        yield f"- **Dependencies**: {sign(s['dependency_count_delta'])} (+{self.edges['added'].count()} / -{self.edges['removed'].count()})\n- **Cycles**: {sign(s['cycle_count_delta'])}\n- **Avg Coupling**: {s['coupling_delta']:+.2f}\n\n"
        for title, issues, n in (("Issues that came", self.new, s["new_issue_count"]), ("Issues that went", self.resolved, s["resolved_issue_count"])):
            if n:
                yield f"## {title}: {n}\n\n"
                for kind, severity, message, where in _rows(issues.orderBy("kind", "message"), "kind", "severity", "message", "locations"):
                    yield f"- **{kind}** [{severity}]: {message}\n" + "".join(f"  - `{x}`\n" for x in where)
                yield "\n"
        for title, table in (("Modules that came", self.added), ("Modules that went", self.removed)):
            if not table.isEmpty():
                yield f"## {title}\n\n"
                yield from (f"- `{p}`\n" for (p,) in _rows(table.orderBy("path"), "path"))
                yield "\n"
        if not self.modified.isEmpty():
            yield "## Modules that differ\n\n"
            for p, old, new in _rows(self.modified.orderBy("path"), "path", "old_lines", "new_lines"):
                yield f"- `{p}` ({sign(new - old)} lines)\n"


def graph_tables(analysis, root: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of the graph that names resolve to, paths relative to ``root``."""
    m, edges = analysis.modules, written(resolve.by_name(analysis.modules).select("src", "dst"), "named")
    facts = m.select("path", "name", "lines", "exports")
    nodes = views.nodes(m, edges, analysis.locations, root).join(facts, "path").withColumn("path", paths.relative(F.col("path"), root))
    each = views.links(edges, graph.strong_components(edges))
    each = each.select(*(paths.relative(F.col(c), root).alias(c) for c in ("source", "target")), F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("_n"), "is_cycle").drop("_n")
    return written(nodes.select(F.col("path").alias("id"), "name", "path", "lines", "fan_in", "fan_out", "issue_count", "category", "exports"), "nodes"), written(each, "links")


def graph_json(analysis, root: str) -> Iterator[str]:
    """The pieces of a node-link document."""
    nodes, links = graph_tables(analysis, root)
    yield "{\n"
    for name, table, by in (("nodes", nodes, ["id"]), ("links", links, ["source", "target"])):
        yield from _list(name, (j for (j,) in _rows(table.select("*", F.to_json(F.struct("*")).alias("j")).orderBy(*by), "j")))
    cycles = analysis.issues.where("kind = 'CircularDependency'").count()
    yield f'  "metadata": {json.dumps({"project_name": paths_name(root), "total_modules": nodes.count(), "total_dependencies": links.count(), "total_issues": analysis.issues.count(), "cycle_count": cycles})}\n}}\n'


#: A page that draws the graph by itself: forces, dragging, zooming, a legend, and a search box.
PAGE = """<!doctype html><html lang="en"><meta charset="utf-8"><title>Module graph</title>
<style>body{margin:0;font:13px sans-serif}#bar{position:fixed;left:8px;top:8px;background:#fffd;padding:6px}#tip{position:fixed;right:8px;top:8px;background:#fffd;padding:6px;white-space:pre}canvas{display:block}</style>
<div id="bar"><b id="name"></b> <span id="sums"></span><br><input id="find" placeholder="find a module"><div id="legend"></div></div><div id="tip"></div><canvas id="c"></canvas>
<script>const given=__DATA__;
const hues={test:'#7a7',index:'#55a',entry:'#a33',config:'#a70',model:'#07a',cli:'#808',output:'#088',parser:'#660',analysis:'#a0a',module:'#777'};
const c=document.getElementById('c'),g=c.getContext('2d'),el=x=>document.getElementById(x);let data,by,view={x:0,y:0,k:1},held=null,over=null,heat=1;
function take(d){data=d;by={};d.nodes.forEach((n,i)=>{n.x=300*Math.cos(i*2.4)*Math.sqrt(i/9+1);n.y=300*Math.sin(i*2.4)*Math.sqrt(i/9+1);n.vx=n.vy=0;by[n.id]=n});
el('name').textContent=d.metadata.project_name;el('sums').textContent=`${d.metadata.total_modules} modules, ${d.metadata.total_dependencies} dependencies, ${d.metadata.total_issues} issues, ${d.metadata.cycle_count} cycles`;
el('legend').replaceChildren(...Object.keys(hues).map(k=>{const s=document.createElement('span');s.style.color=hues[k];s.textContent=k+' ';return s}));heat=1}
const size=n=>4+2*Math.sqrt(n.fan_in);
function step(){const ns=data.nodes;for(let i=0;i<ns.length;i++)for(let j=i+1;j<ns.length&&j<i+400;j++){const a=ns[i],b=ns[j],dx=a.x-b.x,dy=a.y-b.y,d=dx*dx+dy*dy+9,f=900*heat/d;a.vx+=dx*f/9;a.vy+=dy*f/9;b.vx-=dx*f/9;b.vy-=dy*f/9}
for(const l of data.links){const a=by[l.source],b=by[l.target];if(!a||!b||a===b)continue;const dx=b.x-a.x,dy=b.y-a.y;a.vx+=dx*.004*heat;a.vy+=dy*.004*heat;b.vx-=dx*.004*heat;b.vy-=dy*.004*heat}
for(const n of ns){if(n!==held){n.x+=n.vx-n.x*.002;n.y+=n.vy-n.y*.002}n.vx*=.7;n.vy*=.7}heat=Math.max(.05,heat*.995)}
function draw(){step();c.width=innerWidth;c.height=innerHeight;g.setTransform(view.k,0,0,view.k,c.width/2+view.x,c.height/2+view.y);const want=el('find').value;
for(const l of data.links){const a=by[l.source],b=by[l.target];if(!a||!b)continue;g.strokeStyle=l.is_cycle?'#d22':over&&(a===over||b===over)?'#000':'#0003';g.beginPath();g.moveTo(a.x,a.y);g.lineTo(b.x,b.y);g.stroke()}
for(const n of data.nodes){g.fillStyle=hues[n.category]||'#777';g.globalAlpha=want&&!n.path.includes(want)?.15:1;g.beginPath();g.arc(n.x,n.y,size(n),0,7);g.fill();if(n.issue_count){g.strokeStyle='#d22';g.stroke()}g.fillStyle='#000';if(view.k>.8)g.fillText(n.name,n.x+size(n)+2,n.y+4)}g.globalAlpha=1;requestAnimationFrame(draw)}
const at=e=>({x:(e.clientX-c.width/2-view.x)/view.k,y:(e.clientY-c.height/2-view.y)/view.k});
c.onmousemove=e=>{const p=at(e);if(held){held.x=p.x;held.y=p.y;heat=Math.max(heat,.3);return}if(e.buttons){view.x+=e.movementX;view.y+=e.movementY;return}
over=data.nodes.find(n=>(n.x-p.x)**2+(n.y-p.y)**2<size(n)**2)||null;el('tip').textContent=over?`${over.path}\\n${over.lines} lines\\n${over.fan_in} in, ${over.fan_out} out\\n${over.issue_count} issues\\n${over.exports.slice(0,9).join(', ')}`:''};
c.onmousedown=()=>held=over;c.onmouseup=()=>held=null;c.onwheel=e=>{view.k*=e.deltaY<0?1.1:.9};
const load=()=>fetch('api/graph').then(r=>r.json()).then(take);
if(given){take(given);draw()}else{load().then(draw);new EventSource('api/events').onmessage=load}
</script></html>
"""


def page(document: str | None) -> str:
    """The page with a graph's document in it, or one that asks its server."""
    data = "null" if document is None else document.replace("<", "\\u003c").replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")
    return PAGE.replace("__DATA__", data)


def impact_document(affected: DataFrame, edges: DataFrame, target: str, root: str, form: str = "markdown", tree: bool = False) -> Iterator[str]:
    """The impact of ``target`` from ``graph.impact``: by depth, and as a tree.

    The tree hangs each module below the smallest path one step nearer that it depends on.
    """
    short = lambda c: paths.relative(F.col(c), root).alias(c)
    shown = written(affected.select(short("path"), F.col("depth").cast("int").alias("depth")), "affected")
    sizes = {r["depth"]: r["count"] for r in shown.groupBy("depth").count().collect()}
    total, longest = sum(sizes.values()), max(sizes, default=0)
    own = target.removeprefix(root.rstrip("/") + "/")
    rows = lambda: _rows(shown.orderBy("depth", "path"), "depth", "path")
    if form == "json":
        yield f'{{\n  "target": {json.dumps(own)},\n  "summary": {json.dumps({"total_affected": total, "max_chain_length": longest})},\n  "by_depth": ['
        for k, (depth, group) in enumerate(groupby(rows(), lambda r: r[0])):
            yield (",\n    " if k else "\n    ") + f'{{"depth": {depth}, "files": '
            for n, (_, path) in enumerate(group):
                yield (", " if n else "[") + json.dumps(path)
            yield "]}"
        yield "\n  ],\n"
        yield from _list("all_affected", (json.dumps(p) for _, p in rows()))
        yield '  "tree": '
        yield from _nested(_rows(_tree(shown, edges, own, root), "path", "depth"))
        yield "\n}\n"
        return
    yield f"# What depends on {own}\n\n- Files: {total}\n- Steps to the farthest: {longest}\n\n"
    if not total:
        yield "Nothing depends on it.\n"
        return
    yield "## By number of steps\n\n"
    last = 0
    for depth, path in rows():
        if depth != last:
            yield ("\n" if last else "") + f"### {'One step' if depth == 1 else f'{depth} steps'}: {sizes[depth]}\n\n"
            last = depth
        yield f"- `{path}`\n"
    yield "\n"
    if tree:
        yield "## Tree\n\n```\n"
        lasts: list[bool] = []
        for path, depth, last in _rows(_tree(shown, edges, own, root), "path", "depth", "last"):
            lasts[depth:] = [last]
            lead = "".join("    " if x else "│   " for x in lasts[1:depth])
            yield lead + ("" if depth == 0 else "└── " if last else "├── ") + f"{path}\n"
        yield "```\n"


def _tree(shown: DataFrame, edges: DataFrame, target: str, root: str) -> DataFrame:
    """(path, depth, last) of the tree below ``target`` in preorder; ``last`` marks the last child of its parent."""
    near = shown.unionByName(shown.sparkSession.createDataFrame([(target, 0)], "path string, depth int"))
    to = near.select(F.col("path").alias("dst"), F.col("depth").alias("d"))
    own = edges.select(*(paths.relative(F.col(c), root).alias(c) for c in ("src", "dst"))).join(to, "dst")
    parent = shown.join(own, (F.col("src") == F.col("path")) & (F.col("d") == F.col("depth") - 1)).groupBy("path").agg(F.min("dst").alias("parent"))
    top = shown.sparkSession.createDataFrame([(target, None)], "path string, parent string")
    return preorder(parent.unionByName(top)).orderBy("position")


def _nested(rows: Iterator) -> Iterator[str]:
    """Rows (path, depth) of a tree in preorder as JSON."""
    before = -1
    for path, depth in rows:
        if depth <= before:
            yield "]}" * (before - depth + 1) + ", "
        yield f'{{"path": {json.dumps(path)}, "depth": {depth}, "children": ['
        before = depth
    yield "]}" * (before + 1)
