"""All queries of the library, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import counting, paths
from .operators import globs, graph, lists, resolve
from .plans import detect, fixtures as fx, rendered, snapshots, views
from .shared import written
from .sources import parse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


M, E, OE, PE, D, S = (fx.SQL[k] for k in ("m", "e", "oe", "pe", "d", "s"))
MANY = detect.Thresholds(coupling_fanin=fx.MANY)
DEG = "i AS (SELECT dst, count(*) AS fan_in, count(DISTINCT src) AS fan_in_distinct FROM pe GROUP BY dst), o AS (SELECT src, count(*) AS fan_out FROM pe GROUP BY src), g AS (SELECT path, name, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, coalesce(fan_in_distinct, 0) AS fan_in_distinct FROM m LEFT JOIN i ON i.dst = path LEFT JOIN o ON o.src = path)"


@query(f"WITH {M}, {E}, {PE}, {DEG} SELECT path, fan_in, fan_out, fan_in_distinct FROM g")
def fan_in_out(spark, sf):
    return graph.degrees(fx.suppliers(spark, sf), fx.path_edges(spark, sf))


@query(f"WITH {M}, {E}, {PE}, {DEG} SELECT path, fan_in, fan_in_distinct FROM g WHERE fan_in >= 450")
def high_coupling(spark, sf):
    return detect.high_coupling(fx.suppliers(spark, sf), fx.path_edges(spark, sf), MANY)


@query(f"WITH {M}, {E}, {PE} SELECT src, dst, count(*) AS n FROM pe GROUP BY src, dst")
def resolve_by_path(spark, sf):
    return resolve.by_path(fx.suppliers(spark, sf), fx.imports(spark, sf)).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(f"WITH {M}, {E}, {PE} SELECT src, dst, count(*) AS n FROM pe GROUP BY src, dst")
def resolve_by_name(spark, sf):
    return resolve.by_name(fx.suppliers(spark, sf), fx.imports(spark, sf)).groupBy("src", "dst").agg(F.count("*").alias("n"))


#: A glob for each supplier: of its region, a plain name, one with a folder left open, one with an open ending.
GLOB = "CASE s_suppkey % 4 WHEN 0 THEN '**/r' || (s_suppkey // 4 % 5) || '/s' || s_suppkey || '*' WHEN 1 THEN 's' || s_suppkey || '.rs' WHEN 2 THEN '/proj/src/*/s' || s_suppkey || '.rs' ELSE '**/s' || s_suppkey || '.*' END"
GLOBS = f"""gl AS (SELECT s_suppkey AS k, {GLOB} AS pattern FROM supplier), gm AS (
  SELECT path, pattern FROM m JOIN gl ON CASE k % 4
    WHEN 0 THEN regexp_matches(path, '^.*r' || (k // 4 % 5) || '/s' || k || '[^/]*$')
    WHEN 1 THEN ends_with(path, '/s' || k || '.rs')
    WHEN 2 THEN regexp_matches(path, '^/proj/src/[^/]*(.*/)?/s' || k || '[.]rs$')
    ELSE regexp_matches(path, '^.*s' || k || '[.][^/]*$') END)"""


def _globs(spark, sf):
    return fx.table(spark, sf, "supplier").select(F.expr(GLOB.replace("//", "DIV")).alias("glob"))


@query(f'WITH {M}, {GLOBS} SELECT path, pattern AS "glob" FROM gm')
def glob_matches(spark, sf):
    return globs.matched(fx.suppliers(spark, sf), _globs(spark, sf))


@query(f"WITH {M}, {E}, {PE}, {DEG}, {GLOBS} SELECT path, fan_in, fan_in_distinct FROM g WHERE fan_in >= 450 AND path NOT IN (SELECT path FROM gm WHERE starts_with(pattern, '**'))")
def high_coupling_allowed(spark, sf):
    return detect.high_coupling(fx.suppliers(spark, sf), fx.path_edges(spark, sf), MANY, _globs(spark, sf).where("glob LIKE '**%'"))


@query(f"WITH {E} SELECT src FROM e WHERE dst = 7")
def direct_dependents(spark, sf):
    return graph.dependents(fx.key_edges(spark, sf), 7)


@query(f"WITH RECURSIVE {OE}, r(path, depth) AS (SELECT o_orderkey, 0 FROM orders WHERE o_orderstatus = 'P' UNION SELECT oe.src, r.depth + 1 FROM r JOIN oe ON oe.dst = r.path WHERE r.depth < 60), k AS (SELECT path, min(depth) AS depth FROM r GROUP BY path) SELECT path, depth FROM k WHERE depth > 0")
def impact_by_depth(spark, sf):
    targets = fx.table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("path"))
    return graph.impact(fx.order_edges(spark, sf), targets)


@query(f"WITH RECURSIVE {OE}, x AS (SELECT DISTINCT src, dst FROM oe WHERE src <> dst), r(nodes, last, n) AS (SELECT [src, dst], dst, 2 FROM x UNION ALL SELECT list_append(nodes, dst), dst, n + 1 FROM r JOIN x ON x.src = r.last WHERE n < 9 AND NOT list_contains(nodes, dst)) SELECT array_to_string(nodes, ' > ') AS chain, n AS length FROM r WHERE n > 5 ORDER BY length DESC, chain LIMIT 10")
def deep_chains(spark, sf):
    return detect.deep_chains(fx.order_edges(spark, sf)).drop("nodes")


CLOSED = f"{OE}, r(a, b) AS (SELECT DISTINCT src, dst FROM oe UNION SELECT r.a, oe.dst FROM r JOIN oe ON oe.src = r.b)"


@query(f"WITH RECURSIVE {CLOSED}, k AS (SELECT x.a AS path, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a) SELECT component, count(*) AS size, string_agg(path, ',' ORDER BY path) AS members FROM k GROUP BY component")
def cycles(spark, sf):
    return detect.cycles(fx.order_edges(spark, sf))


@query(f"WITH RECURSIVE {CLOSED}, c AS (SELECT a FROM r WHERE a = b), bad AS (SELECT a AS path FROM c UNION SELECT r.b FROM r JOIN c ON c.a = r.a), l(path, layer) AS (SELECT o_orderkey, 0 FROM orders WHERE o_orderkey NOT IN (SELECT path FROM bad) UNION SELECT oe.dst, l.layer + 1 FROM l JOIN oe ON oe.src = l.path WHERE oe.dst NOT IN (SELECT path FROM bad)) SELECT path, max(layer) AS layer FROM l GROUP BY path UNION ALL SELECT path, NULL FROM bad")
def topo_layers(spark, sf):
    nodes = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"))
    return graph.layers(nodes, fx.order_edges(spark, sf))


TREE = "t AS (SELECT CAST(r_regionkey AS BIGINT) AS path, CAST(NULL AS BIGINT) AS parent, CAST(r_regionkey AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, CAST(NULL AS BIGINT) AS c, CAST(NULL AS BIGINT) AS d, 0 AS depth FROM region UNION ALL SELECT 100 + n_nationkey, n_regionkey, n_regionkey, n_nationkey, NULL, NULL, 1 FROM nation UNION ALL SELECT 1000 + 2 * c_custkey, 100 + c_nationkey, n_regionkey, c_nationkey, c_custkey, NULL, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 1001 + 2 * o_orderkey, 1000 + 2 * o_custkey, n_regionkey, c_nationkey, c_custkey, o_orderkey, 3 FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"


@query(f"WITH {TREE}, z AS (SELECT c, count(*) AS n FROM t WHERE depth >= 2 GROUP BY c), y AS (SELECT b, count(*) AS n FROM t WHERE depth >= 1 GROUP BY b), x AS (SELECT a, count(*) AS n FROM t GROUP BY a) SELECT t.path, parent, row_number() OVER (ORDER BY t.a, t.b NULLS FIRST, t.c NULLS FIRST, t.d NULLS FIRST) - 1 AS position, depth, CASE depth WHEN 0 THEN x.n WHEN 1 THEN y.n WHEN 2 THEN z.n ELSE 1 END AS size, t.path = max(t.path) OVER (PARTITION BY parent) AS last FROM t LEFT JOIN z ON z.c = t.c LEFT JOIN y ON y.b = t.b LEFT JOIN x ON x.a = t.a")
def tree_preorder(spark, sf):
    """Regions, nations, customers and orders as trees."""
    as_long = lambda c: c.cast("long")
    of = lambda name, path, parent: fx.table(spark, sf, name).select(as_long(path).alias("path"), as_long(parent).alias("parent"))
    trees = of("region", F.col("r_regionkey"), F.lit(None)).unionByName(of("nation", 100 + F.col("n_nationkey"), F.col("n_regionkey"))).unionByName(of("customer", 1000 + 2 * F.col("c_custkey"), 100 + F.col("c_nationkey"))).unionByName(of("orders", 1001 + 2 * F.col("o_orderkey"), 1000 + 2 * F.col("o_custkey")))
    return lists.preorder(trees)


@query(f"WITH {M}, {E}, {PE}, {DEG}, {D} SELECT g.path, round(2 * fan_in + fan_out + 1.5 * coalesce(structs + enums, 0), 6)::DOUBLE AS score FROM g LEFT JOIN c ON c.path = g.path")
def importance(spark, sf):
    return detect.importance(fx.suppliers(spark, sf), fx.path_edges(spark, sf), detect.definition_counts(fx.definitions(spark, sf)))


@query(f"WITH {M}, {D}, k AS (SELECT path, lines, list_filter([CASE WHEN structs > 3 THEN 'structs' END, CASE WHEN functions > 10 THEN 'functions' END, CASE WHEN traits > 0 THEN 'traits' END, CASE WHEN impls > 5 THEN 'impls' END], lambda x: x IS NOT NULL) AS l FROM c WHERE lines >= 500) SELECT path, CAST(lines AS BIGINT) AS lines, array_to_string(l, ',') AS responsibilities FROM k WHERE len(l) > 1")
def god_objects(spark, sf):
    defs = fx.definitions(spark, sf)
    return detect.god_objects(fx.sized_modules(defs), detect.definition_counts(defs))


@query(f"WITH {M}, {D} SELECT path, CAST(lines AS BIGINT) AS lines, private_functions, public_functions, round(lines / greatest(exports, 1), 6)::DOUBLE AS lines_per_export FROM c WHERE lines >= 400 AND private_functions >= 8 AND lines / greatest(exports, 1) > 100")
def fat_modules(spark, sf):
    defs = fx.definitions(spark, sf)
    return detect.fat_modules(fx.sized_modules(defs), detect.definition_counts(defs))


@query(f"WITH {M}, {D} SELECT path, CAST(lines AS BIGINT) AS lines, structs, functions, impls, traits, enums, private_functions, public_functions, exports, round(private_functions / greatest(exports, 1), 6)::DOUBLE AS sprawl FROM c")
def definition_metrics(spark, sf):
    defs = fx.definitions(spark, sf)
    found = fx.sized_modules(defs).join(detect.definition_counts(defs), "path")
    return found.withColumn("sprawl", F.round(F.col("private_functions") / F.greatest("exports", F.lit(1)), 6))


COH = "p AS (SELECT path, name, regexp_extract(path, '([^/]+)/[^/]+$', 1) AS pk FROM m), im AS (SELECT a.path, CASE WHEN e.dst % 3 = 0 THEN 's' || e.dst ELSE 'c' || (e.dst % 7) || '::T' END AS imp FROM e JOIN m a ON a.key = e.src), x AS (SELECT im.path, p.pk, imp, split_part(imp, '::', -1) AS last FROM im JOIN p USING (path)), y AS (SELECT x.path, CASE WHEN q.name IS NULL THEN split_part(imp, '::', 1) END AS crate FROM x LEFT JOIN (SELECT DISTINCT pk, name FROM p) q ON q.pk = x.pk AND q.name = x.last), z AS (SELECT path, crate, count(*) AS n FROM y GROUP BY path, crate), t AS (SELECT path, CAST(coalesce(sum(n) FILTER (crate IS NULL), 0) AS BIGINT) AS internal, count(crate) AS crates, array_to_string(list(crate ORDER BY n DESC, crate) FILTER (crate IS NOT NULL)[1:3], ',') AS top FROM z GROUP BY path)"


@query(f"WITH {M}, {E}, {COH} SELECT path, round((internal + 1) / (internal + 1 + crates), 6) AS score, internal, crates, top FROM t WHERE (internal + 1) / (internal + 1 + crates) < 0.3 AND crates >= 3")
def low_cohesion(spark, sf):
    named = F.when(F.col("dst") % 3 == 0, F.format_string("s%d", "dst")).otherwise(F.format_string("c%d::T", F.col("dst") % 7))
    m = fx.suppliers(spark, sf)
    imports = fx.key_edges(spark, sf).join(m, F.col("src") == F.col("key")).select("path", named.alias("imported"))
    return detect.low_cohesion(m.select("path", "name"), imports=imports)


#: Kinds of access that the documents hold.
CROSSED = [detect.Boundary("Licence", ["License", "license"], ["/src1/**"]), detect.Boundary("Contact", ["@"], [])]
HITS = "l AS (SELECT path, unnest(string_split(coalesce(content, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(content, ''), chr(10)), 1) AS line FROM s), b AS (SELECT 'Licence' AS boundary, path, line, CASE WHEN contains(text, 'License') THEN 'License' WHEN contains(text, 'license') THEN 'license' END AS indicator FROM l WHERE NOT regexp_matches(path, '^/src1/') UNION ALL SELECT 'Contact', path, line, CASE WHEN contains(text, '@') THEN '@' END FROM l), h AS (SELECT boundary, path, line, indicator FROM b WHERE indicator IS NOT NULL)"


@query(f"WITH {S}, {HITS} SELECT boundary, path, line, indicator FROM h")
def boundary_hits(spark, sf):
    return detect.boundary_hits(fx.sources(spark, sf), CROSSED)


@query(f"WITH {S}, {HITS}, k AS (SELECT boundary, path, count(*) AS n FROM h GROUP BY boundary, path), t AS (SELECT *, sum(n) OVER (PARTITION BY boundary) AS total, row_number() OVER (PARTITION BY boundary ORDER BY n DESC, path) AS r FROM k) SELECT boundary, count(*) AS modules, CAST(sum(n) AS BIGINT) AS hits FROM t WHERE NOT (r = 1 AND n / total >= 0.5) GROUP BY boundary HAVING count(*) >= 2")
def boundary_violations(spark, sf):
    return detect.boundary_violations(detect.boundary_hits(fx.sources(spark, sf), CROSSED), CROSSED)


@query(f"WITH {S} SELECT path, CAST(CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) - CASE WHEN ends_with(content, chr(10)) THEN 1 ELSE 0 END END AS BIGINT) AS lines, md5(content) AS hash FROM s")
def module_lines(spark, sf):
    return fx.sources(spark, sf).select("path", paths.line_count(F.col("content")).alias("lines"), F.md5("content").alias("hash"))


@query()
def token_counts(spark, sf):
    """Tokens of every document, estimated and by a public vocabulary."""
    import public_tokenizers

    text = F.col("content")
    return fx.sources(spark, sf).select("path", counting.estimated(text).alias("estimated"), counting.counted(text, public_tokenizers.path("byte_bpe_50k.json")).alias("counted"))


@query(f"WITH {S} SELECT path, left(content, 50) AS first FROM s")
def truncated_texts(spark, sf):
    return fx.sources(spark, sf).select("path", paths.truncated(F.col("content"), 50).alias("first"))


@query(f"WITH {S}, {M}, u AS (SELECT path FROM s UNION ALL SELECT path FROM m) SELECT path, regexp_replace(regexp_extract(path, '[^/]+$'), '\\.[^.]*$', '') AS stem, regexp_extract(path, '([^/]+)/[^/]+$', 1) AS package, CASE WHEN starts_with(path, '/proj/') THEN substr(path, 7) ELSE path END AS relative FROM u")
def path_parts(spark, sf):
    every = fx.sources(spark, sf).select("path").union(fx.suppliers(spark, sf).select("path"))
    p = F.col("path")
    return every.select("path", paths.stem(p).alias("stem"), paths.package(p).alias("package"), paths.relative(p, fx.ROOT).alias("relative"))


NAMED = "q AS (SELECT p_partkey AS key, CASE p_partkey % 11 WHEN 0 THEN 'tests/x' WHEN 1 THEN 'mod.rs' WHEN 2 THEN 'main.rs' WHEN 3 THEN 'config/x' WHEN 4 THEN 'models/x' WHEN 5 THEN 'cli/x' WHEN 6 THEN 'output/x' WHEN 7 THEN 'parser/x' WHEN 8 THEN 'analysis/x' WHEN 9 THEN 'types' ELSE 'other' END AS path FROM part)"


@query(f"WITH {NAMED} SELECT key, path, CASE p_ WHEN 0 THEN 'test' WHEN 1 THEN 'index' WHEN 2 THEN 'entry' WHEN 3 THEN 'config' WHEN 4 THEN 'model' WHEN 5 THEN 'cli' WHEN 6 THEN 'output' WHEN 7 THEN 'parser' WHEN 8 THEN 'analysis' WHEN 9 THEN 'model' ELSE 'module' END AS category, p_ = 0 AS is_test FROM (SELECT *, key % 11 AS p_ FROM q)")
def categorize(spark, sf):
    names = F.array(*map(F.lit, ["tests/x", "mod.rs", "main.rs", "config/x", "models/x", "cli/x", "output/x", "parser/x", "analysis/x", "types", "other"]))
    own = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.element_at(names, (F.col("p_partkey") % 11 + 1).cast("int")).alias("path"))
    return own.select("key", "path", paths.category(F.col("path")).alias("category"), paths.is_test(F.col("path")).alias("is_test"))


@query("WITH RECURSIVE t AS (SELECT doc_id, n_chars // 4 AS f, n_chars // 40 AS h, row_number() OVER (ORDER BY n_chars DESC, CAST(doc_id AS VARCHAR)) AS k FROM documents WHERE least(n_chars // 4, n_chars // 40) <= 39200), r(k, left_, doc_id, choice) AS (SELECT CAST(0 AS BIGINT), CAST(39200 AS BIGINT), CAST(NULL AS BIGINT), '' UNION ALL SELECT t.k, CASE WHEN t.f <= left_ THEN left_ - t.f WHEN t.h <= left_ THEN left_ - t.h ELSE left_ END, t.doc_id, CASE WHEN t.f <= left_ THEN 'full' WHEN t.h <= left_ THEN 'short' ELSE '' END FROM r JOIN t ON t.k = r.k + 1) SELECT CAST(doc_id AS VARCHAR) AS path, choice FROM r WHERE choice <> ''")
def token_pack(spark, sf):
    docs = fx.table(spark, sf, "documents").select((-F.col("n_chars")).alias("rank"), F.col("doc_id").cast("string").alias("path"), F.floor(F.col("n_chars") / 4).alias("full"), F.floor(F.col("n_chars") / 40).alias("short"))
    return detect.token_pack(docs, 40_000)


def _snapshot(spark, sf, where: str, perturbed: bool):
    docs = fx.table(spark, sf, "documents").where(where)
    mark = F.when(F.col("source") == "src2", "x").otherwise("") if perturbed else F.lit("")
    return docs.select(F.col("doc_id").cast("string").alias("path"), F.md5(F.concat("text", mark)).alias("hash"), paths.line_count(F.col("text")).alias("lines"), F.array(F.col("lang"), F.when(F.lit(perturbed), F.col("source")).otherwise(F.lit("src1"))).alias("exports"))


LINES = "CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END END"
SNAP = f"a AS (SELECT doc_id, md5(text) AS h, {LINES} AS l, lang, source FROM documents WHERE lang <> 'es'), z AS (SELECT doc_id, md5(text || CASE WHEN source = 'src2' THEN 'x' ELSE '' END) AS h, {LINES} AS l, lang, source FROM documents WHERE source <> 'src3')"


@query(f"WITH {SNAP} SELECT CAST(coalesce(a.doc_id, z.doc_id) AS VARCHAR) AS path, CASE WHEN a.h IS NULL THEN 'added' WHEN z.h IS NULL THEN 'removed' ELSE 'changed' END AS status, CAST(coalesce(z.l, 0) - coalesce(a.l, 0) AS BIGINT) AS lines_delta FROM a FULL JOIN z ON a.doc_id = z.doc_id WHERE a.h IS NULL OR z.h IS NULL OR a.h <> z.h")
def diff_modules(spark, sf):
    return snapshots.module_changes(_snapshot(spark, sf, "lang <> 'es'", False), _snapshot(spark, sf, "source <> 'src3'", True))


@query(f"WITH {SNAP} SELECT CAST(a.doc_id AS VARCHAR) AS path, z.source AS added, 'src1' AS removed FROM a JOIN z ON a.doc_id = z.doc_id WHERE z.source <> 'src1'")
def diff_arrays(spark, sf):
    return snapshots.list_changes(_snapshot(spark, sf, "lang <> 'es'", False), _snapshot(spark, sf, "source <> 'src3'", True), "exports")


PARTS = E.replace("l_suppkey)", "l_partkey)").replace("l_suppkey AS dst", "l_partkey AS dst")


@query(f"WITH {PARTS}, f AS ({fx.earlier(PARTS)[6:-1]}) SELECT src, dst, 'added' AS status FROM (SELECT src, dst FROM e EXCEPT SELECT src, dst FROM f) UNION ALL SELECT src, dst, 'removed' FROM (SELECT src, dst FROM f EXCEPT SELECT src, dst FROM e)")
def diff_deps(spark, sf):
    return snapshots.dependency_changes(fx.key_edges(spark, sf, fx.EARLIER, "l_partkey"), fx.key_edges(spark, sf, "true", "l_partkey"))


def _issues(spark, sf, where: str):
    m = fx.suppliers(spark, sf)
    found = detect.high_coupling(m, fx.path_edges(spark, sf, where), MANY)
    return snapshots.issue_id(found.select(F.lit("HighCoupling").alias("kind"), F.array("path").alias("paths")))


ISS = f"{M}, {E}, {PE}, e3 AS ({fx.earlier(E)[6:-1]}), pe3 AS (SELECT a.path AS src, b.path AS dst FROM e3 JOIN m a ON a.key = e3.src JOIN m b ON b.key = e3.dst), i1 AS (SELECT md5('HighCoupling|' || dst) AS issue_id FROM pe GROUP BY dst HAVING count(*) >= 450), i3 AS (SELECT md5('HighCoupling|' || dst) AS issue_id FROM pe3 GROUP BY dst HAVING count(*) >= 450)"


@query(f"WITH {ISS} SELECT issue_id, 'HighCoupling' AS kind, 'new' AS status FROM i1 WHERE issue_id NOT IN (SELECT issue_id FROM i3) UNION ALL SELECT issue_id, 'HighCoupling', 'resolved' FROM i3 WHERE issue_id NOT IN (SELECT issue_id FROM i1)")
def diff_issues(spark, sf):
    return snapshots.issue_changes(_issues(spark, sf, fx.EARLIER), _issues(spark, sf, "true"))


def _metrics(spark, sf, where: str):
    return snapshots.metrics(fx.sized_modules(fx.definitions(spark, sf)), fx.path_edges(spark, sf, where), _issues(spark, sf, where))


MET = "k AS (SELECT count(*) AS total_modules, CAST(sum(lines) AS BIGINT) AS total_lines FROM c), v1 AS (SELECT CAST(sum(n) AS BIGINT) AS t, round(avg(n), 6) AS a, max(n) AS x FROM (SELECT count(*) AS n FROM pe GROUP BY dst)), v3 AS (SELECT CAST(sum(n) AS BIGINT) AS t, round(avg(n), 6) AS a, max(n) AS x FROM (SELECT count(*) AS n FROM pe3 GROUP BY dst))"


@query(f"WITH {ISS}, {D}, {MET} SELECT total_modules, total_lines, t AS total_dependencies, a AS avg_coupling, x AS max_coupling, (SELECT count(*) FROM i1) AS total_issues FROM k, v1")
def snapshot_metrics(spark, sf):
    return _metrics(spark, sf, "true")


@query(f"WITH {ISS}, {D}, {MET} SELECT CAST(0 AS BIGINT) AS total_modules_delta, CAST(0 AS BIGINT) AS total_lines_delta, v1.t - v3.t AS total_dependencies_delta, round(v1.a - v3.a, 6) AS avg_coupling_delta, v1.x - v3.x AS max_coupling_delta, (SELECT count(*) FROM i1) - (SELECT count(*) FROM i3) AS total_issues_delta FROM v1, v3")
def diff_metrics(spark, sf):
    return snapshots.metric_changes(_metrics(spark, sf, fx.EARLIER), _metrics(spark, sf, "true"))


@query(f"WITH {M}, {E}, {PE}, {DEG} SELECT path, fan_in, fan_out, CASE WHEN fan_in >= 450 THEN 1 ELSE 0 END::BIGINT AS issue_count, 'module' AS category FROM g")
def graph_nodes(spark, sf):
    m = fx.modules(spark, sf)
    edges = resolve.by_name(m).select("src", "dst")
    return views.nodes(m, edges, detect.high_coupling(m, edges, MANY), fx.ROOT)


@query(f"WITH RECURSIVE {CLOSED} SELECT src AS source, dst AS target, count(*) AS n, bool_or(EXISTS (SELECT 1 FROM r WHERE r.a = oe.dst AND r.b = oe.src)) AS is_cycle FROM oe GROUP BY src, dst")
def graph_links(spark, sf):
    edges = fx.order_edges(spark, sf)
    return views.links(edges, graph.strong_components(edges))


@query(f"WITH {M}, {E}, {PE} SELECT (SELECT count(*) FROM m) AS total_modules, (SELECT count(*) FROM pe) AS total_dependencies, (SELECT count(*) FROM (SELECT dst FROM pe GROUP BY dst HAVING count(*) >= 450)) AS total_issues")
def graph_metadata(spark, sf):
    m, edges = fx.suppliers(spark, sf), fx.path_edges(spark, sf)
    one = F.lit(1).alias("_one")
    a, b, c = m.agg(F.count("*").alias("total_modules"), one), edges.agg(F.sum("n").alias("total_dependencies"), one), detect.high_coupling(m, edges, MANY).agg(F.count("*").alias("total_issues"), one)
    return a.join(b, "_one").join(c, "_one").drop("_one")


@query(f"WITH RECURSIVE {CLOSED}, f AS (SELECT dst, count(*) AS n FROM oe GROUP BY dst), y AS ({ORACLE_SQL['cycles']}) SELECT (SELECT count(*) FROM orders) AS total_modules, (SELECT CAST(sum(length(o_orderpriority)) AS BIGINT) FROM orders) AS total_lines, (SELECT CAST(sum(n) AS BIGINT) FROM f) AS total_dependencies, (SELECT round(avg(n), 6) FROM f) AS avg_coupling, (SELECT max(n) FROM f) AS max_coupling, (SELECT count(*) FROM y) AS total_issues, (SELECT count(*) FROM y) AS total_cycles")
def snapshot_cycles(spark, sf):
    """Totals with cycles; each cycle is an issue."""
    edges = written(fx.order_edges(spark, sf), "edges")
    on_cycles = graph.strong_components(edges)
    sized = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), F.length("o_orderpriority").cast("long").alias("lines"))
    return snapshots.metrics(sized, edges, on_cycles.select("component").distinct(), on_cycles)


def _union(spark, sf):
    m, edges, defs = fx.suppliers(spark, sf), fx.path_edges(spark, sf), fx.definitions(spark, sf)
    counts, sized = detect.definition_counts(defs), fx.sized_modules(defs)
    row = lambda df, kind, severity: df.select(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), "path", views.advice(F.lit(kind)).alias("advice"))
    return row(detect.god_objects(sized, counts), "GodObject", "warn").unionByName(row(detect.high_coupling(m, edges, MANY), "HighCoupling", "warn")).unionByName(row(detect.fat_modules(sized, counts), "FatModule", "info"))


ALL = f"{M}, {E}, {PE}, {DEG}, {D}, u AS (SELECT 'GodObject' AS kind, 'warn' AS severity, path, 'EXTRACT' AS advice FROM c WHERE lines >= 500 AND CAST(structs > 3 AS INT) + CAST(functions > 10 AS INT) + CAST(traits > 0 AS INT) + CAST(impls > 5 AS INT) > 1 UNION ALL SELECT 'HighCoupling', 'warn', path, 'INTERFACE' FROM g WHERE fan_in >= 450 UNION ALL SELECT 'FatModule', 'info', path, 'EXTRACT' FROM c WHERE lines >= 400 AND private_functions >= 8 AND lines / greatest(exports, 1) > 100)"


@query(f"WITH {ALL} SELECT kind, severity, path FROM u")
def issues_union(spark, sf):
    return _union(spark, sf).drop("advice")


@query(f"WITH {ALL} SELECT kind, severity, count(*) AS n FROM u GROUP BY kind, severity")
def issue_counts(spark, sf):
    return snapshots.issue_counts(_union(spark, sf))


@query(f"WITH {ALL} SELECT kind, severity, path FROM u WHERE severity = 'warn'")
def min_severity(spark, sf):
    return detect.at_least(_union(spark, sf), "warn").drop("advice")


KINDS = f"""SELECT kind, severity, path FROM (WITH {ALL} SELECT kind, severity, path FROM u)
UNION ALL SELECT 'LowCohesion', 'info', path FROM ({ORACLE_SQL['low_cohesion']})
UNION ALL SELECT 'BoundaryViolation', 'warn', boundary FROM ({ORACLE_SQL['boundary_violations']})
UNION ALL SELECT 'CircularDependency', 'error', CAST(component AS VARCHAR) FROM ({ORACLE_SQL['cycles']})
UNION ALL SELECT 'DeepDependencyChain', 'warn', split_part(chain, ' > ', 1) FROM ({ORACLE_SQL['deep_chains']})"""


@query(KINDS)
def issues_of_all_kinds(spark, sf):
    """All seven detectors; components are found once, for cycles and chains."""
    edges = written(fx.order_edges(spark, sf), "edges")
    components = graph.strong_components(edges)
    row = lambda df, kind, severity, path: df.select(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), path.cast("string").alias("path"))
    found = _union(spark, sf).drop("advice")
    found = found.unionByName(row(low_cohesion(spark, sf), "LowCohesion", "info", F.col("path")))
    found = found.unionByName(row(boundary_violations(spark, sf), "BoundaryViolation", "warn", F.col("boundary")))
    found = found.unionByName(row(components.select("component").distinct(), "CircularDependency", "error", F.col("component")))
    return found.unionByName(row(detect.deep_chains(edges, components=components), "DeepDependencyChain", "warn", F.element_at("nodes", 1)))


@query(f"SELECT bool_or(severity = 'error') AS any_error, count(*) AS issues FROM ({KINDS})")
def any_error(spark, sf):
    return issues_of_all_kinds(spark, sf).agg(F.bool_or(F.col("severity") == "error").alias("any_error"), F.count("*").alias("issues"))


@query(f"WITH {ALL} SELECT path, count(*) AS issues, string_agg(DISTINCT advice, ',' ORDER BY advice) AS advice FROM u GROUP BY path")
def recommendations(spark, sf):
    return _union(spark, sf).groupBy("path").agg(F.count("*").alias("issues"), F.array_join(F.array_sort(F.collect_set("advice")), ",").alias("advice"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS escaped FROM pages")
def xml_escape(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", paths.escape_xml(F.col("html")).alias("escaped"))


@query("SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 5 - 2 > 0 THEN '+' || (o_orderkey % 5 - 2) ELSE CAST(o_orderkey % 5 - 2 AS VARCHAR) END AS delta FROM orders")
def format_delta(spark, sf):
    return fx.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", paths.delta(F.col("o_orderkey") % 5 - 2).alias("delta"))


@query("SELECT p_partkey, i AS imported, CASE WHEN p_partkey % 6 IN (0, 1) THEN 'std' WHEN p_partkey % 6 = 2 THEN 'crate' WHEN p_partkey % 6 = 3 THEN 'relative' WHEN p_partkey % 6 = 4 THEN 'serde' ELSE 'numpy' END AS crate FROM (SELECT *, ['std::fs', 'core::mem', 'crate::a::b', './x', 'serde::De', 'numpy'][p_partkey % 6 + 1] AS i FROM part)")
def crate_name(spark, sf):
    kinds = F.array(*map(F.lit, ["std::fs", "core::mem", "crate::a::b", "./x", "serde::De", "numpy"]))
    own = fx.table(spark, sf, "part").select("p_partkey", F.element_at(kinds, (F.col("p_partkey") % 6 + 1).cast("int")).alias("imported"))
    return own.withColumn("crate", paths.crate(F.col("imported")))


@query("WITH a AS (SELECT user_id AS u, max(event_id) AS m FROM events WHERE value < 50 GROUP BY user_id), b AS (SELECT user_id AS u, max(event_id) AS m FROM events WHERE event_type <> 'click' GROUP BY user_id) SELECT CAST(coalesce(a.u, b.u) AS VARCHAR) AS path, CASE WHEN a.u IS NULL THEN 'added' WHEN b.u IS NULL THEN 'deleted' ELSE 'modified' END AS status FROM a FULL JOIN b ON a.u = b.u WHERE a.u IS NULL OR b.u IS NULL OR a.m <> b.m")
def change_status(spark, sf):
    of = lambda where: fx.table(spark, sf, "events").where(where).groupBy(F.col("user_id").cast("string").alias("path")).agg(F.max("event_id").alias("mtime"))
    return snapshots.file_changes(of("value < 50"), of("event_type <> 'click'"))


# Parsers and what follows from them, over files that Spark writes out of the tables.
R = rendered.SQL
#: Limits that the rendered files meet at every scale.
SMALL = detect.Thresholds(god_object_lines=100, fat_module_lines=100, fat_module_private_functions=3, lines_per_export=20.0)
FOUND = f"""{R}, ct AS (
  SELECT path, count(*) FILTER (kind = 'Struct') AS structs, count(*) FILTER (kind = 'Function') AS functions, count(*) FILTER (kind = 'Impl') AS impls, count(*) FILTER (kind = 'Trait') AS traits,
         count(*) FILTER (kind = 'Function' AND visibility = 'Private') AS private_functions, count(*) FILTER (kind = 'Function' AND visibility = 'Public') AS public_functions,
         count(*) FILTER (visibility = 'Public') AS exports
  FROM de GROUP BY path
)"""


def _parsed(spark, sf):
    return parse.modules(rendered.sources(spark, sf))


def _parsed_definitions(spark, sf):
    return _parsed(spark, sf).select("path", F.explode("definitions").alias("d")).select("path", "d.*")


@query(f"WITH {R} SELECT path, name, kind, CAST(line AS BIGINT) AS line, visibility, signature FROM de")
def parsed_definitions(spark, sf):
    return _parsed_definitions(spark, sf)


@query(f"WITH {R} SELECT x AS language, kind, visibility, count(*) AS n, CAST(sum(line) AS BIGINT) AS lines FROM de GROUP BY ALL")
def parsed_by_sql(spark, sf):
    """The parsers as a table function of SQL."""
    parse.register_sql(spark)
    return spark.sql("SELECT substring_index(path, '.', -1) AS language, kind, visibility, count(*) AS n, sum(line) AS lines FROM source_definitions(TABLE(SELECT * FROM {files})) GROUP BY ALL", files=rendered.sources(spark, sf))


@query(f"WITH {R} SELECT path, CAST(pos AS BIGINT) AS pos, imported FROM im")
def parsed_imports(spark, sf):
    return resolve.import_rows(_parsed(spark, sf)).select(F.col("src").alias("path"), F.col("pos").cast("long").alias("pos"), "imported")


@query(
    f"WITH {R}, ex AS (SELECT key, string_agg(name, ',' ORDER BY line) AS exported FROM de WHERE visibility = 'Public' GROUP BY key) "
    "SELECT path, name, CAST(lines AS BIGINT) AS lines, coalesce(exported, '') AS exported, FALSE AS failed FROM mo LEFT JOIN ex ON ex.key = mo.key"
)
def parsed_modules(spark, sf):
    m = _parsed(spark, sf)
    return m.select("path", "name", "lines", F.array_join("exports", ",").alias("exported"), F.col("parse_error").isNotNull().alias("failed"))


RESOLVED = "ed AS (SELECT im.path AS src, t.path AS dst, CAST(pos AS BIGINT) AS pos FROM im JOIN w t ON t.key = im.dst AND t.x = 'rs' WHERE im.x = 'rs' AND im.dst % 2 = 0)"


@query(f"WITH {R}, {RESOLVED} SELECT src, dst, pos FROM ed")
def parsed_edges(spark, sf):
    return resolve.by_path(_parsed(spark, sf)).select("src", "dst", F.col("pos").cast("long").alias("pos"))


@query(f"WITH {R}, {RESOLVED} SELECT dst AS path, count(*) AS fan_in, count(DISTINCT src) AS fan_in_distinct FROM ed WHERE dst NOT LIKE '%/models/%' GROUP BY dst HAVING count(*) >= 5")
def parsed_high_coupling(spark, sf):
    """With the default limit and the files that may be coupled."""
    m = written(_parsed(spark, sf), "modules")
    return detect.high_coupling(m, resolve.by_path(m))


@query(f"""WITH {R}, b AS (
  SELECT CASE t WHEN 2 THEN 'Persistence' ELSE 'Network' END AS boundary, path, CAST(line + 1 AS BIGINT) AS line, CASE t WHEN 2 THEN 'SELECT ' ELSE 'fetch(' END AS indicator, folder
  FROM de WHERE kind = 'Function' AND t IN (2, 3)
) SELECT boundary, path, line, indicator FROM b WHERE NOT (boundary = 'Persistence' AND folder = 'db')""")
def parsed_boundary_hits(spark, sf):
    """With the default boundaries; what a quote sign precedes doesn't count, nor what is allowed in its folder."""
    return detect.boundary_hits(rendered.sources(spark, sf), detect.BOUNDARIES)


@query(
    f"WITH {FOUND}, k AS (SELECT mo.path, lines, list_filter([CASE WHEN structs > 3 THEN 'structs' END, CASE WHEN functions > 10 THEN 'functions' END, CASE WHEN traits > 0 THEN 'traits' END, "
    "CASE WHEN impls > 5 THEN 'impls' END], lambda x: x IS NOT NULL) AS l FROM mo JOIN ct ON ct.path = mo.path WHERE lines >= 100) SELECT path, CAST(lines AS BIGINT) AS lines, array_to_string(l, ',') AS responsibilities FROM k WHERE len(l) > 1"
)
def parsed_god_objects(spark, sf):
    m = written(_parsed(spark, sf), "modules")
    return detect.god_objects(m.select("path", "lines"), detect.definition_counts(m.select("path", F.explode("definitions").alias("d")).select("path", "d.*")), SMALL)


@query(
    f"WITH {FOUND} SELECT mo.path, CAST(lines AS BIGINT) AS lines, private_functions, public_functions, round(lines / greatest(exports, 1), 6)::DOUBLE AS lines_per_export FROM mo JOIN ct ON ct.path = mo.path "
    "WHERE lines >= 100 AND private_functions >= 3 AND lines / greatest(exports, 1) > 20 AND folder <> 'tests'"
)
def parsed_fat_modules(spark, sf):
    m = written(_parsed(spark, sf), "modules")
    return detect.fat_modules(m.select("path", "lines"), detect.definition_counts(m.select("path", F.explode("definitions").alias("d")).select("path", "d.*")), SMALL)


@query(f"""WITH {R}, z AS (
  SELECT path, CASE WHEN imported LIKE 'crate::%' OR imported LIKE './%' THEN NULL ELSE split_part(imported, '::', 1) END AS crate, count(*) AS n FROM im GROUP BY path, crate
), t AS (
  SELECT path, CAST(coalesce(sum(n) FILTER (crate IS NULL), 0) AS BIGINT) AS internal, count(crate) AS crates, array_to_string(list(crate ORDER BY n DESC, crate) FILTER (crate IS NOT NULL)[1:3], ',') AS top FROM z GROUP BY path
) SELECT path, round((internal + 1) / (internal + 1 + crates), 6) AS score, internal, crates, top FROM t WHERE (internal + 1) / (internal + 1 + crates) < 0.3 AND crates >= 3""")
def parsed_low_cohesion(spark, sf):
    m = written(_parsed(spark, sf), "modules")
    return detect.low_cohesion(m)


@query(f"WITH {R} SELECT path, CASE folder WHEN 'tests' THEN 'test' WHEN 'models' THEN 'model' ELSE 'module' END AS category, folder = 'tests' AS is_test FROM w")
def parsed_categories(spark, sf):
    return rendered.sources(spark, sf).select("path", paths.category(F.col("path")).alias("category"), paths.is_test(F.col("path")).alias("is_test"))
