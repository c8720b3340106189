"""Source files written out of the benchmark tables by Spark, so that parsers read something that grows with them.

A supplier is a file, in Rust, Python or TypeScript by its key. It imports what its line items' neighbours name, one line for
each, and holds its parts as definitions of three lines. Bodies hold comments and literals with brackets, keywords and marks of
outside access. Some Python files end in a line that isn't Python. The SQL gives what parsers must find, from the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import fixtures as fx

FOLDER = "CASE {k} % 5 WHEN 0 THEN 'db' WHEN 1 THEN 'models' WHEN 2 THEN 'tests' ELSE 'core' END"
LANGUAGE = "CASE {k} % 3 WHEN 0 THEN 'rs' WHEN 1 THEN 'py' ELSE 'ts' END"
PATH = f"concat('/code/', {FOLDER}, '/s', CAST({{k}} AS STRING), '.', {LANGUAGE})"
#: Shared by Spark and the SQL: what a part is, by language x, size s, turn v, key p.
KIND = {
    "rs": "CASE WHEN s % 10 <= 4 THEN 'Function' WHEN s % 10 <= 6 THEN 'Struct' WHEN s % 10 = 7 THEN 'Trait' WHEN s % 10 = 8 THEN 'Impl' ELSE 'Enum' END",
    "py": "CASE WHEN s % 10 <= 4 THEN 'Function' ELSE 'Class' END",
    "ts": "CASE WHEN s % 10 <= 4 THEN 'Function' WHEN s % 10 <= 6 THEN 'Class' ELSE 'Interface' END",
}


def path(key: str) -> Column:
    return F.expr(PATH.format(k=key))


def _import_line(x: Column, d: Column) -> Column:
    near, far = d % 2 == 0, (d % 7).cast("string")
    d = d.cast("string")
    return (
        F.when(x == "rs", F.when(near, F.concat(F.lit("use crate::s"), d, F.lit("::T;"))).otherwise(F.concat(F.lit("use c"), far, F.lit("::T;"))))
        .when(x == "py", F.when(near, F.concat(F.lit("from .s"), d, F.lit(" import T"))).otherwise(F.concat(F.lit("import c"), far)))
        .otherwise(F.when(near, F.concat(F.lit("import { T } from './s"), d, F.lit("';"))).otherwise(F.concat(F.lit("import x from 'c"), far, F.lit("';"))))
    )


def _definition(x: Column, kind: Column, v: Column, p: Column) -> Column:
    """The three lines of a definition."""
    turn, p = p % 4, p.cast("string")
    seen = F.when(v == 0, "pub ").when(v == 1, "pub(crate) ").otherwise("")
    rust = F.when(kind == "Function", F.concat(seen, F.lit("fn p"), p, F.lit("(x: u32) -> u32 {"))).when(kind == "Impl", F.concat(F.lit("impl P"), p, F.lit(" {"))).otherwise(F.concat(seen, F.lower(kind), F.lit(" P"), p, F.lit(" {")))
    rust_body = F.when(kind != "Function", "    // fn hidden() {").when(turn == 0, "    x + 1").when(turn == 1, '    run("SELECT } 1")').when(turn == 2, "    // SELECT { 1").otherwise("    fetch(x)")
    hidden = F.when(v < 2, "").otherwise("_")
    python = F.when(kind == "Function", F.concat(F.lit("def "), hidden, F.lit("p"), p, F.lit("(x):"))).otherwise(F.concat(F.lit("class "), hidden, F.lit("P"), p, F.lit(":")))
    python_body = F.when(kind != "Function", '    a = "def fake():"').when(turn == 0, "    return x").when(turn == 1, '    run("SELECT 1")').when(turn == 2, "    x = 1  # SELECT 1").otherwise("    fetch(x)")
    shown = F.when(v < 2, "export ").otherwise("")
    script = F.when(kind == "Function", F.concat(shown, F.lit("function p"), p, F.lit("(a: number): string {"))).otherwise(F.concat(shown, F.lower(kind), F.lit(" P"), p, F.lit(" {")))
    script_body = F.when(kind != "Function", "  // function hidden() {").when(turn == 0, '  return "}";').when(turn == 1, '  run("SELECT 1");').when(turn == 2, "  // SELECT 1").otherwise("  fetch(a);")
    first = F.when(x == "rs", rust).when(x == "py", python).otherwise(script)
    body = F.when(x == "rs", rust_body).when(x == "py", python_body).otherwise(script_body)
    return F.concat_ws("\n", first, body, F.when(x == "py", "# class Hidden:").otherwise("}"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a file for each supplier."""
    own = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.expr(LANGUAGE.format(k="s_suppkey")).alias("x"))
    n = own.agg(F.count("*").alias("n"))
    imported = fx.key_edges(spark, sf_dir).distinct().join(own, F.col("src") == F.col("key"))
    lines = imported.select("key", F.lit(0).alias("part"), F.col("dst").alias("at"), _import_line(F.col("x"), F.col("dst")).alias("text"))
    p = fx.table(spark, sf_dir, "part").join(F.broadcast(n)).select((F.col("p_partkey") % F.col("n")).alias("m"), F.floor(F.col("p_partkey") / F.col("n")).alias("v"), F.col("p_size").alias("s"), F.col("p_partkey").alias("p"))  # one row
    p = p.join(own.join(F.broadcast(n)).select("key", "x", (F.col("key") % F.col("n")).alias("m")), "m")
    kind = F.expr(f"CASE x WHEN 'rs' THEN {KIND['rs']} WHEN 'py' THEN {KIND['py']} ELSE {KIND['ts']} END")
    lines = lines.unionByName(p.select("key", F.lit(1).alias("part"), F.col("p").alias("at"), _definition(F.col("x"), kind, F.col("v") % 5, F.col("p")).alias("text")))
    lines = lines.unionByName(own.where("x = 'py' AND key % 7 = 0").select("key", F.lit(2).alias("part"), F.lit(0).cast("long").alias("at"), F.lit("def (").alias("text")))
    # a file's lines, as many as its supplier has parts and neighbours
    texts = lines.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("part", "at", "text"))).alias("t"))
    content = F.concat(F.array_join(F.col("t.text"), "\n"), F.lit("\n"))
    return own.join(texts, "key", "left").select(path("key").alias("path"), F.coalesce(content, F.lit("")).alias("content"))


def _sql(text: str) -> str:
    return text.replace("CAST(key AS STRING)", "key")


SQL = f"""{fx.SQL['e']},
w AS (SELECT s_suppkey AS key, {_sql(PATH.format(k='s_suppkey').replace('CAST(s_suppkey AS STRING)', 's_suppkey'))} AS path, {LANGUAGE.format(k='s_suppkey')} AS x, {FOLDER.format(k='s_suppkey')} AS folder, count(*) OVER () AS n FROM supplier),
im AS (
  SELECT key, path, x, row_number() OVER (PARTITION BY key ORDER BY dst) - 1 AS pos, dst,
         CASE WHEN dst % 2 = 0 THEN CASE x WHEN 'rs' THEN 'crate::s' || dst || '::T' WHEN 'py' THEN '.s' || dst ELSE './s' || dst END
              ELSE 'c' || (dst % 7) || CASE x WHEN 'rs' THEN '::T' ELSE '' END END AS imported
  FROM (SELECT DISTINCT src, dst FROM e) JOIN w ON key = src
),
ni AS (SELECT key, count(*) AS ni FROM im GROUP BY key),
p0 AS (
  SELECT w.key, path, x, folder, p_partkey AS p, (p_partkey // n) % 5 AS v, p_size AS s, p_partkey % 4 AS t,
         CASE x WHEN 'rs' THEN {KIND['rs'].replace('s %', 'p_size %')} WHEN 'py' THEN {KIND['py'].replace('s %', 'p_size %')} ELSE {KIND['ts'].replace('s %', 'p_size %')} END AS kind,
         coalesce(ni, 0) + 3 * row_number() OVER (PARTITION BY w.key ORDER BY p_partkey) - 2 AS line
  FROM part JOIN w ON w.key % n = p_partkey % n LEFT JOIN ni ON ni.key = w.key
),
de AS (
  SELECT key, path, x, folder, t, kind, line,
         CASE WHEN x = 'py' AND v > 1 THEN '_' ELSE '' END || CASE kind WHEN 'Function' THEN 'p' ELSE 'P' END || p AS name,
         CASE WHEN kind = 'Impl' THEN 'Private' WHEN v = 0 OR (v = 1 AND x <> 'rs') THEN 'Public' WHEN v = 1 THEN 'Crate' ELSE 'Private' END AS visibility,
         CASE WHEN x = 'py' THEN CASE kind WHEN 'Function' THEN 'def ' ELSE 'class ' END || CASE WHEN v > 1 THEN '_' ELSE '' END || CASE kind WHEN 'Function' THEN 'p' || p || '(x)' ELSE 'P' || p END
              WHEN x = 'ts' THEN CASE kind WHEN 'Function' THEN 'function p' || p || '(a: number): string' ELSE lower(kind) || ' P' || p || ' {{' || chr(10) || '  // function hidden() {{' || chr(10) || '}}' END
              WHEN kind = 'Impl' THEN 'impl P' || p
              ELSE CASE v WHEN 0 THEN 'pub ' WHEN 1 THEN 'pub(crate) ' ELSE '' END || CASE kind WHEN 'Function' THEN 'fn p' || p || '(x: u32) -> u32' ELSE lower(kind) || ' P' || p || ' {{' || chr(10) || '    // fn hidden() {{' || chr(10) || '}}' END END AS signature
  FROM p0
),
mo AS (
  SELECT w.key, w.path, w.x, folder, 's' || w.key AS name, coalesce(ni, 0) + 3 * coalesce(nd, 0) + CASE WHEN w.x = 'py' AND w.key % 7 = 0 THEN 1 ELSE 0 END AS lines
  FROM w LEFT JOIN ni ON ni.key = w.key LEFT JOIN (SELECT key, count(*) AS nd FROM de GROUP BY key) d ON d.key = w.key
)"""
