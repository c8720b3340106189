"""The tables of the benchmark read as a code base.

Suppliers are modules and neighbouring line items of an order a dependency; parts are definitions; documents
are source files. Orders that follow each other for a customer are a sparse graph, with a cycle for each customer
of negative balance. All rows of the tables take part. The SQL fragments give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Edges that reach a supplier, about the mean at every scale.
MANY = 450
#: Line items of an earlier state of the code base.
EARLIER = "l_returnflag <> 'A'"
ROOT = "/proj"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, path, name, n): suppliers as modules; n counts them."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey"), "s_nationkey")
    return s.select(F.col("s_suppkey").alias("key"), F.format_string("/proj/src/r%d/s%d.rs", "n_regionkey", "s_suppkey").alias("path"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("name"))


def key_edges(spark: SparkSession, sf_dir: str, where: str = "true", key: str = "l_suppkey") -> DataFrame:
    """(src, dst): keys of neighbouring line items of an order, by default its suppliers."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    li = table(spark, sf_dir, "lineitem").where(where)
    return li.select(F.lag(key).over(w).alias("src"), F.col(key).alias("dst")).where("src IS NOT NULL")


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): each order and the customer's next; the last and the first, for customers of negative balance."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    follow = o.select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(w).alias("dst")).where("dst IS NOT NULL")
    debtors = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    ends = o.join(debtors, "o_custkey", "left_semi").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("src"), F.min(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("dst"))
    return follow.unionByName(ends.select("src", "dst"))


def path_edges(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """(src, dst, n): pairs of paths and how often each stands."""
    m = suppliers(spark, sf_dir).select("key", "path")
    e = key_edges(spark, sf_dir, where).groupBy("src", "dst").count()
    e = e.join(m.select(F.col("key").alias("src"), F.col("path").alias("a")), "src").join(m.select(F.col("key").alias("dst"), F.col("path").alias("b")), "dst")
    return e.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("count").alias("n"))


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with imports: by the crate's path to each dependency."""
    e = key_edges(spark, sf_dir).groupBy(F.col("src").alias("key")).agg(F.array_sort(F.collect_list(F.format_string("crate::s%d::T", "dst"))).alias("imports"))
    return suppliers(spark, sf_dir).join(e, "key", "left").select("path", "name", F.coalesce("imports", F.array().cast("array<string>")).alias("imports"))


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, pos, imported): each dependency of a supplier as an import, a row each; positions are all 0."""
    m = suppliers(spark, sf_dir).select("key", F.col("path").alias("a"))
    return key_edges(spark, sf_dir).join(m, F.col("src") == F.col("key")).select(F.col("a").alias("src"), F.lit(0).alias("pos"), F.format_string("crate::s%d::T", "dst").alias("imported"))


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, kind, visibility, size): parts as definitions of suppliers."""
    n = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    k, v = F.col("p_size") % 10, F.floor(F.col("p_partkey") / F.col("n")) % 5
    kind = F.when(k <= 4, "Function").when(k <= 6, "Struct").when(k == 7, "Trait").when(k == 8, "Impl").otherwise("Enum")
    seen = F.when(v == 0, "Public").when(v == 1, "Crate").otherwise("Private")
    p = table(spark, sf_dir, "part").join(F.broadcast(n)).select((F.col("p_partkey") % F.col("n")).alias("m"), "n", kind.alias("kind"), seen.alias("visibility"), F.col("p_size").cast("long").alias("size"))  # one row
    own = suppliers(spark, sf_dir).join(F.broadcast(n)).select((F.col("key") % F.col("n")).alias("m"), "path")
    return p.join(own, "m").select("path", "kind", "visibility", "size")


def sized_modules(defs: DataFrame) -> DataFrame:
    return defs.groupBy("path").agg(F.sum("size").alias("lines"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): documents as files."""
    return table(spark, sf_dir, "documents").select(F.format_string("/%s/%s/%d.txt", "source", "lang", "doc_id").alias("path"), F.col("text").alias("content"))


SQL = {
    "m": "m AS (SELECT s_suppkey AS key, '/proj/src/r' || n_regionkey || '/s' || s_suppkey || '.rs' AS path, 's' || s_suppkey AS name FROM supplier JOIN nation ON n_nationkey = s_nationkey)",
    "e": "e AS (SELECT src, dst FROM (SELECT lag(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS src, l_suppkey AS dst FROM lineitem) WHERE src IS NOT NULL)",
    "oe": "oe AS (SELECT src, dst FROM (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders) WHERE dst IS NOT NULL UNION ALL SELECT arg_max(o_orderkey, (o_orderdate, o_orderkey)), arg_min(o_orderkey, (o_orderdate, o_orderkey)) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0 GROUP BY o_custkey)",
    "pe": "pe AS (SELECT a.path AS src, b.path AS dst FROM e JOIN m a ON a.key = e.src JOIN m b ON b.key = e.dst)",
    "d": "n AS (SELECT count(*) AS n FROM supplier), d AS (SELECT path, CASE WHEN p_size % 10 <= 4 THEN 'Function' WHEN p_size % 10 <= 6 THEN 'Struct' WHEN p_size % 10 = 7 THEN 'Trait' WHEN p_size % 10 = 8 THEN 'Impl' ELSE 'Enum' END AS kind, CASE (p_partkey // n) % 5 WHEN 0 THEN 'Public' WHEN 1 THEN 'Crate' ELSE 'Private' END AS visibility, p_size FROM part, n JOIN m ON m.key % n = p_partkey % n), c AS (SELECT path, sum(p_size) AS lines, count(*) FILTER (kind = 'Struct') AS structs, count(*) FILTER (kind = 'Function') AS functions, count(*) FILTER (kind = 'Impl') AS impls, count(*) FILTER (kind = 'Trait') AS traits, count(*) FILTER (kind = 'Enum') AS enums, count(*) FILTER (kind = 'Function' AND visibility = 'Private') AS private_functions, count(*) FILTER (kind = 'Function' AND visibility = 'Public') AS public_functions, count(*) FILTER (visibility = 'Public') AS exports FROM d GROUP BY path)",
    "s": "s AS (SELECT '/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, text AS content FROM documents)",
}


def earlier(sql: str) -> str:
    """The SQL of edges in the earlier state."""
    return sql.replace("FROM lineitem", f"FROM lineitem WHERE {EARLIER}")
