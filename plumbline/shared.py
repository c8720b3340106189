"""Tables in the folder that the driver and all executors share.

Iterative operators cut their lineage by writing a table and reading it again. The folder comes from
``spark.checkpoint.dir``. Only a local master, where one machine is the whole cluster, gets a folder of
its own when the setting is missing.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder; raises on a cluster that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    own = tempfile.mkdtemp(prefix="plumbline-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def _root(spark: SparkSession) -> str:
    return f"{folder(spark)}/plumbline/{spark.sparkContext.applicationId}"


def place(spark: SparkSession, name: str) -> str:
    """A new path for a table called ``name``."""
    return f"{_root(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots written as two underscores) for the queries that run within."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, safe against lost executors.

    The shuffle files behind it go as soon as the table is complete, not when the driver collects its garbage.
    """
    spark, path = df.sparkSession, place(df.sparkSession, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def bucketed(df: DataFrame, name: str, column: str) -> Iterator[DataFrame]:
    """``df`` as a table in the shared folder, bucketed and sorted by ``column``: joins on it don't shuffle it again.

    It leaves the catalog and the folder with the block, so what is read from it is written within.
    """
    spark, path = df.sparkSession, place(df.sparkSession, name)
    buckets, table = max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "t_" + path.rsplit("-", 1)[1]
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.repartition(buckets, column).write.bucketBy(buckets, column).sortBy(column).option("path", path).saveAsTable(table)
    try:
        yield spark.table(table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        forget(spark, path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that ``written`` made and nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        forget(df.sparkSession, path)


def forget(spark: SparkSession, path: str | None = None) -> None:
    """Deletes ``path``, or everything that this application has written here."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path or _root(spark))
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
