"""The store of snapshots: whole versions, files left out, failures."""

import os

import pytest
from pyspark.sql import functions as F

from plumbline.shared import settings
from plumbline.sources import store


def test_versions(spark, tmp_path):
    where = (tmp_path / "store").as_uri()
    df = spark.range(1000).select(F.format_string("src/m%04d.rs", "id").alias("path"), F.array(F.col("id").cast("string")).alias("imports"), F.col("id").alias("lines"))
    df = df.unionByName(spark.createDataFrame([(None, None, None), ("é.rs", [], 1)], "path string, imports array<string>, lines long"))
    assert store.save(df, where) == 1 and store.save(df.where("lines < 10"), where) == 2 and store.save(df.limit(0), where) == 3
    read = lambda version=None: store.load(spark, where, version and int(version))
    assert read(version="1").schema.simpleString() == df.schema.simpleString()
    assert sorted(map(repr, read(version="1").collect())) == sorted(map(repr, df.collect()))
    assert read(version="2").count() == 11 and read().count() == 0
    with pytest.raises(Exception, match="no version 9"):
        read(version="9").collect()
    files = sorted(os.listdir(tmp_path / "store/files"))
    with settings(spark, spark__sql__python__filterPushdown__enabled="true"):
        one = read(version="1").where("path = 'src/m0500.rs'")
        assert one.collect()[0].lines == 500 and one.rdd.getNumPartitions() == 1
        assert read(version="1").where("path LIKE 'src/m00%'").count() == 100 and read(version="1").where("path > 'src/m0989.rs'").count() == 11
        assert read(version="1").where("path IN ('src/m0001.rs', 'é.rs', 'none')").select("path", "imports").count() == 2
        assert read(version="1").where("path IS NULL").count() == 1 and read(version="1").where("lines = 7").count() == 1
    assert sorted(os.listdir(tmp_path / "store/files")) == files


def test_a_failed_task_leaves_no_version(spark, tmp_path):
    where = str(tmp_path / "store")
    df = spark.range(100).select(F.format_string("p%d", "id").alias("path"), F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("lines"))
    with pytest.raises(Exception, match="lost"):
        store.save(df, where)
    assert store.versions(where) == []
    assert store.save(spark.range(5).select(F.col("id").cast("string").alias("path")), where) == 1
    with pytest.raises(Exception, match="mode append"):
        spark.range(1).select(F.lit("a").alias("path")).write.format("snapshot_store").option("path", where).mode("overwrite").save()
    with pytest.raises(Exception, match="column path"):
        spark.range(1).write.format("snapshot_store").option("path", where).mode("append").save()
