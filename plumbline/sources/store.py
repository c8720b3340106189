"""Snapshots as a store: versions of a table, each whole or not there, read with the paths asked for.

``spark.dataSource.register(SnapshotStore)``, then ``df.write.format("snapshot_store").option("path", ...).mode("append").save()`` adds
a version, and ``spark.read.format("snapshot_store").option("path", ...)`` reads the latest, or the one of ``version``. Each task
writes a Parquet file of its own under a name that no other has; the version is there once its list of files is, which the
driver writes last, under a name that must not exist. A task that fails or runs twice leaves a file that no list names. The list holds
each file's first and last path, so a filter on ``path`` leaves out files unopened.

The folder is a URI or path that driver and executors open alike; the files are the store's own, by Arrow's file systems.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage

LISTS, FILES, KEY = "versions", "files", "path"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _open(where: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(where) if "://" in where or where.startswith("file:") else (fs.LocalFileSystem(), where)


def versions(where: str) -> list[int]:
    """Numbers of the versions in a store, ascending."""
    system, root = _open(where)
    found = system.get_file_info(fs.FileSelector(f"{root}/{LISTS}", allow_not_found=True))
    return sorted(int(x.base_name.removesuffix(".json")) for x in found if x.base_name.endswith(".json"))


@dataclass
class _Written(WriterCommitMessage):
    file: str | None
    rows: int = 0
    low: str | None = None
    high: str | None = None
    nulls: int = 0


class _Writer(DataSourceArrowWriter):
    def __init__(self, where: str, kind: str):
        self.where, self.kind = where, kind

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, root = _open(self.where)
        done, out = _Written(None), None
        name = f"{FILES}/{uuid.uuid4().hex}.parquet"
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    system.create_dir(f"{root}/{FILES}", recursive=True)
                    out = pq.ParquetWriter(f"{root}/{name}", batch.schema, filesystem=system)
                out.write_batch(batch)
                keys = [x for x in batch.column(batch.schema.names.index(KEY)).to_pylist() if x is not None]
                done.rows, done.nulls = done.rows + batch.num_rows, done.nulls + batch.num_rows - len(keys)
                # by bytes, as Spark compares texts
                done.low = min([*keys, *([done.low] if done.low is not None else [])], key=str.encode, default=None)
                done.high = max([*keys, *([done.high] if done.high is not None else [])], key=str.encode, default=None)
        finally:
            if out is not None:
                out.close()
        done.file = name if out is not None else None
        return done

    def commit(self, messages: list[_Written | None]) -> None:
        system, root = _open(self.where)
        system.create_dir(f"{root}/{LISTS}", recursive=True)
        number = max(versions(self.where), default=0) + 1
        target = f"{root}/{LISTS}/{number}.json"
        if system.get_file_info(target).type != fs.FileType.NotFound:
            raise FileExistsError(f"version {number} is there already")
        whole = {"kind": self.kind, "files": [vars(m) for m in messages if m and m.file]}
        part = f"{root}/{LISTS}/{uuid.uuid4().hex}.part"
        with system.open_output_stream(part) as f:
            f.write(json.dumps(whole).encode())
        system.move(part, target)

    def abort(self, messages: list[_Written | None]) -> None:
        """Files of tasks that had ended; those of tasks that failed stay, named by no list."""
        system, root = _open(self.where)
        for m in messages:
            if m and m.file:
                system.delete_file(f"{root}/{m.file}")


@dataclass
class _File(InputPartition):
    file: str
    filters: list = field(default_factory=list)


class _Reader(DataSourceReader):
    def __init__(self, where: str, version: int, columns: list[str]):
        self.where, self.version, self.columns, self.asked = where, version, columns, []

    def partitions(self) -> list[_File]:
        system, root = _open(self.where)
        with system.open_input_stream(f"{root}/{LISTS}/{self.version}.json") as f:
            files = json.loads(f.read())["files"]
        return [_File(x["file"]) for x in files if all(may_hold(f, x["low"], x["high"]) for f in self.asked)] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if partition.file:
            system, root = _open(self.where)
            yield from ds.dataset(f"{root}/{partition.file}", filesystem=system, format="parquet").to_batches(columns=self.columns)


class _ChoosingReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on the path choose files; Spark still applies all of them to the rows."""
        kinds = (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringStartsWith)
        self.asked = [f for f in filters if isinstance(f, kinds) and f.attribute == (KEY,)]
        yield from filters


def may_hold(f: Filter, low: str | None, high: str | None) -> bool:
    """Whether a file with these first and last paths may hold a row that the filter keeps; a null path is kept by none."""
    if low is None:
        return False
    a, z = low.encode(), high.encode()
    if isinstance(f, In):
        return any(x is not None and a <= x.encode() <= z for x in f.value)
    x = f.value.encode()
    if isinstance(f, StringStartsWith):
        return a[: len(x)] <= x <= z[: len(x)]
    if isinstance(f, EqualTo):
        return a <= x <= z
    return z > x if isinstance(f, GreaterThan) else z >= x if isinstance(f, GreaterThanOrEqual) else a < x if isinstance(f, LessThan) else a <= x


class SnapshotStore(DataSource):
    """Options: path, the store's folder; version, by default the latest; choose, whether filters on ``path`` choose files, which needs the setting PUSHDOWN. Rows need a column ``path``; only mode append, which adds a version."""

    @classmethod
    def name(cls) -> str:
        return "snapshot_store"

    def _version(self) -> int:
        found = versions(self.options["path"])
        asked = int(self.options.get("version", found[-1] if found else 0))
        if asked not in found:
            raise ValueError(f"the store has no version {asked or 'yet'}")
        return asked

    def schema(self) -> str:
        system, root = _open(self.options["path"])
        with system.open_input_stream(f"{root}/{LISTS}/{self._version()}.json") as f:
            return json.loads(f.read())["kind"]

    def reader(self, schema) -> _Reader:
        kind = _ChoosingReader if self.options.get("choose", "false") == "true" else _Reader
        return kind(self.options["path"], self._version(), schema.fieldNames())

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("versions are added, not replaced: use mode append")
        if KEY not in schema.fieldNames():
            raise ValueError("a snapshot needs a column path")
        return _Writer(self.options["path"], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields))


def save(modules: DataFrame, where: str) -> int:
    """Adds ``modules`` (path, ...) to the store as a version, files in ranges of paths; the version's number."""
    spark = modules.sparkSession
    spark.dataSource.register(SnapshotStore)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    modules.repartitionByRange(parts, "path").sortWithinPartitions("path").write.format("snapshot_store").option("path", where).mode("append").save()
    return versions(where)[-1]


def load(spark: SparkSession, where: str, version: int | None = None) -> DataFrame:
    """A version of the store, the latest by default; filters on ``path`` choose files if the session has PUSHDOWN on."""
    spark.dataSource.register(SnapshotStore)
    reader = spark.read.format("snapshot_store").option("path", where).option("choose", spark.conf.get(PUSHDOWN, "false"))
    return (reader if version is None else reader.option("version", str(version))).load()
