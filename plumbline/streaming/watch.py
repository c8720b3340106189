"""Watching a source tree: a stream of listings against a state kept by path.

A trigger lists the tree once, over all tasks. The state of a path is when it was last changed; a path that a listing
holds is compared with it and gets a timer for the next trigger, which only fires if that listing doesn't hold the path. State,
timers and offsets are committed together, so a query that starts again from its checkpoint gives each change once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..shared import place, settings
from ..sources.tree import SourceTreeListing

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _row(path: str, status: str, mtime: int) -> pd.DataFrame:
    return pd.DataFrame({"path": pd.Series([path], dtype=object), "status": pd.Series([status], dtype=object), "mtime": [mtime]})


class FileState(StatefulProcessor):
    """Changes (path, status, mtime) of the paths in listings (path, mtime): added, modified, deleted.

    ``missing`` is how many milliseconds a path may be out of the listings before it counts as deleted; those of the next
    trigger always count. A path that stands twice in a listing has its latest time. A null time is zero.
    """

    def __init__(self, missing: int = 1):
        self.missing = max(1, missing)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "mtime long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = max(int(x["mtime"].fillna(0).max()) for x in rows)
        before = self.known.get() if self.known.exists() else None
        status = "added" if before is None else "modified" if before[0] != now else None
        if status:
            self.known.update((now,))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.missing)
        if status:
            yield _row(key[0], status, now)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before = self.known.get()[0]
        self.known.clear()
        yield _row(key[0], "deleted", before)

    def close(self) -> None:
        pass


def changes(listings: DataFrame, missing: int = 1) -> DataFrame:
    """The stream of changes, (path, status, mtime), in a stream of whole listings (path, mtime). The first gives all paths as added.

    Rows with a null path take no part. The query needs the state store ``STORE``.
    """
    named = listings.where("path IS NOT NULL").select("path", "mtime").groupBy("path")
    return named.transformWithStateInPandas(FileState(missing), "path string, status string, mtime long", "append", "processingTime")


def tree_listings(spark: SparkSession, root: str, languages: str = "", exclude: str = "") -> DataFrame:
    """The stream of a tree's listings."""
    spark.dataSource.register(SourceTreeListing)
    return spark.readStream.format("source_tree_listing").options(root=root, languages=languages, exclude=exclude).load()


def watch(
    spark: SparkSession, root: str, react: Callable[[DataFrame, int], None], seconds: int = 1, languages: str = "", exclude: str = "", checkpoint: str | None = None,
) -> StreamingQuery:
    """Calls ``react(changes, tick)`` for each trigger after which the tree differs from the one before.

    ``changes`` has path, status (added, modified, deleted) and mtime. A new watch's first trigger only takes the tree; one
    that goes on from the ``checkpoint`` of another reacts to what changed since. After a failure a tick may come again, by the same number.
    """
    first = checkpoint is None or not _begun(spark, checkpoint)

    def tick(found: DataFrame, number: int) -> None:
        found.persist()
        try:
            if not found.isEmpty() and not (first and number == 0):
                react(found, number)
        finally:
            found.unpersist()

    with settings(spark, spark__sql__streaming__stateStore__providerClass=STORE):
        stream = changes(tree_listings(spark, root, languages, exclude)).writeStream.outputMode("append")
        where = checkpoint or place(spark, "watch")
        return stream.option("checkpointLocation", where).trigger(processingTime=f"{seconds} seconds").foreachBatch(tick).start()


def _begun(spark: SparkSession, checkpoint: str) -> bool:
    commits = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits/0")
    return commits.getFileSystem(spark._jsc.hadoopConfiguration()).exists(commits)
