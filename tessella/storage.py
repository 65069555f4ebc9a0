"""The folder that driver and executors share, and tables written there to cut a lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """URI of the cluster's shared folder, from spark.checkpoint.dir; where that is unset in local mode, as in tests, one of this machine's."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
        if not at:
            if not re.match(r"local(\[[^,]*\])?$", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(at := f"file://{tempfile.mkdtemp()}")
    return at if "://" in at or at.startswith("file:") else f"file://{at}"


_named: ContextVar[list[str] | None] = ContextVar("named", default=None)


def fresh(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder."""
    path = f"{folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    if (named := _named.get()) is not None:
        named.append(path)
    return path


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Removes in the end what :func:`fresh` has named inside; results that read it must be written by then."""
    token = _named.set(named := [])
    try:
        yield
    finally:
        _named.reset(token)
        remove(spark, *named)


def cut(df: DataFrame, most: int | None = None) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint, of at most ``most`` files if that is given."""
    folder(df.sparkSession)
    return (df.coalesce(most) if most else df).checkpoint()


#: Files of a table that is written on the way, at least.
FILES = 12


def files(rows: int, each: int) -> int:
    """Files for so many rows, about ``each`` in one, so that a small table isn't dealt over as many as the session has shuffle partitions.

    For every file, and for its checksums, an executor starts a process that sets the mode, where Hadoop has no native
    code; while it starts, it counts as a second one of the executor's size.
    """
    return max(FILES, -(-rows // each))


#: Deletes what a query has shuffled when it ends; without it that stays on disk until the driver collects its garbage.
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """The same rows with their lineage cut, as compressed columns: fewer bytes than a checkpoint, read by the columns that are asked for.

    What was shuffled to make them goes when they are written.
    """
    conf, path = df.sparkSession.conf, path or fresh(df.sparkSession, "stored")
    before = conf.get(_CLEANED, None)
    try:
        conf.set(_CLEANED, "true")
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(_CLEANED) if before is None else conf.set(_CLEANED, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows of what ``make`` gives, stored, without what it has stored on the way."""
    path = fresh(spark, "stored")
    with swept(spark):
        return stored(make(), path)


#: Rows that a task sorts or groups, about.
DEALT = 500_000


def parts(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows: as many as the session has, or more, so that a task's share doesn't grow with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // DEALT))


#: Rows of a table that is sent to every task, at most.
SMALL = 100_000


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """The same rows, stored, and marked for a broadcast join where they are at most ``most``; where they are more the join shuffles."""
    df = cut(df)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def remove(spark: SparkSession, *uris: str) -> None:
    """Deletes folders, those that are there."""
    for uri in uris:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
