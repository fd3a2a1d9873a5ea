"""Intermediate tables in the folder that the session shares between driver and executors.

They stay until the job that made them is over, as a lost executor's tasks read them again; `sweep` deletes what this session wrote.
Each thread of the driver has a list of its own, so that a job that settles leaves the tables of jobs on other threads alone."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Where this process may write without a shared folder: all executors then run in the driver's own process.
_LOCAL: list[str] = []
_threads: list[list[str]] = []


class _Own(threading.local):
    """What this thread wrote, in order; the list stays known to `sweep` when the thread is gone."""

    def __init__(self):
        self.paths: list[str] = []
        _threads.append(self.paths)


_own = _Own()


def shared_dir(spark) -> str:
    """spark.checkpoint.dir; a temporary folder only in local mode where the session names none, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
        return _LOCAL[0]
    if "://" not in found:  # without a scheme it lies in the session's default file system
        path = spark._jvm.org.apache.hadoop.fs.Path(found)
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
        found = "file://" + found[5:] if found.startswith("file:/") and not found.startswith("file://") else found
    return found.rstrip("/")


def new_path(spark, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _own.paths.append(path)
    return path


#: Spark's setting by which the shuffle files of a statement are deleted when it is over, and how many writes of this process want it now.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writes, _writing = [], threading.Lock()


@contextlib.contextmanager
def no_shuffles_left(spark):
    """The shuffle files of what is written inside go when it is written, as only the written table is read from then on; else they stay as long as the driver's objects."""
    with _writing:
        if not _writes:
            _writes.append(spark.conf.get(CLEANUP, None))
            spark.conf.set(CLEANUP, "true")
        _writes.append(None)
    try:
        yield
    finally:
        with _writing:
            _writes.pop()
            if len(_writes) == 1:
                before = _writes.pop()
                spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialized(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage of an iterative job: df written as Parquet and read back."""
    path = new_path(df.sparkSession, name)
    with no_shuffles_left(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a table that may be broadcast, and rows of a stated set.
BROADCAST_BYTES, STATED_ROWS = 32_000_000, 100_000
#: Bytes of a row of ids in such a table.
ID_BYTES = 40


def small(df: DataFrame, row_bytes: int = 200) -> DataFrame:
    """df with a broadcast hint if it is counted to be small enough, else as it is, for a join by shuffle; for tables that are cheap to count."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def stated(df: DataFrame) -> DataFrame:
    """A stated set, for joins that have no key to shuffle by: broadcast, and refused beyond STATED_ROWS rows."""
    if (n := df.count()) > STATED_ROWS:
        raise ValueError(f"{n} rows are no stated set; run it in parts of at most {STATED_ROWS}")
    return F.broadcast(df)


def mark() -> int:
    """A place in the list of what this thread wrote, for `sweep` and `settled`."""
    return len(_own.paths)


def _deleted(spark, paths: list[str], since: int) -> int:
    n = 0
    while len(paths) > since:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        n += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def sweep(spark, since: int | None = None) -> int:
    """Deletes what this thread wrote after a mark; without a mark what all threads wrote, so call it so when no job runs and no result is needed any more."""
    return sum(_deleted(spark, paths, since or 0) for paths in (_threads if since is None else [_own.paths]))


def settled(df: DataFrame, name: str, since: int) -> DataFrame:
    """df written and read back, after which everything else that this thread wrote after the mark is deleted, as nothing reads it any more."""
    out = materialized(df, name)
    kept = _own.paths.pop()
    sweep(df.sparkSession, since)
    _own.paths.append(kept)
    return out
