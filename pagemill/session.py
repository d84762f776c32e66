"""Session settings and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import threading
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import partial
from uuid import uuid4

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# AQE re-plans joins from real sizes: it broadcasts only what fits the threshold and splits the
# partitions of a join side that holds a hot key. The other operators of this package keep hot
# keys apart themselves (partial aggregation, bounded slices).
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxBytesPerBatch": "32m",
    # A key that occurs twice in a model's reply has its last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def build_session(app: str = "pagemill", **extra: str) -> SparkSession:
    """A session with this package's settings; `extra` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints.

    Where none is named, a run on one machine gets a temporary one. On several machines each
    would write to its own disk, so there the lack of a name is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="pagemill-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


_roots: dict[str, str] = {}
_inner = threading.local()


def run_folder(spark: SparkSession) -> str:
    """Where `cut` writes: the folder of the innermost `tables_of_run`, or else the session's."""
    open_folders = getattr(_inner, "folders", [])
    if open_folders:
        return open_folders[-1]
    session = f"{spark.sparkContext.applicationId} {shared_folder(spark)}"
    if session not in _roots:
        _roots[session] = f"{shared_folder(spark)}/pagemill-{uuid4().hex}"
        atexit.register(_remove, spark, _roots[session])
    return _roots[session]


@contextmanager
def tables_of_run(spark: SparkSession) -> Iterator[str]:
    """Tables that `cut` writes inside go to a folder of their own, which is removed at the end.

    What is read from them must be written elsewhere before that.
    """
    path = f"{run_folder(spark)}/run-{uuid4().hex}"
    _inner.folders = [*getattr(_inner, "folders", []), path]
    try:
        yield path
    finally:
        _inner.folders = _inner.folders[:-1]
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    except Exception:  # the session has ended already; the folder is the cluster's to clear
        return


def side_by_side(spark: SparkSession, *steps: Callable[[], object]) -> None:
    """Run steps that need nothing of each other at the same time, all in this thread's run folder.

    A step over few rows keeps the driver planning while the executors wait. An error of a step is
    raised when all have ended.
    """
    folders = getattr(_inner, "folders", [])

    def run(step: Callable[[], object]) -> None:
        _inner.folders = list(folders)
        step()

    with ThreadPoolExecutor(len(steps)) as pool:
        # Each gets the local properties of this thread, such as the job group of its stream.
        started = [pool.submit(inheritable_thread_target(spark)(partial(run, step))) for step in steps]
    for one in started:
        one.result()


def cut(df: DataFrame, by: str | None = None, session: SparkSession | None = None) -> DataFrame:
    """Write `df` once to the shared checkpoint folder and read it from there.

    Used where an expensive stage feeds several branches. The table lies in shared storage, so a
    lost executor costs only the tasks that were running; it is columnar, and its size is known
    to the planner. `checkpoint()` would work out the rows twice, once to count them. The table
    goes when its run ends (`tables_of_run`), or with the driver. With `by`, a folder per value of
    that column lets a reader of one value skip the rest. With `session`, it is that one which reads.
    """
    path = f"{run_folder(df.sparkSession)}/{uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return (session or df.sparkSession).read.schema(df.schema).parquet(path)


def look_up(rows: DataFrame, table: DataFrame, on: str | list[str]) -> DataFrame:
    """Left join of rows, of which any share may have one key, with a table of one row per key.

    The table is written first. Then the planner knows its size and broadcasts it only if it is
    small, and otherwise both sides come out of a shuffle, which is what AQE needs to split the
    rows of a hot key. Straight from an aggregate by the same key it could not.
    """
    return rows.join(cut(table), on, "left")
