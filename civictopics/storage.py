"""Where intermediate tables go, and how small tables reach the driver."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Spark then deletes the shuffle files of a query when it ends, rather than when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_folder: tempfile.TemporaryDirectory | None = None
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or the checkpoint folder set
    on the context.

    On a cluster a session without one is an error, because each executor would write to its own
    disk and a later read would miss those files.  Only Spark on one machine (``local[...]``) then
    gets a temporary folder, which is removed when Python ends.
    """
    global _own_folder
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_folder is None:
        _own_folder = tempfile.TemporaryDirectory(prefix="civictopics-")
    return _own_folder.name


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/civictopics/{name}-{uuid.uuid4().hex}"
    for scope in _scopes:
        scope.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end of the block, all tables that were written inside it.

    Results that are still to be used must be written elsewhere, or collected, before it ends.
    """
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.remove(paths)
        conf = spark._jsc.hadoopConfiguration()
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def write(df: DataFrame, path: str, *partition_by: str) -> None:
    """Write ``df`` as Parquet; what it has shuffled is deleted at once, as nothing runs it again."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, partitionBy=list(partition_by) or None)
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The result has no lineage left to recompute, so it survives lost executors, and unlike
    ``checkpoint()`` the plan runs only once.
    """
    path = new_path(df.sparkSession, name)
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Write what ``make`` returns, as ``cut`` does, and delete all other tables that it wrote."""
    path = new_path(spark, name)
    with scratch(spark):
        df = make()
        write(df, path)
    return spark.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def committed(spark: SparkSession, folder: str, name: str) -> list[int]:
    """The numbers n, ascending, for which Spark finished writing ``folder/name=n``.

    Spark puts the file ``_SUCCESS`` into a folder last, so half-written ones are not listed.
    """
    files, place = _place(spark, folder)
    if not files.exists(place):
        return []
    found = (status.getPath() for status in files.listStatus(place))
    numbered = [p for p in found if p.getName().startswith(f"{name}=")]
    done = [p for p in numbered if files.exists(_place(spark, f"{p}/_SUCCESS")[1])]
    return sorted(int(p.getName().partition("=")[2]) for p in done)


def delete(spark: SparkSession, path: str) -> None:
    files, place = _place(spark, path)
    files.delete(place, True)
