"""Written intermediate tables: they cut a plan's lineage, survive lost executors, and are deleted when nothing reads them."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

SHARED = "spark.checkpoint.dir"
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Tables that no open scope knows, and those of the open scopes, innermost last.
_LEFT: list[str] = []
_SCOPES: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where a local session names none, as in tests."""
    folder = spark.conf.get(SHARED, None) or spark.sparkContext.getConf().get(SHARED, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {SHARED} to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(SHARED, folder)
    return folder.rstrip("/")


@contextlib.contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Writes within it drop their shuffle files as they end: nothing reads those again, and else they stay until the driver collects its garbage."""
    before = spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(TIDY, before)


def cut(df: DataFrame, result: bool = False) -> DataFrame:
    """df, written to the shared folder and read back. result: it outlives the scope it is written in."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/graph/{uuid.uuid4().hex}"
    holders = [_LEFT, *_SCOPES]
    holders[max(0, len(holders) - 1 - result)].append(path)
    with _tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Tables written within it are deleted at its end, results aside."""
    _SCOPES.append([])
    try:
        yield _SCOPES[-1]
    finally:
        delete(spark, _SCOPES.pop())


def settled(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The function with its rows written; the tables of its rounds are deleted."""

    @functools.wraps(function)
    def run(first: DataFrame, *args, **kwargs) -> DataFrame:
        with scope(first.sparkSession):
            return cut(function(first, *args, **kwargs), result=True)

    return run


def drop_left(spark: SparkSession) -> int:
    """Deletes every table that results returned so far read: for callers that have written those. How many there were."""
    paths, _LEFT[:] = list(_LEFT), []
    delete(spark, paths)
    return len(paths)
