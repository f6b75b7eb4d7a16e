"""Incremental ingest of bundles (STM): new or changed snapshot files become rows as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.bundles import SCHEMA, SNAPSHOT, directory
from ..sources.tables import cut, delete, scope

STATE = "path string, modified timestamp, length long, digest string"


def snapshot_stream(spark: SparkSession, root: str) -> DataFrame:
    """A stream of (bundle_id, modified, text, snapshot) of snapshot files below root."""
    rows = spark.readStream.schema("value string").option("recursiveFileLookup", "true").option("pathGlobFilter", SNAPSHOT).text(root, wholetext=True)
    rows = rows.select(F.sha2(directory(F.col("_metadata.file_path")), 256).alias("bundle_id"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))
    return rows.withColumn("snapshot", F.from_json("text", SCHEMA))


def latest(rows: DataFrame) -> DataFrame:
    """The newest row of each bundle."""
    return rows.groupBy("bundle_id").agg(F.max_by(F.struct("modified", "text", "snapshot"), "modified").alias("x")).select("bundle_id", "x.*")


def ingest(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls handle with the newest state of the bundles in each batch, until everything present has been read; exactly once by the checkpoint."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: handle(latest(df), n)).start()


def _versions(spark: SparkSession, state: str) -> list[int]:
    """The states that were written whole."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{state}/version=*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])


def _files(spark: SparkSession, root: str) -> DataFrame:
    """(path, modified, length, content) of the snapshot files below root; content is read only where it is used."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", SNAPSHOT).load(root)
    return rows.withColumnRenamed("modificationTime", "modified")


def refresh(spark: SparkSession, root: str, state: str, handle: Callable[[DataFrame, int], None]) -> int:
    """Hands the bundles below root that changed since the last call, and returns the state's number.

    handle gets (bundle_id, change, modified, text, snapshot), change being new, changed or removed (text and
    snapshot null), and a number; it isn't called where nothing changed. The state is written after handle
    returns: if a call is lost before, the next one hands the same changes under the same number. A file with a new time
    but its old content is no change. Files that don't parse have a null snapshot. Calls must not overlap.
    """
    done = _versions(spark, state)
    before = spark.read.schema(STATE).parquet(f"{state}/version={done[-1]}") if done else spark.createDataFrame([], STATE)
    number = done[-1] + 1 if done else 0
    with scope(spark):
        now = cut(_files(spark, root).select("path", "modified", "length"))
        touched = cut(now.join(before, ["path", "modified", "length"], "left_anti").select("path", "modified"))
        oldest = touched.agg(F.min("modified")).first()[0]
        # the scan leaves out files older than all that were touched without opening them
        rows = _files(spark, root).where(F.col("modified") >= F.lit(oldest)).join(touched.select("path"), "path", "left_semi") if oldest else _files(spark, root).where("false")
        read = cut(rows.select("path", "modified", "length", F.sha2("content", 256).alias("digest"), F.col("content").cast("string").alias("text")))
        old = before.select("path", F.col("digest").alias("was"))
        kept = before.join(touched, "path", "left_anti").join(now.select("path"), "path", "left_semi")
        after = cut(kept.unionByName(read.drop("text")))

        change = F.when(F.col("was").isNull(), "new").when(F.col("was") != F.col("digest"), "changed")
        found = read.join(old, "path", "left").select("path", change.alias("change"), "modified", "text").where("change is not null")
        gone = before.join(now.select("path"), "path", "left_anti").select("path", F.lit("removed").alias("change"), "modified", F.lit(None).cast("string").alias("text"))
        found = cut(found.unionByName(gone).select(F.sha2(directory(F.col("path")), 256).alias("bundle_id"), "change", "modified", "text")).withColumn("snapshot", F.from_json("text", SCHEMA))
        if oldest is None and found.isEmpty():
            return number - 1
        if not found.isEmpty():
            handle(found, number)
        after.write.mode("overwrite").parquet(f"{state}/version={number}")
    delete(spark, [f"{state}/version={n}" for n in done[:-1]])
    return number
