"""Differences between two sessions by track name (SDF).

tracks: pair_id, ord, name, kind, volume_db; names compare without case and the last of equal names
counts. Returns and masters are compared apart from tracks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .delta import multiset_changes


def by_name(tracks: DataFrame) -> DataFrame:
    rows = tracks.where("kind not in ('return', 'master')").withColumn("key", F.lower("name"))
    return rows.groupBy("pair_id", "key").agg(F.max_by(F.struct("name", "volume_db"), "ord").alias("t"))


def track_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(pair_id, change, name, old, new): tracks added or removed, and faders moved."""
    rows = by_name(before).withColumnRenamed("t", "x").join(by_name(after).withColumnRenamed("t", "y"), ["pair_id", "key"], "full_outer")
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(~F.col("x.volume_db").eqNullSafe(F.col("y.volume_db")), "volume")
    moved = change == "volume"
    return rows.select("pair_id", change.alias("change"), F.coalesce("y.name", "x.name").alias("name"), F.when(moved, F.col("x.volume_db")).alias("old"), F.when(moved, F.col("y.volume_db")).alias("new")).where("change is not null")


def processor_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(pair_id, track, processor, change, n): processors that a track has more or fewer of. Tables: pair_id, track, processor."""
    return multiset_changes(before, after, "pair_id", "track", "processor")


def parameter_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(pair_id, track, processor, parameter, old, new), only of processors whose name is unique on its track on both sides. Tables: pair_id, track, processor, slot, parameter, value."""
    key = ["pair_id", "track", "processor"]
    alone = lambda df: df.groupBy(*key).agg(F.countDistinct("slot").alias("n")).where("n = 1").select(*key)
    rows = before.join(alone(before), key, "left_semi").select(*key, "parameter", F.col("value").alias("old")).join(
        after.join(alone(after), key, "left_semi").select(*key, "parameter", F.col("value").alias("new")), [*key, "parameter"])
    return rows.where(~F.col("old").eqNullSafe(F.col("new")))


def narrative(changes: DataFrame) -> DataFrame:
    """(pair_id, text): one sentence of how many changes of each kind there are."""
    counts = changes.groupBy("pair_id", "change").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("pair_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("change", "n"))), lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["change"])), ", ").alias("text"))
