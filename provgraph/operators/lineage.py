"""Version families (VAR): order of members, derivation edges, alternatives, shared sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import cut, settled


def members(variants: DataFrame) -> DataFrame:
    """variants (snapshot_id, family, ordinal, parent) with their family key, depth and position. A member without a family is a family of one."""
    rows = variants.withColumn("family_key", F.coalesce("family", F.concat(F.lit("__ungrouped__:"), "snapshot_id")))
    rows = rows.join(depths(variants), "snapshot_id", "left").withColumn("ordinal", F.coalesce("ordinal", "depth"))
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("family_key").orderBy("ordinal", "snapshot_id")))


def climbed(rows: DataFrame) -> tuple[DataFrame, bool]:
    """rows (snapshot_id, at, depth), each id once; a top is its own at, at depth 0. To (snapshot_id, at, depth, open), and whether loops are left.

    A round doubles the steps that at is away. Rows still open after more steps than there are rows lead
    into a loop, and their at is a member of it.
    """
    rows, steps = cut(rows), 1
    n = rows.where("depth > 0").count()
    while True:
        up = rows.select(F.col("snapshot_id").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"))
        rows = cut(rows.join(up, "at").select("snapshot_id", F.col("next").alias("at"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("open")))
        if rows.where("open").isEmpty():
            return rows, False
        if steps >= n:
            return rows, True
        steps *= 2


def loop_sizes(parents: DataFrame) -> DataFrame:
    """parents (snapshot_id, at) that all lie on loops: (snapshot_id, size) of each one's loop."""
    rows, steps = cut(parents.withColumn("low", F.col("snapshot_id"))), 1
    n = rows.count()
    while steps < n:
        up = rows.select(F.col("snapshot_id").alias("at"), F.col("at").alias("next"), F.col("low").alias("other"))
        rows = cut(rows.join(up, "at").select("snapshot_id", F.col("next").alias("at"), F.least("low", "other").alias("low")))
        steps *= 2
    sizes = rows.groupBy("low").agg(F.count(F.lit(1)).alias("size"))
    return cut(rows.join(sizes, "low").select("snapshot_id", "size"))


@settled
def depths(variants: DataFrame) -> DataFrame:
    """(snapshot_id, depth): derivations above a member, however many; a chain that returns to itself stops there.

    Of several parents of one id the greatest counts.
    """
    ids = variants.select("snapshot_id").distinct()
    parents = variants.select("snapshot_id", F.col("parent").alias("at")).join(ids.withColumnRenamed("snapshot_id", "at"), "at", "left_semi")
    parents = cut(parents.groupBy("snapshot_id").agg(F.max("at").alias("at")))
    base = lambda up: ids.join(up, "snapshot_id", "left").select("snapshot_id", F.coalesce("at", "snapshot_id").alias("at"), F.col("at").isNotNull().cast("long").alias("depth"))
    rows, loops = climbed(base(parents))
    if loops:
        # members of loops become tops; above them are the others of their loop
        sizes = loop_sizes(parents.join(rows.where("open").select(F.col("at").alias("snapshot_id")).distinct(), "snapshot_id", "left_semi"))
        rows, _ = climbed(base(parents.join(sizes, "snapshot_id", "left_anti")))
        rows = rows.join(sizes.withColumnRenamed("snapshot_id", "at"), "at", "left").withColumn("depth", F.col("depth") + F.coalesce(F.col("size") - 1, F.lit(0)))
    return rows.select("snapshot_id", F.col("depth").cast("int").alias("depth"))


def derived_from(rows: DataFrame) -> DataFrame:
    """(family_key, source, target): from parent to child within a family; where no member names one, between rising neighbours."""
    ids = rows.select("family_key", F.col("snapshot_id").alias("parent"))
    named = rows.where("parent is not null").join(ids, ["family_key", "parent"], "left_semi").select("family_key", F.col("parent").alias("source"), F.col("snapshot_id").alias("target"))
    order = Window.partitionBy("family_key").orderBy("position")
    before = rows.join(named.select("family_key").distinct(), "family_key", "left_anti")
    before = before.withColumn("source", F.lag("snapshot_id").over(order)).withColumn("o", F.lag("ordinal").over(order)).where("source is not null and ordinal > o")
    return named.unionByName(before.select("family_key", "source", F.col("snapshot_id").alias("target")))


def alternatives(rows: DataFrame) -> DataFrame:
    """(family_key, source, target): members of one ordinal, each pair once."""
    a = rows.select("family_key", "ordinal", F.col("snapshot_id").alias("source"), F.col("position").alias("p"))
    b = rows.select("family_key", "ordinal", F.col("snapshot_id").alias("target"), F.col("position").alias("q"))
    return a.join(b, ["family_key", "ordinal"]).where("p < q").select("family_key", "source", "target")


def shared_sources(assets: DataFrame) -> DataFrame:
    """assets (family_key, snapshot_id, path): (family_key, path, members, first_member) of paths that several members use.

    A class and its size instead of all pairs, whose number grows with the square of a family.
    """
    rows = assets.groupBy("family_key", "path").agg(F.countDistinct("snapshot_id").alias("members"), F.min("snapshot_id").alias("first_member"))
    return rows.where("members > 1")


def adjacent(rows: DataFrame) -> DataFrame:
    """(family_key, source, target): neighbours by position, the pairs to compare."""
    order = Window.partitionBy("family_key").orderBy("position")
    return rows.withColumn("source", F.lag("snapshot_id").over(order)).where("source is not null").select("family_key", "source", F.col("snapshot_id").alias("target"))
