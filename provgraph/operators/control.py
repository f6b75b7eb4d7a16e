"""Automation lanes, modulation sources and what they control (NRM15, NRM16, NRM17).

lanes: bundle_id, lane (its place in the session, from 1), parameter_name, unit, and four references that a
source may give: target_parameter_id, target_processor_id, target_channel_field, target_track_id.
points: bundle_id, lane, ord (anything with an order), time, value, curve; a point is a row, so that a lane of any
length spans tasks. modulations: as lanes, with source_type, source_track_id, depth, rate.
entities: bundle_id, id; channels: bundle_id, track, channel. Nulls and empty references name nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import slug

#: Points of a lane that are stored; all are counted.
STORED = 512


def named(c: str) -> Column:
    return F.when(F.col(c) != "", F.col(c))


def resolved(rows: DataFrame, entities: DataFrame, channels: DataFrame) -> DataFrame:
    """rows with target, target_kind and field: the first reference that something in the snapshot bears.

    A parameter comes before a processor's field, that before a field of a track's channel. The three kinds of
    references are keys of one table, so that the cascade is a single join and an aggregate that keeps
    the first place; what names nothing known has a null target.
    """
    step = lambda place, space, key, kind, field: F.struct(F.lit(place).alias("place"), F.lit(space).alias("space"), key.alias("key"), F.lit(kind).alias("target_kind"), field.cast("string").alias("field"))
    channel = F.when(named("target_channel_field").isNotNull(), named("target_track_id"))
    steps = F.array(step(1, "id", named("target_parameter_id"), "parameter", F.lit(None)), step(2, "id", named("target_processor_id"), "processor_field", named("parameter_name")), step(3, "track", channel, "channel_field", named("target_channel_field")))
    asked = rows.select("bundle_id", "lane", F.explode(F.filter(steps, lambda s: s["key"].isNotNull())).alias("s")).select("bundle_id", "lane", "s.*")
    known = entities.select("bundle_id", F.lit("id").alias("space"), F.col("id").alias("key"), "id").unionByName(channels.select("bundle_id", F.lit("track").alias("space"), F.col("track").alias("key"), F.col("channel").alias("id")))
    hits = asked.join(known.distinct(), ["bundle_id", "space", "key"]).groupBy("bundle_id", "lane").agg(F.min_by(F.struct("id", "target_kind", "field"), F.struct("place", "id")).alias("t"))
    return rows.join(hits, ["bundle_id", "lane"], "left").withColumns({"target": F.col("t.id"), "target_kind": F.col("t.target_kind"), "field": F.col("t.field")}).drop("t")


def lane_values(points: DataFrame, stored: int = STORED) -> DataFrame:
    """(bundle_id, lane, point_count, value_min, value_max, first_value, last_value, curve, points): over all points but for points, the first stored ones in order.

    The counts are partial aggregates of every task's rows; of the prefix no task hands on more than stored rows of a lane.
    """
    all_ = points.groupBy("bundle_id", "lane").agg(
        F.count(F.lit(1)).alias("point_count"), F.min("value").alias("value_min"), F.max("value").alias("value_max"),
        F.min_by("value", "ord").alias("first_value"), F.max_by("value", "ord").alias("last_value"), F.min_by("curve", "ord").alias("curve"))
    place = F.row_number().over(Window.partitionBy("bundle_id", "lane").orderBy("ord"))
    head = points.withColumn("place", place).where(F.col("place") <= stored)
    head = head.groupBy("bundle_id", "lane").agg(F.sort_array(F.collect_list(F.struct("place", "time", "value", "curve"))).alias("points"))
    return all_.join(head, ["bundle_id", "lane"])


def automation(lanes: DataFrame, points: DataFrame, entities: DataFrame, channels: DataFrame, namespace: str, stored: int = STORED) -> DataFrame:
    """One AUTOMATION a lane: id, name, unit, its values, target, target_kind, field; availability is UNKNOWN where nothing is controlled. A lane without points has a count of 0."""
    rows = resolved(lanes, entities, channels).join(lane_values(points, stored), ["bundle_id", "lane"], "left")
    ident = F.concat(F.lit(f"{namespace}:auto:"), slug(F.coalesce("parameter_name", F.lit(""))), F.lit(":"), F.col("lane").cast("string"))
    return rows.select("bundle_id", ident.alias("id"), F.col("parameter_name").alias("name"), "unit", F.coalesce("point_count", F.lit(0)).cast("long").alias("point_count"), "value_min", "value_max", "first_value", "last_value", "curve", "points",
                       "target", "target_kind", "field", F.when(F.col("target").isNull(), "UNKNOWN").alias("availability"))


def modulation(modulations: DataFrame, entities: DataFrame, channels: DataFrame, namespace: str) -> DataFrame:
    """One MODULATION a source: id, name (its parameter's, else its type), depth, rate, target, target_kind, field, availability, and driver, the channel that a sidechain listens to."""
    rows = resolved(modulations, entities, channels)
    listens = F.when(F.col("source_type") == "sidechain", named("source_track_id"))
    rows = rows.withColumn("track", listens).join(channels.select("bundle_id", "track", F.col("channel").alias("driver")), ["bundle_id", "track"], "left")
    name = F.coalesce(named("parameter_name"), "source_type")
    ident = F.concat(F.lit(f"{namespace}:mod:"), slug(F.coalesce(name, F.lit(""))), F.lit(":"), F.col("lane").cast("string"))
    return rows.select("bundle_id", ident.alias("id"), name.alias("name"), "source_type", "depth", "rate", "unit", "target", "target_kind", "field", F.when(F.col("target").isNull(), "UNKNOWN").alias("availability"), "driver")


def control_entities(automations: DataFrame, modulations: DataFrame) -> DataFrame:
    """(bundle_id, id, entity_type, name, value, normalized): rows of the entity table."""
    none = F.lit(None).cast("double")
    row = lambda df, kind: df.select("bundle_id", "id", F.lit(kind).alias("entity_type"), "name", none.alias("value"), none.alias("normalized"))
    return row(automations, "AUTOMATION").unionByName(row(modulations, "MODULATION"))


def control_edges(automations: DataFrame, modulations: DataFrame) -> DataFrame:
    """(bundle_id, rel_type, source, target, kind): CONTROLS of what has a target, LINKED_WITH from a sidechain's channel."""
    controls = automations.select("bundle_id", "id", "target", "target_kind").unionByName(modulations.select("bundle_id", "id", "target", "target_kind")).where("target is not null")
    controls = controls.select("bundle_id", F.lit("CONTROLS").alias("rel_type"), F.col("id").alias("source"), "target", F.col("target_kind").alias("kind"))
    links = modulations.where("driver is not null").select("bundle_id", F.lit("LINKED_WITH").alias("rel_type"), F.col("driver").alias("source"), F.col("id").alias("target"), F.lit("sidechain_source").alias("kind"))
    return controls.unionByName(links)
