"""What sets a parameter (INF): its own value, automation lanes and modulation sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drivers(relationships: DataFrame) -> DataFrame:
    """(bundle_id, source, target): what a control edge names, and both directions of a link, of which only sources that modulate count."""
    edge = relationships.select("bundle_id", "rel_type", "source", "target")
    ways = F.when(F.col("rel_type") == "LINKED_WITH", F.array(F.struct("source", "target"), F.struct(F.col("target").alias("source"), F.col("source").alias("target")))).otherwise(F.array(F.struct("source", "target")))
    return edge.where("rel_type in ('CONTROLS', 'LINKED_WITH')").select("bundle_id", F.explode(ways).alias("w"), (F.col("rel_type") == "LINKED_WITH").alias("link")).select("bundle_id", "w.*", "link")


def targets(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """(bundle_id, id): parameters, and whatever an automation or modulation controls."""
    sources = entities.where("entity_type in ('AUTOMATION', 'MODULATION')").select("bundle_id", F.col("id").alias("source"), F.col("entity_type").alias("kind"))
    driven = drivers(relationships).join(sources, ["bundle_id", "source"]).where("not link or kind = 'MODULATION'").select("bundle_id", F.col("target").alias("id"))
    return entities.where("entity_type = 'PARAMETER'").select("bundle_id", "id").unionByName(driven).distinct()


def influence(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """(bundle_id, id, base, automation, modulation, effective): names of what drives each target; effective never claims a point value where something does."""
    named = entities.select("bundle_id", F.col("id").alias("source"), F.col("entity_type").alias("kind"), F.coalesce("name", "id").alias("driver"))
    drives = drivers(relationships).join(named, ["bundle_id", "source"]).where("not link or kind = 'MODULATION'").groupBy("bundle_id", F.col("target").alias("id")).agg(
        F.sort_array(F.collect_set(F.when(F.col("kind") == "AUTOMATION", F.col("driver")))).alias("automation"), F.sort_array(F.collect_set(F.when(F.col("kind") == "MODULATION", F.col("driver")))).alias("modulation"))
    base = entities.select("bundle_id", "id", F.coalesce("value", "normalized").alias("base"))
    out = targets(entities, relationships).join(base, ["bundle_id", "id"], "left").join(drives, ["bundle_id", "id"], "left")
    none = F.array().cast("array<string>")
    out = out.withColumn("automation", F.coalesce("automation", none)).withColumn("modulation", F.coalesce("modulation", none))
    parts = F.array_compact(F.array(F.when(F.col("base").isNotNull(), F.format_string("base %s", F.col("base").cast("string"))), F.when(F.size("automation") > 0, F.concat(F.lit("automated by "), F.array_join("automation", ", "))), F.when(F.size("modulation") > 0, F.concat(F.lit("modulated by "), F.array_join("modulation", ", ")))))
    return out.withColumn("effective", F.array_join(parts, " / "))
