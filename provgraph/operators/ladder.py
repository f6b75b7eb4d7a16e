"""Capability profile of every snapshot (LAD): which of seven rungs it reaches.

One conditional aggregate over entities and one over relationships; context (renders, interventions)
comes in as tables and is joined, never passed around.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The rungs and the relationship types of the routing rung.
RUNGS = ("validity", "structure", "routing", "time", "scenes and modulation", "audio outcome", "intervention")
ROUTING = ("CHANNEL_SENDS_TO", "CHANNEL_ROUTES_TO", "SUMS_TO", "TRACK_USES_CHANNEL")


def entity_counts(entities: DataFrame) -> DataFrame:
    """Counts by type that the rungs need; a scene container says so in its role or native type."""
    n = lambda *types: F.count_if(F.col("entity_type").isin(*types))
    scene = (F.col("entity_type") == "STRUCTURAL_CONTAINER") & F.lower(F.coalesce("role", F.lit(""))).contains("scene")
    return entities.groupBy("bundle_id").agg(
        n("TRACK").alias("tracks"), n("CHANNEL").alias("channels"), n("PROCESSOR").alias("processors"), n("TEMPORAL_OBJECT", "TIMELINE").alias("temporal"), n("AUTOMATION").alias("automation"),
        F.count_if(scene).alias("scenes"), n("MODULATION").alias("modulation"), n("VARIANT").alias("variants"), n("OBSERVATION", "RENDER").alias("outcomes"),
    )


def profile(snapshots: DataFrame, errors: DataFrame, entities: DataFrame, relationships: DataFrame, rendered: DataFrame | None = None, intervened: DataFrame | None = None) -> DataFrame:
    """(bundle_id, level, title, reached, provisional): seven rows a snapshot. errors: (bundle_id, errors); rendered, intervened: bundle_ids with such context."""
    routed = relationships.where(F.col("rel_type").isin(*ROUTING)).groupBy("bundle_id").agg(F.count(F.lit(1)).alias("routes"))
    base = snapshots.select("bundle_id").join(errors.select("bundle_id", "errors"), "bundle_id", "left").join(entity_counts(entities), "bundle_id", "left").join(routed, "bundle_id", "left")
    for name, context in (("rendered", rendered), ("intervened", intervened)):
        base = base.withColumn(name, F.lit(False)) if context is None else base.join(context.select("bundle_id", F.lit(True).alias(name)).distinct(), "bundle_id", "left")
    base = base.fillna(0).fillna(False)
    reached = [
        F.col("errors") == 0,
        (F.col("tracks") > 0) & (F.col("channels") + F.col("processors") > 0),
        F.col("routes") > 0,
        F.col("temporal") + F.col("automation") > 0,
        F.col("scenes") + F.col("modulation") + F.col("variants") > 0,
        (F.col("outcomes") > 0) | F.col("rendered"),
        F.col("intervened"),
    ]
    rungs = F.array(*(F.struct(F.lit(i).alias("level"), F.lit(RUNGS[i]).alias("title"), r.alias("reached"), F.lit(i == 4).alias("provisional")) for i, r in enumerate(reached)))
    return base.select("bundle_id", F.inline(rungs))


def summary(rungs: DataFrame) -> DataFrame:
    """(bundle_id, reached_set, highest_contiguous): -1 if the lowest rung fails."""
    first_gap = F.min(F.when(~F.col("reached"), F.col("level")))
    levels = F.sort_array(F.collect_set(F.when(F.col("reached"), F.col("level"))))
    return rungs.groupBy("bundle_id").agg(levels.alias("reached_set"), (F.coalesce(first_gap, F.lit(len(RUNGS))) - 1).alias("highest_contiguous"))


def matrix(rungs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Share of each source's snapshots that reach a rung."""
    rows = rungs.join(snapshots.select("bundle_id", "daw"), "bundle_id")
    return rows.groupBy("daw", "level").agg(F.count_if("reached").alias("reached"), F.count(F.lit(1)).alias("snapshots"))


def evidence_refs(entities: DataFrame, most: int = 3) -> DataFrame:
    """(bundle_id, entity_type, refs): the first ids of each type."""
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy("bundle_id", "entity_type").orderBy("id"))
    first = entities.select("bundle_id", "entity_type", "id", n.alias("n")).where(F.col("n") <= most)
    return first.groupBy("bundle_id", "entity_type").agg(F.sort_array(F.collect_list("id")).alias("refs"))
