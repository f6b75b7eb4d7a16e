"""Nested sessions to entity and edge tables (NRM).

sessions: bundle_id, dialect, tracks ARRAY<STRUCT<id, name, kind, role, group_id, processors ARRAY<STRUCT<
id, name, family, chain, parameters ARRAY<STRUCT<id, name, value>>>>, clips ARRAY<STRUCT<id, name, path>>>>,
routes ARRAY<STRUCT<source, target, kind>>. Every block is an explode and a projection, so a corpus is
one pass and a union; references are resolved by joins on (bundle_id, id).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ENTITY = ("bundle_id", "id", "entity_type", "name", "role", "family", "value")
EDGE = ("bundle_id", "rel_type", "source", "target", "idx")


def namespaced(dialect: Column, raw: Column) -> Column:
    """dialect:raw, unless it already has that prefix."""
    prefix = F.concat(dialect, F.lit(":"))
    return F.when(F.startswith(raw, prefix), raw).otherwise(F.concat(prefix, raw))


def tracks(sessions: DataFrame) -> DataFrame:
    rows = sessions.select("bundle_id", "dialect", F.posexplode("tracks").alias("ord", "t"))
    return rows.select("bundle_id", "dialect", "ord", namespaced(F.col("dialect"), F.col("t.id")).alias("id"), "t.name", "t.kind", "t.role", "t.group_id", "t.processors", "t.clips")


def channel_id(kind: Column, track: Column) -> Column:
    """Returns and masters are channels themselves; other tracks have one beside them, but for inferred ones."""
    return F.when(kind.isin("return", "master"), track).when(kind != "inferred", F.concat(track, F.lit(":channel")))


# Track roles and the semantic role of each; any other role is only slugged.
ROLES = {
    "vocal": "vocal_source",
    "vocals": "vocal_source",
    "drums": "drum_source",
    "drum": "drum_source",
    "percussion": "drum_source",
    "bass": "bass_source",
    "guitar": "guitar_source",
    "keys": "keys_source",
    "piano": "keys_source",
    "synth": "synth_source",
    "strings": "strings_source",
    "brass": "brass_source",
    "fx": "effect_source",
    "bus": "submix",
    "master": "main_output",
    "reference": "reference_material",
}


def semantic_role(kind: Column, role: Column) -> Column:
    """The first semantic role of a track: what its kind says, then its own role; null and empty roles give none."""
    known = F.element_at(F.create_map(*(F.lit(x) for p in ROLES.items() for x in p)), F.lower(F.trim(role)))
    slug = F.regexp_replace(F.regexp_replace(F.lower(role), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    own = F.when(role != "", F.coalesce(known, F.when(slug == "", "unnamed").otherwise(slug)))
    return F.when(kind == "return", "effect_return").when(kind == "master", "main_output").when(kind == "group", "submix").otherwise(own)


def processors(rows: DataFrame) -> DataFrame:
    """One row a processor, with the channel or track it sits on and its place."""
    p = rows.select("bundle_id", "dialect", F.coalesce(channel_id(F.col("kind"), F.col("id")), F.col("id")).alias("owner"), F.posexplode("processors").alias("idx", "p"))
    return p.select("bundle_id", "dialect", "owner", "idx", namespaced(F.col("dialect"), F.col("p.id")).alias("id"), "p.name", "p.family", F.coalesce("p.chain", F.lit("main")).alias("chain"), "p.parameters")


def parameters(rows: DataFrame) -> DataFrame:
    p = rows.select("bundle_id", "dialect", F.col("id").alias("owner"), F.explode("parameters").alias("p"))
    return p.select("bundle_id", "owner", namespaced(F.col("dialect"), F.col("p.id")).alias("id"), "p.name", F.col("p.value").cast("double").alias("value"))


def assets(rows: DataFrame) -> DataFrame:
    """One row a path and snapshot, with the first clip that uses it."""
    c = rows.select("bundle_id", "dialect", F.posexplode("clips").alias("c_ord", "c"), "ord").where("c.path is not null")
    first = F.row_number().over(Window.partitionBy("bundle_id", "c.path").orderBy("ord", "c_ord"))
    return c.withColumn("n", first).where("n = 1").select("bundle_id", F.concat(F.lit("asset:"), F.substring(F.sha2("c.path", 256), 1, 12)).alias("id"), F.col("c.path").alias("path"))


def entities(sessions: DataFrame) -> DataFrame:
    t = tracks(sessions)
    p = processors(t)
    none = F.lit(None)
    row = lambda df, kind, name, role=none, family=none, value=none: df.select("bundle_id", "id", F.lit(kind).alias("entity_type"), name.alias("name"), role.cast("string").alias("role"), family.cast("string").alias("family"), value.cast("double").alias("value"))
    role = semantic_role(F.col("kind"), F.col("role"))
    channels = t.withColumn("id", channel_id(F.col("kind"), F.col("id"))).where("id is not null")
    clips = t.select("bundle_id", "dialect", F.explode("clips").alias("c")).select("bundle_id", namespaced(F.col("dialect"), F.col("c.id")).alias("id"), "c.name")
    parts = [
        row(sessions.select("bundle_id", F.concat("dialect", F.lit(":project")).alias("id")), "PROJECT", none.cast("string")),
        row(t.where("kind not in ('return', 'master')"), "TRACK", F.col("name"), role),
        row(channels, "CHANNEL", F.col("name"), F.when(F.col("kind").isin("return", "master", "group"), role)),
        row(p, "PROCESSOR", F.col("name"), family=F.col("family")),
        row(parameters(p), "PARAMETER", F.col("name"), value=F.col("value")),
        row(clips, "TEMPORAL_OBJECT", F.col("name")),
        row(assets(t), "MEDIA_ASSET", F.col("path")),
    ]
    return reduce(DataFrame.unionByName, parts)


def relationships(sessions: DataFrame) -> DataFrame:
    t = tracks(sessions)
    p = processors(t)
    edge = lambda df, kind, source, target, idx=F.lit(None): df.select("bundle_id", F.lit(kind).alias("rel_type"), source.alias("source"), target.alias("target"), idx.cast("long").alias("idx"))
    own = channel_id(F.col("kind"), F.col("id"))
    groups = t.where("group_id is not null").withColumn("g", namespaced(F.col("dialect"), F.col("group_id"))).join(t.select("bundle_id", F.col("id").alias("g"), F.col("kind").alias("g_kind")), ["bundle_id", "g"])
    sums = groups.where("g_kind = 'group' and kind not in ('return', 'master', 'inferred')")
    before = F.lag("id").over(Window.partitionBy("bundle_id", "owner", "chain").orderBy("idx"))
    clips = t.select("bundle_id", "dialect", "id", F.explode("clips").alias("c"))
    clip = namespaced(F.col("dialect"), F.col("c.id"))
    return reduce(DataFrame.unionByName, [
        edge(t.where("kind not in ('return', 'master', 'inferred')"), "TRACK_USES_CHANNEL", F.col("id"), own),
        edge(groups, "CONTAINS", F.col("g"), F.col("id")),
        edge(sums, "SUMS_TO", own, F.concat("g", F.lit(":channel"))),
        edge(p, "CHANNEL_PROCESSED_BY", F.col("owner"), F.col("id"), F.col("idx")),
        edge(p.withColumn("before", before).where("before is not null"), "PRECEDES", F.col("before"), F.col("id")),
        edge(parameters(p), "CONTAINS", F.col("owner"), F.col("id")),
        edge(clips, "TRACK_CONTAINS_TEMPORAL_OBJECT", F.col("id"), clip),
        edge(clips.where("c.path is not null"), "REFERENCES_ASSET", clip, F.concat(F.lit("asset:"), F.substring(F.sha2("c.path", 256), 1, 12))),
        routes(sessions),
    ])


def routes(sessions: DataFrame) -> DataFrame:
    """Sends and routes between channels; an end that is no track becomes an endpoint of its own name."""
    t = tracks(sessions).select("bundle_id", "id", F.coalesce(channel_id(F.col("kind"), F.col("id")), F.col("id")).alias("channel"))
    r = sessions.select("bundle_id", "dialect", F.explode("routes").alias("r")).select("bundle_id", namespaced(F.col("dialect"), F.col("r.source")).alias("s"), namespaced(F.col("dialect"), F.col("r.target")).alias("d"), "r.kind")
    r = r.join(t.toDF("bundle_id", "s", "cs"), ["bundle_id", "s"], "left").join(t.toDF("bundle_id", "d", "cd"), ["bundle_id", "d"], "left")
    kind = F.when(F.col("kind").isin("send", "receive"), "CHANNEL_SENDS_TO").otherwise("CHANNEL_ROUTES_TO")
    end = lambda c, raw: F.coalesce(c, F.concat(F.lit("endpoint:"), raw))
    return r.select("bundle_id", kind.alias("rel_type"), end("cs", F.col("s")).alias("source"), end("cd", F.col("d")).alias("target"), F.lit(None).cast("long").alias("idx"))


def endpoints(edges: DataFrame) -> DataFrame:
    """(bundle_id, id): ends of routes that no track explains."""
    return edges.select("bundle_id", F.explode(F.array("source", "target")).alias("id")).where(F.startswith("id", F.lit("endpoint:"))).distinct()


def provenance_store(records: DataFrame) -> DataFrame:
    """records (bundle_id, ord, evidence, capture_method, source_ref, confidence) without repeats: each distinct one gets an id by first appearance; observed ones drop their confidence."""
    key = ["evidence", "capture_method", "source_ref", "confidence"]
    rows = records.withColumn("confidence", F.when(F.col("evidence") != "OBSERVED", F.col("confidence")))
    first = rows.groupBy("bundle_id", *key).agg(F.min("ord").alias("first"))
    return first.withColumn("id", F.format_string("prov:%04d", F.row_number().over(Window.partitionBy("bundle_id").orderBy("first"))))
