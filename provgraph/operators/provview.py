"""The corpus as a provenance graph (PRV): entities, agents, attributions, relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Edge types of a session graph and the provenance relation that each is an instance of.
RELATIONS = {
    "has_track": "prov:hadMember",
    "has_scene": "prov:hadMember",
    "has_clip": "prov:hadMember",
    "has_processor": "prov:hadMember",
    "has_route": "prov:hadMember",
    "references_audio": "prov:hadMember",
    "uses_audio_file": "prov:hadMember",
    "sends_to": "prov:wasInfluencedBy",
    "routes_to": "prov:wasInfluencedBy",
    "has_unresolved_route": "prov:wasInfluencedBy",
    "contains_audio": "prov:hadMember",
    "infers_track": "prov:wasDerivedFrom",
    "has_descriptor": "prov:wasDerivedFrom",
    "linked_to_midi": "prov:wasDerivedFrom",
    "linked_to_score_part": "prov:wasDerivedFrom",
    "annotated_by": "prov:wasAttributedTo",
    "mentions_plugin": "prov:hadMember",
    "mentions_send": "prov:hadMember",
    "mentions_bus": "prov:hadMember",
    "compared_to_reference": "prov:wasInfluencedBy",
    "part_of_reconciliation": "prov:wasDerivedFrom",
    "part_of_comparison": "prov:wasDerivedFrom",
    "has_hidden_state": "sse:hasHiddenState",
    "supports_recommendation": "prov:wasDerivedFrom",
}
DEFAULT = "prov:wasInfluencedBy"

#: Snapshot relationships and the session graph's edge type for each.
EDGES = {"CHANNEL_PROCESSED_BY": "has_processor", "TRACK_CONTAINS_TEMPORAL_OBJECT": "has_clip", "REFERENCES_ASSET": "references_audio", "CHANNEL_SENDS_TO": "sends_to", "CHANNEL_ROUTES_TO": "routes_to"}


def _mapped(values: dict[str, str], key: str) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for p in values.items() for x in p)), F.col(key))


def session_edges(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """(bundle_id, edge_type, source, target): a snapshot as a session graph, its project with its tracks and what these hold."""
    project = entities.where("entity_type = 'PROJECT'").select("bundle_id", F.col("id").alias("source"))
    tracks = entities.where("entity_type = 'TRACK'").select("bundle_id", F.lit("has_track").alias("edge_type"), F.col("id").alias("target"))
    rows = relationships.where(F.col("rel_type").isin(*EDGES)).select("bundle_id", _mapped(EDGES, "rel_type").alias("edge_type"), "source", "target")
    return rows.unionByName(tracks.join(project, "bundle_id"))


def relations(edges: DataFrame) -> DataFrame:
    """(bundle_id, relation, source, target) of edges; those that attribute are attributions, not relations."""
    rows = edges.select("bundle_id", F.coalesce(_mapped(RELATIONS, "edge_type"), F.lit(DEFAULT)).alias("relation"), "source", "target")
    return rows.where("relation <> 'prov:wasAttributedTo'")


def annotated(edges: DataFrame) -> DataFrame:
    """(bundle_id, id, agent): targets of edges that attribute, the producer's."""
    rows = edges.where(_mapped(RELATIONS, "edge_type") == "prov:wasAttributedTo")
    return rows.select("bundle_id", F.col("target").alias("id"), F.lit("producer").alias("agent"))


def agents(snapshots: DataFrame) -> DataFrame:
    """(bundle_id, agent, kind): the source system that captured a snapshot."""
    return snapshots.select("bundle_id", F.concat(F.lit("tool:"), "daw").alias("agent"), F.lit("SoftwareAgent").alias("kind")).distinct()


def attributions(entities: DataFrame, provenance: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(bundle_id, id, agent, observability) of every entity; one whose evidence is missing counts as derived.

    Inferred, derived and hidden things are the analyzer's, annotated ones the user's, observed ones the capturing tool's.
    """
    records = provenance.select("bundle_id", F.col("id").alias("star"), F.lower("evidence").alias("observability"))
    rows = entities.join(records, ["bundle_id", "star"], "left").withColumn("observability", F.coalesce("observability", F.lit("derived"))).join(agents(snapshots).select("bundle_id", "agent"), "bundle_id")
    who = F.when(F.col("observability").isin("inferred", "derived", "hidden"), "analyzer").when(F.col("observability") == "annotated", "user").otherwise(F.col("agent"))
    return rows.select("bundle_id", "id", who.alias("agent"), "observability")
