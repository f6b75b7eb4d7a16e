"""Referential and contract checks (VAL) as rows (bundle_id, severity, rule, element_id).

Every rule is a semi, anti or counting query over the whole corpus; a snapshot is valid if it has no
row of severity 'error'.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import AVAILABILITY, EVIDENCE, REL_TYPES
from ..sources.tables import cut, settled


def issue(rows: DataFrame, severity: str, rule: str, element: Column) -> DataFrame:
    return rows.select("bundle_id", F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), element.cast("string").alias("element_id"))


def version_gate(snapshots: DataFrame, major: str = "0", minor: str = "2") -> DataFrame:
    """Snapshots whose schema version is missing, malformed, or of another major or minor number than the contract's."""
    parts = F.split("schema_version", r"\.")
    ok = (F.size(parts) >= 2) & (F.get(parts, F.lit(0)) == major) & (F.get(parts, F.lit(1)) == minor)
    return issue(snapshots.where(~F.coalesce(ok, F.lit(False))), "error", "schema_version", F.col("schema_version"))


def repeated(rows: DataFrame, rule: str) -> DataFrame:
    """One row for each extra occurrence of an id."""
    again = rows.groupBy("bundle_id", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return issue(again.withColumn("_", F.explode(F.sequence(F.lit(2), F.col("n").cast("int")))), "error", rule, F.col("id"))


def one_project(snapshots: DataFrame, entities: DataFrame) -> DataFrame:
    n = entities.where("entity_type = 'PROJECT'").groupBy("bundle_id").agg(F.count(F.lit(1)).alias("n"))
    return issue(snapshots.join(n, "bundle_id", "left").where("coalesce(n, 0) <> 1"), "error", "one_project", F.coalesce("n", F.lit(0)))


def project_pointer(snapshots: DataFrame, entities: DataFrame) -> DataFrame:
    """snapshots with a column project: the pointer must be the id of the PROJECT entity."""
    own = entities.where("entity_type = 'PROJECT'").select("bundle_id", F.col("id").alias("project"))
    return issue(snapshots.where("project is not null").join(own, ["bundle_id", "project"], "left_anti"), "error", "project_pointer", F.col("project"))


def unresolved(rows: DataFrame, column: str, targets: DataFrame, rule: str) -> DataFrame:
    """Rows whose non-null reference names no id of targets."""
    ids = targets.select("bundle_id", F.col("id").alias(column)).distinct()
    element = F.concat_ws("->", "id", column)
    return issue(rows.where(F.col(column).isNotNull()).join(ids, ["bundle_id", column], "left_anti"), "error", rule, element)


def outside(rows: DataFrame, column: str, allowed: tuple[str, ...], severity: str, rule: str) -> DataFrame:
    """Rows with a value that isn't in a closed vocabulary."""
    return issue(rows.where(~F.col(column).isin(*allowed)), severity, rule, F.concat_ws("=", "id", column))


def lone_tracks(entities: DataFrame, relationships: DataFrame, availability: DataFrame) -> DataFrame:
    """Tracks with neither a channel edge nor a flag that says why."""
    used = relationships.where("rel_type = 'TRACK_USES_CHANNEL'").select("bundle_id", F.col("source").alias("id"))
    flagged = availability.where("field = 'channel'").select("bundle_id", "id")
    rows = entities.where("entity_type = 'TRACK'").join(used, ["bundle_id", "id"], "left_anti").join(flagged, ["bundle_id", "id"], "left_anti")
    return issue(rows, "warning", "lone_track", F.col("id"))


def sure_observations(provenance: DataFrame) -> DataFrame:
    """Observed records don't carry a confidence."""
    return issue(provenance.where("evidence = 'OBSERVED' and confidence is not null"), "warning", "observed_confidence", F.col("id"))


@settled
def issues(snapshots: DataFrame, entities: DataFrame, relationships: DataFrame, provenance: DataFrame, availability: DataFrame) -> DataFrame:
    """All rules together. Each rule's rows are written before the next rule runs, so that the disk holds one rule's shuffle at a time."""
    found = [
        version_gate(snapshots),
        repeated(entities, "entity_id"),
        repeated(relationships, "relationship_id"),
        one_project(snapshots, entities),
        unresolved(entities, "star", provenance, "entity_prov"),
        unresolved(relationships, "source", entities, "rel_source"),
        unresolved(relationships, "target", entities, "rel_target"),
        unresolved(relationships, "prov_ref", provenance, "rel_prov"),
        outside(relationships, "rel_type", REL_TYPES, "warning", "rel_type"),
        outside(provenance, "evidence", EVIDENCE, "error", "evidence"),
        outside(availability, "status", AVAILABILITY, "error", "availability"),
        lone_tracks(entities, relationships, availability),
        sure_observations(provenance),
    ]
    return reduce(DataFrame.unionByName, map(cut, found))


def report(snapshots: DataFrame, found: DataFrame) -> DataFrame:
    """(bundle_id, errors, warnings, valid), snapshots without any issue included."""
    counts = found.groupBy("bundle_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    out = snapshots.select("bundle_id").join(counts, "bundle_id", "left").fillna(0, ["errors", "warnings"])
    return out.withColumn("valid", F.col("errors") == 0)


def stats(entities: DataFrame) -> DataFrame:
    return entities.groupBy("bundle_id", "entity_type").agg(F.count(F.lit(1)).alias("n"))


def namespaces(entities: DataFrame) -> DataFrame:
    """(bundle_id, namespaces): distinct id prefixes but for shared ones; a conforming snapshot has one."""
    prefix = F.split_part("id", F.lit(":"), F.lit(1))
    return entities.where(~prefix.isin("asset", "prov")).groupBy("bundle_id").agg(F.countDistinct(prefix).alias("namespaces"))


def coverage_bounds(reported: DataFrame) -> DataFrame:
    """Adapter-reported counts whose buckets exceed what is applicable."""
    return issue(reported.where("observed + inferred + hidden + unsupported > applicable"), "error", "coverage_bounds", F.col("domain"))


def home_paths(raw: DataFrame) -> DataFrame:
    """raw (bundle_id, text): snapshots whose text names a home directory."""
    return issue(raw.where(F.col("text").rlike(r"(/Users/|/home/|[A-Za-z]:\\Users\\)[^/\\\s\"]+")), "error", "home_path", F.lit("text"))


def native_digests(files: DataFrame, extensions: DataFrame) -> DataFrame:
    """files (bundle_id, content): their SHA-256 must be the one that the snapshot records (bundle_id, sha256)."""
    rows = files.select("bundle_id", F.sha2("content", 256).alias("found")).join(extensions.select("bundle_id", "sha256"), "bundle_id")
    return issue(rows.where("found <> sha256"), "error", "native_digest", F.col("found"))
