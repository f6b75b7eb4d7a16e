"""Point access and inspection (ACC): evidence behind an entity, registry lookups, readable counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_id(rows: DataFrame, bundle_id, *ids: str) -> DataFrame:
    return rows.where((F.col("bundle_id") == bundle_id) & F.col("id").isin(*ids))


def listing(entities: DataFrame) -> DataFrame:
    """Entities in the order of an inspector: type, name without case, id."""
    return entities.orderBy("bundle_id", "entity_type", F.lower("name"), "id")


def evidence_rows(prov: DataFrame, provenance: DataFrame, availability: DataFrame) -> DataFrame:
    """(bundle_id, id, field, source, detail): every provenance reference, resolved or dangling, and every availability flag.

    prov: bundle_id, id, field, ref.
    """
    records = provenance.select("bundle_id", F.col("id").alias("ref"), "evidence")
    refs = prov.join(records, ["bundle_id", "ref"], "left").select("bundle_id", "id", "field", F.lit("provenance").alias("source"), F.coalesce("evidence", F.lit("DANGLING REFERENCE")).alias("detail"))
    return refs.unionByName(availability.select("bundle_id", "id", "field", F.lit("availability").alias("source"), F.col("status").alias("detail")))


def readout(items: DataFrame) -> DataFrame:
    """items (bundle_id, bucket): a class of how well a snapshot can be seen: mostly seen, helped, hidden parts, or partly seen."""
    n = items.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("applicable"), *(F.count_if(F.col("bucket") == b).alias(b) for b in ("observed", "inferred", "annotated", "hidden")))
    share = lambda x: x / F.col("applicable")
    kind = F.when(share(F.col("observed")) >= 0.9, "seen").when(F.col("inferred") + F.col("annotated") >= F.col("observed"), "helped").when(share(F.col("hidden")) >= 0.2, "hidden").otherwise("partly")
    return n.select("bundle_id", "applicable", kind.alias("readout"))


def concepts_of(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """rows (bundle_id, id, daw, wire_type) with the registry's concepts (concept_id, concept_rank, daw, wire_type) in declaration order; none is an empty list."""
    hits = rows.join(registry, ["daw", "wire_type"]).groupBy("bundle_id", "id").agg(F.transform(F.sort_array(F.collect_set(F.struct("concept_rank", "concept_id"))), lambda x: x["concept_id"]).alias("concepts"))
    return rows.join(hits, ["bundle_id", "id"], "left").withColumn("concepts", F.coalesce("concepts", F.array().cast("array<string>")))


def equivalence(rows: DataFrame, levels: DataFrame) -> DataFrame:
    """rows (concept_id, daw) with the registered level of equivalence, UNKNOWN where none is."""
    return rows.join(levels, ["concept_id", "daw"], "left").withColumn("level", F.coalesce("level", F.lit("UNKNOWN")))


def unexplained_hidden(rows: DataFrame, model: DataFrame) -> DataFrame:
    """rows (dialect, artifact_type, annotated ARRAY<STRING>): hidden fields of the observation model that nobody annotated. model: dialect, artifact_type, hidden ARRAY<STRING>."""
    out = rows.join(model, ["dialect", "artifact_type"], "left")
    return out.withColumn("unexplained", F.sort_array(F.array_except(F.coalesce("hidden", F.array().cast("array<string>")), "annotated")))
