"""Report metrics (MET): provenance completeness, evidence ratios, corpus sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .atlas import BUCKETS, measured


def evidence_ratios(items: DataFrame) -> DataFrame:
    """Each bucket's share of what is applicable, by snapshot; 0 when nothing is."""
    counts = measured(items, "bundle_id")
    return counts.select("bundle_id", "applicable", *(F.coalesce(F.try_divide(F.col(b), F.col("applicable")), F.lit(0.0)).alias(f"{b}_ratio") for b in BUCKETS))


def provenance_completeness(snapshots: DataFrame, entities: DataFrame, relationships: DataFrame, provenance: DataFrame) -> DataFrame:
    """(bundle_id, refs, resolved, completeness): entity refs and non-null relationship refs that a record answers; 1 without refs."""
    refs = entities.where("star is not null").select("bundle_id", F.col("star").alias("ref")).unionByName(relationships.where("prov_ref is not null").select("bundle_id", F.col("prov_ref").alias("ref")))
    # few distinct references a snapshot: counted before the join
    refs = refs.groupBy("bundle_id", "ref").agg(F.count(F.lit(1)).alias("n"))
    known = provenance.select("bundle_id", F.col("id").alias("ref"), F.lit(True).alias("known")).distinct()
    sums = refs.join(known, ["bundle_id", "ref"], "left").groupBy("bundle_id").agg(F.sum("n").alias("refs"), F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0)).alias("resolved"))
    out = snapshots.select("bundle_id").join(sums, "bundle_id", "left").fillna(0, ["refs", "resolved"])
    return out.withColumn("completeness", F.when(F.col("refs") == 0, 1.0).otherwise(F.col("resolved") / F.col("refs")))


def native_preservation(extensions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(bundle_id, feature_count, extension_keys): keys of the own namespace and of all."""
    rows = extensions.join(snapshots.select("bundle_id", "daw"), "bundle_id")
    return rows.groupBy("bundle_id").agg(F.count_if(F.col("namespace") == F.col("daw")).alias("feature_count"), F.count(F.lit(1)).alias("extension_keys"))


def alignment_metrics(results: DataFrame) -> DataFrame:
    """By concept and status: results, and mean confidence over those that have one."""
    return results.groupBy("concept_id", "status").agg(F.count(F.lit(1)).alias("results"), F.avg("confidence").alias("mean_confidence"))


def corpus(ratios: DataFrame, completeness: DataFrame) -> DataFrame:
    """One row for the whole corpus."""
    rows = ratios.join(completeness, "bundle_id", "full_outer")
    return rows.agg(F.count(F.lit(1)).alias("snapshots"), F.sum("applicable").alias("applicable"), F.sum("refs").alias("refs"), F.sum("resolved").alias("resolved"), F.count_if(F.col("completeness") < 1).alias("incomplete"))
