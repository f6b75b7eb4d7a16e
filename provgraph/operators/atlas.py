"""Coverage of evidence by domain (ATL): what was observed, inferred, annotated, hidden or absent.

Inputs: entities (bundle_id, id, entity_type, star), provenance (bundle_id, id, evidence),
availability (bundle_id, id, entity_type, field, status), snapshots (bundle_id, daw). The ten domains
and the two bucket maps are expressions, so a corpus costs one join on provenance and one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import AVAILABILITY_BUCKET, BUCKETS, DOMAINS, EVIDENCE_BUCKET


def mapped(column: str, values: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), F.col(column))


def domain_of(entity_type: str = "entity_type") -> Column:
    """The domain that counts an entity type; null for types outside all domains."""
    return mapped(entity_type, {t: d for d, (types, _) in DOMAINS.items() for t in types})


def ledger(entities: DataFrame, provenance: DataFrame, availability: DataFrame) -> DataFrame:
    """(bundle_id, domain, element_id, field, bucket): one row for each applicable item; a null bucket counts as applicable only."""
    records = provenance.select("bundle_id", F.col("id").alias("star"), mapped("evidence", EVIDENCE_BUCKET).alias("bucket"))
    items = entities.withColumn("domain", domain_of()).where("domain is not null").join(records, ["bundle_id", "star"], "left")
    items = items.select("bundle_id", "domain", F.col("id").alias("element_id"), F.lit("*").alias("field"), "bucket")
    absent = availability.withColumn("domain", domain_of()).withColumn("bucket", mapped("status", AVAILABILITY_BUCKET))
    absent = absent.where("domain is not null and bucket is not null").select("bundle_id", "domain", F.col("id").alias("element_id"), "field", "bucket")
    return items.unionByName(absent.dropDuplicates(["bundle_id", "element_id", "field"]))


def native_features(extensions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Rows for the ledger: every top-level key of the extension named after the snapshot's source is observed."""
    own = extensions.join(snapshots.select("bundle_id", F.col("daw").alias("namespace")), ["bundle_id", "namespace"])
    return own.select("bundle_id", F.lit("Native Features").alias("domain"), F.concat(F.lit("extensions:"), "namespace").alias("element_id"), F.col("key").alias("field"), F.lit("observed").alias("bucket")).distinct()


def measured(items: DataFrame, *keys: str) -> DataFrame:
    """Bucket counts of ledger rows by the given keys."""
    counts = [F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS]
    return items.groupBy(*keys).agg(F.count(F.lit(1)).alias("applicable"), *counts)


def domains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, d) for i, d in enumerate(DOMAINS)], "domain_rank int, domain string")


def declared(capabilities: DataFrame) -> DataFrame:
    """(bundle_id, domain, field_count, support, source_stability, validation): what adapters claim to read, as maps of counts."""
    cap = mapped("cap_domain", {c: d for d, (_, caps) in DOMAINS.items() for c in caps})
    own = capabilities.where("mode = 'read'").withColumn("domain", cap).where("domain is not null")
    out = own.groupBy("bundle_id", "domain").agg(F.count(F.lit(1)).alias("field_count"))
    for name, column in (("support", "support"), ("source_stability", "source_stability"), ("validation", "validation_status")):
        counts = own.where(F.col(column).isNotNull()).groupBy("bundle_id", "domain", column).agg(F.count(F.lit(1)).alias("n"))
        out = out.join(counts.groupBy("bundle_id", "domain").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(column, "n")))).alias(name)), ["bundle_id", "domain"], "left")
    return out


def status(declared_: Column) -> Column:
    """The headline of a cell, by thresholds in fixed order."""
    share = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    ladder = F.when(share("hidden_ratio") >= 0.5, "MOSTLY_HIDDEN").when(share("direct") >= 0.999, "FULLY_OBSERVED").when(share("combined") >= 0.999, "FULLY_RECOVERED")
    ladder = ladder.when(share("direct") >= 0.5, "MOSTLY_OBSERVED").when(share("combined") >= 0.5, "MOSTLY_INFERRED").otherwise("PARTIAL")
    return F.when(F.col("applicable") > 0, ladder).when(declared_, "DECLARED_ONLY").otherwise("NOT_APPLICABLE")


def cells(snapshots: DataFrame, items: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """The dense grid: one row for every snapshot and domain, with counts, ratios and status."""
    grid = snapshots.select("bundle_id", "daw").crossJoin(F.broadcast(domains(snapshots.sparkSession)))
    out = grid.join(measured(items, "bundle_id", "domain"), ["bundle_id", "domain"], "left").fillna(0, ["applicable", *BUCKETS])
    ratio = lambda x: F.when(F.col("applicable") > 0, x / F.col("applicable"))
    out = out.withColumn("direct", ratio(F.col("observed"))).withColumn("combined", ratio(F.col("observed") + F.col("inferred") + F.col("annotated"))).withColumn("hidden_ratio", ratio(F.col("hidden")))
    if claims is None:
        return out.withColumn("status", status(F.lit(False)))
    out = out.join(claims.select("bundle_id", "domain", F.lit(True).alias("_claimed")), ["bundle_id", "domain"], "left")
    return out.withColumn("status", status(F.coalesce("_claimed", F.lit(False)))).drop("_claimed")


def evidence_mix(items: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Sums over domains by source, with a row for the corpus (daw null)."""
    counts = measured(items, "bundle_id").join(snapshots.select("bundle_id", "daw"), "bundle_id")
    out = counts.rollup("daw").agg(*(F.sum(x).alias(x) for x in ("applicable", "observed", "inferred", "annotated", "hidden")), F.sum(F.col("unsupported") + F.col("not_present") + F.col("unknown")).alias("absent"))
    return out


def field_escalations(prov: DataFrame, entities: DataFrame, provenance: DataFrame) -> DataFrame:
    """Per-field evidence behind a cell: prov (bundle_id, id, field, ref) other than '*', resolved; never in the denominator."""
    records = provenance.select("bundle_id", F.col("id").alias("ref"), mapped("evidence", EVIDENCE_BUCKET).alias("bucket"))
    rows = prov.where("field <> '*'").join(entities.select("bundle_id", "id", domain_of().alias("domain")), ["bundle_id", "id"])
    return rows.join(records, ["bundle_id", "ref"]).where("bucket is not null and domain is not null").select("bundle_id", "domain", "bucket", F.col("id").alias("element_id"), "field")


def unknown_states(availability: DataFrame, hidden_prov: DataFrame, failures: DataFrame) -> DataFrame:
    """(bundle_id, category, element_id, field) from flagged fields, hidden evidence and adapter failures."""
    kinds = {"NOT_APPLICABLE": "NOT_APPLICABLE", "UNSUPPORTED": "UNSUPPORTED", "INACCESSIBLE": "HIDDEN", "UNKNOWN": "UNKNOWN", "PARSE_ERROR": "PARSE_ERROR"}
    a = availability.withColumn("category", mapped("status", kinds)).where("category is not null").select("bundle_id", "category", F.col("id").alias("element_id"), "field")
    b = hidden_prov.select("bundle_id", F.lit("HIDDEN").alias("category"), F.col("id").alias("element_id"), "field")
    conflict = F.lower(F.concat_ws(" ", "stage", "message")).contains("conflict")
    c = failures.select("bundle_id", F.when(conflict, "CONFLICTING").otherwise("PARSE_ERROR").alias("category"), F.col("stage").alias("element_id"), F.lit("*").alias("field"))
    return a.unionByName(b).unionByName(c).distinct()
