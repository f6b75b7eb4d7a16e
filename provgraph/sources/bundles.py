"""Reading bundles of JSON files into corpus tables (SRC), and writing datasets of them (SNK).

A bundle is a directory with one canonical.snapshot.json and optional sidecars. The reader never walks
directories itself: each kind of file is one Spark read by glob, keyed by a digest of its directory.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.sanitize import hash_asset, is_asset, redact_paths, sanitize_json
from .tables import delete

# File names of a bundle.
SNAPSHOT, SIDECARS = "canonical.snapshot.json", ("native.json", "capabilities.json", "adapter_descriptor.json", "validation.json")

TEXTS = "map<string,string>"
SCHEMA = f"""schema_version string, snapshot_id string, created_at string, project string, source struct<daw:string,daw_version:string,adapter:string,adapter_version:string,capture_modes:array<string>>,
entities array<struct<id:string,entity_type:string,name:string,semantic_roles:array<string>,properties:{TEXTS},native:struct<daw:string,native_type:string,properties:{TEXTS}>,prov:{TEXTS},availability:{TEXTS}>>,
relationships array<struct<id:string,rel_type:string,source:string,target:string,properties:{TEXTS},prov_ref:string>>,
provenance array<struct<id:string,evidence:string,capture_method:string,source_stability:string,source_ref:string,confidence:double,explanation:string,warnings:array<string>>>,
coverage map<string,struct<applicable:bigint,observed:bigint,inferred:bigint,hidden:bigint,unsupported:bigint>>, extensions map<string,{TEXTS}>, warnings array<string>, failures array<struct<stage:string,message:string,detail:string>>"""


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(bundle_id, path, text) of every file of that name below root."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(root, wholetext=True)
    return rows.select(F.sha2(directory(F.col("_metadata.file_path")), 256).alias("bundle_id"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def snapshots(spark: SparkSession, root: str) -> DataFrame:
    """One row a bundle: the snapshot, and which sidecars lie beside it; a file that doesn't parse has a null snapshot."""
    out = files(spark, root, SNAPSHOT).withColumn("snapshot", F.from_json("text", SCHEMA))
    for name in SIDECARS:
        own = files(spark, root, name).select("bundle_id", F.lit(True).alias(f"has_{name.split('.')[0]}")).distinct()
        out = out.join(own, "bundle_id", "left").withColumn(f"has_{name.split('.')[0]}", F.coalesce(f"has_{name.split('.')[0]}", F.lit(False)))
    return out


def native(spark: SparkSession, root: str) -> DataFrame:
    """(bundle_id, payload): the native files as VARIANT, null where one doesn't parse. A table of its own: nothing reads these files that doesn't ask for a payload."""
    return files(spark, root, "native.json").select("bundle_id", F.try_parse_json("text").alias("payload"))


def load_warnings(rows: DataFrame) -> DataFrame:
    """(bundle_id, warnings): sidecars that are missing."""
    missing = F.array_compact(F.array(*(F.when(~F.col(f"has_{n.split('.')[0]}"), F.lit(f"missing {n}")) for n in SIDECARS if n != "native.json")))
    return rows.select("bundle_id", missing.alias("warnings"))


def tables(rows: DataFrame) -> dict[str, DataFrame]:
    """The contract's tables, list order kept in ord."""
    s = rows.where("snapshot is not null").select("bundle_id", "snapshot.*")
    each = lambda name: s.select("bundle_id", F.posexplode(name).alias("ord", "x")).select("bundle_id", "ord", "x.*")
    e = each("entities")
    number = lambda key: F.get_json_object(F.to_json("properties"), f"$.{key}").try_cast("double")
    entities = e.withColumn("role", F.get("semantic_roles", F.lit(0))).withColumn("family", F.element_at("properties", "family")).withColumn("star", F.element_at("prov", "*")).withColumn("value", number("value")).withColumn("normalized", number("normalized_value"))
    return {
        "snapshots": s.select("bundle_id", "snapshot_id", "schema_version", "created_at", F.col("source.daw").alias("daw"), "project", "source.capture_modes"),
        "entities": entities,
        "relationships": each("relationships").withColumn("idx", F.element_at("properties", "index").try_cast("long")),
        "provenance": each("provenance"),
        "availability": e.select("bundle_id", "id", "entity_type", F.explode("availability").alias("field", "status")),
        "prov": e.select("bundle_id", "id", F.explode("prov").alias("field", "ref")),
        "extensions": s.select("bundle_id", F.explode("extensions").alias("namespace", "v")).select("bundle_id", "namespace", F.explode("v").alias("key", "value")),
        "reported_coverage": s.select("bundle_id", F.explode("coverage").alias("domain", "c")).select("bundle_id", "domain", "c.*"),
        "failures": each("failures"),
    }


def capabilities(spark: SparkSession, root: str) -> DataFrame:
    """(bundle_id, mode, cap_domain, field, applicability, support, ...): the manifest's nested maps as rows."""
    cap = "struct<applicability:string,support:string,capture_method:string,source_stability:string,tested_daw_version:string,validation_status:string>"
    parsed = files(spark, root, "capabilities.json").select("bundle_id", F.from_json("text", f"map<string,map<string,struct<fields:map<string,{cap}>>>>").alias("m"))
    rows = parsed.select("bundle_id", F.explode("m").alias("mode", "d")).select("bundle_id", "mode", F.explode("d").alias("cap_domain", "c"))
    return rows.select("bundle_id", "mode", "cap_domain", F.explode("c.fields").alias("field", "f")).select("bundle_id", "mode", "cap_domain", "field", "f.*")


def sanitized(rows: DataFrame, users: tuple[str, ...] = ()) -> DataFrame:
    """(bundle_id, text): snapshots fit for export."""
    return rows.select("bundle_id", sanitize_json("text", users).alias("text"))


def write_dataset(parts: dict[str, DataFrame], out: str, files: int | None = None) -> DataFrame:
    """Writes each part as JSON below out and returns the manifest (part, rows), which is written last: a folder with a manifest holds a whole dataset.

    Each part is computed once and counted as it is written. Rows are dealt to files (as many as the session's shuffle partitions
    if not given) by all their values and sorted there, so the same input gives the same bytes, and a hot bundle spreads.
    """
    spark = next(iter(parts.values())).sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    delete(spark, [f"{out}/manifest"])
    counts = []
    for name, df in sorted(parts.items()):
        order = [F.to_json(F.struct(c)) if "map<" in t or t == "variant" else F.col(c) for c, t in df.dtypes]
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        # counted behind the shuffle, where each row passes once
        df.repartition(files, F.xxhash64(*order)).sortWithinPartitions(*order).observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").json(f"{out}/{name}")
        counts.append((name, seen.get["rows"]))
    manifest = spark.createDataFrame(counts, "part string, rows long")
    manifest.coalesce(1).write.mode("overwrite").json(f"{out}/manifest")
    return manifest


def labelled(spark: SparkSession, path: str) -> DataFrame:
    """Labelled names from CSV; a missing count is 1."""
    rows = spark.read.option("header", "true").schema("name string, expected_role string, count bigint, category string").csv(path)
    return rows.withColumn("count", F.coalesce("count", F.lit(1)))


def label_counts(lines: DataFrame, key: str = "instrument") -> DataFrame:
    """(label, n) of `key: label` lines in a table of text lines (value)."""
    label = F.regexp_extract("value", rf"^\s*{key}:\s*(.+?)\s*$", 1)
    return lines.select(label.alias("label")).where("label <> ''").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


__all__ = ["capabilities", "files", "hash_asset", "is_asset", "label_counts", "labelled", "load_warnings", "native", "redact_paths", "sanitized", "snapshots", "tables", "write_dataset"]
