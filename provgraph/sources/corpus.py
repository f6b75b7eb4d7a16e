"""The driver's relational tables as a corpus of snapshots, in SQL that Spark and DuckDB both read.

A customer is a snapshot, an order a track (and mostly a channel), a line item a processor with one
parameter. The statements only project and rename; every operator works on the resulting tables, or on
tables of the same columns read from bundles.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .tables import cut, scope

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: name -> statement; a statement names driver tables and earlier statements in braces.
STATEMENTS = {
    "lines": """
SELECT l.*, o.o_custkey AS bundle_id, o.o_orderpriority,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS line_uid,
       'o' || CAST(l_orderkey AS STRING) AS okey
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey""",
    "snapshots": """
SELECT c_custkey AS bundle_id, 'snap:' || CAST(c_custkey AS STRING) AS snapshot_id,
       CASE WHEN c_custkey % 50 = 0 THEN '0.9.0' ELSE '0.2.0' END AS schema_version,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'ableton_live' WHEN 'BUILDING' THEN 'cubase' WHEN 'FURNITURE' THEN 'logic_pro' WHEN 'HOUSEHOLD' THEN 'reaper' ELSE 'synthetic' END AS daw
FROM {customer}""",
    "provenance": """
SELECT c_custkey AS bundle_id, e.id, e.evidence,
       CASE WHEN e.evidence = 'INFERRED' THEN 0.8 WHEN e.evidence = 'OBSERVED' AND c_custkey % 40 = 0 THEN 1.0 END AS confidence
FROM {customer} CROSS JOIN (SELECT 'prov:0001' AS id, 'OBSERVED' AS evidence UNION ALL SELECT 'prov:0002', 'INFERRED' UNION ALL SELECT 'prov:0003', 'ANNOTATED' UNION ALL SELECT 'prov:0004', 'HIDDEN') e""",
    "returns": """
SELECT DISTINCT l.bundle_id, s.s_nationkey FROM {lines} l JOIN {supplier} s ON l.l_suppkey = s.s_suppkey""",
    "entities": """
SELECT c_custkey AS bundle_id, 'p' || CAST(c_custkey AS STRING) AS id, 'PROJECT' AS entity_type, c_name AS name, CAST(NULL AS STRING) AS role, CAST(NULL AS STRING) AS family, 'prov:0001' AS star, CAST(NULL AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS normalized FROM {customer}
UNION ALL
SELECT o_custkey, 't' || CAST(o_orderkey AS STRING), 'TRACK', 'Track ' || CAST(o_orderkey AS STRING), CASE WHEN o_orderpriority = '1-URGENT' THEN 'submix' WHEN o_orderpriority = '2-HIGH' THEN 'vocal_source' ELSE 'track' END, NULL,
       CASE o_orderstatus WHEN 'F' THEN 'prov:0001' WHEN 'O' THEN 'prov:0002' WHEN 'P' THEN 'prov:0003' ELSE 'prov:9999' END, NULL, NULL FROM {orders}
UNION ALL
SELECT o_custkey, 'c' || CAST(o_orderkey AS STRING), 'CHANNEL', 'Channel ' || CAST(o_orderkey AS STRING), NULL, NULL, CASE WHEN o_orderkey % 97 = 0 THEN 'prov:9999' ELSE 'prov:0001' END, NULL, NULL FROM {orders} WHERE o_orderpriority <> '4-NOT SPECIFIED'
UNION ALL
SELECT r.bundle_id, 'r' || CAST(r.bundle_id AS STRING) || '-' || CAST(r.s_nationkey AS STRING), 'CHANNEL', n.n_name || ' Return', 'effect_return', NULL, 'prov:0001', NULL, NULL FROM {returns} r JOIN {nation} n ON r.s_nationkey = n.n_nationkey
UNION ALL
SELECT c_custkey, 'm' || CAST(c_custkey AS STRING), 'CHANNEL', 'Master', 'main_output', NULL, 'prov:0001', NULL, NULL FROM {customer}
UNION ALL
SELECT l.bundle_id, 'x' || CAST(l.l_orderkey AS STRING) || '-' || CAST(l.line_uid AS STRING), 'PROCESSOR', p.p_name, NULL, CASE p.p_type WHEN 'PROMO' THEN 'Ambience' WHEN 'STANDARD' THEN 'Dynamics' WHEN 'SMALL' THEN 'EQ' ELSE p.p_type END, CASE l.l_returnflag WHEN 'A' THEN 'prov:0001' WHEN 'N' THEN 'prov:0002' ELSE 'prov:0004' END, NULL, NULL FROM {lines} l JOIN {part} p ON l.l_partkey = p.p_partkey
UNION ALL
SELECT l.bundle_id, 'v' || CAST(l.l_orderkey AS STRING) || '-' || CAST(l.line_uid AS STRING), 'PARAMETER', CASE WHEN l.l_partkey % 3 = 0 THEN 'Wet Mix' WHEN l.l_partkey % 3 = 1 THEN 'Delay Feedback' ELSE 'Width' END, NULL, NULL, 'prov:0001', l.l_quantity, l.l_discount FROM {lines} l""",
    "availability": """
SELECT o_custkey AS bundle_id, 't' || CAST(o_orderkey AS STRING) AS id, 'TRACK' AS entity_type, 'channel' AS field, 'UNKNOWN' AS status FROM {orders} WHERE o_orderpriority = '4-NOT SPECIFIED' AND o_orderkey % 11 <> 0
UNION ALL
SELECT bundle_id, 'x' || CAST(l_orderkey AS STRING) || '-' || CAST(line_uid AS STRING), 'PROCESSOR', 'parameters', 'INACCESSIBLE' FROM {lines} WHERE l_linestatus = 'F' AND l_tax >= 0.06
UNION ALL
SELECT bundle_id, 'x' || CAST(l_orderkey AS STRING) || '-' || CAST(line_uid AS STRING), 'PROCESSOR', 'preset', CASE WHEN l_partkey % 5 = 0 THEN 'UNSUPPORTED' ELSE 'NOT_PRESENT' END FROM {lines} WHERE l_discount = 0""",
    "relationships": """
SELECT o_custkey AS bundle_id, 'u' || CAST(o_orderkey AS STRING) AS id, 'TRACK_USES_CHANNEL' AS rel_type, 't' || CAST(o_orderkey AS STRING) AS source, 'c' || CAST(o_orderkey AS STRING) AS target, CAST(NULL AS BIGINT) AS idx, 'prov:0001' AS prov_ref FROM {orders} WHERE o_orderpriority <> '4-NOT SPECIFIED'
UNION ALL
SELECT bundle_id, 'b' || CAST(l_orderkey AS STRING) || '-' || CAST(line_uid AS STRING), 'CHANNEL_PROCESSED_BY', 'c' || CAST(l_orderkey AS STRING), 'x' || CAST(l_orderkey AS STRING) || '-' || CAST(line_uid AS STRING), line_uid, 'prov:0001' FROM {lines}
UNION ALL
SELECT bundle_id, 'k' || CAST(l_orderkey AS STRING) || '-' || CAST(line_uid AS STRING), 'CONTAINS', 'x' || CAST(l_orderkey AS STRING) || '-' || CAST(line_uid AS STRING), 'v' || CAST(l_orderkey AS STRING) || '-' || CAST(line_uid AS STRING), NULL, NULL FROM {lines}
UNION ALL
SELECT DISTINCT l.bundle_id, 's' || CAST(l.l_orderkey AS STRING) || '-' || CAST(s.s_nationkey AS STRING), 'CHANNEL_SENDS_TO', 'c' || CAST(l.l_orderkey AS STRING), 'r' || CAST(l.bundle_id AS STRING) || '-' || CAST(s.s_nationkey AS STRING), CAST(NULL AS BIGINT), 'prov:0002' FROM {lines} l JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
UNION ALL
SELECT DISTINCT l.bundle_id, 'f' || CAST(l.l_orderkey AS STRING) || '-' || CAST(s.s_nationkey AS STRING), 'CHANNEL_SENDS_TO', 'r' || CAST(l.bundle_id AS STRING) || '-' || CAST(s.s_nationkey AS STRING), 'c' || CAST(l.l_orderkey AS STRING), CAST(NULL AS BIGINT), 'prov:0002' FROM {lines} l JOIN {supplier} s ON l.l_suppkey = s.s_suppkey WHERE l.l_partkey % 97 = 0
UNION ALL
SELECT bundle_id, 'g' || CAST(bundle_id AS STRING) || '-' || CAST(s_nationkey AS STRING), 'CHANNEL_ROUTES_TO', 'r' || CAST(bundle_id AS STRING) || '-' || CAST(s_nationkey AS STRING), 'm' || CAST(bundle_id AS STRING), NULL, 'prov:0001' FROM {returns}""",
}


#: Statements whose rows are written once for a query, however often it reads them.
WRITTEN = ("lines", "entities", "relationships", "availability")


def _named(statement: str) -> set[str]:
    return set(re.findall(r"\{(\w+)\}", statement))


def _read(name: str) -> set[str]:
    """The written tables that a table's rows are read from."""
    return {name} if name in WRITTEN else set().union(*map(_read, _named(STATEMENTS.get(name, ""))))


def tables(spark: SparkSession, sf_dir: str, *names: str) -> tuple[DataFrame, ...]:
    """The named corpus or driver tables. Those of WRITTEN are written tables, read with the columns that a query takes (tables.drop_left deletes them).

    A query that takes several names them in one call: each is then written once, and those that only others are made of are deleted.
    """
    made: dict[str, DataFrame] = {}
    kept = set().union(*map(_read, names))

    def get(name: str) -> DataFrame:
        if name not in made:
            if name in STATEMENTS:
                made[name] = spark.sql(STATEMENTS[name], **{x: get(x) for x in _named(STATEMENTS[name])})
                made[name] = cut(made[name], result=name in kept) if name in WRITTEN else made[name]
            else:
                made[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return made[name]

    with scope(spark):
        return tuple(get(name) for name in names)


def with_clause(*names: str) -> str:
    """The same tables as a WITH clause over the driver's views."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in re.findall(r"\{(\w+)\}", STATEMENTS[name]):
            if x in STATEMENTS and x not in order:
                add(x)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    plain = {x: x for x in (*TABLES, *STATEMENTS)}
    return "WITH " + ",\n".join(f"{name} AS MATERIALIZED ({STATEMENTS[name].format(**plain)})" for name in order)
