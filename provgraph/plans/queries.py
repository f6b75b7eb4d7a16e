"""Registered queries of the library's own operators over the projected corpus, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, roles, sanitize
from ..operators import access, align, atlas, delta, evaluate, graph, influence, ladder, lineage, metrics, normalize, provview, rules, sessiondiff, signal, similarity, validate
from ..sources.corpus import tables, with_clause

QUERIES: dict = {}
SQL: dict[str, str] = {}

# Pieces of SQL that several oracles share; fixed values of the contract spelled out.
DOMAIN = "CASE WHEN entity_type IN ('PROJECT','TRACK','STRUCTURAL_CONTAINER') THEN 'Structure' WHEN entity_type IN ('TEMPORAL_OBJECT','TIMELINE') THEN 'Timeline' WHEN entity_type IN ('ROUTING_ENDPOINT','ROUTING_EDGE','CHANNEL') THEN 'Routing' WHEN entity_type = 'PROCESSOR' THEN 'Processing' WHEN entity_type = 'PARAMETER' THEN 'Parameters' WHEN entity_type = 'AUTOMATION' THEN 'Automation' WHEN entity_type = 'MODULATION' THEN 'Modulation' END"
LEDGER = f""", ledger AS (
  SELECT e.bundle_id, {DOMAIN} AS domain, lower(p.evidence) AS bucket FROM entities e LEFT JOIN provenance p ON e.bundle_id = p.bundle_id AND e.star = p.id WHERE {DOMAIN} IS NOT NULL
  UNION ALL
  SELECT bundle_id, {DOMAIN}, CASE status WHEN 'INACCESSIBLE' THEN 'hidden' WHEN 'UNSUPPORTED' THEN 'unsupported' WHEN 'NOT_PRESENT' THEN 'not_present' WHEN 'UNKNOWN' THEN 'unknown' END
  FROM (SELECT DISTINCT bundle_id, id, entity_type, field, status FROM availability))"""
COUNTS = "count(*) AS applicable, " + ", ".join(f"count(*) FILTER (bucket = '{b}') AS {b}" for b in atlas.BUCKETS)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atlas.ledger(*tables(spark, sf_dir, "entities", "provenance", "availability"))


@query(with_clause("snapshots", "entities", "provenance", "availability") + LEDGER + f""",
cells AS (SELECT bundle_id, domain, {COUNTS} FROM ledger GROUP BY ALL),
names AS (SELECT unnest(['Structure','Timeline','Routing','Processing','Parameters','Automation','Modulation','Musical Content','Native Features','Audio Outcome']) AS domain),
grid AS (SELECT s.bundle_id, s.daw, n.domain, {", ".join(f"coalesce({x}, 0) AS {x}" for x in ("applicable", *atlas.BUCKETS))} FROM snapshots s CROSS JOIN names n LEFT JOIN cells c ON s.bundle_id = c.bundle_id AND n.domain = c.domain)
SELECT *, round(observed / nullif(applicable, 0), 6) AS direct, round((observed + inferred + annotated) / nullif(applicable, 0), 6) AS combined, round(hidden / nullif(applicable, 0), 6) AS hidden_ratio,
  CASE WHEN applicable = 0 THEN 'NOT_APPLICABLE' WHEN hidden / applicable >= 0.5 THEN 'MOSTLY_HIDDEN' WHEN observed / applicable >= 0.999 THEN 'FULLY_OBSERVED' WHEN (observed + inferred + annotated) / applicable >= 0.999 THEN 'FULLY_RECOVERED'
       WHEN observed / applicable >= 0.5 THEN 'MOSTLY_OBSERVED' WHEN (observed + inferred + annotated) / applicable >= 0.5 THEN 'MOSTLY_INFERRED' ELSE 'PARTIAL' END AS status
FROM grid""")
def atlas_cells(spark, sf_dir):
    (snapshots,) = tables(spark, sf_dir, "snapshots")
    out = atlas.cells(snapshots, _ledger(spark, sf_dir)).drop("domain_rank")
    return out.withColumns({c: F.round(c, 6) for c in ("direct", "combined", "hidden_ratio")})


@query(with_clause("snapshots", "entities", "provenance", "availability") + LEDGER + """
SELECT daw, count(*) AS applicable, count(*) FILTER (bucket = 'observed') AS observed, count(*) FILTER (bucket = 'inferred') AS inferred, count(*) FILTER (bucket = 'annotated') AS annotated, count(*) FILTER (bucket = 'hidden') AS hidden,
  count(*) FILTER (bucket IN ('unsupported', 'not_present', 'unknown')) AS absent
FROM ledger JOIN snapshots USING (bundle_id) GROUP BY ROLLUP (daw)""")
def evidence_mix(spark, sf_dir):
    return atlas.evidence_mix(_ledger(spark, sf_dir), *tables(spark, sf_dir, "snapshots"))


@query(with_clause("entities", "provenance", "availability") + """
SELECT DISTINCT bundle_id, CASE status WHEN 'INACCESSIBLE' THEN 'HIDDEN' ELSE status END AS category, id AS element_id, field FROM availability WHERE status IN ('INACCESSIBLE', 'UNSUPPORTED', 'UNKNOWN')
UNION SELECT e.bundle_id, 'HIDDEN', e.id, '*' FROM entities e JOIN provenance p ON e.bundle_id = p.bundle_id AND e.star = p.id WHERE p.evidence = 'HIDDEN'""")
def unknown_states(spark, sf_dir):
    entities, provenance, availability = tables(spark, sf_dir, "entities", "provenance", "availability")
    records = provenance.where("evidence = 'HIDDEN'").select("bundle_id", F.col("id").alias("star"))
    hidden = entities.join(records, ["bundle_id", "star"]).select("bundle_id", "id", F.lit("*").alias("field"))
    return atlas.unknown_states(availability, hidden, spark.createDataFrame([], "bundle_id long, stage string, message string"))


ISSUES = """, refs AS (SELECT bundle_id, id FROM provenance), ids AS (SELECT DISTINCT bundle_id, id FROM entities),
issues AS (
  SELECT bundle_id, 'error' AS severity, 'schema_version' AS rule, schema_version AS element_id FROM snapshots WHERE schema_version NOT LIKE '0.2.%'
  UNION ALL SELECT bundle_id, 'error', 'entity_id', id FROM (SELECT bundle_id, id, row_number() OVER (PARTITION BY bundle_id, id) AS n FROM entities) WHERE n > 1
  UNION ALL SELECT bundle_id, 'error', 'relationship_id', id FROM (SELECT bundle_id, id, row_number() OVER (PARTITION BY bundle_id, id) AS n FROM relationships) WHERE n > 1
  UNION ALL SELECT bundle_id, 'error', 'entity_prov', e.id || '->' || star FROM entities e WHERE star IS NOT NULL AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.bundle_id = e.bundle_id AND r.id = e.star)
  UNION ALL SELECT bundle_id, 'error', 'rel_source', e.id || '->' || source FROM relationships e WHERE NOT EXISTS (SELECT 1 FROM ids r WHERE r.bundle_id = e.bundle_id AND r.id = e.source)
  UNION ALL SELECT bundle_id, 'error', 'rel_target', e.id || '->' || target FROM relationships e WHERE NOT EXISTS (SELECT 1 FROM ids r WHERE r.bundle_id = e.bundle_id AND r.id = e.target)
  UNION ALL SELECT bundle_id, 'error', 'rel_prov', e.id || '->' || prov_ref FROM relationships e WHERE prov_ref IS NOT NULL AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.bundle_id = e.bundle_id AND r.id = e.prov_ref)
  UNION ALL SELECT bundle_id, 'warning', 'lone_track', id FROM entities e WHERE entity_type = 'TRACK'
    AND NOT EXISTS (SELECT 1 FROM relationships r WHERE r.bundle_id = e.bundle_id AND r.rel_type = 'TRACK_USES_CHANNEL' AND r.source = e.id) AND NOT EXISTS (SELECT 1 FROM availability a WHERE a.bundle_id = e.bundle_id AND a.id = e.id AND a.field = 'channel')
  UNION ALL SELECT bundle_id, 'warning', 'observed_confidence', id FROM provenance WHERE evidence = 'OBSERVED' AND confidence IS NOT NULL)"""
CONTRACT = ("snapshots", "entities", "relationships", "provenance", "availability")


@query(with_clause(*CONTRACT) + ISSUES + " SELECT * FROM issues")
def validation_issues(spark, sf_dir):
    return validate.issues(*tables(spark, sf_dir, *CONTRACT))


@query(with_clause(*CONTRACT) + ISSUES + """
SELECT s.bundle_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'error') = 0 AS valid FROM snapshots s LEFT JOIN issues i USING (bundle_id) GROUP BY s.bundle_id""")
def validation_report(spark, sf_dir):
    t = tables(spark, sf_dir, *CONTRACT)
    return validate.report(t[0], validate.issues(*t))


@query(with_clause("entities") + " SELECT bundle_id, entity_type, count(*) AS n FROM entities GROUP BY ALL")
def validation_stats(spark, sf_dir):
    return validate.stats(*tables(spark, sf_dir, "entities"))


RUNGS = """, c AS (SELECT bundle_id, count(*) FILTER (entity_type = 'TRACK') AS tracks, count(*) FILTER (entity_type IN ('CHANNEL', 'PROCESSOR')) AS paths, count(*) FILTER (entity_type IN ('TEMPORAL_OBJECT', 'TIMELINE', 'AUTOMATION')) AS times, count(*) FILTER (entity_type IN ('MODULATION', 'VARIANT')) AS mods, count(*) FILTER (entity_type IN ('OBSERVATION', 'RENDER')) AS outs FROM entities GROUP BY 1),
r AS (SELECT bundle_id, count(*) AS routes FROM relationships WHERE rel_type IN ('CHANNEL_SENDS_TO', 'CHANNEL_ROUTES_TO', 'SUMS_TO', 'TRACK_USES_CHANNEL') GROUP BY 1),
v AS (SELECT bundle_id, count(*) AS errors FROM issues WHERE severity = 'error' GROUP BY 1),
flags AS (SELECT s.bundle_id, s.daw, [coalesce(errors, 0) = 0, coalesce(tracks, 0) > 0 AND paths > 0, coalesce(routes, 0) > 0, coalesce(times, 0) > 0, coalesce(mods, 0) > 0, coalesce(outs, 0) > 0, false] AS f FROM snapshots s LEFT JOIN c USING (bundle_id) LEFT JOIN r USING (bundle_id) LEFT JOIN v USING (bundle_id)),
rungs AS (SELECT bundle_id, daw, l AS level, f[l + 1] AS reached FROM flags, range(7) t(l))"""


def _profile(spark, sf_dir):
    t = tables(spark, sf_dir, *CONTRACT)
    return ladder.profile(t[0], validate.report(t[0], validate.issues(*t)), t[1], t[2])


@query(with_clause(*CONTRACT) + ISSUES + RUNGS + " SELECT bundle_id, level::INTEGER AS level, ['validity', 'structure', 'routing', 'time', 'scenes and modulation', 'audio outcome', 'intervention'][level + 1] AS title, reached, level = 4 AS provisional FROM rungs")
def ladder_profile(spark, sf_dir):
    return _profile(spark, sf_dir)


@query(with_clause(*CONTRACT) + ISSUES + RUNGS + """
SELECT bundle_id, array_to_string(list_sort(list(level) FILTER (reached)), ',') AS reached_set, (coalesce(min(level) FILTER (NOT reached), 7) - 1)::INTEGER AS highest_contiguous FROM rungs GROUP BY 1""")
def ladder_summary(spark, sf_dir):
    out = ladder.summary(_profile(spark, sf_dir))
    # no rung reached: null, as in SQL
    return out.withColumn("reached_set", F.when(F.size("reached_set") > 0, F.array_join(F.col("reached_set").cast("array<string>"), ",")))


@query(with_clause(*CONTRACT) + ISSUES + RUNGS + " SELECT daw, level::INTEGER AS level, count(*) FILTER (reached) AS reached, count(*) AS snapshots FROM rungs GROUP BY ALL")
def ladder_matrix(spark, sf_dir):
    return ladder.matrix(_profile(spark, sf_dir), *tables(spark, sf_dir, "snapshots"))


@query(with_clause("entities", "provenance", "availability") + LEDGER + f", m AS (SELECT bundle_id, {COUNTS} FROM ledger GROUP BY 1) SELECT bundle_id, applicable, " + ", ".join(f"round({b} / applicable, 6) AS {b}_ratio" for b in atlas.BUCKETS) + " FROM m")
def metric_evidence_ratios(spark, sf_dir):
    out = metrics.evidence_ratios(_ledger(spark, sf_dir))
    return out.withColumns({f"{b}_ratio": F.round(f"{b}_ratio", 6) for b in atlas.BUCKETS})


COMPLETE = """, refs AS (SELECT bundle_id, star AS ref FROM entities WHERE star IS NOT NULL UNION ALL SELECT bundle_id, prov_ref FROM relationships WHERE prov_ref IS NOT NULL),
done AS (SELECT s.bundle_id, count(r.ref) AS refs, count(p.id) AS resolved FROM snapshots s LEFT JOIN refs r ON s.bundle_id = r.bundle_id LEFT JOIN provenance p ON r.bundle_id = p.bundle_id AND r.ref = p.id GROUP BY 1)"""


@query(with_clause("snapshots", "entities", "relationships", "provenance") + COMPLETE + " SELECT *, round(CASE WHEN refs = 0 THEN 1.0 ELSE resolved / refs END, 6)::DOUBLE AS completeness FROM done")
def metric_provenance_completeness(spark, sf_dir):
    out = metrics.provenance_completeness(*tables(spark, sf_dir, "snapshots", "entities", "relationships", "provenance"))
    return out.withColumn("completeness", F.round("completeness", 6))


@query(with_clause("snapshots", "entities", "relationships", "provenance", "availability") + COMPLETE + LEDGER + """, m AS (SELECT bundle_id, count(*) AS applicable FROM ledger GROUP BY 1)
SELECT count(*) AS snapshots, sum(applicable)::BIGINT AS applicable, sum(refs)::BIGINT AS refs, sum(resolved)::BIGINT AS resolved, count(*) FILTER (resolved < refs) AS incomplete FROM m FULL JOIN done USING (bundle_id)""")
def metric_corpus(spark, sf_dir):
    done = metrics.provenance_completeness(*tables(spark, sf_dir, "snapshots", "entities", "relationships", "provenance"))
    return metrics.corpus(metrics.evidence_ratios(_ledger(spark, sf_dir)), done)


LAYER = """, e AS (SELECT * FROM relationships r WHERE rel_type IN ('TRACK_USES_CHANNEL', 'CHANNEL_SENDS_TO', 'CHANNEL_ROUTES_TO', 'CHANNEL_PROCESSED_BY', 'SUMS_TO') AND EXISTS (SELECT 1 FROM entities x WHERE x.bundle_id = r.bundle_id AND x.id = r.source) AND EXISTS (SELECT 1 FROM entities x WHERE x.bundle_id = r.bundle_id AND x.id = r.target)),
touched AS (SELECT bundle_id, source AS id FROM e UNION SELECT bundle_id, target FROM e),
n AS (SELECT * FROM entities x WHERE entity_type IN ('CHANNEL', 'ROUTING_ENDPOINT') OR EXISTS (SELECT 1 FROM touched t WHERE t.bundle_id = x.bundle_id AND t.id = x.id))"""


def _signal_flow(spark, sf_dir):
    entities, relationships = tables(spark, sf_dir, "entities", "relationships")
    edges = graph.layer_edges(entities, relationships, "signal_flow")
    return graph.layer_nodes(entities, edges, "signal_flow"), edges


@query(with_clause("entities", "relationships") + LAYER + """, a AS (SELECT bundle_id, count(*) AS nodes FROM n GROUP BY 1), b AS (SELECT bundle_id, count(*) AS edges FROM e GROUP BY 1)
SELECT bundle_id, nodes, coalesce(edges, 0) AS edges, round_even(CASE WHEN nodes > 1 THEN coalesce(edges, 0) / (nodes * (nodes - 1)) ELSE 0 END, 5)::DOUBLE AS density FROM a LEFT JOIN b USING (bundle_id)""")
def graph_summary(spark, sf_dir):
    return graph.summary(*_signal_flow(spark, sf_dir))


@query(with_clause("entities", "relationships", "provenance") + LAYER + """
SELECT n.bundle_id, entity_type, coalesce(lower(p.evidence), 'observed') AS observability, count(*) AS n FROM n LEFT JOIN provenance p ON n.bundle_id = p.bundle_id AND n.star = p.id GROUP BY ALL""")
def graph_observability(spark, sf_dir):
    nodes, _ = _signal_flow(spark, sf_dir)
    return graph.observability(nodes, *tables(spark, sf_dir, "provenance")).groupBy("bundle_id", "entity_type", "observability").agg(F.count(F.lit(1)).alias("n"))


@query(with_clause("relationships").replace("WITH ", "WITH RECURSIVE ", 1) + """, h AS (SELECT DISTINCT bundle_id, source, target FROM relationships WHERE rel_type IN ('CHANNEL_SENDS_TO', 'CHANNEL_ROUTES_TO', 'SUMS_TO')),
back AS (SELECT bundle_id, source AS n FROM h INTERSECT SELECT bundle_id, target FROM h),
k AS (SELECT h.* FROM h JOIN back x ON h.bundle_id = x.bundle_id AND h.source = x.n JOIN back y ON h.bundle_id = y.bundle_id AND h.target = y.n),
w AS (SELECT bundle_id, source AS root, target AS tip, [source] AS path FROM k WHERE target >= source
  UNION ALL SELECT w.bundle_id, root, k.target, list_append(path, tip) FROM w JOIN k ON w.bundle_id = k.bundle_id AND w.tip = k.source WHERE tip <> root AND NOT list_contains(path, tip) AND k.target >= root AND len(path) < 4)
SELECT bundle_id, array_to_string(path, '>') AS path FROM w WHERE tip = root""")
def graph_cycles(spark, sf_dir):
    (relationships,) = tables(spark, sf_dir, "relationships")
    found = graph.cycles(graph.hops(relationships), most=1_000_000)
    return found.select("bundle_id", F.array_join("path", ">").alias("path"))


@query(with_clause("relationships") + " SELECT bundle_id, source AS channel, array_to_string(list(target ORDER BY idx, target), '>') AS chain FROM relationships WHERE rel_type = 'CHANNEL_PROCESSED_BY' GROUP BY ALL")
def graph_chains(spark, sf_dir):
    return graph.chains(*tables(spark, sf_dir, "relationships")).withColumn("chain", F.array_join("chain", ">"))


@query(with_clause("relationships") + " SELECT * FROM (SELECT bundle_id, lag(target) OVER (PARTITION BY bundle_id, source ORDER BY idx, target) AS source, target FROM relationships WHERE rel_type = 'CHANNEL_PROCESSED_BY') WHERE source IS NOT NULL")
def graph_precedes(spark, sf_dir):
    return graph.precedes(*tables(spark, sf_dir, "relationships"))


@query(with_clause("entities", "relationships") + """, g AS (SELECT bundle_id, id FROM entities WHERE role = 'submix'),
u AS (SELECT bundle_id, source AS id, min_by(target, id) AS channel FROM relationships WHERE rel_type = 'TRACK_USES_CHANNEL' GROUP BY ALL),
i AS (SELECT g.bundle_id, g.id AS group_id, count(DISTINCT r.source) AS routes_in FROM g JOIN u ON g.bundle_id = u.bundle_id AND g.id = u.id JOIN relationships r ON r.bundle_id = g.bundle_id AND r.target = u.channel AND r.rel_type IN ('CHANNEL_SENDS_TO', 'CHANNEL_ROUTES_TO') GROUP BY ALL)
SELECT g.bundle_id, g.id AS group_id, u.channel, coalesce(i.routes_in, 0)::INTEGER AS routes_in, (coalesce(i.routes_in, 0) > 0)::INTEGER AS concept_count FROM g LEFT JOIN u ON g.bundle_id = u.bundle_id AND g.id = u.id LEFT JOIN i ON g.bundle_id = i.bundle_id AND g.id = i.group_id""")
def graph_groups(spark, sf_dir):
    entities, relationships = tables(spark, sf_dir, "entities", "relationships")
    out = graph.decompose(graph.groups(entities, relationships), relationships)
    return out.select("bundle_id", "group_id", "channel", F.size("routes_in").alias("routes_in"), "concept_count")


STRIPS = """, used AS (SELECT bundle_id, source AS id, max_by(target, id) AS channel FROM relationships WHERE rel_type = 'TRACK_USES_CHANNEL' GROUP BY ALL),
base AS (SELECT e.bundle_id, e.id, e.name, e.entity_type AS primary_type, e.role, u.channel FROM entities e LEFT JOIN used u ON e.bundle_id = u.bundle_id AND e.id = u.id WHERE entity_type = 'TRACK'
  UNION ALL SELECT bundle_id, id, name, entity_type, role, id FROM entities e WHERE entity_type = 'CHANNEL' AND NOT EXISTS (SELECT 1 FROM relationships r WHERE r.rel_type = 'TRACK_USES_CHANNEL' AND r.bundle_id = e.bundle_id AND r.target = e.id)),
sends AS (SELECT DISTINCT bundle_id, source, target FROM relationships WHERE rel_type = 'CHANNEL_SENDS_TO'),
mains AS (SELECT DISTINCT r.bundle_id, r.source FROM relationships r JOIN entities e ON r.bundle_id = e.bundle_id AND r.target = e.id WHERE e.role = 'main_output' AND r.rel_type IN ('CHANNEL_SENDS_TO', 'CHANNEL_ROUTES_TO')),
fams AS (SELECT r.bundle_id, r.source AS channel, list_sort(list(DISTINCT CASE WHEN lower(e.family) IN ('ambience', 'reverb', 'delay', 'echo') THEN 'reverb' ELSE lower(e.family) END)) AS buckets FROM relationships r JOIN entities e ON r.bundle_id = e.bundle_id AND r.target = e.id WHERE r.rel_type = 'CHANNEL_PROCESSED_BY' GROUP BY ALL),
marked AS (SELECT b.bundle_id, b.id, b.name, b.primary_type, b.role, b.channel IS NOT NULL AS has_channel, coalesce(f.buckets, []) AS buckets,
  EXISTS (SELECT 1 FROM sends s WHERE s.bundle_id = b.bundle_id AND s.target = b.channel) AS receives, EXISTS (SELECT 1 FROM sends s WHERE s.bundle_id = b.bundle_id AND s.source = b.channel) AS sends, EXISTS (SELECT 1 FROM mains s WHERE s.bundle_id = b.bundle_id AND s.source = b.channel) AS routes_main
  FROM base b LEFT JOIN fams f ON b.bundle_id = f.bundle_id AND b.channel = f.channel),
strips AS (SELECT *, role IS NOT DISTINCT FROM 'effect_return' OR NOT (receives AND list_contains(buckets, 'reverb') AND role IS DISTINCT FROM 'main_output') AS declared,
  CASE WHEN role = 'effect_return' OR NOT declared THEN 'effect_return' WHEN role IN ('main_output', 'submix') THEN role WHEN role LIKE '%_source' THEN 'audio_source' WHEN primary_type = 'TRACK' THEN 'track' ELSE 'channel' END AS concept
  FROM marked)"""


def _strips(spark, sf_dir):
    return align.strips(*tables(spark, sf_dir, "entities", "relationships"))


@query(with_clause("entities", "relationships") + STRIPS + " SELECT bundle_id, id, primary_type, has_channel, receives, sends, routes_main, concept, array_to_string(buckets, ',') AS buckets FROM strips")
def align_strips(spark, sf_dir):
    return _strips(spark, sf_dir).select("bundle_id", "id", "primary_type", "has_channel", "receives", "sends", "routes_main", "concept", F.array_join("buckets", ",").alias("buckets"))


TOKENS = r"list_filter(string_split_regex(lower(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[^\w#+]+|_+'), lambda t: t <> '')"
GENERIC = "[" + ", ".join(f"'{g}'" for g in names.GENERIC) + "]"
IDENTITY = f", tok AS (SELECT *, {TOKENS.format('name')} AS w FROM strips), own AS (SELECT *, list_distinct(list_filter(w, lambda t: NOT list_contains({GENERIC}, t))) AS own FROM tok), idn AS (SELECT * EXCLUDE (w, own), CASE WHEN len(own) > 0 THEN own ELSE list_distinct(w) END AS i FROM own)"


@query(with_clause("entities", "relationships") + STRIPS + IDENTITY + """,
pairs AS (SELECT c_custkey AS pair_id, c_custkey AS a, c_custkey + 1 AS b FROM customer WHERE c_custkey % 2 = 0),
both_ AS (SELECT p.pair_id, a.id AS source_id, b.id AS target_id, a.concept = b.concept AS same, CASE WHEN len(a.i) <= len(b.i) THEN a.i ELSE b.i END AS s, CASE WHEN len(a.i) <= len(b.i) THEN b.i ELSE a.i END AS g,
  (CASE WHEN a.concept = b.concept AND a.declared AND b.declared THEN 0.45 WHEN a.concept = b.concept THEN 0.4 ELSE 0 END)::DOUBLE AS c1, ((a.has_channel AND b.has_channel) OR a.primary_type = b.primary_type) AS c3, a.receives AND b.receives AS c4, a.sends AND b.sends AS c5, a.routes_main AND b.routes_main AS c6, list_has_any(a.buckets, b.buckets) AS c7
  FROM pairs p JOIN idn a ON a.bundle_id = p.a JOIN idn b ON b.bundle_id = p.b),
conf AS (SELECT *, CASE WHEN len(s) = 0 OR len(g) = 0 THEN 0 ELSE len(list_filter(s, lambda x: list_contains(g, x) OR list_contains(g, x || 's') OR (x LIKE '%s' AND list_contains(g, x[:-2])))) / len(s) END AS name FROM both_),
sc AS (SELECT *, least(1.0, round(c1 + 0.3 * name + 0.1 * c3::INT + 0.1 * c4::INT + 0.05 * c5::INT + 0.1 * c6::INT + 0.15 * c7::INT, 9)) AS score, same::INT + (name >= 0.5)::INT + c3::INT + c4::INT + c5::INT + c6::INT + c7::INT AS reasons FROM conf),
rk AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS nxt FROM sc WINDOW w AS (PARTITION BY pair_id, source_id ORDER BY score DESC, target_id)),
st AS (SELECT *, CASE WHEN score < 0.55 THEN 'UNMATCHED' WHEN nxt >= 0.55 AND round(score - nxt, 9) < 0.05 THEN 'CONFLICTING' WHEN score >= 0.8 AND reasons >= 3 THEN 'PROBABLE' ELSE 'POSSIBLE' END AS status FROM rk WHERE n = 1)
SELECT p.pair_id, i.id AS source_id, CASE WHEN status <> 'UNMATCHED' THEN target_id END AS target_id, coalesce(status, 'UNMATCHED') AS status, round_even(score, 3)::DOUBLE AS confidence FROM pairs p JOIN idn i ON i.bundle_id = p.a LEFT JOIN st ON st.pair_id = p.pair_id AND st.source_id = i.id""")
def align_pairs(spark, sf_dir):
    pairs = tables(spark, sf_dir, "customer")[0].where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("pair_id"), F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"))
    return align.align(pairs, _strips(spark, sf_dir)).select("pair_id", "source_id", "target_id", "status", "confidence")


def _states(lines):
    """Two states of each snapshot: the lines shipped before a date, and all of them with changed values."""
    base = lines.select(F.col("bundle_id").alias("pair_id"), F.concat(F.lit("v"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("line_uid").cast("string")).alias("id"), F.lit("PARAMETER").alias("entity_type"),
                        F.when(F.col("l_partkey") % 3 == 0, "Wet Mix").when(F.col("l_partkey") % 3 == 1, "Delay Feedback").otherwise("Width").alias("name"), F.col("l_quantity").alias("value"), F.col("l_discount").alias("normalized"), "l_shipdate", "l_tax")
    signed = lambda df: df.withColumn("signature", F.concat_ws("|", "name", F.col("value").cast("bigint").cast("string")))
    before = signed(base.where("l_shipdate < timestamp'1998-07-01'"))
    return before, signed(base.withColumn("value", F.when(F.col("l_tax") >= 0.07, F.col("value") + 1).otherwise(F.col("value"))))


@query(with_clause("lines") + """
SELECT bundle_id AS pair_id, CASE WHEN l_shipdate < TIMESTAMP '1998-07-01' THEN 'changed' ELSE 'added' END AS change, 'PARAMETER' AS entity_type, 'v' || l_orderkey || '-' || line_uid AS id FROM lines WHERE l_shipdate >= TIMESTAMP '1998-07-01' OR l_tax >= 0.07""")
def delta_entities(spark, sf_dir):
    return delta.entity_changes(*_states(*tables(spark, sf_dir, "lines")))


@query(with_clause("lines") + """
SELECT bundle_id AS pair_id, 'v' || l_orderkey || '-' || line_uid AS id, CASE l_partkey % 3 WHEN 0 THEN 'Wet Mix' WHEN 1 THEN 'Delay Feedback' ELSE 'Width' END AS name, CASE l_partkey % 3 WHEN 0 THEN 'WET_DRY' WHEN 1 THEN 'FEEDBACK' END AS role, l_quantity AS old, l_quantity + 1 AS new
FROM lines WHERE l_shipdate < TIMESTAMP '1998-07-01' AND l_tax >= 0.07""")
def delta_parameters(spark, sf_dir):
    return delta.parameter_changes(*_states(*tables(spark, sf_dir, "lines")))


@query(with_clause("relationships") + """, b AS (SELECT DISTINCT bundle_id, rel_type, source, target FROM relationships WHERE rel_type = 'CHANNEL_SENDS_TO' AND id LIKE 's%'), a AS (SELECT DISTINCT bundle_id, rel_type, source, target FROM relationships WHERE rel_type IN ('CHANNEL_SENDS_TO', 'CHANNEL_ROUTES_TO'))
SELECT bundle_id AS pair_id, 'added' AS change, rel_type, source, target FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def delta_relationships(spark, sf_dir):
    rel = tables(spark, sf_dir, "relationships")[0].withColumnRenamed("bundle_id", "pair_id")
    return delta.relationship_changes(rel.where("rel_type = 'CHANNEL_SENDS_TO' and id like 's%'"), rel.where("rel_type in ('CHANNEL_SENDS_TO', 'CHANNEL_ROUTES_TO')"))


@query(with_clause("relationships") + """
SELECT bundle_id, k.target AS id, min_by(k.source, k.id) AS processor, min_by(p.source, p.id) AS channel FROM relationships k LEFT JOIN relationships p USING (bundle_id) WHERE k.rel_type = 'CONTAINS' AND p.rel_type = 'CHANNEL_PROCESSED_BY' AND p.target = k.source GROUP BY ALL""")
def delta_parameter_owners(spark, sf_dir):
    return delta.parameter_owners(*tables(spark, sf_dir, "relationships"))


@query("""
WITH s AS (SELECT user_id AS pair_id, sqrt(avg(value * value) FILTER (event_id % 2 = 0)) AS r0, sqrt(avg(value * value) FILTER (event_id % 2 = 1)) AS r1, max(abs(value)) FILTER (event_id % 2 = 0) AS p0, max(abs(value)) FILTER (event_id % 2 = 1) AS p1 FROM events GROUP BY 1),
l AS (SELECT pair_id, 'rms' AS measure, r0 AS old, r1 AS new FROM s UNION ALL SELECT pair_id, 'peak', p0, p1 FROM s), d AS (SELECT *, CASE WHEN old > 0 AND new > 0 THEN 20 * log10(new / old) END AS delta FROM l)
SELECT pair_id, measure, round(old, 6) AS old, round(new, 6) AS new, round(delta, 6) AS delta, CASE WHEN delta IS NULL THEN 'unavailable' WHEN delta >= 0.5 THEN 'up' WHEN delta <= -0.5 THEN 'down' ELSE 'same' END AS direction FROM d""")
def delta_acoustic(spark, sf_dir):
    events = tables(spark, sf_dir, "events")[0]
    side = lambda k: events.where(F.col("event_id") % 2 == k).groupBy(F.col("user_id").alias("pair_id")).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.max(F.abs("value")).alias("peak"))
    out = delta.acoustic_delta(side(0), side(1)).drop("unit")
    return out.withColumns({c: F.round(c, 6) for c in ("old", "new", "delta")})


def _variants(spark, sf_dir):
    rows = tables(spark, sf_dir, "conversations")[0].where("turn is not null")
    sid = lambda turn: F.concat(F.lit("s"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    parent = F.when((F.col("turn") > 0) & (F.col("conv_id") % 3 > 0), sid(F.col("turn") - 1))
    return rows.select(sid(F.col("turn")).alias("snapshot_id"), F.when(F.col("conv_id") % 7 > 0, F.concat(F.lit("f"), (F.col("conv_id") / 2).cast("bigint").cast("string"))).alias("family"), F.when(F.col("conv_id") % 2 == 0, F.col("turn")).alias("ordinal"), parent.alias("parent"))


VARIANTS = """WITH v AS (SELECT 's' || conv_id || '-' || turn AS snapshot_id, CASE WHEN conv_id % 7 > 0 THEN 'f' || (conv_id // 2) END AS family, CASE WHEN conv_id % 2 = 0 THEN turn END AS ordinal, CASE WHEN turn > 0 AND conv_id % 3 > 0 THEN 's' || conv_id || '-' || (turn - 1) END AS parent, CASE WHEN conv_id % 3 > 0 THEN turn ELSE 0 END AS depth FROM conversations),
m AS (SELECT snapshot_id, coalesce(family, '__ungrouped__:' || snapshot_id) AS family_key, coalesce(ordinal, depth) AS ordinal, parent FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY family_key ORDER BY ordinal, snapshot_id) AS position FROM m)"""


@query(VARIANTS + " SELECT snapshot_id, family_key, ordinal, position::INTEGER AS position FROM r")
def lineage_members(spark, sf_dir):
    return lineage.members(_variants(spark, sf_dir)).select("snapshot_id", "family_key", "ordinal", "position")


@query(VARIANTS + """, named AS (SELECT c.family_key, c.parent AS source, c.snapshot_id AS target FROM r c JOIN r p ON p.family_key = c.family_key AND p.snapshot_id = c.parent),
before AS (SELECT family_key, lag(snapshot_id) OVER w AS source, snapshot_id AS target, ordinal, lag(ordinal) OVER w AS o FROM r WHERE family_key NOT IN (SELECT family_key FROM named) WINDOW w AS (PARTITION BY family_key ORDER BY position))
SELECT * FROM named UNION ALL SELECT family_key, source, target FROM before WHERE source IS NOT NULL AND ordinal > o""")
def lineage_derived(spark, sf_dir):
    return lineage.derived_from(lineage.members(_variants(spark, sf_dir)))


@query(VARIANTS + " SELECT a.family_key, a.snapshot_id AS source, b.snapshot_id AS target FROM r a JOIN r b ON a.family_key = b.family_key AND a.ordinal = b.ordinal AND a.position < b.position")
def lineage_alternatives(spark, sf_dir):
    return lineage.alternatives(lineage.members(_variants(spark, sf_dir)))


@query("SELECT lang AS family_key, sha256(text) AS path, count(DISTINCT source) AS members, min(source) AS first_member FROM documents WHERE text IS NOT NULL GROUP BY ALL HAVING count(DISTINCT source) > 1")
def lineage_shared_sources(spark, sf_dir):
    docs = tables(spark, sf_dir, "documents")[0].where("text is not null")
    return lineage.shared_sources(docs.select(F.col("lang").alias("family_key"), F.col("source").alias("snapshot_id"), F.sha2("text", 256).alias("path")))


@query(f"SELECT p_partkey, array_to_string({TOKENS.format('p_name || p_type')}, ' ') AS tokens FROM part")
def name_tokens(spark, sf_dir):
    part = tables(spark, sf_dir, "part")[0]
    return part.select("p_partkey", F.array_join(names.tokens(F.concat("p_name", "p_type")), " ").alias("tokens"))


@query("SELECT page_id, trim(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages")
def name_slugs(spark, sf_dir):
    return tables(spark, sf_dir, "pages")[0].select("page_id", names.slug(F.col("url")).alias("slug"))


@query("SELECT page_id, 'asset:sha256:' || substr(sha256(url), 1, 12) AS asset, sha256(regexp_replace(html, '/home/[^/\\s\"]+', '<redacted>', 'g')) AS html_sha256 FROM pages")
def sanitize_pages(spark, sf_dir):
    pages = tables(spark, sf_dir, "pages")[0]
    return pages.select("page_id", sanitize.hash_asset(F.col("url")).alias("asset"), F.sha2(F.regexp_replace("html", r'/home/[^/\s"]+', sanitize.REDACTED), 256).alias("html_sha256"))


# what a session calls the roles of a snapshot's tracks
SESSION_ROLES = "CASE role WHEN 'vocal_source' THEN 'Vocal' WHEN 'submix' THEN 'Bus' ELSE role END"


@query(with_clause("entities", "relationships") + f""", s AS (SELECT * REPLACE ({SESSION_ROLES} AS role) FROM entities),
e AS (SELECT bundle_id, count(*) FILTER (entity_type = 'TRACK') AS n_tracks,
  count(*) FILTER (entity_type = 'TRACK' AND role = 'Vocal') AS n_vocal_tracks, count(*) FILTER (entity_type = 'TRACK' AND role = 'Drums') AS n_drum_tracks,
  count(*) FILTER (entity_type = 'TRACK' AND role = 'Bass') AS n_bass_tracks, count(*) FILTER (entity_type = 'TRACK' AND role = 'Guitar') AS n_guitar_tracks,
  count(*) FILTER (entity_type = 'TRACK' AND role = 'Keys') AS n_keys_tracks, count(*) FILTER (entity_type = 'TRACK' AND role = 'Bus') AS n_bus_tracks,
  count(*) FILTER (entity_type = 'PROCESSOR') AS n_fx, count(*) FILTER (entity_type = 'PROCESSOR' AND family = 'Ambience') AS n_ambience_fx,
  count(*) FILTER (entity_type = 'PROCESSOR' AND family = 'Dynamics') AS n_dynamics_fx, count(*) FILTER (entity_type = 'PROCESSOR' AND family = 'EQ') AS n_eq_fx
  FROM s GROUP BY 1),
r AS (SELECT bundle_id, count(*) FILTER (rel_type IN ('CHANNEL_SENDS_TO', 'CHANNEL_ROUTES_TO')) AS n_routes FROM relationships GROUP BY 1)
SELECT e.*, coalesce(n_routes, 0) AS n_routes, round_even(CASE WHEN n_tracks > 0 THEN n_fx / n_tracks ELSE 0 END, 3)::DOUBLE AS avg_fx_per_track FROM e LEFT JOIN r USING (bundle_id)""")
def fingerprints(spark, sf_dir):
    entities, relationships = tables(spark, sf_dir, "entities", "relationships")
    return similarity.fingerprint(entities.withColumn("role", F.expr(SESSION_ROLES)), relationships)


def _predictions(spark, sf_dir):
    docs, labels = tables(spark, sf_dir, "documents", "labels")
    low = docs.select("doc_id", F.when(F.col("n_chars") < 300, 0).otherwise(1).alias("predicted"), F.when(F.col("n_chars") % 3 == 0, 0.75).otherwise(0.85).alias("confidence"))
    return labels.join(low, "doc_id").select(F.col("quality").alias("expected"), "predicted", "confidence", F.lit(1).cast("bigint").alias("count"))


PREDICTED = "WITH p AS (SELECT quality AS expected, CASE WHEN n_chars < 300 THEN 0 ELSE 1 END AS predicted, CASE WHEN n_chars % 3 = 0 THEN 0.75 ELSE 0.85 END::DOUBLE AS confidence FROM labels JOIN documents USING (doc_id))"


@query(PREDICTED + """, c AS (SELECT k AS label, count(*) FILTER (expected = k AND predicted = k) AS tp, count(*) FILTER (expected <> k AND predicted = k) AS fp, count(*) FILTER (expected = k AND predicted <> k) AS fn FROM p, (SELECT 0 AS k UNION ALL SELECT 1) GROUP BY 1)
SELECT label, tp, fp, fn, tp + fn AS support, round(coalesce(tp / nullif(tp + fp, 0), 0), 6)::DOUBLE AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6)::DOUBLE AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6)::DOUBLE AS f1 FROM c""")
def evaluation_by_class(spark, sf_dir):
    return evaluate.by_class(_predictions(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(PREDICTED + " SELECT confidence AS bucket, count(*) AS n, count(*) FILTER (expected = predicted) AS correct, round(count(*) FILTER (expected = predicted) / count(*), 6) AS accuracy FROM p GROUP BY 1")
def evaluation_reliability(spark, sf_dir):
    out = evaluate.reliability(_predictions(spark, sf_dir))
    return out.withColumn("accuracy", F.round("accuracy", 6))


@query(PREDICTED + " SELECT expected, predicted, count(*) AS n FROM p WHERE expected <> predicted GROUP BY ALL ORDER BY n DESC, expected, predicted LIMIT 12")
def evaluation_confusions(spark, sf_dir):
    return evaluate.confusions(_predictions(spark, sf_dir))


def _samples(spark, sf_dir):
    return tables(spark, sf_dir, "events")[0].select(F.col("user_id").alias("audio_id"), F.lit(0).alias("channel"), F.col("event_id").alias("i"), "value")


SAMPLES = "WITH s AS (SELECT user_id AS audio_id, event_id AS i, value - avg(value) OVER (PARTITION BY user_id) AS x, value FROM events)"


@query(SAMPLES + " SELECT audio_id, round(max(abs(value)), 6) AS peak, round(sqrt(avg(x * x)), 6) AS rms, round(CASE WHEN sqrt(avg(x * x)) > 0 AND max(abs(value)) > 0 THEN 20 * log10(max(abs(value)) / sqrt(avg(x * x))) END, 6) AS crest_db FROM s GROUP BY 1")
def signal_levels(spark, sf_dir):
    return signal.levels(_samples(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("peak", "rms", "crest_db")})


@query(SAMPLES + ", z AS (SELECT audio_id, (x < 0) <> (lag(x) OVER (PARTITION BY audio_id ORDER BY i) < 0) AS crossed FROM s) SELECT audio_id, count(*) AS samples, count(*) FILTER (crossed) AS crossings FROM z GROUP BY 1")
def signal_zero_crossings(spark, sf_dir):
    return signal.zero_crossings(_samples(spark, sf_dir))


@query("""WITH m AS (SELECT event_type AS mix_id, user_id AS i, sum(value) AS s FROM events GROUP BY ALL), x AS (SELECT event_type AS mix_id, user_id AS i, max(value) AS m FROM events GROUP BY ALL)
SELECT mix_id, count(*) AS n, round(sum(s * m) / sum(s * s), 6) AS gain, round(corr(s, m), 6) AS correlation FROM m JOIN x USING (mix_id, i) GROUP BY 1""")
def signal_reconcile(spark, sf_dir):
    events = tables(spark, sf_dir, "events")[0]
    stems = events.select(F.col("event_type").alias("mix_id"), F.col("event_id").alias("audio_id"), F.col("user_id").alias("i"), "value")
    out = signal.reconcile(stems, stems.groupBy("mix_id", "i").agg(F.max("value").alias("value")))
    return out.select("mix_id", "n", F.round("gain", 6).alias("gain"), F.round("correlation", 6).alias("correlation"))


@query(with_clause("entities", "relationships") + """,
x AS (SELECT r.bundle_id, r.source AS channel, e.family, lower(e.name) AS name FROM relationships r
  JOIN entities e ON r.bundle_id = e.bundle_id AND r.target = e.id WHERE r.rel_type = 'CHANNEL_PROCESSED_BY' AND e.entity_type = 'PROCESSOR'),
feeds AS (SELECT DISTINCT bundle_id, source, target FROM relationships WHERE rel_type IN ('CHANNEL_SENDS_TO', 'CHANNEL_ROUTES_TO')),
used AS (SELECT t.bundle_id, t.id, t.role, u.target AS channel FROM entities t
  JOIN relationships u ON u.rel_type = 'TRACK_USES_CHANNEL' AND u.bundle_id = t.bundle_id AND u.source = t.id WHERE t.entity_type = 'TRACK'),
shared AS (SELECT bundle_id, id FROM entities WHERE role IN ('effect_return', 'main_output')),
carriers AS (SELECT DISTINCT x.bundle_id, x.channel FROM x
  LEFT JOIN shared s ON s.bundle_id = x.bundle_id AND s.id = x.channel
  LEFT JOIN feeds f ON f.bundle_id = x.bundle_id AND f.source = x.channel
  WHERE x.family = 'Ambience' AND s.id IS NULL AND f.source IS NULL),
buses AS (SELECT bundle_id, id AS channel FROM entities WHERE role = 'effect_return' UNION SELECT bundle_id, channel FROM used WHERE role = 'submix'),
vocals AS (SELECT u.bundle_id, u.id, bool_or(x.name LIKE '%de-esser%' OR x.name LIKE '%deesser%' OR x.name LIKE '%de esser%' OR x.name LIKE '%sibilance%') AS has
  FROM used u JOIN x ON x.bundle_id = u.bundle_id AND x.channel = u.channel WHERE u.role = 'vocal_source' GROUP BY ALL),
faders AS (SELECT o_custkey AS bundle_id, 't' || CAST(o_orderkey AS STRING) AS id, CAST(o_orderkey % 17 AS DOUBLE) - 10 AS volume_db FROM orders)
SELECT bundle_id, 'suggestion' AS severity, 0.7::DOUBLE AS confidence, count(*)::VARCHAR AS subject, 'core.shared_ambience' AS rule_id FROM carriers GROUP BY 1 HAVING count(*) >= 2
UNION ALL SELECT DISTINCT b.bundle_id, 'info', 0.8, b.channel, 'core.unused_returns' FROM buses b JOIN x ON x.bundle_id = b.bundle_id AND x.channel = b.channel
  LEFT JOIN feeds f ON f.bundle_id = b.bundle_id AND f.target = b.channel WHERE f.target IS NULL
UNION ALL SELECT bundle_id, 'suggestion', 0.55, id, 'core.vocal_corrective_chain' FROM vocals WHERE NOT coalesce(has, false)
UNION ALL SELECT bundle_id, 'info', 0.6, source, 'core.dense_chain' FROM relationships WHERE rel_type = 'CHANNEL_PROCESSED_BY' GROUP BY bundle_id, source HAVING count(*) > 6
UNION ALL SELECT bundle_id, 'suggestion', 0.5, min(id) FILTER (volume_db = top), 'core.level_imbalance'
  FROM (SELECT *, max(volume_db) OVER (PARTITION BY bundle_id) AS top FROM faders) GROUP BY bundle_id HAVING max(volume_db) - min(volume_db) > 12
UNION ALL SELECT DISTINCT m.bundle_id, 'info', 0.6, m.id, 'core.master_limiter_context' FROM entities m JOIN x ON x.bundle_id = m.bundle_id AND x.channel = m.id
  WHERE m.role = 'main_output' AND (x.name LIKE '%limiter%' OR x.name LIKE '%maximizer%' OR x.name LIKE '%brickwall%') AND m.bundle_id % 3 <> 0""")
def rule_findings(spark, sf_dir):
    entities, relationships, orders, customer = tables(spark, sf_dir, "entities", "relationships", "orders", "customer")
    # the driver's tables hold no faders; levels follow the order keys, every third customer has a loudness measured
    faders = orders.selectExpr("o_custkey AS bundle_id", "'t' || CAST(o_orderkey AS STRING) AS id", "CAST(o_orderkey % 17 AS DOUBLE) - 10 AS volume_db")
    loudness = customer.where("c_custkey % 3 = 0").selectExpr("c_custkey AS bundle_id")
    found = rules.run(rules.DEFAULT + rules.MIXER, {"entities": entities, "relationships": relationships, "faders": faders, "loudness": loudness})
    return found.select("bundle_id", "severity", "confidence", "subject", "rule_id")


@query("""WITH v(role, priority, keyword) AS (VALUES ('Bolt', 1, 'cold bolt'), ('Bolt', 2, 'bolts'), ('Plate', 3, 'plate'), ('Heat', 4, 'hot')),
h AS (SELECT p_partkey, role, keyword, row_number() OVER (PARTITION BY p_partkey ORDER BY priority) AS n FROM part, v WHERE (' ' || p_name || ' ') LIKE '% ' || keyword || ' %' OR (keyword = 'bolts' AND (' ' || p_name || ' ') LIKE '% bolt %'))
SELECT p.p_partkey, coalesce(role, 'Unknown') AS role, keyword, CASE WHEN role IS NULL THEN 0.2 WHEN keyword = 'cold bolt' THEN 0.85 ELSE 0.75 END::DOUBLE AS confidence FROM part p LEFT JOIN h ON p.p_partkey = h.p_partkey AND h.n = 1""")
def role_keywords(spark, sf_dir):
    vocabulary = spark.createDataFrame([("Bolt", 1, "cold bolt"), ("Bolt", 2, "bolts"), ("Plate", 3, "plate"), ("Heat", 4, "hot")], "role string, priority int, keyword string")
    return roles.keyword_roles(tables(spark, sf_dir, "part")[0].select("p_partkey", "p_name"), vocabulary, "p_name").drop("p_name")


@query(with_clause("entities") + " SELECT bundle_id, id, 'base ' || CAST(value AS DOUBLE) AS effective FROM entities WHERE entity_type = 'PARAMETER'")
def parameter_influence(spark, sf_dir):
    return influence.influence(*tables(spark, sf_dir, "entities", "relationships")).select("bundle_id", "id", "effective")


@query(with_clause("entities", "relationships") + """,
edges AS (SELECT t.bundle_id, 'prov:hadMember' AS relation FROM entities t JOIN entities p ON t.bundle_id = p.bundle_id WHERE t.entity_type = 'TRACK' AND p.entity_type = 'PROJECT'
  UNION ALL SELECT bundle_id, CASE rel_type WHEN 'CHANNEL_PROCESSED_BY' THEN 'prov:hadMember' ELSE 'prov:wasInfluencedBy' END FROM relationships WHERE rel_type IN ('CHANNEL_PROCESSED_BY', 'CHANNEL_SENDS_TO', 'CHANNEL_ROUTES_TO'))
SELECT bundle_id, relation, count(*) AS n FROM edges GROUP BY ALL""")
def prov_relations(spark, sf_dir):
    edges = provview.session_edges(*tables(spark, sf_dir, "entities", "relationships"))
    return provview.relations(edges).groupBy("bundle_id", "relation").agg(F.count(F.lit(1)).alias("n"))


@query(with_clause("entities", "provenance", "snapshots") + """
SELECT e.bundle_id, e.id, CASE coalesce(p.evidence, 'DERIVED') WHEN 'INFERRED' THEN 'analyzer' WHEN 'DERIVED' THEN 'analyzer' WHEN 'HIDDEN' THEN 'analyzer' WHEN 'ANNOTATED' THEN 'user' ELSE 'tool:' || s.daw END AS agent, lower(coalesce(p.evidence, 'DERIVED')) AS observability FROM entities e LEFT JOIN provenance p ON e.bundle_id = p.bundle_id AND e.star = p.id JOIN snapshots s ON e.bundle_id = s.bundle_id""")
def prov_attributions(spark, sf_dir):
    return provview.attributions(*tables(spark, sf_dir, "entities", "provenance", "snapshots"))


def _sessions(spark, sf_dir):
    """Nested sessions, one a customer: orders as tracks, line items as processors."""
    lines, orders = tables(spark, sf_dir, "lines", "orders")
    key = lambda c: F.col(c).cast("string")
    parameter = F.array(F.struct(F.concat(F.lit("v"), key("l_orderkey"), F.lit("-"), key("line_uid")).alias("id"), F.lit("Level").alias("name"), F.col("l_quantity").alias("value")))
    p = F.struct("line_uid", F.concat(F.lit("x"), key("l_orderkey"), F.lit("-"), key("line_uid")).alias("id"), F.concat(F.lit("Part "), key("l_partkey")).alias("name"), F.col("l_returnflag").alias("family"), F.col("l_linestatus").alias("chain"), parameter.alias("parameters"))
    chains = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(p)).alias("processors"))
    oid = F.concat(F.lit("o"), key("o_orderkey"))
    kind = F.when(F.col("o_orderpriority") == "5-LOW", "return").when(F.col("o_orderstatus") == "F", "audio").when(F.col("o_orderstatus") == "O", "group").otherwise("inferred")
    role = F.when(F.col("o_orderpriority") == "1-URGENT", " Vocals").when(F.col("o_orderpriority") == "2-HIGH", "Percussion").when(F.col("o_orderpriority") == "3-MEDIUM", "FX").otherwise(F.col("o_orderpriority"))
    clip = F.array(F.struct(F.concat(F.lit("c"), key("o_orderkey")).alias("id"), F.lit("Clip").alias("name"), F.concat(F.lit("media/"), (F.col("o_orderkey") % 7).cast("string"), F.lit(".wav")).alias("path")))
    group = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("o"), (F.col("o_orderkey") - 1).cast("string")))
    rows = orders.join(chains, "o_orderkey", "left")
    none = F.array().cast(chains.schema["processors"].dataType)
    t = F.struct("o_orderkey", oid.alias("id"), F.concat(F.lit("Track "), key("o_orderkey")).alias("name"), kind.alias("kind"), role.alias("role"), group.alias("group_id"), F.coalesce("processors", none).alias("processors"), clip.alias("clips"))
    r = F.struct(oid.alias("source"), F.concat(F.lit("bus"), (F.col("o_orderkey") % 3).cast("string")).alias("target"), F.lit("send").alias("kind"))
    return rows.groupBy(F.col("o_custkey").alias("bundle_id")).agg(F.lit("demo").alias("dialect"), F.sort_array(F.collect_list(t)).alias("tracks"), F.sort_array(F.collect_list(r)).alias("routes"))


SESSIONS = """, t AS (SELECT o_custkey AS bundle_id, o_orderkey, 'demo:o' || o_orderkey AS id, CASE WHEN o_orderpriority = '5-LOW' THEN 'return' WHEN o_orderstatus = 'F' THEN 'audio' WHEN o_orderstatus = 'O' THEN 'group' ELSE 'inferred' END AS kind,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'vocal_source' WHEN '2-HIGH' THEN 'drum_source' WHEN '3-MEDIUM' THEN 'effect_source' ELSE trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g'), '_') END AS own FROM orders),
k AS (SELECT *, CASE WHEN kind = 'return' THEN id WHEN kind <> 'inferred' THEN id || ':channel' END AS channel, CASE kind WHEN 'return' THEN 'effect_return' WHEN 'group' THEN 'submix' ELSE own END AS role FROM t)"""


@query(with_clause("lines") + SESSIONS + """
SELECT DISTINCT bundle_id, 'demo:project' AS id, 'PROJECT' AS entity_type, NULL AS name, NULL AS role, NULL AS family, NULL::DOUBLE AS value FROM k
UNION ALL SELECT bundle_id, id, 'TRACK', 'Track ' || o_orderkey, role, NULL, NULL FROM k WHERE kind <> 'return'
UNION ALL SELECT bundle_id, channel, 'CHANNEL', 'Track ' || o_orderkey, CASE WHEN kind IN ('return', 'group') THEN role END, NULL, NULL FROM k WHERE channel IS NOT NULL
UNION ALL SELECT bundle_id, 'demo:x' || l_orderkey || '-' || line_uid, 'PROCESSOR', 'Part ' || l_partkey, NULL, l_returnflag, NULL FROM lines
UNION ALL SELECT bundle_id, 'demo:v' || l_orderkey || '-' || line_uid, 'PARAMETER', 'Level', NULL, NULL, l_quantity FROM lines
UNION ALL SELECT bundle_id, 'demo:c' || o_orderkey, 'TEMPORAL_OBJECT', 'Clip', NULL, NULL, NULL FROM k
UNION ALL SELECT DISTINCT bundle_id, 'asset:' || substr(sha256('media/' || (o_orderkey % 7) || '.wav'), 1, 12), 'MEDIA_ASSET', 'media/' || (o_orderkey % 7) || '.wav', NULL, NULL, NULL FROM k""")
def normalized_entities(spark, sf_dir):
    return normalize.entities(_sessions(spark, sf_dir))


@query(with_clause("lines") + SESSIONS + """, x AS (SELECT l.bundle_id, coalesce(k.channel, k.id) AS owner, 'demo:x' || l_orderkey || '-' || line_uid AS id, l_linestatus AS chain, line_uid - 1 AS idx, 'demo:v' || l_orderkey || '-' || line_uid AS v FROM lines l JOIN k ON k.o_orderkey = l.l_orderkey),
b AS (SELECT bundle_id, lag(id) OVER (PARTITION BY bundle_id, owner, chain ORDER BY idx) AS source, id AS target FROM x),
g AS (SELECT c.bundle_id, c.id, c.channel, c.kind, p.id AS g, p.kind AS g_kind FROM k c JOIN k p ON c.bundle_id = p.bundle_id AND c.o_orderkey % 2 = 0 AND p.o_orderkey = c.o_orderkey - 1)
SELECT bundle_id, 'TRACK_USES_CHANNEL' AS rel_type, id AS source, channel AS target, NULL::BIGINT AS idx FROM k WHERE kind NOT IN ('return', 'inferred')
UNION ALL SELECT bundle_id, 'CONTAINS', g, id, NULL FROM g
UNION ALL SELECT bundle_id, 'SUMS_TO', channel, g || ':channel', NULL FROM g WHERE g_kind = 'group' AND kind NOT IN ('return', 'inferred')
UNION ALL SELECT bundle_id, 'CHANNEL_PROCESSED_BY', owner, id, idx FROM x
UNION ALL SELECT bundle_id, 'PRECEDES', source, target, NULL FROM b WHERE source IS NOT NULL
UNION ALL SELECT bundle_id, 'CONTAINS', id, v, NULL FROM x
UNION ALL SELECT bundle_id, 'TRACK_CONTAINS_TEMPORAL_OBJECT', id, 'demo:c' || o_orderkey, NULL FROM k
UNION ALL SELECT bundle_id, 'REFERENCES_ASSET', 'demo:c' || o_orderkey, 'asset:' || substr(sha256('media/' || (o_orderkey % 7) || '.wav'), 1, 12), NULL FROM k
UNION ALL SELECT bundle_id, 'CHANNEL_SENDS_TO', coalesce(channel, id), 'endpoint:demo:bus' || (o_orderkey % 3), NULL FROM k""")
def normalized_relationships(spark, sf_dir):
    return normalize.relationships(_sessions(spark, sf_dir))


@query("""WITH r AS (SELECT user_id AS bundle_id, min(event_id) AS first, CASE event_type WHEN 'click' THEN 'OBSERVED' ELSE 'INFERRED' END AS evidence, event_type AS capture_method, 'ref' || (event_id % 5) AS source_ref, CASE WHEN event_type <> 'click' THEN (event_id % 2) / 2 END::DOUBLE AS confidence FROM events GROUP BY ALL)
SELECT *, 'prov:' || lpad((row_number() OVER (PARTITION BY bundle_id ORDER BY first))::VARCHAR, 4, '0') AS id FROM r""")
def normalized_provenance(spark, sf_dir):
    events = tables(spark, sf_dir, "events")[0]
    records = events.select(F.col("user_id").alias("bundle_id"), F.col("event_id").alias("ord"), F.when(F.col("event_type") == "click", "OBSERVED").otherwise("INFERRED").alias("evidence"), F.col("event_type").alias("capture_method"), F.concat(F.lit("ref"), (F.col("event_id") % 5).cast("string")).alias("source_ref"), ((F.col("event_id") % 2) / 2).alias("confidence"))
    return normalize.provenance_store(records)


@query(with_clause("entities", "provenance", "availability") + """
SELECT e.bundle_id, e.id, '*' AS field, 'provenance' AS source, coalesce(p.evidence, 'DANGLING REFERENCE') AS detail FROM entities e LEFT JOIN provenance p ON e.bundle_id = p.bundle_id AND e.star = p.id
UNION ALL SELECT bundle_id, id, field, 'availability', status FROM availability""")
def inspector_evidence(spark, sf_dir):
    entities, provenance, availability = tables(spark, sf_dir, "entities", "provenance", "availability")
    return access.evidence_rows(entities.select("bundle_id", "id", F.lit("*").alias("field"), F.col("star").alias("ref")), provenance, availability)


@query(with_clause("entities", "provenance", "availability") + LEDGER + """, n AS (SELECT bundle_id, count(*) AS applicable, count(*) FILTER (bucket = 'observed') AS o, count(*) FILTER (bucket IN ('inferred', 'annotated')) AS h, count(*) FILTER (bucket = 'hidden') AS x FROM ledger GROUP BY 1)
SELECT bundle_id, applicable, CASE WHEN o / applicable >= 0.9 THEN 'seen' WHEN h >= o THEN 'helped' WHEN x / applicable >= 0.2 THEN 'hidden' ELSE 'partly' END AS readout FROM n""")
def inspector_readout(spark, sf_dir):
    return access.readout(_ledger(spark, sf_dir))


REGISTRY = [("effect_return", 1, "reaper", "PROMO"), ("submix", 2, "reaper", "PROMO"), ("track", 3, "reaper", "SMALL"), ("submix", 2, "cubase", "LARGE"), ("scene", 4, "ableton_live", "SMALL")]


@query(with_clause("snapshots", "entities") + f", reg(concept_id, r, daw, wire_type) AS (VALUES {', '.join(map(str, REGISTRY))})" + """
SELECT e.bundle_id, e.id, coalesce(string_agg(g.concept_id, ',' ORDER BY g.r), '') AS concepts FROM entities e JOIN snapshots s USING (bundle_id) LEFT JOIN reg g ON g.daw = s.daw AND g.wire_type = e.family WHERE e.entity_type = 'PROCESSOR' GROUP BY ALL""")
def concept_lookup(spark, sf_dir):
    snapshots, entities = tables(spark, sf_dir, "snapshots", "entities")
    rows = entities.where("entity_type = 'PROCESSOR'").join(snapshots.select("bundle_id", "daw"), "bundle_id").select("bundle_id", "id", "daw", F.col("family").alias("wire_type"))
    registry = spark.createDataFrame(REGISTRY, "concept_id string, concept_rank int, daw string, wire_type string")
    return access.concepts_of(rows, registry).select("bundle_id", "id", F.array_join("concepts", ",").alias("concepts"))


def _tracks(spark, sf_dir):
    orders = tables(spark, sf_dir, "orders")[0].select(F.col("o_custkey").alias("pair_id"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("Song "), (F.col("o_orderkey") % 9).cast("string")).alias("name"), F.when(F.col("o_orderpriority") == "5-LOW", "return").otherwise("audio").alias("kind"), F.col("o_totalprice").alias("volume_db"), "o_orderdate")
    return orders.where("o_orderdate < timestamp'1997-01-01'").drop("o_orderdate"), orders.drop("o_orderdate")


@query("""WITH t AS (SELECT o_custkey AS pair_id, o_orderkey AS ord, 'Song ' || (o_orderkey % 9) AS name, o_totalprice AS v, o_orderdate < TIMESTAMP '1997-01-01' AS old FROM orders WHERE o_orderpriority <> '5-LOW'),
x AS (SELECT pair_id, name, max_by(v, ord) AS v FROM t WHERE old GROUP BY ALL), y AS (SELECT pair_id, name, max_by(v, ord) AS v FROM t GROUP BY ALL)
SELECT y.pair_id, CASE WHEN x.name IS NULL THEN 'added' ELSE 'volume' END AS change, y.name, x.v AS old, CASE WHEN x.name IS NOT NULL THEN y.v END AS new FROM y LEFT JOIN x USING (pair_id, name) WHERE x.v IS DISTINCT FROM y.v""")
def session_track_changes(spark, sf_dir):
    return sessiondiff.track_changes(*_tracks(spark, sf_dir))


@query(with_clause("lines") + """, b AS (SELECT bundle_id AS pair_id, okey AS track, l_returnflag AS processor, count(*) FILTER (l_shipdate < TIMESTAMP '1998-07-01') AS n0, count(*) AS n1 FROM lines GROUP BY ALL)
SELECT pair_id, track, processor, 'added' AS change, n1 - n0 AS n FROM b WHERE n1 > n0""")
def session_processor_changes(spark, sf_dir):
    lines = tables(spark, sf_dir, "lines")[0].select(F.col("bundle_id").alias("pair_id"), F.col("okey").alias("track"), F.col("l_returnflag").alias("processor"), "l_shipdate")
    return sessiondiff.processor_changes(lines.where("l_shipdate < timestamp'1998-07-01'"), lines)


@query("""WITH n AS (SELECT vec_id, label, [x::DOUBLE for x in embedding] AS v FROM embeddings WHERE vec_id % 5 = vec_id % 5), p AS (
  SELECT a.vec_id AS id, b.vec_id AS other, round_even(greatest(0, least(1, list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))))), 4)::DOUBLE AS similarity FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS rank FROM p) SELECT id, rank::INTEGER AS rank, other, similarity FROM r WHERE rank <= 3""".replace(" WHERE vec_id % 5 = vec_id % 5", ""))
def fingerprint_nearest(spark, sf_dir):
    rows = tables(spark, sf_dir, "embeddings")[0].select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    return similarity.nearest(rows, "label", 3)


@query(SAMPLES + """, f AS (SELECT audio_id, i // 16 AS frame, sqrt(avg(x * x)) AS r FROM s GROUP BY ALL)
SELECT audio_id, count(*) AS frames, count(*) FILTER (r > 0 AND 20 * log10(CASE WHEN r > 0 THEN r END) > 30) AS active, round(count(*) FILTER (r > 0 AND 20 * log10(CASE WHEN r > 0 THEN r END) > 30) / count(*), 6) AS activity_ratio FROM f GROUP BY 1""")
def signal_activity(spark, sf_dir):
    out = signal.activity(_samples(spark, sf_dir), 16, 30.0)
    return out.withColumn("activity_ratio", F.round("activity_ratio", 6))


@query(with_clause("entities", "relationships") + """
SELECT r.bundle_id, r.id, coalesce(a.name, r.source) || ' → ' || coalesce(b.name, r.target) AS label FROM relationships r LEFT JOIN entities a ON r.bundle_id = a.bundle_id AND r.source = a.id LEFT JOIN entities b ON r.bundle_id = b.bundle_id AND r.target = b.id WHERE r.rel_type = 'CHANNEL_SENDS_TO'""")
def delta_edge_labels(spark, sf_dir):
    entities, relationships = tables(spark, sf_dir, "entities", "relationships")
    return delta.edge_labels(relationships.where("rel_type = 'CHANNEL_SENDS_TO'"), entities).select("bundle_id", "id", "label")


@query(with_clause("relationships").replace("WITH ", "WITH RECURSIVE ", 1) + """, d AS (SELECT c_custkey AS bundle_id, 'm' || c_custkey AS id FROM customer UNION SELECT d.bundle_id, r.source FROM d JOIN relationships r ON r.bundle_id = d.bundle_id AND r.target = d.id AND r.rel_type IN ('CHANNEL_SENDS_TO', 'CHANNEL_ROUTES_TO'))
SELECT bundle_id, id FROM d""")
def graph_feeding_master(spark, sf_dir):
    customer, relationships = tables(spark, sf_dir, "customer", "relationships")
    back = relationships.where("rel_type in ('CHANNEL_SENDS_TO', 'CHANNEL_ROUTES_TO')").select("bundle_id", F.col("target").alias("source"), F.col("source").alias("target"))
    roots = customer.select(F.col("c_custkey").alias("bundle_id"), F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("root"))
    return graph.descendants(back, roots).select("bundle_id", "id")


@query("SELECT (o_orderkey % 5)::INTEGER AS concept_id, o_orderstatus AS status, count(*) AS results, round(avg(o_totalprice), 4) AS mean_confidence FROM orders GROUP BY ALL")
def metric_alignment(spark, sf_dir):
    rows = tables(spark, sf_dir, "orders")[0].select((F.col("o_orderkey") % 5).cast("int").alias("concept_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("confidence"))
    out = metrics.alignment_metrics(rows)
    return out.withColumn("mean_confidence", F.round("mean_confidence", 4))


from . import contract_queries, flow_queries, session_queries, signal_queries  # noqa: E402, F401  they register their queries here
