"""Queries on tables with rows that the generated ones lack, against their SQL."""

import os
import pathlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from provgraph.operators import delta, pathway, session_graph, signalflow, similarity, validate
from provgraph.plans.queries import QUERIES, SQL
from provgraph.sources import corpus, strict, tables

from .test_queries import SF, TABLES, normal

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """sf0.001 with two customers without orders, one of them of a version that the contract doesn't know."""
    folder, con = tmp_path_factory.mktemp("odd"), duckdb.connect()
    for t in TABLES:
        rows = f"SELECT * FROM '{SF}/{t}.parquet'"
        if t == "customer":
            rows += f" UNION ALL SELECT c.* REPLACE (k AS c_custkey) FROM (SELECT * FROM '{SF}/customer.parquet' LIMIT 1) c, (VALUES (1000050), (1000051)) v(k)"
        con.execute(f"COPY ({rows}) TO '{folder}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con


def test_no_rung_reached(spark, odd):
    folder, duck = odd
    got = QUERIES["ladder_summary"](spark, folder).select("bundle_id", "reached_set", "highest_contiguous").collect()
    assert normal(got) == normal(duck.execute(f"SELECT bundle_id, reached_set, highest_contiguous FROM ({SQL['ladder_summary']})").fetchall())
    assert {r.bundle_id: (r.reached_set, r.highest_contiguous) for r in got if r.bundle_id >= 1000050} == {1000050: (None, -1), 1000051: ("0", 0)}


def files(folder, pattern):
    return {str(p) for p in pathlib.Path(folder).rglob(pattern)}


def test_written_tables_drop_their_shuffles(spark):
    """What a written table was made by isn't left on the disk, and the session's own setting stays."""
    where = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    before = {f for d in where for f in files(d, "shuffle_*")}
    made = tables.cut(spark.range(5000).repartition(7, "id").groupBy((F.col("id") % 100).alias("k")).count())
    assert {f for d in where for f in files(d, "shuffle_*")} <= before and made.count() == 100
    assert spark.conf.get(tables.TIDY) == "false"


def test_corpus_keeps_what_is_asked_for(spark):
    """Tables that only other tables are made of are deleted; those asked for can be read, and each is written once."""
    tables.drop_left(spark)
    kept = corpus.tables(spark, SF, "entities", "relationships", "customer")
    assert len(tables._LEFT) == 2 and all(df.count() for df in kept)
    tables.drop_left(spark)
    assert corpus.tables(spark, SF, "returns", "entities")[0].count() and len(tables._LEFT) == 2
    tables.drop_left(spark)


def test_tokens_that_end_in_s(spark):
    """Sets are met by one key for a token and its plural; only those equal up to one s are pairs."""
    sets = lambda *rows: spark.createDataFrame([("b", list(r)) for r in rows], "bundle_id string, tokens array<string>")
    found = pathway.containment(sets(("glas",), ("s",), ("bus", "main")), sets(("glass",), ("ss",), ("gla",), ("glasss",), ("bu",)), 0.5)
    assert {(tuple(r.a), tuple(r.b)) for r in found.collect()} == {(("glas",), ("glass",)), (("glas",), ("gla",)), (("s",), ("ss",)), (("bus", "main"), ("bu",))}


def test_nearest_of_all_pairs(spark, monkeypatch):
    """Parts of a block against every pair by cosine: copies, zeros, nulls, a NaN, and shares that end on a half; no join makes pairs."""
    draw = random.Random(4)
    vectors = [[float(draw.randint(-2, 2)) for _ in range(6)] for _ in range(60)] + [[1.0, 0, 0, 0, 0, 0], [1.0, 799, 38, 12, 3, 1], [1.0, 799, 39, 8, 3, 2]] + [[2.0, 1, 0, 0, 1, 2]] * 9 + [[0.0] * 6, None, [1.0, None, 0, 0, 0, 0], [float("nan"), 1, 0, 0, 0, 0]]
    rows = spark.createDataFrame([(f"r{i * 37 % 101}", i % 2, v and [x if x is None else float(x) for x in v]) for i, v in enumerate(vectors)], "id string, block int, vector array<double>")
    monkeypatch.setattr(similarity, "PART", 7)
    found = similarity.nearest(rows, "block", 4)
    a, b = rows.toDF("id", "block", "v"), rows.toDF("other", "block", "w")
    pairs = a.join(b, "block").where("id <> other").select("id", "other", similarity.cosine(F.col("v"), F.col("w")).alias("similarity")).collect()
    want = []
    for i in {p.id for p in pairs}:
        best = sorted((-p.similarity, p.other) for p in pairs if p.id == i)[:4]
        want += [(i, n + 1, other, -s) for n, (s, other) in enumerate(best)]
    assert sorted(tuple(r) for r in found.select("id", "rank", "other", "similarity").collect()) == sorted(want)
    assert "FlatMapCoGroupsInPandas" in found._jdf.queryExecution().executedPlan().toString()


def test_departures_are_written_by_level(spark, monkeypatch):
    """Every kind of departure, none of them joined in one plan: each level's are written, what the last write reads is written tables only."""
    plans, cut = [], strict.cut
    monkeypatch.setattr(strict, "cut", lambda df, **more: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), cut(df, **more))[1])
    texts = ["{", '{"schema_version":"1","source":{"daw":"x"},"colour":1}', '{"source":{}}', '{"source":{"daw":7}}', '{"source":{"daw":"x"},"entities":[{"id":"a","entity_type":"NO"}]}', None]
    found = strict.departures(spark.createDataFrame(list(enumerate(texts)), "bundle_id int, text string")).collect()
    want = {(0, "", "not_json"), (1, ".colour", "unknown_field"), (2, ".source.daw", "missing"), (3, ".source.daw", "wrong_type"), (4, ".entities[0].entity_type", "bad_value"), (5, "", "not_json")}
    assert sorted(tuple(r) for r in found) == sorted(want)
    assert "Join" in plans[0] and "Join" not in plans[-1] and "Generate" not in plans[-1] and plans[-1].count("Relation") == strict.depth() + 1


def test_rules_run_one_by_one(spark, monkeypatch):
    """No rule's joins are in another one's plan, nor in that of what is returned."""
    plans, cut = [], validate.cut
    monkeypatch.setattr(validate, "cut", lambda df, **more: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), cut(df, **more))[1])
    make = lambda rows, schema: spark.createDataFrame(rows, "bundle_id int, " + schema)
    found = validate.issues(
        make([(1, "0.2.0"), (2, "9")], "schema_version string"), make([(1, "p", "PROJECT", "o"), (2, "t", "TRACK", "gone"), (2, "t", "TRACK", None)], "id string, entity_type string, star string"),
        make([(2, "r", "ODD", "t", "no", "o")], "id string, rel_type string, source string, target string, prov_ref string"), make([(1, "o", "OBSERVED", 0.5)], "id string, evidence string, confidence double"), make([], "id string, field string, status string"))
    want = {(2, "schema_version", "9"), (2, "entity_id", "t"), (2, "one_project", "0"), (2, "entity_prov", "t->gone"), (2, "rel_target", "r->no"), (2, "rel_prov", "r->o"), (2, "rel_type", "r=ODD"), (2, "lone_track", "t"), (1, "observed_confidence", "o")}
    assert {(r.bundle_id, r.rule, r.element_id) for r in found.collect()} == want
    assert len(plans) == 13 and max(p.count("Join") for p in plans) == 2 and "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_flow_writes_the_corpus_once(spark, monkeypatch):
    """A query's tables of the corpus are written once, whatever its parts take; what is told is written, so that nothing is joined when it is read."""
    written, cut = [], corpus.cut
    monkeypatch.setattr(corpus, "cut", lambda df, **more: (written.append(df.columns), cut(df, **more))[1])
    found = QUERIES["flow_parameters"](spark, SF)
    assert len(written) == 3 and "Join" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count()


def test_owners_and_nouns_of_some(spark):
    """What is asked for is told as it is among all."""
    make = lambda rows, schema: spark.createDataFrame([("b", *r) for r in rows], schema)
    rel = make([("k1", "CONTAINS", "x1", "v1"), ("k2", "CONTAINS", "x2", "v1"), ("k3", "CONTAINS", "x2", "v2"), ("p1", "CHANNEL_PROCESSED_BY", "c1", "x1"), ("u1", "TRACK_USES_CHANNEL", "t2", "c1"), ("u0", "TRACK_USES_CHANNEL", "t1", "c1")], "bundle_id string, id string, rel_type string, source string, target string")
    of = make([("v1",)], "bundle_id string, id string")
    assert [tuple(r) for r in delta.parameter_owners(rel, of).select("id", "processor", "channel").collect()] == [("v1", "x1", "c1")]
    entities = make([("c1", "One", None), ("c2", "", None), ("t1", "T", "lead_vocal_source"), ("t2", "T", "drum_source")], "pair_id string, id string, name string, role string")
    rel, asked = rel.withColumnRenamed("bundle_id", "pair_id"), make([("c1",), ("c2",), ("no",)], "pair_id string, id string")
    every = {r.id: r.noun for r in signalflow.nouns(entities, rel).collect()}
    assert {r.id: r.noun for r in signalflow.nouns(entities, rel, asked).collect()} == {c: every[c] for c in ("c1", "c2")} == {"c1": "lead vocal", "c2": "c2"}


def test_session_graph_checks_ends_once(spark):
    """Neither nodes nor edges, nor what is read of both, checks the ends of an edge again."""
    make = lambda rows, schema: spark.createDataFrame(rows, "bundle_id string, " + schema)
    given = {"sessions": make([("b", "Song")], "name string"), "tracks": make([("b", "t1", "A", None, "t2", 0, None), ("b", "t2", "B", None, None, 1, None)], "id string, name string, kind string, group_id string, idx int, observability string"), "routes": make([("b", "q", "gone", "t2", None)], "id string, source string, target string, source_name string")}
    nodes, edges = session_graph.build(given)
    assert {(r.edge_type, r.source, r.target) for r in edges.collect()} == {("contains_track", "project", "t1"), ("contains_track", "project", "t2"), ("group_contains", "t2", "t1"), ("has_unresolved_route", "q", "t2")}
    assert {r.id for r in nodes.collect()} == {"project", "t1", "t2", "q"} and all("Join LeftOuter" not in df._jdf.queryExecution().optimizedPlan().toString() for df in (nodes, edges))
