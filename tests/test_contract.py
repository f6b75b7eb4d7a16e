"""Control targets, lanes, stock names, strict reading, native payloads, and what written tables leave behind."""

import glob
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from provgraph.functions import roles
from provgraph.functions.sanitize import sanitize_text
from provgraph.operators import control, delta, graph, influence
from provgraph.sources import bundles, corpus, strict, tables


def test_lane_counts_all_points_and_stores_the_first(spark):
    rng = random.Random(1)
    values = [(1, k, float(rng.randrange(1000))) for k in range(1500)] + [(2, 0, 5.0)]
    rows = values[:]
    rng.shuffle(rows)
    points = spark.createDataFrame([("b", lane, k, float(k), v, "hold" if k else "linear") for lane, k, v in rows], "bundle_id string, lane int, ord int, time double, value double, curve string").repartition(7)
    got = {r.lane: r for r in control.lane_values(points).collect()}
    first = [v for lane, _, v in values if lane == 1]
    assert (got[1].point_count, got[1].value_min, got[1].value_max, got[1].first_value, got[1].last_value, got[1].curve) == (1500, min(first), max(first), first[0], first[-1], "linear")
    assert [p.value for p in got[1].points] == first[:512] and len(got[2].points) == 1


LANE = "bundle_id string, lane int, parameter_name string, unit string, target_parameter_id string, target_processor_id string, target_channel_field string, target_track_id string"


def test_targets_are_resolved_in_order(spark):
    entities = spark.createDataFrame([("b", "p1"), ("b", "x1"), ("b", "c1"), ("other", "p2")], "bundle_id string, id string")
    channels = spark.createDataFrame([("b", "t1", "c1")], "bundle_id string, track string, channel string")
    rows = [
        ("b", 1, "Gain", None, "p1", "x1", "volume", "t1"), ("b", 2, "Gain", None, "p2", "x1", "volume", "t1"), ("b", 3, "Gain", None, None, "gone", "volume", "t1"),
        ("b", 4, "Gain", None, None, None, None, "t1"), ("b", 5, None, None, "", None, "pan", "t9"), ("b", 6, None, None, None, None, None, None),
    ]
    got = {r.lane: (r.target, r.target_kind, r.field) for r in control.resolved(spark.createDataFrame(rows, LANE), entities, channels).collect()}
    assert got == {1: ("p1", "parameter", None), 2: ("x1", "processor_field", "Gain"), 3: ("c1", "channel_field", "volume"), 4: (None, None, None), 5: (None, None, None), 6: (None, None, None)}


def test_modulation_links_and_influence(spark):
    entities = spark.createDataFrame([("b", "p1", "PARAMETER", "Cutoff", 0.5, None), ("b", "c1", "CHANNEL", "Kick", None, None)], "bundle_id string, id string, entity_type string, name string, value double, normalized double")
    channels = spark.createDataFrame([("b", "t1", "c1")], "bundle_id string, track string, channel string")
    mods = spark.createDataFrame([("b", 1, "Duck", None, "p1", None, None, None, "sidechain", "t1", 0.4, None), ("b", 2, None, None, None, None, None, None, "lfo", "t1", None, 2.0)], LANE + ", source_type string, source_track_id string, depth double, rate double")
    lanes = spark.createDataFrame([("b", 1, "Cutoff", "Hz", "p1", None, None, None)], LANE)
    points = spark.createDataFrame([], "bundle_id string, lane int, ord int, time double, value double, curve string")
    m, a = control.modulation(mods, entities, channels, "n"), control.automation(lanes, points, entities, channels, "n")
    assert {(r.id, r.availability, r.driver) for r in m.collect()} == {("n:mod:duck:1", None, "c1"), ("n:mod:lfo:2", "UNKNOWN", None)}
    assert [(r.id, r.point_count) for r in a.collect()] == [("n:auto:cutoff:1", 0)]
    edges = control.control_edges(a, m)
    assert {tuple(r) for r in edges.collect()} == {("b", "CONTROLS", "n:auto:cutoff:1", "p1", "parameter"), ("b", "CONTROLS", "n:mod:duck:1", "p1", "parameter"), ("b", "LINKED_WITH", "c1", "n:mod:duck:1", "sidechain_source")}
    got = {r.id: (r.automation, r.modulation) for r in influence.influence(entities.unionByName(control.control_entities(a, m)), edges).collect()}
    assert got == {"p1": (["Cutoff"], ["Duck"]), "c1": ([], ["Duck"])}


def longest(words, stock):
    best = None
    for place, (entry, role) in enumerate(stock):
        key = entry.split()
        starts = [i for i in range(len(words) - len(key) + 1) if words[i : i + len(key)] == key]
        if starts and (best is None or len(key) > best[3]):
            best = (entry, role, starts[0], len(key))
    return best or (None, None, None, None)


def test_stock_names_equal_brute_force(spark):
    rng = random.Random(4)
    stock = [("a b", "X"), ("a", "Y"), ("b c", None), ("a b c d", "Z"), ("d d", "W"), ("c", "V"), ("b a", "U"), ("a b c", None)]
    names = {" ".join(rng.choices("abcd", k=rng.randrange(0, 7))) for _ in range(200)} | {"", "zz a b", "Zed AB c"}
    rows = spark.createDataFrame([(n,) for n in sorted(names)] + [(None,)], "name string")
    table = spark.createDataFrame([(e, r, i) for i, (e, r) in enumerate(stock)], "entry string, role string, place int")
    for r in roles.stock_matches(rows, table).collect():
        words = roles_tokens(r.name)
        assert (r.entry, r.stock_role, r.start, r.length) == longest(words, stock), r
    assert roles.stock_matches(rows, table.limit(0)).where("entry is not null").count() == 0


def roles_tokens(name):
    import re

    return [t for t in re.split(r"[^\w#+]+|_+", re.sub("([a-z0-9])([A-Z])", r"\1_\2", name or "").lower()) if t]


GOOD = {"schema_version": "0.2.0", "source": {"daw": "x", "daw_version": None}, "entities": [{"id": "a", "entity_type": "TRACK", "properties": {"k": [1, {"z": None}]}, "prov": {"*": "p"}}], "provenance": [{"id": "p", "evidence": "OBSERVED", "confidence": 1}]}


@pytest.mark.parametrize(
    ("change", "want"),
    [
        (lambda d: None, set()),
        (lambda d: d.update(more=1), {(".more", "unknown_field")}),
        (lambda d: d.pop("source"), {(".source", "missing")}),
        (lambda d: d["source"].update(daw=None), {(".source.daw", "wrong_type")}),
        (lambda d: d["entities"][0].update(entity_type="track", name=3), {(".entities[0].entity_type", "bad_value"), (".entities[0].name", "wrong_type")}),
        (lambda d: d["entities"].append({}), {(".entities[1].id", "missing"), (".entities[1].entity_type", "missing")}),
        (lambda d: d["provenance"][0].update(evidence="SEEN", confidence="1"), {(".provenance[0].evidence", "bad_value"), (".provenance[0].confidence", "wrong_type")}),
        (lambda d: d.update(coverage={"a": {"hidden": 1.5, "x": 0}}), {(".coverage.a.hidden", "wrong_type"), (".coverage.a.x", "unknown_field")}),
        (lambda d: d.update(entities={"a": 1}), {(".entities", "wrong_type")}),
    ],
)
def test_departures_from_the_contract(spark, change, want):
    document = json.loads(json.dumps(GOOD))
    change(document)
    rows = spark.createDataFrame([(1, json.dumps(document))], "bundle_id int, text string")
    assert {(r.path, r.error) for r in strict.departures(rows).collect()} == want


def test_strict_keeps_good_documents(spark):
    rows = spark.createDataFrame([(1, json.dumps(GOOD)), (2, "{"), (3, None), (4, "[]"), (5, "{}")], "bundle_id int, text string")
    good, rejects = strict.strict(rows)
    assert [r.bundle_id for r in good.collect()] == [1]
    assert {(r.bundle_id, r.path, r.error) for r in rejects.collect()} == {(2, "", "not_json"), (3, "", "not_json"), (4, "", "wrong_type"), (5, ".source", "missing")}
    assert strict.departures(rows.limit(0)).count() == 0


def test_native_payloads_are_read_on_demand(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"b{k}").mkdir()
        (tmp_path / f"b{k}" / bundles.SNAPSHOT).write_text(json.dumps(GOOD))
    (tmp_path / "b0" / "native.json").write_text('{"deep": {"er": [1, 2]}}')
    rows = bundles.native(spark, str(tmp_path))
    assert rows.select(F.try_variant_get("payload", "$.deep.er[1]", "int").alias("x")).collect()[0].x == 2
    plan = bundles.snapshots(spark, str(tmp_path)).select("bundle_id", "has_native")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan and "ReadSchema: struct<value" not in plan.replace("struct<value:string>", "", 1) and bundles.snapshots(spark, str(tmp_path)).where("has_native").count() == 1


def test_one_file_has_one_hash_whoever_owns_it(spark):
    texts = ["/Users/ann/x/take.wav", "/Users/bob/x/take.wav", "  /home/bob/a.flac ", r"\\server\Users\bob\notes", "it's '/home/bob'"]
    got = [r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").select(sanitize_text(F.col("t")).alias("s")).collect()]
    assert got[0] == got[1] and got[2].startswith("asset:sha256:")
    assert "bob" not in "".join(got) and got[4] == "it's '<redacted>'"


def test_labels_say_where_a_send_taps(spark):
    edges = spark.createDataFrame([("b", "CHANNEL_SENDS_TO", "x", "y", True), ("b", "CHANNEL_SENDS_TO", "x", "z", False), ("b", "CHANNEL_ROUTES_TO", "x", "z", True)], "bundle_id string, rel_type string, source string, target string, pre_fader boolean")
    names = spark.createDataFrame([("b", "x", "Ex")], "bundle_id string, id string, name string")
    assert sorted(r.label for r in delta.edge_labels(edges, names).collect()) == ["Ex → y (pre-fader)", "Ex → z", "Ex → z (post-fader)"]


@pytest.fixture
def folder(spark, tmp_path, monkeypatch):
    tables.drop_left(spark)
    monkeypatch.setattr(tables, "shared_folder", lambda _: f"file://{tmp_path}")
    yield lambda: glob.glob(f"{tmp_path}/graph/*")
    tables.drop_left(spark)


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://somewhere:7077"
            getConf = staticmethod(dict)

    with pytest.raises(RuntimeError):
        tables.shared_folder(Session)


def test_rounds_leave_only_the_result(spark, folder):
    pairs = [(f"n{i}", f"n{(i + 1) % 9}") for i in range(9)]
    edges = spark.createDataFrame([("b", s, t) for s, t in pairs], "bundle_id string, source string, target string")
    found = graph.cycles(edges)
    assert found.count() == 1 and len(folder()) == 1
    assert tables.drop_left(spark) == 1 and not folder()


def test_corpus_reads_the_facts_once(spark, folder):
    _, entities, relationships = corpus.tables(spark, "/root/testdata/sf0.001", "lines", "entities", "relationships")
    plan = entities.join(relationships, "bundle_id")._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and len(folder()) == 3


def test_all_lane_orders_give_one_result(spark):
    rows = [("b", 1, k, float(k), float(v), "c") for k, v in enumerate([3, 1, 2])]
    schema = "bundle_id string, lane int, ord int, time double, value double, curve string"
    got = {str(control.lane_values(spark.createDataFrame(list(p), schema), 2).collect()) for p in itertools.permutations(rows)}
    assert len(got) == 1
