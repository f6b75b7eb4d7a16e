"""Rule-level tests on hand-built tables, and reading, writing and streaming of bundles."""

import json

import pytest
from pyspark.sql import functions as F

from provgraph.functions import names, sanitize
from provgraph.operators import access, align, delta, graph, influence, lineage, normalize, provview, rules, signal, similarity, validate
from provgraph.sources import bundles
from provgraph.streaming import ingest


def snapshot(name, value=0.5):
    return {
        "schema_version": "0.2.0", "snapshot_id": name, "created_at": "t", "project": "d:p", "source": {"daw": "reaper", "daw_version": "7", "adapter": "a", "adapter_version": "1", "capture_modes": ["file"]},
        "entities": [
            {"id": "d:p", "entity_type": "PROJECT", "name": "Song", "semantic_roles": [], "properties": {}, "prov": {"*": "prov:0001"}, "availability": {}},
            {"id": "d:t", "entity_type": "TRACK", "name": "Lead Vox", "semantic_roles": ["vocal_source"], "properties": {"path": "/Users/bobby/x.wav"}, "prov": {"*": "prov:0001", "name": "prov:0009"}, "availability": {"channel": "UNKNOWN"}},
            {"id": "d:g", "entity_type": "PARAMETER", "name": "Gain", "properties": {"value": value, "nested": {"a": [1, 2]}}, "prov": {"*": "prov:0001"}},
        ],
        "relationships": [{"id": "rel:1", "rel_type": "CONTAINS", "source": "d:t", "target": "d:g", "properties": {"index": 3}, "prov_ref": None}],
        "provenance": [{"id": "prov:0001", "evidence": "OBSERVED", "confidence": None}], "extensions": {"reaper": {"k": {"deep": 1}}}, "warnings": [], "failures": [],
    }


@pytest.fixture
def root(tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / bundles.SNAPSHOT).write_text(json.dumps(snapshot(name), indent=1))
    (tmp_path / "one" / "validation.json").write_text("{}")
    (tmp_path / "one" / "capabilities.json").write_text(json.dumps({"read": {"routing": {"fields": {"sends": {"support": "full", "validation_status": "tested"}}}}}))
    return tmp_path


def test_bundles_become_tables(spark, root):
    rows = bundles.snapshots(spark, str(root))
    t = bundles.tables(rows)
    assert rows.count() == 2 and t["entities"].count() == 6
    assert sorted(len(r.warnings) for r in bundles.load_warnings(rows).collect()) == [1, 3]
    assert {(r.name, r.value) for r in t["entities"].where("entity_type = 'PARAMETER'").collect()} == {("Gain", 0.5)}
    assert {r.idx for r in t["relationships"].collect()} == {3} and t["extensions"].count() == 2
    found = validate.issues(t["snapshots"], t["entities"], t["relationships"], t["provenance"], t["availability"])
    assert found.count() == 0
    assert [(r.cap_domain, r.field, r.support) for r in bundles.capabilities(spark, str(root)).collect()] == [("routing", "sends", "full")]


def test_export_hides_people_and_media(spark, root, tmp_path):
    rows = bundles.sanitized(bundles.snapshots(spark, str(root)), users=("bobby",))
    assert all("bobby" not in r.text and ".wav" not in r.text and "asset:sha256:" in r.text for r in rows.collect())
    manifest = bundles.write_dataset({"snapshots": rows}, str(tmp_path / "out"))
    assert [(r.part, r.rows) for r in manifest.collect()] == [("snapshots", 2)] and spark.read.json(str(tmp_path / "out" / "snapshots")).count() == 2


def test_stream_reads_each_bundle_once(spark, root, tmp_path):
    seen = []
    handle = lambda df, n: seen.extend(r.snapshot.snapshot_id for r in df.collect())
    for _ in range(2):
        ingest.ingest(ingest.snapshot_stream(spark, str(root)), handle, str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(seen) == ["one", "two"]


def test_validation_rules(spark):
    s = spark.createDataFrame([("b", "1.2.0"), ("c", None), ("d", "x")], "bundle_id string, schema_version string")
    assert {r.bundle_id for r in validate.version_gate(s).collect()} == {"b", "c", "d"}
    e = spark.createDataFrame([("b", "1"), ("b", "1"), ("b", "1"), ("c", "1")], "bundle_id string, id string")
    assert validate.repeated(e, "r").count() == 2
    cov = spark.createDataFrame([("b", "x", 1, 1, 1, 0, 0)], "bundle_id string, domain string, applicable int, observed int, inferred int, hidden int, unsupported int")
    assert validate.coverage_bounds(cov).count() == 1
    assert validate.home_paths(spark.createDataFrame([("b", "see /home/ann/x"), ("c", "fine")], "bundle_id string, text string")).count() == 1


@pytest.mark.parametrize(("a", "b", "want"), [("Lead Vox", "LeadVox", 1.0), ("Drums 1", "Drum 1", 1.0), ("Гитара", "гитара", 1.0), ("Kick In", "Snare", 0.0), ("Bass DI", "Bass Amp", 0.5), ("", "x", 0.0)])
def test_name_confidence(spark, a, b, want):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(names.confidence(names.identity(names.tokens(F.col("a"))), names.identity(names.tokens(F.col("b")))).alias("c"))
    assert row.first().c == want


def test_sanitize_text(spark):
    rows = spark.createDataFrame([("/Users/ann/My Song.wav",), ("open /home/bob/notes and take1.wav",), ("plain",)], "t string")
    out = [r.s for r in rows.select(sanitize.sanitize_text(F.col("t")).alias("s")).collect()]
    assert out[0].startswith("asset:sha256:") and "bob" not in out[1] and "take1" not in out[1] and out[2] == "plain"


def test_contract_constants(spark):
    """Export words aren't identity, project files and bare paths are hashed, only the contract's version passes, missing evidence is derived."""
    t = spark.createDataFrame([("05_Lead_Vocal_Bounce.wav",), ("Bounce.wav",), ("main bus",)], "t string")
    got = [sorted(r.i) for r in t.select(names.identity(names.tokens(F.col("t"))).alias("i")).collect()]
    assert got == [["05", "lead", "vocal"], ["bounce", "wav"], ["bus", "main"]]
    p = spark.createDataFrame([("mix.als",), ("C:\\work\\x",), ("~/x",), ("a take.rpp here",), ("and/or",)], "t string")
    out = [r.s for r in p.select(sanitize.sanitize_text(F.col("t")).alias("s")).collect()]
    assert all(x.startswith("asset:") for x in out[:3]) and "take.rpp" not in out[3] and out[4] == "and/or"
    v = spark.createDataFrame([("a", "0.2.0"), ("b", "0.2"), ("c", "0.3.0"), ("d", "1.0.0"), ("e", "0")], "bundle_id string, schema_version string")
    assert {r.bundle_id for r in validate.version_gate(v).collect()} == {"c", "d", "e"}
    e = spark.createDataFrame([("b", "x", "p:1"), ("b", "y", "p:9")], "bundle_id string, id string, star string")
    prov = spark.createDataFrame([("b", "p:1", "OBSERVED")], "bundle_id string, id string, evidence string")
    rows = provview.attributions(e, prov, spark.createDataFrame([("b", "reaper")], "bundle_id string, daw string")).collect()
    assert {(r.id, r.agent, r.observability) for r in rows} == {("x", "tool:reaper", "observed"), ("y", "analyzer", "derived")}
    items = spark.createDataFrame([("b", x) for x in ("hidden", "hidden", "inferred", "annotated", "observed")], "bundle_id string, bucket string")
    assert access.readout(items).first().readout == "helped"


def edges(spark, pairs, kind="CHANNEL_SENDS_TO"):
    return spark.createDataFrame([("b", f"e{i}", kind, s, t) for i, (s, t) in enumerate(pairs)], "bundle_id string, id string, rel_type string, source string, target string")


def test_cycles(spark):
    found = graph.cycles(graph.hops(edges(spark, [("a", "b"), ("b", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"), ("x", "a")])))
    assert {tuple(r.path) for r in found.collect()} == {("a", "b"), ("a", "b", "c"), ("d",)}
    one = graph.cycles(graph.hops(edges(spark, [("a", "b"), ("b", "a"), ("d", "d")])), most=1).collect()
    assert len(one) == 1 and one[0].truncated


def test_descendants_stop_at_loops(spark):
    roots = spark.createDataFrame([("b", "a")], "bundle_id string, root string")
    assert {r.id for r in graph.descendants(edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")]), roots).collect()} == {"a", "b", "c"}


def test_delta_of_equal_states_is_empty(spark):
    a = spark.createDataFrame([("p", "1", "TRACK", "s")], "pair_id string, id string, entity_type string, signature string")
    b = spark.createDataFrame([("p", "2", "TRACK", "s"), ("p", "1", "TRACK", "z")], a.schema)
    assert delta.entity_changes(a, a).count() == 0
    assert {(r.id, r.change) for r in delta.entity_changes(a, b).collect()} == {("1", "changed"), ("2", "added")}
    assert {(r.id, r.change) for r in delta.entity_changes(b, a).collect()} == {("1", "changed"), ("2", "removed")}
    assert {(r.a, r.change, r.n) for r in delta.multiset_changes(spark.createDataFrame([("x",), ("x",)], "a string"), spark.createDataFrame([("x",), ("y",)], "a string"), "a").collect()} == {("x", "removed", 1), ("y", "added", 1)}


def test_lineage_depth_survives_a_loop(spark):
    v = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", None), ("d", "c"), ("e", "d")], "snapshot_id string, parent string")
    got = {r.snapshot_id: r.depth for r in lineage.depths(v).collect()}
    assert got["c"] == 0 and got["d"] == 1 and got["e"] == 2 and got["a"] == got["b"] == 1


def test_alignment_statuses(spark):
    cols = "bundle_id string, id string, name string, entity_type string, role string, family string"
    e = spark.createDataFrame([("a", "r", "Reverb Return", "CHANNEL", "effect_return", None), ("b", "r1", "Reverb Return", "CHANNEL", "effect_return", None), ("b", "r2", "Reverb Return", "CHANNEL", "effect_return", None), ("a", "k", "Kick", "TRACK", None, None)], cols)
    pairs = spark.createDataFrame([("ab", "a", "b"), ("ax", "a", "x")], "pair_id string, a string, b string")
    got = {(r.pair_id, r.source_id): r for r in align.align(pairs, align.strips(e, edges(spark, [("q", "q")]))).collect()}
    assert got["ab", "r"].status == "CONFLICTING" and got["ab", "k"].status == "UNMATCHED" and got["ax", "r"].confidence is None
    done = align.confirm(align.align(pairs, align.strips(e, edges(spark, [("q", "q")]))), spark.createDataFrame([("ab", "r"), ("ab", "k")], "pair_id string, source_id string"))
    assert {r.source_id: r.status for r in done.where("pair_id = 'ab'").collect()} == {"r": "CONFIRMED", "k": "UNMATCHED"}


def test_influence_names_drivers(spark):
    e = spark.createDataFrame([("b", "p", "PARAMETER", "Gain", 0.5, None), ("b", "a", "AUTOMATION", "Lane", None, None), ("b", "m", "MODULATION", None, None, None)], "bundle_id string, id string, entity_type string, name string, value double, normalized double")
    row = influence.influence(e, edges(spark, [("a", "p"), ("m", "p")], "CONTROLS")).first()
    assert row.effective == "base 0.5 / automated by Lane / modulated by m"


def test_rules_are_skipped_where_fields_are_hidden(spark):
    rule = rules.Rule("r", lambda t: rules.finding(t["x"], "warning", 0.5, F.col("bundle_id")), ("routes",))
    x = spark.createDataFrame([("a",), ("b",)], "bundle_id string")
    out = {r.bundle_id: r.subject for r in rules.run((rule,), {"x": x}, spark.createDataFrame([("b", "routes")], "bundle_id string, field string")).collect()}
    assert out == {"a": "a", "b": "skipped"}


def test_signal_measures(spark):
    wave = spark.createDataFrame([(1, c, i, (1.0 if i % 2 else -1.0) * (1 - c / 2)) for i in range(64) for c in (0, 1)], "audio_id long, channel int, i long, value double")
    assert signal.levels(wave).first().peak == 1.0 and signal.zero_crossings(wave).first().crossings == 63
    assert abs(signal.stereo_width(wave).first().width - 1 / 3) < 1e-9
    energies = {r.band_hz: r.energy for r in signal.band_energies(wave, 8000).collect()}
    assert max(energies, key=energies.get) == 4000


def test_cosine(spark):
    rows = spark.createDataFrame([(1, "x", [1.0, 0.0]), (2, "x", [1.0, 1.0]), (3, "x", [0.0, 0.0])], "id long, block string, vector array<double>")
    got = {(r.id, r.other): r.similarity for r in similarity.nearest(rows, "block").collect()}
    assert got[1, 2] == 0.7071 and got[1, 3] == 0.0


def test_decompose_reads_either_side_and_no_group_sums(spark):
    rows = [
        ("b", "1", "TRACK_USES_CHANNEL", "g", "gc", {}),
        ("b", "2", "TRACK_USES_CHANNEL", "t", "tc", {}),
        ("b", "3", "SUMS_TO", "tc", "gc", {}),
        ("b", "4", "CHANNEL_ROUTES_TO", "tc", "gc", {"via": "group_sum"}),
        ("b", "5", "CHANNEL_ROUTES_TO", "x", "gc", {}),
        ("b", "6", "CHANNEL_SENDS_TO", "y", "gc", {"via": "group_sum"}),
        ("b", "7", "CONTAINS", "g", "t", {"kind": "group_member"}),
        ("b", "8", "CONTAINS", "g", "clip", {}),
        ("b", "9", "CONTROLS", "v", "tc", {"kind": "vca_or_edit_group"}),
        ("b", "10", "CONTROLS", "lane", "p", {"kind": "automation"}),
    ]
    rel = spark.createDataFrame(rows, "bundle_id string, id string, rel_type string, source string, target string, properties map<string,string>")
    ent = spark.createDataFrame([("b", "g", "TRACK", "submix"), ("b", "gc", "CHANNEL", None), ("b", "v", "CHANNEL", None)], "bundle_id string, id string, entity_type string, role string")
    found = graph.groups(ent, rel)
    assert {r.id for r in found.collect()} == {"g", "gc", "v"}
    out = {r.group_id: r for r in graph.decompose(found, rel).collect()}
    for gid in ("g", "gc"):
        assert (out[gid].channel, out[gid].contains, out[gid].sums, out[gid].routes_in, out[gid].concept_count) == ("gc", ["t"], ["tc"], ["x", "y"], 3)
    assert (out["v"].controls, out["v"].concept_count) == (["tc"], 1)


def test_layers(spark):
    rows = [("b", "u", "TRACK_USES_CHANNEL", "t", "c"), ("b", "p", "CHANNEL_PROCESSED_BY", "c", "x"), ("b", "o", "OTHER", "t", "x"), ("b", "d", "CHANNEL_SENDS_TO", "c", "gone")]
    rel = spark.createDataFrame(rows, "bundle_id string, id string, rel_type string, source string, target string")
    ent = spark.createDataFrame([("b", "t", "TRACK"), ("b", "c", "CHANNEL"), ("b", "x", "PROCESSOR"), ("b", "m", "MEDIA_ASSET")], "bundle_id string, id string, entity_type string")
    want = {"signal_flow": ({"u", "p"}, {"t", "c", "x"}), "organizational": ({"u"}, {"t", "c", "m"}), "all": ({"u", "p", "o"}, {"t", "c", "x", "m"}), "variant": (set(), {"m"})}
    for name, (edges_, nodes_) in want.items():
        e = graph.layer_edges(ent, rel, name)
        assert ({r.id for r in e.collect()}, {r.id for r in graph.layer_nodes(ent, e, name).collect()}) == (edges_, nodes_)


def test_provenance_relations(spark):
    e = spark.createDataFrame([("b", k, "s", "t") for k in ("has_track", "has_hidden_state", "annotated_by", "linked_to_midi", "unheard_of")], "bundle_id string, edge_type string, source string, target string")
    assert sorted(r.relation for r in provview.relations(e).collect()) == ["prov:hadMember", "prov:wasDerivedFrom", "prov:wasInfluencedBy", "sse:hasHiddenState"]
    assert [tuple(r) for r in provview.annotated(e).collect()] == [("b", "t", "producer")]


def test_semantic_roles(spark):
    rows = spark.createDataFrame([("audio", " Vocals"), ("audio", "Lead  Gtr!"), ("audio", "!!"), ("audio", ""), ("audio", None), ("group", "Bass"), ("return", None)], "kind string, role string")
    got = [r[0] for r in rows.select(normalize.semantic_role(F.col("kind"), F.col("role"))).collect()]
    assert got == ["vocal_source", "lead_gtr", "unnamed", None, None, "submix", "effect_return"]


def test_rules_on_a_small_session(spark):
    e = [("t1", "TRACK", None, None, "vocal_source"), ("t2", "TRACK", None, None, None), ("c1", "CHANNEL", None, None, None), ("c2", "CHANNEL", None, None, None), ("r", "CHANNEL", "Hall", None, "effect_return"),
         ("m", "CHANNEL", "Master", None, "main_output"), ("x1", "PROCESSOR", "Plate", "Ambience", None), ("x2", "PROCESSOR", "Room", "Ambience", None), ("x3", "PROCESSOR", "Hall", "Ambience", None), ("x4", "PROCESSOR", "Brickwall 2", "Dynamics", None)]
    entities = spark.createDataFrame([("b", *row) for row in e], "bundle_id string, id string, entity_type string, name string, family string, role string")
    r = [("TRACK_USES_CHANNEL", "t1", "c1"), ("TRACK_USES_CHANNEL", "t2", "c2"), ("CHANNEL_PROCESSED_BY", "c1", "x1"), ("CHANNEL_PROCESSED_BY", "c2", "x2"), ("CHANNEL_PROCESSED_BY", "r", "x3"), ("CHANNEL_PROCESSED_BY", "m", "x4")]
    relationships = spark.createDataFrame([("b", *row) for row in r], "bundle_id string, rel_type string, source string, target string")
    faders = spark.createDataFrame([("b", "t2", 0.0), ("b", "t1", -12.5), ("b", "t3", None), ("c", "t1", 3.0), ("c", "t2", -9.0)], "bundle_id string, id string, volume_db double")
    loudness = spark.createDataFrame([], "bundle_id string")
    found = rules.run(rules.DEFAULT + rules.MIXER, {"entities": entities, "relationships": relationships, "faders": faders, "loudness": loudness}).collect()
    assert {(x.bundle_id, x.rule_id, x.severity, x.confidence, x.subject) for x in found} == {
        ("b", "core.shared_ambience", "suggestion", 0.7, "2"), ("b", "core.unused_returns", "info", 0.8, "r"), ("b", "core.vocal_corrective_chain", "suggestion", 0.55, "t1"),
        ("b", "core.level_imbalance", "suggestion", 0.5, "t2"), ("b", "core.master_limiter_context", "info", 0.6, "m")}
