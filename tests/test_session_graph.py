"""Session graphs: every kind of node and edge, gaps, ties, what is shown."""

import pytest

from provgraph.operators import provview, session_graph
from provgraph.sources.tables import cut

SEEN = ", observability string"


@pytest.fixture(scope="module")
def tables(spark):
    make = lambda rows, schema: spark.createDataFrame([("b", *r) for r in rows], "bundle_id string, " + schema)
    return {
        "sessions": make([("Song",)], "name string"),
        "scenes": make([("s1", "", 0, None)], "id string, name string, idx int" + SEEN),
        "tracks": make([("t1", "Vox", "audio", None, 0, None), ("t2", "vox", None, "t1", 1, "inferred"), ("t3", None, "return", "gone", 2, None), ("m1", "Main", "master", None, 3, None), ("m2", "Main", "master", None, 4, None), (None, "x", None, None, 5, None)], "id string, name string, kind string, group_id string, idx int" + SEEN),
        "clips": make([("k1", "t1", None, "midi", "s1", None, None), ("k2", "t2", "Take", "audio", "gone", "C:\\a\\take.wav", None)], "id string, track string, name string, clip_type string, scene string, audio_file string" + SEEN),
        "processors": make([("x1", "t1", "EQ", "inferred"), ("x2", "gone", "Comp", None)], "id string, owner string, name string" + SEEN),
        "parameters": make([("v1", "x1", "Gain")], "id string, processor string, name string"),
        "routes": make([("q1", "t1", "t3", None), ("q2", "gone", "t3", ""), ("q3", None, "t3", "Bus"), ("q4", "t1", "gone", None), ("q5", "t1", "m1", None), ("q6", "a1", "t3", None)], "id string, source string, target string, source_name string"),
        "audio": make([("a1", "vox.wav", False, False, "t1"), ("a2", "mix.wav", True, False, None), ("a3", "ref.wav", False, True, "gone")], "id string, name string, is_mixdown boolean, is_reference boolean, track string"),
        "scores": make([("f1", "a.mid", "midi", ["Bass", "Bass", None]), ("f2", "a.xml", "musicxml", ["Flute"])], "id string, name string, kind string, parts array<string>"),
        "notes": make([("n1", "VOX", ["EQ"], ["Hall"], "Main"), ("n2", "nobody", None, [], "")], "id string, track_name string, plugins array<string>, sends array<string>, bus string"),
        "reconciliations": make([("r1", ["a1", "a2", "gone"])], "id string, members array<string>"),
        "comparisons": make([("c1", ["a2", "a3"])], "id string, members array<string>"),
        "descriptors": make([("d1", "a1", ""), ("a2", "a2", "same")], "id string, anchor string, name string"),
        "markers": make([("h1", "t2", "freeze"), ("h2", "gone", "macro"), ("h3", None, "macro")], "id string, target string, kind string"),
        "recommendations": make([("z1", "Look", ["t1", "gone", "h1"])], "id string, title string, related array<string>"),
    }


@pytest.fixture(scope="module")
def graph(tables):
    return tuple(cut(df) for df in session_graph.build(tables))


def test_all_kinds(graph):
    nodes, edges = graph
    kinds = {r.id: (r.node_type, r.label, r.observability) for r in nodes.collect()}
    assert nodes.count() == len(kinds)
    assert kinds["project"] == ("project", "Song", "observed") and kinds["s1"][1] == "Scene 1" and kinds["t3"] == ("return_track", "Track 3", "observed") and kinds["t2"][2] == "inferred"
    assert kinds["k1"] == ("midi_clip", "k1", "observed") and kinds["file:C:\\a\\take.wav"] == ("audio_file", "take.wav", "observed") and kinds["v1"] == ("parameter", "Gain", "inferred")
    assert kinds["q2"] == ("unresolved_route", "Unresolved source", "hidden") and kinds["q3"][1] == "Bus" and kinds["q6"][0] == "unresolved_route" and not {"q1", "q4", "q5", None} & set(kinds)
    assert kinds["a2"] == ("descriptor_set", "same", "derived") and kinds["a3"][0] == "reference_track" and kinds["f1:track:Bass"][0] == "midi_track" and kinds["n1:bus:Main"][0] == "bus_note" and "n2:bus:" not in kinds
    got = {(r.source, r.target): r.edge_type for r in edges.collect()}
    want = {
        ("project", "s1"): "contains_scene", ("project", "t1"): "contains_track", ("project", "t2"): "contains_track", ("project", "t3"): "has_return", ("project", "m1"): "has_master", ("project", "m2"): "has_master",
        ("t1", "t2"): "group_contains", ("t1", "m1"): "sends_to", ("t2", "m1"): "routes_to_master", ("t3", "m1"): "routes_to_master", ("t1", "k1"): "contains_clip", ("t2", "k2"): "contains_clip", ("k1", "s1"): "clip_in_scene",
        ("k2", "file:C:\\a\\take.wav"): "uses_audio_file", ("t1", "x1"): "has_processor", ("x1", "v1"): "has_parameter", ("t1", "t3"): "sends_to", ("q2", "t3"): "has_unresolved_route", ("q3", "t3"): "has_unresolved_route", ("q6", "t3"): "has_unresolved_route",
        ("project", "a1"): "contains_audio", ("project", "a2"): "contains_audio", ("project", "a3"): "contains_audio", ("project", "f1"): "contains_audio", ("project", "f2"): "contains_audio", ("a1", "t1"): "infers_track", ("f1", "f1:track:Bass"): "infers_track", ("f2", "f2:part:Flute"): "infers_track",
        ("n1", "t1"): "annotated_by", ("n1", "n1:plugin:EQ"): "mentions_plugin", ("n1", "n1:send:Hall"): "mentions_send", ("n1", "n1:bus:Main"): "mentions_bus", ("a1", "r1"): "part_of_reconciliation", ("a3", "c1"): "compared_to_reference",
        ("a1", "d1"): "has_descriptor", ("t2", "h1"): "has_hidden_state", ("project", "h2"): "has_hidden_state", ("project", "h3"): "has_hidden_state", ("t1", "z1"): "supports_recommendation", ("h1", "z1"): "supports_recommendation",
    }
    # a2 is a descriptor set here, which evidence can't refer to
    assert got == want
    assert edges.count() == len(want)
    found = {r.relation for r in provview.relations(edges).collect()}
    assert found == {"prov:hadMember", "prov:wasInfluencedBy", "prov:wasDerivedFrom", "sse:hasHiddenState"} and provview.annotated(edges).count() == 1


def test_shown(spark, graph):
    nodes, edges = graph
    kept, left = session_graph.shown(nodes, edges, ("scene",), ("observed", "hidden"))
    assert {r.observability for r in kept.collect()} == {"observed", "hidden"} and kept.where("node_type = 'scene'").isEmpty()
    ids = {r.id for r in kept.collect()}
    assert {(r.source, r.target) for r in left.collect()} == {(r.source, r.target) for r in edges.collect() if r.source in ids and r.target in ids}
    roots = spark.createDataFrame([("b", "t2"), ("b", "gone"), ("c", "t2")], "bundle_id string, root string")
    kept, left = session_graph.shown(nodes, edges, tracks=roots)
    assert {r.id for r in kept.collect()} == {"project", "m1", "m2", "t2", "k2", "file:C:\\a\\take.wav", "h1", "z1"}
    assert ("project", "t2") in {(r.source, r.target) for r in left.collect()}
    assert session_graph.shown(nodes, edges, tracks=roots.where("root = 'gone'"))[0].count() == nodes.count()


def test_tables_left_out_and_empty(tables):
    nodes, edges = session_graph.build({"sessions": tables["sessions"]})
    assert [r.id for r in nodes.collect()] == ["project"] and edges.isEmpty()
    nodes, edges = session_graph.build({name: df.where("false") for name, df in tables.items()})
    assert nodes.isEmpty() and edges.isEmpty()
