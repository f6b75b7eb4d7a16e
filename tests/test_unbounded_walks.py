"""Walks that no fixed number of hops may cut short."""

from provgraph.operators import graph, lineage


def edges(spark, pairs):
    return spark.createDataFrame([("b", f"e{i}", "CHANNEL_SENDS_TO", s, t) for i, (s, t) in enumerate(pairs)], "bundle_id string, id string, rel_type string, source string, target string")


def test_cycles_of_any_length(spark):
    ring = [f"n{i:02d}" for i in range(12)]
    found = graph.cycles(graph.hops(edges(spark, [*zip(ring, ring[1:] + ring[:1], strict=True), ("n03", "n01"), ("x", "n00"), ("n05", "y")]))).collect()
    assert {(tuple(r.path), r.truncated) for r in found} == {(tuple(ring), False), (("n01", "n02", "n03"), False)}
    one = graph.cycles(graph.hops(edges(spark, [*zip(ring, ring[1:] + ring[:1], strict=True), ("n03", "n01")])), most=1).collect()
    assert [(tuple(r.path), r.truncated) for r in one] == [(("n01", "n02", "n03"), True)]


def test_depths_of_long_chains_and_loops(spark):
    """A chain of 150, a loop of 5 with a tail of 3, and a member that is its own parent."""
    rows = [(f"c{i}", f"c{i - 1}" if i else "outside") for i in range(150)]
    rows += [(f"l{i}", f"l{(i + 1) % 5}") for i in range(5)] + [("t1", "l0"), ("t2", "t1"), ("t3", "t2"), ("self", "self"), ("child", "self"), ("alone", None)]
    got = {r.snapshot_id: r.depth for r in lineage.depths(spark.createDataFrame(rows, "snapshot_id string, parent string")).collect()}
    want = {f"c{i}": i for i in range(150)} | {f"l{i}": 4 for i in range(5)} | {"t1": 5, "t2": 6, "t3": 7, "self": 0, "child": 1, "alone": 0}
    assert got == want


def test_descendants_of_long_chains(spark):
    roots = spark.createDataFrame([("b", "n0")], "bundle_id string, root string")
    assert graph.descendants(edges(spark, [(f"n{i}", f"n{i + 1}") for i in range(36)]), roots).count() == 37
