import random

from provgraph.llm import common


def test_long_chains_are_one_component(spark):
    """A randomly numbered chain of 1000 nodes, another one linked at distances 1 and 2, and a pair."""
    ids = list(range(2000))
    random.Random(1).shuffle(ids)
    one, two = ids[:1000], ids[1000:]
    links = [*zip(one, one[1:], strict=False), *zip(two, two[1:], strict=False), *zip(two, two[2:], strict=False), (5001, 5000)]
    got = {r.node: r.root for r in common.components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: min(one) for x in one} | {x: min(two) for x in two} | {5000: 5000, 5001: 5000}
