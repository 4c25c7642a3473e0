import random

import brute
from marquee.llm.shared import connected_components


def test_components_equal_union_find(spark):
    random.seed(1)
    pairs = [(random.randint(0, 400), random.randint(0, 400)) for _ in range(220)]
    pairs += [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(50)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parts = brute.Union(3000)
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    for a, b in real:
        parts.join(a, b)
    assert got == {x: parts.find(x) for pair in real for x in pair}


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
