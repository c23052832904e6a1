import random

import pytest

from bioloom.operators.graph import components


def plain(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {(x, root(x)) for x in parent}


@pytest.mark.parametrize("kind", ["random", "chain", "hub", "empty"])
def test_components(spark, kind):
    rng = random.Random(4)
    edges = {
        "random": [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(None, 3), (5, 5), (1, 2), (1, 2)],
        "chain": [(i, i + 1) for i in range(40)],
        "hub": [(50, i) for i in range(100)],
        "empty": [],
    }[kind]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(found) == len(set(found)) and {tuple(r) for r in found} == plain(edges)
