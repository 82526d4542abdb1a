import random

import numpy as np
import pytest

from lodestone.operators.graph import components, forest
from lodestone.operators.skew import salted_join


def roots(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_forest_keeps_components():
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    a, b = forest(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]))
    want = roots([e for e in edges if e[0] != e[1]])
    assert roots(list(zip(a.tolist(), b.tolist()))) == {k: v for k, v in want.items()}
    assert len(a) == len(want) - len(set(want.values()))


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 300)], [(7, 7)], [(5, 3), (3, 5), (9, 8)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(8)).collect()}
    assert got == {k: v for k, v in roots([e for e in edges if e[0] != e[1]]).items()}


def test_components_of_a_random_graph_and_of_nothing(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(10**12), rng.randrange(10**12)) for _ in range(50)] + [(rng.randrange(400), rng.randrange(400)) for _ in range(380)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    assert got == roots([e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([(None, 1)], "a long, b long")).count() == 0


def test_salted_join_is_an_inner_join(spark):
    left = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 99), (None, 1)], "k string, v long")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("cold", 3), (None, 4)], "k string, w long")
    got = sorted(tuple(r) for r in salted_join(left, right, "k", most=10).select("k", "v", "w").collect())
    assert got == sorted(tuple(r) for r in left.join(right, "k").select("k", "v", "w").collect())
