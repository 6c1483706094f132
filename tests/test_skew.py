"""Joins and components with hot keys, by the ways for small and for large tables."""

import random

import pytest
from pyspark.sql import functions as F

from narrata.operators.components import connected_components
from narrata.operators.skew import hot_limit, join_counted


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
@pytest.mark.parametrize("small", [0, 1000])
def test_join_counted(spark, how, small):
    keys = [0] * 500 + [k for k in range(1, 40) for _ in range(k % 4)] + [None]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int")
    keyed = rows.where("k % 2 = 0").groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    got = join_counted(rows, keyed, "k", len(keys), how=how, small=small)
    want = rows.join(keyed, "k", how)
    assert hot_limit(len(keys)) < 500 and got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


@pytest.mark.parametrize("small", [0, 1000])
def test_components_with_a_hub(spark, small):
    rng = random.Random(1)
    edges = [(500, i) for i in range(501, 800)] + [(i, i + 1) for i in range(100, 140)] + [(rng.randint(0, 99), rng.randint(0, 99)) for _ in range(40)] + [(501, 90), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src int, dst int"), small=small).collect()}
    assert got == {x: find(x) for x in root}
