import random


from sluice.llm.base import Scratch
from sluice.llm.components import connected_components


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def check(spark, edges):
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.root for r in connected_components(df, Scratch(spark, "test")).collect()}
    assert got == brute(edges)


def test_shapes(spark):
    rng = random.Random(1)
    check(spark, [(i, i + 1) for i in range(60)])
    check(spark, [(7, i) for i in range(300)] + [(1000 + i, 2000 + i) for i in range(40)])
    check(spark, [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(5, None), (9, 9), (-3, 5)])
    check(spark, [(1, 1), (None, 2)])
    check(spark, [])
