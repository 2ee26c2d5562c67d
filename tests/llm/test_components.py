import random

from sparrowdex.llm.components import components


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_components_are_those_of_brute_force(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(1000, 1400)]
    rng.shuffle(chain)
    star = [(5000, 5001 + i) for i in range(300)]
    loose = [(rng.randrange(6000, 7000), rng.randrange(6000, 7000)) for _ in range(500)]
    edges = [(a, b) for a, b in chain + star + loose + star if a != b]
    df = spark.createDataFrame([*edges, (9, 9), (None, 3), (4, None)], "a long, b long").repartition(4)
    assert {r.node: r.comp for r in components(df).collect()} == brute(edges)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
