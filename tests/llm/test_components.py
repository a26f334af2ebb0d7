import random

from tessera.llm import common as C


def slow(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def found(spark, edges, parts):
    df = spark.createDataFrame(edges, "a long, b long").repartition(parts)
    rows = C.components(df, "test").collect()
    assert len({r.node for r in rows}) == len(rows)
    return {r.node: r.root for r in rows}


def test_components_against_brute_force(spark, monkeypatch):
    """Paths, hubs, cycles, repeated edges, loops and negative nodes; few edges are linked at a time, so that rounds are needed."""
    monkeypatch.setattr(C, "EDGES", 5)
    rng = random.Random(3)
    path = [(i, i + 1) for i in range(-40, 40)]
    hub = [(1000, 1001 + i) for i in range(60)]
    loose = [(rng.randrange(2000, 2120), rng.randrange(2000, 2120)) for _ in range(90)]
    edges = path + hub + loose + loose[:10] + [(5000, 5001), (5001, 5002), (5002, 5000)]
    rng.shuffle(edges)
    want = slow([e for e in edges if e[0] != e[1]])
    assert found(spark, edges, 4) == want


def test_components_of_nothing(spark):
    assert found(spark, [], 1) == {}
    assert found(spark, [(7, 7)], 1) == {}
