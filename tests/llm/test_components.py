import random

from taskprep.llm.components import components


def test_against_union_find(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 200), rng.randint(100, 200)) for _ in range(50)] + [(300, k) for k in range(301, 340)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_edges_take_no_rounds(spark, monkeypatch):
    """What one task can join is written four times at most, however long its chains; rounds give the same."""
    from taskprep.llm import components as module

    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(-5, 9000), (9000, 9001)], "a long, b long")
    cuts, cut = [], module.cut_lineage
    monkeypatch.setattr(module, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    got = sorted(map(tuple, components(edges).collect()))
    assert got == sorted([(i, 0) for i in range(301)] + [(-5, -5), (9000, -5), (9001, -5)]) and len(cuts) <= 4
    monkeypatch.setattr(module, "FEW", 20)
    assert sorted(map(tuple, components(edges).collect())) == got
