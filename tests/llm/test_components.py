"""Connected components of links: right labels, and rows that grow with the links."""

import random

from docloom.llm import _common


def smallest(edges: list, nodes: set) -> dict:
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def shapes() -> list:
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(300)]
    star = [(1500, i) for i in range(1000, 1200)]
    clique = [(i, j) for i in range(2000, 2040) for j in range(i) if j >= 2000]
    scattered = [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(250)]
    return [*chain, *star, *clique, *scattered, (4000, 4000), (-7, 9000), (9000, -7)]


def test_components_and_joined(spark):
    edges = shapes()
    nodes = {x for e in edges for x in e}
    labels = _common.components(spark.createDataFrame(edges, "a long, b long"), "test")
    assert {r.node: r.component for r in labels.collect()} == smallest(edges, nodes)
    assert labels.count() == len(nodes)
    more = [(300, 1000), (2003, 1150), (4000, -7), (5, 6)]
    after = _common.joined(labels, spark.createDataFrame(more, "a long, b long"), "test")
    assert {r.node: r.component for r in after.collect()} == smallest(edges + more, nodes)
    assert _common.components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


def test_rounds_make_few_rows(spark, monkeypatch):
    made, real = [], _common.stage

    def counted(df, label):
        out = real(df, label)
        made.append(out.count())
        return out

    monkeypatch.setattr(_common, "stage", counted)
    edges = [(i, i + 1) for i in range(2000)]
    labels = _common.components(spark.createDataFrame(edges, "a long, b long"), "test")
    assert labels.filter("component = 0").count() == 2001
    assert sum(made) < 12 * len(edges)
