import random

from pyspark.sql import functions as F

from quillion.llm import shared


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (2000, 2000 - 1)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    expected = {x: find(x) for x in parent}
    out = shared.components(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    assert {r["node"]: r["root"] for r in out.collect()} == expected and out.count() == len(expected)
    assert shared.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_ranked(spark):
    rows = [(i % 3 and 1, i, i % 7) for i in range(500)] + [(9, 1000, 4)] * 5
    df = shared.stash(spark.createDataFrame(rows, "k int, id long, w long"), "t")
    out = shared.ranked(df, ["k"], [F.col("id")], "w").collect()
    assert len(out) == len(rows)
    for k in {r["k"] for r in out}:
        own = sorted((r for r in out if r["k"] == k), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(len(own)))
        assert [r["before"] for r in own] == [sum(x["w"] for x in own[:i]) for i in range(len(own))]
    again = shared.ranked(df.repartition(7), ["k"], [F.col("id")], "w").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))
