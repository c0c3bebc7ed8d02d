import random

import pytest

from inkwell.operators.components import components


@pytest.mark.parametrize("edges", [2_000_000, 25, 0])
def test_merged_and_hooked_give_the_same_roots(spark, edges):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)]
    df = spark.createDataFrame(links, "u long, v long").where("u <> v").repartition(16)
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for u, v in links:
        if u != v and (a := find(u)) != (b := find(v)):
            up[max(a, b)] = min(a, b)
    assert {r["key"]: r["root"] for r in components(df, forest_edges=edges).collect()} == {k: find(k) for k in up}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
