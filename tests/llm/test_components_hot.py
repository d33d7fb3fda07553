"""Connected components with hub nodes on both sides of the bound for a broadcast."""

from __future__ import annotations

import random

import pytest

from aspectra.llm import components as C


def brute(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("hot", [1, 5, 1000, 10**9])
def test_hubs_chains_and_pairs(spark, monkeypatch, hot):
    """hot=1: no node is broadcast; 10**9: all are."""
    monkeypatch.setattr(C, "HOT", hot)
    rnd = random.Random(9)
    edges = [(5000, i) for i in range(400)] + [(3, i) for i in range(2000, 2300)]
    edges += [(i, i + 1) for i in range(7000, 7040)] + [(2 * i, 2 * i + 1) for i in range(4100, 4150)]
    edges += [(rnd.randint(9000, 9400), rnd.randint(9000, 9400)) for _ in range(300)]
    edges = [e for e in edges if e[0] != e[1]]
    rnd.shuffle(edges)
    got = C.components(spark.createDataFrame(edges + edges[:50], "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == brute(edges)
