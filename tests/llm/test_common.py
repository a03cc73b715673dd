"""Shared pieces against brute force."""

import random

import numpy as np
import pytest

from semlake.llm import common, textblock


def brute_roots(edges):
    names = sorted({x for e in edges for x in e})
    place = {x: i for i, x in enumerate(names)}
    u, v = (np.array([place[e[k]] for e in edges]) for k in (0, 1))
    return {(x, names[r]) for x, r in zip(names, textblock.components_of(len(names), u, v).tolist(), strict=True)}


@pytest.mark.parametrize("centre", [0, 2500, 9999])
def test_components_with_a_star_that_holds_most_edges(spark, centre):
    toss = random.Random(centre)
    star = [(centre, x) for x in toss.sample(range(10_000), 3000) if x != centre]
    chain = [(20_000 + i, 20_001 + i) for i in range(9)]
    others = [(30_000 + toss.randrange(900), 30_000 + toss.randrange(900)) for _ in range(700)]
    edges = star + chain + [e for e in others if e[0] != e[1]] + chain[:2]
    found = common.components(spark.createDataFrame(edges, "u long, v long"))
    assert {(r.node, r.root) for r in found.collect()} == brute_roots(edges)


def test_components_without_edges(spark):
    assert common.components(spark.createDataFrame([(1, 1)], "u long, v long")).collect() == []
