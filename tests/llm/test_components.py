import random

import pytest

from tarnflow.llm.components import decided_links, link_groups


def brute(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            ra, rb = find(a), find(b)
            up[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(up)}


def got(df):
    rows = [tuple(r) for r in df.collect()]
    out = dict(rows)
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("kernel", [0, 10**6])
def test_random_pairs(spark, seed, kernel):
    rnd = random.Random(seed)
    pairs = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(90)] + [(None, 3), (4, None), (5, 5), (5, 6), (6, 5)]
    df = spark.createDataFrame([(*p, "clash") for p in pairs], "a long, b long, group_id string")
    assert got(link_groups(df, kernel_edges=kernel)) == brute(pairs)


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_long_chain_with_a_hub(spark, levels):
    """The hub lies at the end of a chain that the search cannot follow to its end."""
    pairs = [(k, k + 1) for k in range(100, 160)] + [(160, k) for k in range(200, 230)] + [(1, 2), (7, 130)]
    assert got(link_groups(spark.createDataFrame(pairs, "a long, b long"), levels=levels, kernel_edges=0)) == brute(pairs)


def test_empty_and_unlinked(spark):
    df = spark.createDataFrame([], "a long, b long")
    assert link_groups(df).count() == 0
    assert link_groups(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


def test_last_verdict_decides(spark):
    rows = [(1, 1, 2, True), (5, 2, 1, False), (2, 3, 4, False), (3, 4, 3, True), (4, 5, 6, None), (1, 5, 6, True), (7, 7, 8, True), (7, 7, 8, False), (None, 9, 10, True)]
    df = spark.createDataFrame(rows, "m long, x long, y long, s boolean")
    assert {tuple(r) for r in decided_links(df, "x", "y", "s", "m").collect()} == {(3, 4), (9, 10)}
