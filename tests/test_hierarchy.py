import random

import pytest
from pyspark.sql import functions as F

from tarnflow.operators.hierarchy import ancestor_pairs, latest_by, resolve_hierarchy


def brute(links):
    nodes = {}
    for n, p in links:
        if n is not None:
            nodes[n] = p if n not in nodes else min((x for x in (nodes[n], p) if x is not None), default=None)
    out = {}
    for n in nodes:
        path, c = [n], n
        while nodes[c] is not None and nodes[c] in nodes and nodes[c] not in path:
            c = nodes[c]
            path.append(c)
        nxt = nodes[c]
        if nxt is None or nxt not in nodes:
            out[n] = (c, len(path) - 1, "tree")
        else:
            k = path.index(nxt)
            out[n] = (min(path[k:]), k, "cycle" if k == 0 else "into_cycle")
    return out


def got(df):
    return {r["node"]: (r["root"], r["steps"], r["outcome"]) for r in df.collect()}


@pytest.mark.parametrize("kernel_rows", [0, 10**6])
def test_paths_into_loops(spark, kernel_rows):
    links = [(k, k + 1) for k in range(40)] + [(40, 41), (41, 42), (42, 40), (50, 50), (51, 50), (60, None), (61, 60)]
    rows = resolve_hierarchy(spark.createDataFrame(links, "node long, parent long"), with_path=True, kernel_rows=kernel_rows).collect()
    path = {r["node"]: r["path"] for r in rows}
    assert {r["node"]: (r["root"], r["steps"], r["outcome"]) for r in rows} == brute(links)
    assert path[0] == list(range(41)) and path[41] == [41] and path[51] == [51, 50] and path[61] == [61, 60]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("kernel_rows", [0, 10**6])
def test_random_graphs(spark, seed, kernel_rows):
    rnd = random.Random(seed)
    n = 60
    links = [(k, rnd.choice([None, rnd.randrange(n + 5), max(0, k - 1), k])) for k in range(n)]
    df = spark.createDataFrame(links, "node long, parent long")
    assert got(resolve_hierarchy(df, kernel_rows=kernel_rows)) == brute(links)


def test_deep_chain_and_hub(spark):
    links = [(k, k - 1 if k else None) for k in range(300)] + [(1000 + k, 299) for k in range(200)]
    out = got(resolve_hierarchy(spark.createDataFrame(links, "node long, parent long")))
    assert out[299] == (0, 299, "tree") and all(out[1000 + k] == (0, 300, "tree") for k in range(200))


def test_paths_and_descendants(spark):
    links = [(1, None), (2, 1), (3, 2), (4, 2), (7, 8), (8, 7), (9, 7)]
    r = resolve_hierarchy(spark.createDataFrame(links, "node long, parent long"), with_path=True)
    again = resolve_hierarchy(spark.createDataFrame(links, "node long, parent long"), with_path=True, kernel_rows=0)
    assert sorted(map(str, r.collect())) == sorted(map(str, again.collect()))
    paths = {x["node"]: x["path"] for x in r.collect()}
    assert paths[3] == [3, 2, 1] and paths[1] == [1] and paths[9] == [9, 7]
    pairs = {tuple(x) for x in ancestor_pairs(r).collect()}
    assert pairs == {(1, 2, 1), (1, 3, 2), (1, 4, 2), (2, 3, 1), (2, 4, 1), (7, 9, 1)}


def test_nulls_repeats_ties_empty_and_extra_columns(spark):
    links = [(1, None, "x"), (1, None, "x"), (2, 1, None), (2, 5, "y"), (None, 1, "z"), (3, 99, "w"), (4, 4, "v")]
    df = spark.createDataFrame(links, "node long, parent long, root string").withColumn("steps", F.lit(7)).withColumn("path", F.lit("clash"))
    assert got(resolve_hierarchy(df)) == {1: (1, 0, "tree"), 2: (1, 1, "tree"), 3: (3, 0, "tree"), 4: (4, 0, "cycle")}
    assert resolve_hierarchy(df.limit(0)).count() == 0


def test_latest_by_ignores_arrival_and_orders_nulls_first(spark):
    df = spark.createDataFrame([(1, 2, 10), (1, None, 99), (1, 3, None), (2, None, 5)], "k long, rev int, v long")
    assert {tuple(r) for r in latest_by(df, "k", "rev", "v").collect()} == {(1, None), (2, 5)}
