import math
import random

import pytest
from pyspark.sql import functions as F

from tarnflow.operators import hotkeys
from tarnflow.operators.hotkeys import distinct_items, exact_quantiles, frequent_keys, key_profile

SCHEMA = "key long, g long, c long, value double, n_items string"


def rank(vs, q):
    vs = sorted(vs)
    return vs[max(1, math.ceil(q * len(vs))) - 1]


@pytest.mark.parametrize("broadcast_rows", [hotkeys.BROADCAST_ROWS, -1])
def test_quantiles_of_skewed_keys(spark, broadcast_rows):
    rnd = random.Random(5)
    pool = [-1e300, 1e300, float("inf"), float("-inf"), 0.1, 0.1 + 1e-17, *[rnd.gauss(0, 1e6) for _ in range(400)]]
    rows = [(0 if k % 3 else k % 20, 1, k, rnd.choice(pool), "clash") for k in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["key"], r["q"]): r["quantile"] for r in exact_quantiles(distinct_items(df, "key", ["g", "c"], "value"), [0.0, 0.25, 0.5, 1.0], bins=8, broadcast_rows=broadcast_rows).collect()}
    by = {}
    for k, _, _, v, _ in rows:
        by.setdefault(k, []).append(v)
    assert got == {(k, q): rank(vs, q) for k, vs in by.items() for q in (0.0, 0.25, 0.5, 1.0)}


def test_profile_counts_distinct_items(spark):
    nan = float("nan")
    rows = [(1, 1, 1, 5.0, ""), (1, 1, 1, 4.0, ""), (1, 1, 2, None, ""), (1, 2, 1, nan, ""), (None, 1, 9, 1.0, ""), (2, 1, 1, 7.0, ""), (2, None, None, 8.0, ""), (2, None, None, 8.0, "")]
    got, total = key_profile(spark.createDataFrame(rows, SCHEMA), "key", ["g", "c"], "value", extent=["c"])
    out = {r["key"]: r for r in got.collect()}
    assert total == 5  # (1,1) has two keys and counts once
    assert (out[1]["n_items"], out[1]["n_values"], out[1]["low"], out[1]["high"], out[1]["q_50"], out[1]["max_c"]) == (3, 1, 4.0, 4.0, 4.0, 2)
    assert (out[2]["n_items"], out[2]["q_50"]) == (2, 7.0)
    keys = frequent_keys(spark.createDataFrame(rows, SCHEMA), "key", ["g", "c"], (1, 2))
    assert {(r["key"], r["n_items"]) for r in keys.collect()} == {(1, 3)}


@pytest.mark.parametrize("seed", range(4))
def test_frequent_keys(spark, seed):
    rnd = random.Random(seed)
    base = rnd.choice([0, 2**62])  # neighbours that one double stands for
    pool = [base + k for k in (0, 1, 2, 3, 700, -5)] + [-(2**62), None]
    rows = [(rnd.choice(pool) if rnd.random() < 0.7 else base + 10 + k, k % 3, rnd.randrange(300), 0.0, "") for k in range(rnd.choice([0, 3, 900]))]
    share = rnd.choice([(1, 20), (1, 3), (1, 7)])
    items, total = {}, len({(g, c) for _, g, c, _, _ in rows})
    for k, g, c, _, _ in rows:
        items.setdefault(k, set()).add((g, c))
    want = {(k, len(v)) for k, v in items.items() if k is not None and len(v) * share[1] >= total * share[0]}
    got = frequent_keys(spark.createDataFrame(rows, SCHEMA), "key", ["g", "c"], share, bins=4)
    assert {(r["key"], r["n_items"]) for r in got.collect()} == want


def test_empty_and_constant(spark):
    got, total = key_profile(spark.createDataFrame([], SCHEMA), "key", ["g", "c"], "value")
    assert got.count() == 0 and total == 0
    same = spark.range(500).select(F.lit(1).alias("key"), F.lit(1).alias("g"), F.col("id").alias("c"), F.lit(3.5).alias("value"))
    assert key_profile(same, "key", ["g", "c"], "value")[0].first()["q_50"] == 3.5
