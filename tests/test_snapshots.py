import math
import random

import pytest

from tarnflow.operators.snapshots import SnapshotIndex, snapshot_changes

SCHEMA = "g long, ver long, dlv int, k long, a double, f boolean, change_kind string"
ARGS = {"series": ["g"], "version": "ver", "key": "k", "values": ["f", "a"], "delivery": "dlv", "tolerance": 1e-6}


def same(x, y):
    if x is None or y is None:
        return x is y
    if isinstance(x, float):
        return (math.isnan(x) and math.isnan(y)) if math.isnan(x) or math.isnan(y) else x == y or abs(x - y) <= 1e-6
    return x == y


def brute(rows):
    top = {}
    for g, v, d, *_ in rows:
        top[g, v] = max(d, top.get((g, v), d))
    snaps = {key: {} for key in top}
    for g, v, d, k, a, f in rows:
        if k is not None and d == top[g, v]:
            snaps[g, v][k] = (a, f)
    out = set()
    for g in {x for x, _ in snaps}:
        vs = sorted(v for x, v in snaps if x == g)
        for p, n in zip(vs, vs[1:], strict=False):
            old, new = snaps[g, p], snaps[g, n]
            out |= {(g, n, k, "added") for k in new.keys() - old.keys()} | {(g, n, k, "removed") for k in old.keys() - new.keys()}
            out |= {(g, n, k, "changed") for k in new.keys() & old.keys() if not all(same(x, y) for x, y in zip(new[k], old[k], strict=True))}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_series(spark, seed):
    rnd = random.Random(seed)
    vals = [None, float("nan"), 0.0, -0.0, 1.0, 1.0000005, 1.1, float("inf")]
    rows = []
    for g in (1, 2):
        for v in rnd.sample(range(1, 9), 5):
            for d in range(1, rnd.randint(1, 2) + 1):
                rows.append((g, v, d, None, 1.0, True))
                for k in range(1, 12):
                    if rnd.random() < 0.7:
                        row = (g, v, d, k, rnd.choice(vals), rnd.choice([True, False, None]))
                        rows += [row] * rnd.randint(1, 2)
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    assert {tuple(r) for r in snapshot_changes(df, **ARGS).collect()} == brute(rows)


def test_signed_zero_nan_and_null_are_told_apart(spark):
    rows = [(1, 1, 1, k, a, True) for k, a in enumerate([0.0, float("nan"), None, float("nan"), 1.0])]
    rows += [(1, 2, 1, k, a, True) for k, a in enumerate([-0.0, float("nan"), None, None, 1.00001])]
    df = spark.createDataFrame([(*r, "") for r in rows], SCHEMA)
    assert {tuple(r) for r in snapshot_changes(df, **ARGS).collect()} == {(1, 2, 3, "changed"), (1, 2, 4, "changed")}


def test_snapshot_without_keys_removes_all(spark):
    df = spark.createDataFrame([(1, 1, 1, 5, 1.0, True, ""), (1, 3, 1, None, None, None, ""), (1, 7, 1, 5, 1.0, True, "")], SCHEMA)
    assert {tuple(r) for r in snapshot_changes(df, **ARGS).collect()} == {(1, 3, 5, "removed"), (1, 7, 5, "added")}


def test_empty_table(spark):
    assert snapshot_changes(spark.createDataFrame([], SCHEMA), **ARGS).count() == 0


def test_index_advances_by_snapshot(spark):
    ix = SnapshotIndex(spark, "k", ["a"], tolerance=1e-6, buckets=3)
    snap = lambda rows: spark.createDataFrame(rows, "k long, a double")
    assert ix.advance(snap([(1, 1.0), (2, 2.0), (None, 3.0)])).count() == 0
    assert {tuple(r) for r in ix.advance(snap([(1, 1.0), (3, 1.0), (2, 2.5)])).collect()} == {(3, "added"), (2, "changed")}
    assert {tuple(r) for r in ix.advance(snap([(1, 1.0000001)])).collect()} == {(3, "removed"), (2, "removed")}
    assert {tuple(r) for r in ix.advance(snap([])).collect()} == {(1, "removed")}
