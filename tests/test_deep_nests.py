"""Nests as deep as there are ponds: work and memory must not grow with their depth."""

import time

import numpy as np
import pandas as pd
import pytest
from test_terrain import analyzed, some

from tarnflow.operators import traps


def nest(n):
    """Passes of n regions in a row, each higher than the one before; the last leads out."""
    rows = []
    for k in range(1, n):
        rows += [(a, b, b, float(k), 0, 0, k, a, b) for a, b in ((k, k + 1), (k + 1, k))]
    rows.append((n, 0, 0, float(n), 1, 0, n, n, n))
    return pd.DataFrame(rows, columns=["src", "dst", "dst_region", "z_pass", "phase", "ord", "pos", "cell", "ncell"])


def test_rounds_of_a_deep_nest():
    n = 6000
    began = time.time()
    out = traps._rounds(nest(n), n, 0)
    assert time.time() - began < 3
    new = out[out["old"].isna()].sort_values("trap")
    assert new["level"].tolist() == list(range(1, n)) and new["elevation"].tolist() == [float(k) for k in range(2, n + 1)]
    assert new["downstream_region"].tolist() == [*range(3, n + 1), 0]


def test_volumes_of_a_deep_nest():
    n = 6000
    trap = np.arange(1, 2 * n)
    parent = np.array([n, *range(n, 2 * n - 1), *range(n + 1, 2 * n - 1), -1])
    elevation = np.array([1.0, *map(float, range(1, n)), *map(float, range(2, n + 1))])
    volume, sub = traps.tree_volumes(np.arange(1, n + 1), np.zeros(n), trap, parent, elevation)
    assert volume[n:].tolist() == [float(k * k) for k in range(2, n + 1)]
    assert sub[n : n + 2].tolist() == [2.0, 6.0] and sub[0] == 0


@pytest.mark.parametrize("seed", range(2))
def test_volumes_equal_joins(spark, seed, monkeypatch):
    ts = analyzed(spark, some(12, 12, seed, 30))
    got = {x["trap"]: (x["volume"], x["subvolume"]) for x in ts.volumes.collect()}
    monkeypatch.setattr(traps, "KERNEL_CELLS", -1)
    del ts.__dict__["volumes"]
    assert got == {x["trap"]: (x["volume"], x["subvolume"]) for x in ts.volumes.collect()} and got


def test_thinned_passes_give_the_same_nest(spark):
    ts = analyzed(spark, some(12, 12, 5, 30))
    rows = ts.adjacency.withColumnRenamed("dst", "dst_region").withColumn("dst", traps.F.col("dst_region")).toPandas()
    plain = lambda d: sorted(map(str, d.values.tolist()))
    last, thin = int(rows["src"].max()), traps._forest(rows)
    assert len(thin) < len(rows) and plain(traps._rounds(thin, last, 0)) == plain(traps._rounds(rows, last, 0))


def deep_basin(n):
    """One cell a region; trap n + k holds the regions up to k + 1 and spills towards the next one."""
    from tarnflow.operators.basin import Basin

    ids = np.arange(1, n + 1)
    cells = pd.DataFrame({"cell_id": ids, "z": 0.0, "region": ids, "dir": -1, "target": ids})
    elevation = np.array([1.0, *map(float, range(1, n)), *map(float, range(2, n + 1))])
    up = [n + 1, *range(n + 1, 2 * n), *range(n + 2, 2 * n), np.nan]
    volume, sub = traps.tree_volumes(ids, np.zeros(n), np.arange(1, 2 * n), np.array([p - 1 if p == p else -1 for p in up], dtype=int), elevation)
    frame = pd.DataFrame({"trap": np.arange(1, 2 * n), "parent": up, "elevation": elevation, "level": [0] * n + list(range(1, n)), "volume": volume, "subvolume": sub})
    return Basin(cells, frame.assign(downstream_region=0, current_region_cell=1, downstream_region_cell=1))


def test_flow_over_a_deep_nest():
    n = 6000
    began = time.time()
    b = deep_basin(n)
    runoff, _, off, used = b.watercourses(np.full(n, 3.0), np.full(n, 1.0), set(range(1, 2 * n)))
    assert time.time() - began < 3
    assert (off, used) == (2.0 * n, 1.0 * n) and len(b.footprint(2 * n - 2)) == n and b.chain(n) == [n - 1, 2 * n - 2]


def test_flow_over_very_many_full_traps():
    """Each full trap spills out by itself; the search for loops must not copy what it has seen."""
    n = 60_000
    b = deep_basin(n)
    began = time.time()
    _, _, off, used = b.watercourses(np.full(n, 3.0), np.full(n, 1.0), set(range(1, n + 1)))
    assert time.time() - began < 6
    assert (off, used) == (2.0 * n, 1.0 * n)
