"""Terrain queries over all traps, against brute force on a small raster."""

import pytest
from test_terrain import analyzed, some

from tarnflow.plans import terrain_queries as tq


@pytest.fixture
def small(spark, monkeypatch):
    ts = analyzed(spark, some(12, 12, 3, 30))
    monkeypatch.setattr(tq, "_structure", lambda *_: ts)
    sets: dict = {}
    for r in ts.members.collect():
        sets.setdefault(r["trap"], set()).add(r["region"])
    t = {r["trap"]: r for r in ts.traps.collect()}
    up = {a: min((b for b in sets if sets[a] < sets[b]), key=lambda b: len(sets[b]), default=None) for a in sets}
    assert any(up.values()) and max(map(len, sets.values())) > 2
    return ts, sets, t, up


def test_spill_graphs(spark, small):
    _, sets, t, up = small

    def name(k):
        return (min(sets[k]), len(sets[k]))

    def edge(k):
        return name(k) if k in sets else (k, 0)

    def graph(n):
        full = {k for k in sets if all(r % n for r in sets[k])}
        out = {}
        for k in full:
            p = up[k]
            if p and (p in full or all(c in full for c in up if up[c] == p)):
                out[k] = name(p)
            else:
                to = t[k]["downstream_region"]
                out[k] = edge(to if to > 0 else -1)
        return out

    cols = ("min_region", "n_regions", "target_region", "target_regions")
    rows = {tuple(r[c] for c in cols) for r in tq.saturated_spillgraph_all(spark, "").collect()}
    assert rows == {(*name(k), *(name(up[k]) if up[k] else edge(t[k]["downstream_region"]))) for k in sets}
    rows = {tuple(r[c] for c in cols) for r in tq.complete_spillgraph_all(spark, "").collect()}
    a, b = graph(5), graph(7)
    assert rows == {(*name(k), *v) for k, v in a.items()} and any(r[1] > 1 for r in rows)
    cols = (*cols[:2], "old_target_region", "old_target_regions", "new_target_region", "new_target_regions")
    rows = {tuple(r[c] for c in cols) for r in tq.update_spillgraph_all(spark, "").collect()}
    none = (None, None)
    assert rows == {(*name(k), *a.get(k, none), *b.get(k, none)) for k in a.keys() | b.keys() if a.get(k) != b.get(k)}


def test_level_tables_of_all_traps(spark, small):
    ts, sets, t, up = small
    cells = [(r["region"], r["z"]) for r in ts.regions.collect()]
    want = set()
    for k, own in sets.items():
        floor, top = max((t[c]["elevation"] for c in up if up[c] == k), default=-1.0), t[k]["elevation"]
        zs = [max(z, floor) for r, z in cells if r in own and z <= top]
        want |= {(min(own), len(own), z, sum(max(0.0, z - x) for x in zs)) for z in {*zs, top}}
    assert {tuple(r) for r in tq.zvol_tables_all(spark, "").collect()} == want
