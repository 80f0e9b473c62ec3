import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnflow.operators import field as fld
from tarnflow.operators import flat, flow, geometry, spill, traps
from tarnflow.operators import regions as reg
from tarnflow.operators.components import dense_numbers, minimum_labels
from tarnflow.sources import grid

BOWL = [[10, 10, 10, 10, 10], [10, 5, 5, 5, 10], [10, 5, 1, 5, 10], [10, 5, 5, 5, 10], [10, 10, 10, 10, 10]]
TWO = [[10] * 7, [10, 4, 4, 6, 3, 3, 10], [10, 4, 1, 6, 2, 3, 8], [10, 4, 4, 6, 3, 3, 10], [10] * 7]


def raster(spark, rows):
    cells = [(i + 1, j + 1, None if z is None else float(z)) for i, r in enumerate(rows) for j, z in enumerate(r)]
    return grid.raster_from_cells(spark.createDataFrame(cells, "i long, j long, z double"), len(rows), len(rows[0]))


_analyzed = {}


def analyzed(spark, rows):
    """The analysis of a raster, done once for all tests that only read it."""
    key = (spark.sparkContext.applicationId, str(rows))
    if key not in _analyzed:
        _analyzed[key] = traps.analyze(raster(spark, rows))
    return _analyzed[key]


def matrix(df, r, c):
    m = {(x["i"], x["j"]): x[c] for x in df.collect()}
    return [[m[i, j] for j in range(1, r.ncols + 1)] for i in range(1, r.nrows + 1)]


def some(rows, cols, seed, levels=9):
    rnd = random.Random(seed)
    return [[rnd.randrange(levels) for _ in range(cols)] for _ in range(rows)]


def brute_dirs(z, diagonals=True):
    n, m = len(z), len(z[0])
    out = []
    for i in range(n):
        row = []
        for j in range(m):
            s = {}
            for k in range(8 if diagonals else 4):
                a, b = i + fld.DI[k], j + fld.DJ[k]
                d = 2**0.5 if k > 3 else 1.0
                if 0 <= a < n and 0 <= b < m:
                    s[k] = (z[a][b] - z[i][j]) * (1 / d)
            for k in range(8 if diagonals else 4):
                if k not in s and fld.OPPOSITE[k] in s and 0 <= i + fld.DI[fld.OPPOSITE[k]] < n and 0 <= j + fld.DJ[fld.OPPOSITE[k]] < m:
                    s[k] = -s[fld.OPPOSITE[k]]
            if diagonals and 4 not in s:
                s.pop(6, None), s.pop(7, None)
            best = min(s.items(), key=lambda x: (x[1], x[0]))
            row.append(best[0] if best[1] < 0 else -1)
        out.append(row)
    return out


def test_bowl(spark):
    ts = analyzed(spark, BOWL)
    r = ts.raster
    assert matrix(ts.field, r, "dir") == [[5, 1, 1, 1, -1], [3, 5, 1, 6, 2], [3, 3, -1, 2, 2], [3, 7, 0, 4, 2], [-1, 0, 0, 0, 4]]
    assert matrix(fld.spill_field(r, diagonals=False), r, "dir") == [[-1, 1, 1, 1, -1], [3, -1, 1, -1, 2], [3, 3, -1, 2, 2], [3, -1, 0, -1, 2], [-1, 0, 0, 0, -1]]
    p = ts.spillpoints.first()
    assert (p["downstream_region"], p["current_region_cell"], p["downstream_region_cell"], p["elevation"]) == (-1, 4, 5, 10.0)
    assert ts.volumes.first()["volume"] == 49.0 and ts.footprints.count() == 23
    assert ts.regions.groupBy("region").count().filter("region = 1").first()["count"] == 23


def test_two_pits(spark):
    ts = analyzed(spark, TWO)
    t = {x["trap"]: x for x in ts.traps.join(ts.volumes, "trap").collect()}
    got = {k: (x["elevation"], x["downstream_region"], x["current_region_cell"], x["downstream_region_cell"], x["parent"], x["volume"], x["subvolume"]) for k, x in t.items()}
    assert got == {1: (6.0, 2, 17, 22, 3, 15.0, 0.0), 2: (6.0, 1, 22, 17, 3, 19.0, 0.0), 3: (8.0, 0, 33, 33, None, 64.0, 34.0)}
    assert {x["trap"]: x["n"] for x in ts.footprints.groupBy("trap").agg(F.count("*").alias("n")).collect()} == {1: 9, 2: 6, 3: 16}
    assert (ts.numregions(), ts.numtraps()) == (2, 3)
    assert {x["trap"] for x in ts.subtrapsof(3).collect()} == {1, 2} and ts.parentof(1).first()["parent"] == 3
    assert {x["trap"] for x in flow.all_subtraps_of(ts, [3]).collect()} == {1, 2}
    assert {x["trap"] for x in flow.all_subtraps_of(ts, [3, 1]).collect()} == {1, 2}  # 1 lies below 3
    assert {(x["region"], tuple(x["traps"])) for x in ts.supertraps.collect()} == {(1, (1, 3)), (2, (2, 3))}


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("diagonals", [True, False])
def test_directions_against_brute_force(spark, seed, diagonals):
    z = some(5 + seed, 6, seed, 5)
    r = raster(spark, z)
    assert matrix(fld.spill_field(r, diagonals=diagonals), r, "dir") == brute_dirs(z, diagonals)


def test_masks_and_voids(spark):
    r = raster(spark, [[3, 2, 3], [2, 1, None], [3, 2, 3]])
    ij = lambda *c: spark.createDataFrame(list(c), "i long, j long")
    f = fld.spill_field(r, buildings=ij((1, 1), (2, 2), (None, 1)), sinks=ij((2, 2), (9, 9)))
    d = matrix(f, r, "dir")
    assert d[0][0] == -2 and d[1][1] == -3 and d[1][2] is None
    g = reg.spill_regions(f, r)
    m = matrix(g, r, "region")
    assert m[0][0] == 0 and m[1][2] == 0 and m[1][1] < 0


def test_update_and_concatenation_equal_whole(spark):
    z = np.array(some(8, 9, 3, 30))
    r = raster(spark, z.tolist())
    whole = {x["cell_id"]: (x["dir"], x["slope"]) for x in fld.spill_field(r).collect()}
    for axis in (0, 1):
        a, b = np.split(z, [4], axis=axis)
        ra, rb = raster(spark, a.tolist()), raster(spark, b.tolist())
        join = fld.vconcat_fields if axis == 0 else fld.hconcat_fields
        got, _ = join(fld.spill_field(ra), ra, fld.spill_field(rb), rb)
        assert {x["cell_id"]: (x["dir"], x["slope"]) for x in got.collect()} == whole
    z2 = z.copy()
    z2[3:5, 3:6] += 7
    r2, dom = raster(spark, z2.tolist()), grid.Domain(4, 5, 4, 6)
    old = fld.spill_field(r)
    new = fld.update_spill_field(old, r2, dom)
    fresh = fld.spill_field(r2)
    assert {x["cell_id"]: x["dir"] for x in new.collect()} == {x["cell_id"]: x["dir"] for x in fresh.collect()}
    upd, pairs = reg.update_spill_regions(reg.spill_regions(old, r), new, r2, dom)
    assert {x["cell_id"]: x["region"] for x in upd.collect()} == {x["cell_id"]: x["region"] for x in reg.spill_regions(fresh, r2).collect()}
    assert pairs.count() > 0


def test_tiles_do_not_change_regions(spark):
    r = raster(spark, some(20, 17, 8, 6))
    f = fld.spill_field(r)
    a, b = (matrix(reg.spill_regions(f, r, tile=t), r, "region") for t in (256, 5))
    assert a == b


def test_flat_raster_is_one_outside_region(spark):
    r = raster(spark, [[1] * 4] * 3)
    ts = traps.analyze(r)
    assert {x["region"] for x in ts.regions.collect()} == {-1} and ts.numtraps() == 0
    assert flow.mass_balance(flow.watercourses(ts)[2])
    with pytest.raises(ValueError):
        fld.spill_field(raster(spark, [[1, 2, 3]]))


@pytest.mark.parametrize("seed", range(3))
def test_hierarchy_invariants_and_kernel(spark, seed):
    ts = traps.analyze(raster(spark, some(12, 12, seed, 40)))
    rounds = traps.trap_hierarchy(ts.adjacency, ts.spillpoints, kernel_rows=0)
    cols = sorted(ts.traps.columns)
    assert sorted(map(str, ts.traps.select(*cols).collect())) == sorted(map(str, rounds.select(*cols).collect()))
    assert sorted(map(tuple, ts.members.collect())) == sorted(map(tuple, traps.trap_regions(ts.traps, kernel_rows=0).collect()))
    v = {x["trap"]: (x["volume"], x["subvolume"]) for x in ts.volumes.collect()}
    assert all(s <= w + 1e-9 for w, s in v.values())
    e = {x["trap"]: (x["elevation"], x["parent"]) for x in ts.traps.collect()}
    assert all(p is None or e[p][0] >= z for z, p in e.values())


def test_large_regions_are_salted(spark):
    ts = traps.analyze(raster(spark, some(12, 12, 3, 30)))
    for f in (traps.trap_volumes, traps.trap_footprints):
        a, b = (sorted(map(tuple, f(ts.regions, ts.traps, ts.members, n).collect())) for n in (10**6, -1))
        assert a == b and a


@pytest.mark.parametrize("full", ["none", "low", "all"])
def test_mass_balance(spark, full):
    ts = analyzed(spark, some(10, 11, 4, 30))
    chosen = {"none": ts.traps.limit(0), "low": ts.traps.filter("level = 0"), "all": ts.traps}[full]
    for infil in (0.0, 0.3):
        _, _, totals = flow.watercourses(ts, chosen.select("trap"), infiltration=infil)
        assert flow.mass_balance(totals)


def test_watercourses_of_two_pits(spark):
    ts = analyzed(spark, TWO)
    accum = lambda full: {x["region"]: x["region_accum"] for x in flow.watercourses(ts, full)[1].collect()}
    assert accum([]) == {1: 17.0, 2: 16.0}
    assert accum([1]) == {1: 0.0, 2: 33.0}
    assert accum([1, 2]) == {1: 17.0, 2: 16.0}  # they spill into each other
    assert accum([1, 2, 3]) == {1: 0.0, 2: 0.0}


def test_accumulation_equals_kernel(spark):
    ts = traps.analyze(raster(spark, some(9, 9, 6, 20)))
    a = {x["cell_id"]: x["total"] for x in flow.accumulate_flow(ts.field, ts.raster).collect()}
    dry = flow.watercourses(ts)
    kernel = flow.watercourses(ts, ts.traps.limit(0).select("trap"))
    for x, y in zip(dry, kernel, strict=True):
        assert sorted(map(tuple, x.select(*y.columns).collect())) == sorted(map(tuple, y.collect()))
    assert a == {x["cell_id"]: x["runoff"] for x in dry[0].collect()}


def test_upstream(spark):
    ts = analyzed(spark, TWO)
    assert {x["region"] for x in flow.all_upstream_regions(ts, 1).collect()} == {1, 2}
    assert flow.upstream_area(ts, 13).count() == 17  # inside the first pond
    assert flow.upstream_area(ts, 13, local_only=False).count() == 33
    assert {x["cell_id"] for x in flow.upstream_area(ts, 1).collect()} >= {1}
    colors = {x["color"] for x in flow.region_selection(ts, region_color=-5).collect()}
    assert 2 in colors and 5 in colors
    assert flow.draining_into(spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "node long, target long"), spark.createDataFrame([(9,)], "node long")).collect()[0]["node"] == 9


def test_flat_areas(spark):
    r = raster(spark, [[1, 1, 1, 9], [1, 1, 1, 9], [5, 7, 9, 30]])
    got = {x["cell_id"] for x in flat.identify_flat_areas(r, 0.01, 3).filter("is_flat").collect()}
    assert got == {1, 2, 4, 5, 7, 8}
    mask = r.cells.filter("z >= 5")
    level = flat.flatten_grid(r, mask, "max", edge_quirk=False)
    assert level.cells.filter("z = 30").count() == 6 and level.cells.filter("z = 1").count() == 6
    assert flat.flatten_grid(r, mask.limit(0), "mean").cells.filter("z = 30").count() == 1


def test_grid_files_and_tiles(spark, tmp_path):
    r = raster(spark, some(4, 5, 1))
    grid.save_grid(r, str(tmp_path / "g"))
    text = "\n".join(x["value"] for x in spark.read.text(str(tmp_path / "g")).coalesce(1).collect())
    (tmp_path / "one.txt").write_text(text + "\n")
    again = grid.load_grid(spark, str(tmp_path / "one.txt"))
    assert (again.nrows, again.ncols) == (4, 5)
    assert sorted(map(tuple, again.cells.collect())) == sorted(map(tuple, r.cells.collect()))
    wide = raster(spark, some(60, 7, 2))
    grid.save_grid(wide, str(tmp_path / "w"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")  # every split holds a few lines
    try:
        again = grid.load_grid(spark, str(tmp_path / "w"))
        assert sorted(map(tuple, again.cells.collect())) == sorted(map(tuple, wide.cells.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "bad.txt").write_text("1,2\n3\n")
    with pytest.raises(ValueError):
        grid.load_grid(spark, str(tmp_path / "bad.txt"))
    doms, xs, ys = grid.tile_domain(r.domain, 2, 2)
    assert xs == [1, 3, 5] and ys == [1, 3, 6] and [d.size() for d in doms] == [(2, 2), (2, 2), (2, 3), (2, 3)]
    assert grid.with_tiles(r.cells, doms).count() == 20
    with pytest.raises(ValueError):
        grid.split_points(1, 3, 4)


def test_mesh(spark):
    m = geometry.mesh_geometry(raster(spark, [[0, 1], [0, 1], [0, 1]]), height=2.0)
    x = m.filter("i = 1 and j = 2").first()
    assert x["z"] == 2.0 and x["y"] == 2.0 and abs(x["nx"] ** 2 + x["ny"] ** 2 + x["nz"] ** 2 - 1) < 1e-12
    assert geometry.mesh_faces(3, 2, spark).count() == 2


def test_components_and_numbers(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(70)]
    df = spark.createDataFrame(edges, "u long, v long")
    a, b = (sorted(map(tuple, minimum_labels(df, kernel_edges=k).collect())) for k in (10**6, 0))
    assert a == b
    nums = dense_numbers(spark.createDataFrame([(x,) for x in (5, 70000, 3, 10**9)], "x long"), "x")
    assert {x["x"]: x["number"] for x in nums.collect()} == {3: 1, 5: 2, 70000: 3, 10**9: 4}
    mapped = reg.remap(spark.createDataFrame([(1,), (2,), (None,)], "region long"), spark.createDataFrame([(1, 9)], "old long, new long"))
    assert {x["region"] for x in mapped.collect()} == {9, 2, None}


def test_boundary_passes(spark):
    r = raster(spark, TWO)
    g = reg.spill_regions(fld.spill_field(r), r)
    b = spill.region_boundaries(g, r)
    assert b.filter("src = 1 and dst = 2").agg(F.min("z_pass")).first()[0] == 6.0
    # the rim has 20 cells, two of them belong to outside catchments
    assert b.filter("dst = 0").count() == 18
