"""Terrain queries over the fixture raster. Traps are named by content (least region, number of regions)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnflow.functions.runtime import Scratch, broadcast_if_small, shared_dir, table
from tarnflow.operators import dynamics as dyn
from tarnflow.operators import field as fld
from tarnflow.operators import flat, flow, geometry, spill, traps
from tarnflow.operators import regions as reg
from tarnflow.sources import fixture as fx
from tarnflow.sources import grid

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _raster(spark: SparkSession, d: str) -> grid.Raster:
    r = fx.fixture_raster(spark, d)
    return r.with_cells(Scratch(spark, "dem").put(r.cells))


def _field(spark: SparkSession, d: str, **kw) -> tuple[DataFrame, grid.Raster]:
    r = _raster(spark, d)
    return fld.spill_field(r, **kw), r


def _structure(spark: SparkSession, d: str, **kw) -> traps.TrapStructure:
    return traps.analyze(_raster(spark, d), **kw)


def _edited(r: grid.Raster) -> tuple[grid.Raster, grid.Domain]:
    """Heights of a square in the middle transposed."""
    a, b = r.nrows // 3, r.nrows // 2
    dom = grid.Domain(a, b, a, b)
    inside = r.cells.filter(dom.contains()).select((F.col("j") - a + a).alias("i"), (F.col("i") - a + a).alias("j"), F.col("z").alias("new_z"))
    cells = r.cells.join(inside, ["i", "j"], "left").select("cell_id", "i", "j", F.coalesce("new_z", "z").alias("z"))
    return r.with_cells(Scratch(cells.sparkSession, "dem").put(cells)), dom


def _keys(ts: traps.TrapStructure) -> DataFrame:
    return ts.members.groupBy("trap").agg(F.min("region").alias("min_region"), F.count("*").alias("n_regions"))


def _named(ts: traps.TrapStructure, edges: DataFrame, *targets: str) -> DataFrame:
    """Edges of traps with the trap and its targets by content; a target outside keeps its number, with 0 regions."""
    k, out = _keys(ts), edges.join(_keys(ts), "trap")
    for c in targets:
        to = k.select(F.col("trap").alias(c), F.col("min_region").alias(f"{c}_region"), F.col("n_regions").alias(f"{c}_regions"))
        out = out.join(to, c, "left")
        out = out.withColumn(f"{c}_region", F.coalesce(f"{c}_region", c)).withColumn(f"{c}_regions", F.when(F.col(c).isNotNull(), F.coalesce(f"{c}_regions", F.lit(0).cast("long"))))
    return out.drop("trap", *targets)


def _filled(ts: traps.TrapStructure, n: int) -> DataFrame:
    """A valid fill state of traps of all levels: those without a region divisible by n."""
    return ts.members.groupBy("trap").agg(F.every(F.col("region") % n != 0).alias("is_full")).filter("is_full").select("trap")


# ------------------------------------------------------------------ sources, directions


@query
def dem_cells(spark, d):
    return _raster(spark, d).cells


@query
def grid_roundtrip(spark, d):
    r = _raster(spark, d)
    path = f"{shared_dir(spark)}/roundtrip-{spark.sparkContext.applicationId}-{abs(hash(d))}"
    grid.save_grid(r, path, numbered=True)
    return grid.load_grid_parts(spark, path).cells


@query
def grid_scan(spark, d):
    """Lines without numbers, written in several files and read in parallel splits."""
    r = _raster(spark, d)
    path = f"{shared_dir(spark)}/scan-{spark.sparkContext.applicationId}-{abs(hash(d))}"
    grid.save_grid(r, path)
    return grid.load_grid(spark, path).cells


@query
def tile_stats(spark, d):
    r = _raster(spark, d)
    doms, _, _ = grid.tile_domain(r.domain, 4, 3)
    return grid.with_tiles(r.cells, doms).groupBy("tile").agg(F.count("*").alias("n"), F.min("z").alias("low"), F.max("z").alias("high"))


@query
def spillfield_d8(spark, d):
    return _field(spark, d)[0].select("cell_id", "dir", "slope")


@query
def spillfield_d4(spark, d):
    return _field(spark, d, diagonals=False)[0].select("cell_id", "dir", "slope")


@query
def spillfield_masked(spark, d):
    r = _raster(spark, d)
    return fld.spill_field(r, buildings=fx.buildings(r), sinks=fx.sinks(r)).select("cell_id", "dir", F.when(~F.isnan("slope"), F.col("slope")).alias("slope"))


@query
def spillfield_update(spark, d):
    r = _raster(spark, d)
    new, dom = _edited(r)
    return fld.update_spill_field(fld.spill_field(r), new, dom).select("cell_id", "dir", "slope")


def _halves(spark, d, axis):
    r = _raster(spark, d)
    at = r.nrows // 2
    n, m = (at, r.ncols) if axis == "i" else (r.nrows, at)
    a = grid.raster_from_cells(r.cells.filter(F.col(axis) <= at), n, m)
    n, m = (r.nrows - at, r.ncols) if axis == "i" else (r.nrows, r.ncols - at)
    b = grid.raster_from_cells(r.cells.filter(F.col(axis) > at).withColumn(axis, F.col(axis) - at), n, m)
    return a, b


@query
def spillfield_vconcat(spark, d):
    a, b = _halves(spark, d, "i")
    return fld.vconcat_fields(fld.spill_field(a), a, fld.spill_field(b), b)[0].select("cell_id", "dir", "slope")


@query
def spillfield_hconcat(spark, d):
    a, b = _halves(spark, d, "j")
    return fld.hconcat_fields(fld.spill_field(a), a, fld.spill_field(b), b)[0].select("cell_id", "dir", "slope")


@query
def dir_histogram(spark, d):
    return _field(spark, d)[0].groupBy("dir").agg(F.count("*").alias("n"))


@query
def exit_cells(spark, d):
    f, r = _field(spark, d)
    return f.filter(fld.is_exit(r.nrows, r.ncols)).select("cell_id")


@query
def flow_edges(spark, d):
    return fld.flow_edges(*_field(spark, d))


@query
def flat_edges(spark, d):
    return fld.flat_edges(_field(spark, d)[0])


def _mosaic(spark, d):
    """(raster of the windows of all grids of ``cells`` side by side, with a free column between them so that
    no cell has a neighbour in another grid; (grid_id, cell, i, j, dir) of its cells). Repeated cells count once;
    every cell has the size of its grid's cells, of differing ones the greatest."""
    meta = table(spark, d, "grid_meta").groupBy("grid_id").agg(F.max(F.col("len_x") / F.col("nrows")).alias("dx"), F.max(F.col("len_y") / F.col("ncols")).alias("dy"))
    scratch = Scratch(spark, "mosaic")
    one = scratch.put(table(spark, d, "cells").groupBy("grid_id", F.col("cell_id").alias("cell")).agg(*[F.min(c).alias(c) for c in ("i", "j", "z", "dir")]))
    box = one.groupBy("grid_id").agg(F.min("i").alias("i0"), F.min("j").alias("j0"), (F.max("i") - F.min("i") + 1).alias("h"), (F.max("j") - F.min("j") + 2).alias("w"))
    before = F.sum("w").over(Window.orderBy("grid_id").rowsBetween(Window.unboundedPreceding, -1))  # one row a grid
    box = scratch.put(box.withColumn("off", F.coalesce(before, F.lit(0))).join(meta, "grid_id", "left"))
    n, nrows, ncols = box.agg(F.count("*"), F.max("h"), F.sum("w")).first()
    placed = one.join(broadcast_if_small(box, n), "grid_id").select("grid_id", "cell", (F.col("i") - F.col("i0") + 1).alias("i"), (F.col("j") - F.col("j0") + F.col("off") + 1).alias("j"), "z", "dir", "dx", "dy")
    placed = scratch.put(placed)
    cells = placed.withColumn("cell_id", F.col("i") + (F.col("j") - 1) * nrows).select("cell_id", "i", "j", "z", "dx", "dy")
    return grid.Raster(cells, nrows, ncols), placed


@query
def grid_directions(spark, d):
    """Direction and slope of the cells of all grids, with their voids and buildings."""
    r, placed = _mosaic(spark, d)
    f = fld.spill_field(r, buildings=placed.filter(F.col("dir") == fld.BUILDING).select("i", "j"))
    return placed.select("grid_id", F.col("cell").alias("cell_id"), "i", "j").join(f.select("i", "j", "dir", F.when(~F.isnan("slope"), F.col("slope")).alias("slope")), ["i", "j"]).drop("i", "j")


# ------------------------------------------------------------------ catchments, traps


@query
def spill_regions(spark, d):
    return reg.spill_regions(*_field(spark, d)).select("cell_id", "region")


@query
def spill_regions_tiled(spark, d):
    return reg.spill_regions(*_field(spark, d), tile=16).select("cell_id", "region")


@query
def spill_regions_update(spark, d):
    r = _raster(spark, d)
    old_field = fld.spill_field(r)
    old = reg.spill_regions(old_field, r)
    new, dom = _edited(r)
    return reg.update_spill_regions(old, fld.update_spill_field(old_field, new, dom), new, dom)[0].select("cell_id", "region")


@query
def region_reindex(spark, d):
    """Old and new numbers of the regions that share cells before and after the update."""
    r = _raster(spark, d)
    old_field = fld.spill_field(r)
    new, dom = _edited(r)
    return reg.update_spill_regions(reg.spill_regions(old_field, r), fld.update_spill_field(old_field, new, dom), new, dom)[1]


@query
def region_remap(spark, d):
    """Regions renumbered by a table: those of even number swap sign, the others stay."""
    regions = reg.spill_regions(*_field(spark, d))
    pairs = regions.select("region").distinct().filter("region % 2 = 0").select(F.col("region").alias("old"), (-F.col("region")).alias("new"))
    return reg.remap(regions.select("cell_id", "region"), pairs)


@query
def region_sizes(spark, d):
    return reg.spill_regions(*_field(spark, d)).groupBy("region").agg(F.count("*").alias("n_cells"))


@query
def region_adjacency(spark, d):
    f, r = _field(spark, d)
    return spill.region_adjacency(reg.spill_regions(f, r), r).select("src", "dst", "z_pass", "cell", "ncell")


@query
def spillpoints(spark, d):
    f, r = _field(spark, d)
    g = reg.spill_regions(f, r)
    return spill.spill_points(g, spill.region_adjacency(g, r))


@query
def trap_summary(spark, d):
    """The flagship: every trap with its level, volumes and footprint."""
    ts = _structure(spark, d)
    foot = ts.footprints.groupBy("trap").agg(F.count("*").alias("n_cells"))
    out = _keys(ts).join(ts.traps.select("trap", "elevation"), "trap").join(ts.volumes, "trap").join(foot, "trap", "left")
    return out.select("min_region", "n_regions", "elevation", "volume", "subvolume", F.coalesce("n_cells", F.lit(0)).alias("n_cells"))


@query
def trap_parents(spark, d):
    ts = _structure(spark, d)
    k = _keys(ts)
    up = k.select(F.col("trap").alias("parent"), F.col("n_regions").alias("parent_regions"), F.col("min_region").alias("parent_min_region"))
    return k.join(ts.traps.select("trap", "parent"), "trap").join(up, "parent", "left").select("min_region", "n_regions", "parent_min_region", "parent_regions")


@query
def toplevel_traps(spark, d):
    ts = _structure(spark, d)
    return _keys(ts).join(ts.toplevel(), "trap").select("min_region", "n_regions")


@query
def supertraps_of(spark, d):
    """The traps that hold each region, by content, the innermost first."""
    ts = _structure(spark, d)
    each = ts.supertraps.select("region", F.explode("traps").alias("trap")).join(_keys(ts), "trap")
    named = F.array_sort(F.collect_list(F.struct("n_regions", "min_region")))
    return each.groupBy("region").agg(F.array_join(F.transform(named, lambda x: F.concat_ws(":", x.min_region, x.n_regions)), " ").alias("traps"))


@query
def subtraps_closure(spark, d):
    ts = _structure(spark, d)
    below = flow.all_subtraps_of(ts, ts.toplevel())
    return _keys(ts).join(below, "trap").select("min_region", "n_regions")


@query
def subtraps_nested(spark, d):
    """All traps below the merged ones whose least region is no multiple of 3, which lie below each other."""
    ts = _structure(spark, d)
    roots = _keys(ts).filter("n_regions > 1 and min_region % 3 <> 0")
    return _keys(ts).join(flow.all_subtraps_of(ts, roots), "trap").select("min_region", "n_regions")


@query
def trap_footprints(spark, d):
    ts = _structure(spark, d)
    return _keys(ts).join(ts.footprints, "trap").select("min_region", "n_regions", "cell_id")


@query
def trap_spillpoints(spark, d):
    """Where every trap pours over, with all outside catchments merged into one."""
    ts = _structure(spark, d, merge_outregions=True)
    return _keys(ts).join(ts.traps, "trap").select("min_region", "n_regions", "elevation", "downstream_region", "current_region_cell", "downstream_region_cell")


@query
def trap_counts(spark, d):
    ts = _structure(spark, d)
    return ts.traps.agg(F.sum(F.when(F.col("level") == 0, 1).otherwise(0)).alias("numregions"), F.count("*").alias("numtraps"))


@query
def merged_outregions(spark, d):
    ts = _structure(spark, d, merge_outregions=True)
    return ts.regions.groupBy("region").agg(F.count("*").alias("n_cells"))


@query
def masked_analysis(spark, d):
    r = _raster(spark, d)
    ts = traps.analyze(r, buildings=fx.buildings(r), sinks=fx.sinks(r))
    return _keys(ts).join(ts.traps.select("trap", "elevation"), "trap").join(ts.volumes, "trap").select("min_region", "n_regions", "elevation", "volume", "subvolume")


# ------------------------------------------------------------------ flow


@query
def flow_accumulation(spark, d):
    return flow.accumulate_flow(*_field(spark, d)).select("cell_id", F.col("total").cast("long").alias("total"))


@query
def region_inflow(spark, d):
    _, accum, _ = flow.watercourses(_structure(spark, d))
    return accum


@query
def watercourses_infil(spark, d):
    ts = _structure(spark, d)
    return flow.watercourses(ts, precipitation=2.0, infiltration=fx.infiltration(ts.raster))[0]


@query
def overflow_full_traps(spark, d):
    ts = _structure(spark, d)
    return flow.watercourses(ts, ts.toplevel())[2]


def _half_full(spark, d):
    ts = _structure(spark, d)
    return flow.watercourses(ts, ts.traps.filter("level = 0").select("trap"), precipitation=2.0, infiltration=fx.infiltration(ts.raster))


@query
def watercourses_half_full(spark, d):
    """Totals with every lowest trap full, no merged one."""
    return _half_full(spark, d)[2]


@query
def runoff_half_full(spark, d):
    return _half_full(spark, d)[0]


@query
def inflow_half_full(spark, d):
    return _half_full(spark, d)[1]


@query
def saturated_spillgraph_all(spark, d):
    """The edges of all traps, those to parents included."""
    ts = _structure(spark, d)
    return _named(ts, flow.saturated_spill_graph(ts), "target")


@query
def complete_spillgraph_all(spark, d):
    ts = _structure(spark, d)
    return _named(ts, dyn.complete_spill_graph(ts, _filled(ts, 5)), "target")


@query
def update_spillgraph_all(spark, d):
    ts = _structure(spark, d)
    return _named(ts, dyn.update_spill_graph(ts, _filled(ts, 5), _filled(ts, 7)), "old_target", "new_target")


@query
def invalid_full_traps(spark, d):
    """Full traps with a child that is not full, in a state that is full where the least region is even."""
    ts = _structure(spark, d)
    bad = dyn.invalid_full_traps(ts, _keys(ts).filter("min_region % 2 = 0").select("trap"))
    return _keys(ts).join(bad, "trap").select("min_region", "n_regions")


@query
def upstream_cells(spark, d):
    f, r = _field(spark, d)
    goals = f.filter("i % 25 = 0 and j % 25 = 0").select(F.col("cell_id").alias("node"))
    return flow.draining_into(fld.flow_edges(f, r), goals, "cell_id", "target").select(F.col("node").alias("cell_id"))


def _largest(ts) -> int:
    return ts.regions.filter("region > 0").groupBy("region").agg(F.count("*").alias("n")).agg(F.max_by("region", F.struct("n", "region"))).first()[0]


def _upstream(ts, cell):
    return flow.upstream_area(ts, cell, local_only=False)


@query
def upstream_area(spark, d):
    ts = _structure(spark, d)
    return _upstream(ts, ts.regions.filter("region > 0").agg(F.max_by("cell_id", F.struct("z", "cell_id"))).first()[0])


@query
def upstream_area_river(spark, d):
    """Upstream of the dry cell that most cells drain through."""
    ts = _structure(spark, d)
    top = ts.members.join(ts.toplevel(), "trap").join(ts.traps.select("trap", "elevation"), "trap").select("region", "elevation")
    dry = ts.regions.join(top, "region").filter("z > elevation").join(flow.accumulate_flow(ts.field, ts.raster), "cell_id")
    return _upstream(ts, dry.agg(F.max_by("cell_id", F.struct("total", "cell_id"))).first()[0])


@query
def upstream_area_pond(spark, d):
    """Upstream of the lowest cell of the region with most cells."""
    ts = _structure(spark, d)
    return _upstream(ts, ts.regions.filter(F.col("region") == _largest(ts)).agg(F.min_by("cell_id", F.struct("z", "cell_id"))).first()[0])


@query
def upstream_regions(spark, d):
    """The regions whose water reaches the region with most cells once everything is full."""
    ts = _structure(spark, d)
    return flow.all_upstream_regions(ts, _largest(ts))


@query
def region_selection(spark, d):
    return flow.region_selection(_structure(spark, d))


# ------------------------------------------------------------------ flat areas, geometry


@query
def flat_areas(spark, d):
    return flat.identify_flat_areas(_raster(spark, d), 0.02, 3)


@query
def mask_clusters(spark, d):
    r = _raster(spark, d)
    return flat.mask_clusters(r.cells.filter("z >= 160000").select("cell_id", "i", "j"), r)


def _flattened(spark, d, height):
    r = _raster(spark, d)
    return flat.flatten_grid(r, r.cells.filter("z >= 160000").select("cell_id", "i", "j"), height).cells.select("cell_id", "z")


@query
def flatten_min(spark, d):
    return _flattened(spark, d, "min")


@query
def flatten_max(spark, d):
    return _flattened(spark, d, "max")


@query
def flatten_mean(spark, d):
    return _flattened(spark, d, "mean")


@query
def mesh_geometry(spark, d):
    out = geometry.mesh_geometry(_raster(spark, d), downsample=2.0, height=0.5)
    return out.select("i", "j", "z", *[F.round(c, 9).alias(c) for c in ("x", "y", "u", "v", "nx", "ny", "nz")])


@query
def mesh_faces(spark, d):
    r = _raster(spark, d)
    return geometry.mesh_faces(r.nrows, r.ncols, spark)


# ------------------------------------------------------------------ dynamics


@query
def zvol_tables_all(spark, d):
    """The level tables of all traps, merged ones from the spill level of their children."""
    ts = _structure(spark, d)
    return dyn.level_tables(ts).join(_keys(ts), "trap").select("min_region", "n_regions", "z", "volume")


@query
def fill_sequence_events(spark, d):
    return dyn.fill_sequence(_structure(spark, d), [(0.0, 1.0)]).events


@query
def fill_sequence_infil(spark, d):
    ts = _structure(spark, d)
    return dyn.fill_sequence(ts, [(0.0, 2.0), (500.0, 0.0)], infiltration=fx.infiltration(ts.raster)).trap_log


@query
def trap_states(spark, d):
    ts = _structure(spark, d)
    return dyn.trap_states_at(ts, dyn.fill_sequence(ts, [(0.0, 1.0)], timepoints=[100.0, 500.0, 2000.0]))


@query
def timeseries_raster(spark, d):
    ts = _structure(spark, d)
    return dyn.interpolate_timeseries(ts, dyn.fill_sequence(ts, [(0.0, 1.0)], timepoints=[100.0, 1000.0]))


@query
def flow_rates(spark, d):
    ts = _structure(spark, d)
    return dyn.compute_flow(ts, ts.volumes.filter("volume = 0").select("trap"), precipitation=2.0, infiltration=fx.infiltration(ts.raster))[0]


def _event_log(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    kind = e.agg(F.min("event_type")).first()[0]
    return e.withColumn("value", F.when(F.col("event_type") != kind, F.col("value")))


@query
def event_states(spark, d):
    """The change log with every missing value filled in from the last one before it."""
    return dyn.filled_in(_event_log(spark, d), ["user_id"], ["value"], ["ts", "event_id"]).select("user_id", "event_id", "value")


@query
def event_last(spark, d):
    log = _event_log(spark, d).withColumn("o", F.struct("ts", "event_id"))
    return dyn.reconstruct(log, "user_id", "value", order="o")


@query
def asof_state(spark, d):
    log = _event_log(spark, d).withColumn("t", F.col("ts"))
    times = log.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(F.explode(F.sequence(F.date_trunc("day", "a"), F.date_trunc("day", "b"), F.expr("interval 7 days"))).alias("tp"))
    return dyn.as_of(log, times, "user_id", order="event_id").select(F.col("tp").cast("string").alias("tp"), "user_id", "event_id")
