"""Steady-state flow, reachability on the spill graph, and the split of a terrain into basins."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.functions.runtime import Scratch
from tarnflow.operators.basin import Basin
from tarnflow.operators.field import flow_edges, target_cell
from tarnflow.operators.traps import TrapStructure

#: Basins of fewer cells share a task with others, up to about so many cells together.
SMALL_BASIN, TASK_CELLS = 50_000, 200_000
_CELLS = ["basin", "cell_id", "z", "region", "dir", "target"]
_TRAPS = ["basin", "trap", "parent", "elevation", "downstream_region", "current_region_cell", "downstream_region_cell", "level", "volume", "subvolume"]


def saturated_spill_graph(ts: TrapStructure) -> DataFrame:
    """(trap, target): the parent where there is one, else the downstream region (0 or less leaves)."""
    return ts.traps.select("trap", F.coalesce("parent", "downstream_region").alias("target"))


def accumulate_flow(field: DataFrame, raster, weights: DataFrame | None = None) -> DataFrame:
    """(cell_id, total): the weight of each cell and of all cells that drain through it.

    Doubling: after round k a cell holds everything less than 2^k steps upstream, so rounds are the
    logarithm of the longest path. For weights that are nowhere negative; without a table all are 1.
    Masked cells have their own weight.
    """
    scratch = Scratch(field.sparkSession, "accumulate")
    down = flow_edges(field, raster).withColumnRenamed("target", "to")
    w = field.select("cell_id", F.lit(1.0).alias("total")) if weights is None else field.select("cell_id").join(weights.select("cell_id", F.col(weights.columns[1]).cast("double").alias("total")), "cell_id", "left").fillna(0.0, ["total"])
    state = scratch.put(w.join(down, "cell_id", "left"))
    while state.filter("to is not null").limit(1).count():
        got = state.filter("to is not null").groupBy(F.col("to").alias("cell_id")).agg(F.sum("total").alias("more"))
        hop = state.select(F.col("cell_id").alias("to"), F.col("to").alias("next"))
        nxt = scratch.put(state.join(got, "cell_id", "left").join(hop, "to", "left").select("cell_id", (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"), F.col("next").alias("to")))
        scratch.drop(state)
        state = nxt
    return state.select("cell_id", "total")


def basins(ts: TrapStructure) -> DataFrame:
    """(region, basin): independent parts of the spill graph. Two traps belong together if one spills
    into the other or both pour over the same outside catchment; the outside itself joins nothing."""
    return ts.sizes.select("region", "basin")


def basin_frames(ts: TrapStructure, extra: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(cells, traps) of all basins for the array kernels; ``extra`` adds columns by cell_id.

    The key ``basin`` names a task: a large basin of its own, or many small ones that do not touch.
    """
    spark = ts.traps.sparkSession
    scratch = Scratch(spark, "basins")
    size = ts.sizes.select("region", F.col("basin").alias("part"), "n")
    total = size.agg(F.sum("n")).first()[0] or 0
    packs = max(2 * spark.sparkContext.defaultParallelism, -(-total // TASK_CELLS))
    whole = size.groupBy("part").agg(F.sum("n").alias("cells"))
    name = F.when(F.col("cells") < SMALL_BASIN, F.concat(F.lit("pack "), F.pmod(F.xxhash64("part"), F.lit(packs)))).otherwise(F.concat(F.lit("basin "), F.col("part")))
    named = scratch.put(whole.select("part", name.alias("basin")))
    parts = scratch.put(size.join(named, "part").select("region", "basin"))
    cells = ts.regions.filter("region <> 0").join(parts, "region")
    cells = cells.withColumn("target", target_cell(ts.raster.nrows, ts.raster.ncols)).select(*_CELLS)
    if extra is not None:
        cells = cells.join(extra, "cell_id", "left")
    traps = ts.traps.join(ts.volumes, "trap").join(ts.trap_basins.withColumnRenamed("basin", "part"), "trap").join(named, "part").select(*_TRAPS)
    # both sides descend from one table; a new column keeps their keys apart
    return cells, scratch.put(traps)


def basin_rows(cells: DataFrame, traps: DataFrame) -> DataFrame:
    """Both of ``basin_frames`` in one table, told apart by ``is_trap``: a group of it can be handed over in
    pieces. Columns of the other side are 0."""
    kinds = dict(cells.dtypes) | dict(traps.dtypes)
    side = lambda df, is_trap: df.select(F.lit(is_trap).alias("is_trap"), *[F.col(c) if c in df.columns else F.lit(0).cast(kind).alias(c) for c, kind in kinds.items()])
    return side(cells, False).unionByName(side(traps, True))


def gathered(pieces: Iterable[pd.DataFrame]) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(cells by cell_id, traps by number) of one basin from pieces of ``basin_rows``, a column at a time."""
    parts: tuple[dict[str, list], dict[str, list]] = ({}, {})
    for piece in pieces:
        is_trap = piece["is_trap"].to_numpy(bool)
        for c in piece.columns.drop(["basin", "is_trap"]):
            own = int(c in _TRAPS)
            parts[own].setdefault(c, []).append(piece[c].to_numpy()[is_trap if own else ~is_trap])
    out = []
    for part, key in zip(parts, ("cell_id", "trap"), strict=True):
        order = np.argsort(np.concatenate(part[key]), kind="stable")
        out.append(pd.DataFrame({c: np.concatenate(part.pop(c))[order] for c in list(part)}, copy=False))
    return out[0], out[1]


def as_cells(ts: TrapStructure, value: float | DataFrame | None, name: str) -> DataFrame | None:
    """A rate given as a number (None here), or as a table (cell_id, value)."""
    if not isinstance(value, DataFrame):
        return None
    c = next(x for x in value.columns if x != "cell_id")
    return value.select("cell_id", F.col(c).cast("double").alias(name))


def rates(ts: TrapStructure, **given: float | DataFrame) -> DataFrame:
    """(cell_id, a column per given rate): numbers hold for all cells, missing cells of tables are 0."""
    out = ts.regions.select("cell_id")
    for name, value in given.items():
        t = as_cells(ts, value, name)
        out = out.withColumn(name, F.lit(float(value))) if t is None else out.join(t, "cell_id", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    return out


def watercourses(ts: TrapStructure, full_traps: DataFrame | Sequence[int] = (), *, precipitation: float | DataFrame = 1.0, infiltration: float | DataFrame = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Steady flow: (runoff by cell, inflow by catchment, totals).

    ``full_traps`` (a table with a column trap, or numbers) spill over. runoff is what a cell gets from
    rain and upstream, less infiltration; negative values are capacity that is left. totals has one
    row: precipitation, region_accum, offregion_runoff, used_infiltration; the first equals the sum
    of the others. Rain on buildings and voids leaves the domain.
    """
    spark = ts.traps.sparkSession
    scratch = Scratch(spark, "watercourses")
    dry = not isinstance(infiltration, DataFrame) and not infiltration
    if dry and not isinstance(full_traps, DataFrame) and not len(full_traps) and not isinstance(precipitation, DataFrame) and precipitation >= 0:
        return _dry_watercourses(ts, precipitation, scratch)
    r = scratch.put(rates(ts, precip=precipitation, infil=infiltration))
    cells, traps = basin_frames(ts, r)
    full = full_traps.select("trap").distinct() if isinstance(full_traps, DataFrame) else spark.createDataFrame([(int(t),) for t in full_traps], "trap long").distinct()
    traps = traps.join(full.withColumn("is_full", F.lit(True)), "trap", "left").withColumn("is_full", F.coalesce("is_full", F.lit(False)))

    def run(cell_part: pd.DataFrame, trap_part: pd.DataFrame) -> pd.DataFrame:
        cell_part = cell_part.sort_values("cell_id", ignore_index=True)
        b = Basin(cell_part, trap_part)
        full_set = set(trap_part.loc[trap_part["is_full"], "trap"].astype(int))
        runoff, accum, off, used = b.watercourses(cell_part["precip"].to_numpy(float), cell_part["infil"].to_numpy(float), full_set)
        parts = [pd.DataFrame({"kind": "runoff", "id": b.cell_id, "value": runoff}), pd.DataFrame({"kind": "accum", "id": list(accum), "value": list(accum.values())})]
        parts.append(pd.DataFrame({"kind": ["off", "used"], "id": [0, 0], "value": [off, used]}))
        return pd.concat([p for p in parts if len(p)], ignore_index=True)

    out = cells.groupBy("basin").cogroup(traps.groupBy("basin")).applyInPandas(run, "kind string, id long, value double")
    masked = ts.regions.filter("region = 0").select("cell_id").join(r, "cell_id")
    alone = masked.select("cell_id", (F.col("precip") - F.col("infil")).alias("v"), "infil")
    rest = alone.select(F.lit("runoff").alias("kind"), F.col("cell_id").alias("id"), F.col("v").alias("value"))
    rest = rest.unionByName(alone.groupBy().agg(F.sum(F.greatest("v", F.lit(0.0))).alias("value")).select(F.lit("off").alias("kind"), F.lit(0).cast("long").alias("id"), F.coalesce("value", F.lit(0.0)).alias("value")))
    rest = rest.unionByName(alone.groupBy().agg(F.sum(F.col("infil") - F.greatest(-F.col("v"), F.lit(0.0))).alias("value")).select(F.lit("used").alias("kind"), F.lit(0).cast("long").alias("id"), F.coalesce("value", F.lit(0.0)).alias("value")))
    out = scratch.put(out.unionByName(rest))
    runoff = out.filter("kind = 'runoff'").select(F.col("id").alias("cell_id"), F.col("value").alias("runoff"))
    accum = out.filter("kind = 'accum'").select(F.col("id").alias("region"), F.col("value").alias("region_accum"))
    pick = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("value"))), F.lit(0.0))
    sums = out.agg(pick("accum").alias("region_accum"), pick("off").alias("offregion_runoff"), pick("used").alias("used_infiltration"))
    return runoff, accum, r.agg(F.sum("precip").alias("precipitation")).crossJoin(sums)


def _dry_watercourses(ts: TrapStructure, precipitation: float, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``watercourses`` where nothing seeps away or spills over: sums along the flow, of any basin size."""
    r = scratch.put(rates(ts, precip=precipitation))
    runoff = scratch.put(accumulate_flow(ts.field, ts.raster, r).withColumnRenamed("total", "runoff"))
    inner = flow_edges(ts.field, ts.raster).select("cell_id")
    ends = scratch.put(ts.regions.select("cell_id", "region").join(inner, "cell_id", "left_anti").join(runoff, "cell_id").groupBy("region").agg(F.sum("runoff").alias("region_accum")))
    accum = ends.filter("region > 0")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("region_accum"))), F.lit(0.0))
    sums = ends.agg(total(F.col("region") > 0).alias("region_accum"), total(F.col("region") <= 0).alias("offregion_runoff"), F.lit(0.0).alias("used_infiltration"))
    return runoff, accum, r.agg(F.sum("precip").alias("precipitation")).crossJoin(sums)  # one row by one row


# ---------------------------------------------------------------------- reachability


def all_subtraps_of(ts: TrapStructure, roots: DataFrame | Sequence[int]) -> DataFrame:
    """(trap): all traps below the given ones, without these unless one lies below another."""
    from tarnflow.operators.hierarchy import ancestor_pairs, resolve_hierarchy

    spark = ts.traps.sparkSession
    r = roots.select(F.col("trap").alias("ancestor")) if isinstance(roots, DataFrame) else spark.createDataFrame([(int(t),) for t in roots], "ancestor long")
    pairs = ancestor_pairs(resolve_hierarchy(ts.traps, "trap", "parent", with_path=True))
    return pairs.join(r.distinct(), "ancestor", "left_semi").select(F.col("node").alias("trap")).distinct()


def draining_into(links: DataFrame, goals: DataFrame, node: str = "node", target: str = "target") -> DataFrame:
    """(node): all nodes from which following (node -> target) leads to one of ``goals`` (column node),
    goals included. Paths are cut at goals and doubled, so rounds are the logarithm of their length;
    loops end the search once a round reaches nothing new."""
    scratch = Scratch(links.sparkSession, "draining")
    g = goals.select(F.col("node").cast("long").alias("node")).distinct().withColumn("hit", F.lit(True))
    state = links.select(F.col(node).cast("long").alias("node"), F.col(target).cast("long").alias("to")).filter("node is not null")
    state = state.join(g, "node", "full").select("node", F.when(F.col("hit"), F.lit(None)).otherwise(F.col("to")).alias("to"), F.coalesce("hit", F.lit(False)).alias("hit"))
    state, last = scratch.put(state), (-1, -1)
    while True:
        now = state.agg(F.sum(F.col("hit").cast("long")), F.count("to")).first()
        now = (now[0] or 0, now[1])
        if not now[1] or now == last:
            return state.filter("hit").select("node")
        last = now
        ahead = state.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("hit").alias("there"))
        nxt = scratch.put(state.join(ahead, "to", "left").select("node", F.when(~F.coalesce("there", F.lit(False)), F.col("next")).alias("to"), (F.col("hit") | F.coalesce("there", F.lit(False))).alias("hit")))
        scratch.drop(state)
        state = nxt


def all_upstream_regions(ts: TrapStructure, region: int) -> DataFrame:
    """(region): catchments whose overflow reaches the given one when everything is full."""
    top = ts.members.filter(F.col("region") == region).agg(F.max(F.col("trap"))).first()[0]
    if top is None:
        return ts.traps.limit(0).select(F.col("trap").alias("region"))
    spark = ts.traps.sparkSession
    goal = spark.createDataFrame([(int(top),)], "node long")
    graph = saturated_spill_graph(ts).filter("target > 0")
    up = draining_into(graph, goal, "trap", "target")
    return up.join(ts.traps.filter("level = 0").select(F.col("trap").alias("node")), "node", "left_semi").select(F.col("node").alias("region"))


def upstream_area(ts: TrapStructure, cell_id: int, *, local_only: bool = True) -> DataFrame:
    """(cell_id): the cells upstream of a cell.

    In a pond (at or below the spill level of the topmost trap of its region) it is the whole region,
    or all upstream regions. On dry land it is everything that drains through the cell, and unless
    ``local_only`` also what drains into the traps that spill into that area, and so on.
    """
    spark = ts.traps.sparkSession
    here = ts.regions.filter(F.col("cell_id") == cell_id).select("region", "z").first()
    if here is None:
        return ts.regions.limit(0).select("cell_id")
    region, z = here
    tops = ts.members.filter(F.col("region") == region).join(ts.traps.filter("parent is null"), "trap").select("elevation").first()
    if region > 0 and tops is not None and z <= tops[0]:
        if local_only:
            return ts.regions.filter(F.col("region") == region).select("cell_id")
        return ts.regions.join(all_upstream_regions(ts, region), "region", "left_semi").select("cell_id")
    scratch = Scratch(spark, "upstream")
    flow = flow_edges(ts.field, ts.raster)
    area = scratch.put(draining_into(ts.regions.filter(F.col("region") == region).select("cell_id").join(flow, "cell_id", "left"), spark.createDataFrame([(cell_id,)], "node long"), "cell_id", "target").withColumnRenamed("node", "cell_id"))
    if local_only:
        return area
    # traps that spill into the area, their whole upstream regions included
    tops_in = ts.traps.filter("parent is null").join(area.withColumnRenamed("cell_id", "downstream_region_cell"), "downstream_region_cell", "left_semi").select(F.col("trap").alias("node"))
    graph = saturated_spill_graph(ts).filter("target > 0")
    up = draining_into(graph, tops_in, "trap", "target").join(ts.traps.filter("level = 0").select(F.col("trap").alias("node")), "node", "left_semi")
    cells = ts.regions.join(up.select(F.col("node").alias("region")), "region", "left_semi").select("cell_id")
    return area.unionByName(cells).distinct()


def river_cells(ts: TrapStructure, traps: DataFrame) -> DataFrame:
    """(trap, cell_id): the cells from the spill point of each given trap down to where its water rests
    or leaves. Level by level with doubling strides; paths of different traps may share cells."""
    start = ts.traps.join(traps.select("trap").distinct(), "trap", "left_semi").filter("downstream_region_cell > 0").select("trap", F.col("downstream_region_cell").alias("cell_id"))
    scratch = Scratch(ts.traps.sparkSession, "rivers")
    hop = scratch.put(flow_edges(ts.field, ts.raster).withColumnRenamed("target", "to"))
    have = scratch.put(start)
    n = have.count()
    while True:
        ahead = have.join(hop, "cell_id").select("trap", F.col("to").alias("cell_id"))
        more = scratch.put(have.unionByName(ahead).distinct())
        m = more.count()
        scratch.drop(have)
        have = more
        if m == n:
            return have
        n = m
        two = scratch.put(hop.join(hop.select(F.col("cell_id").alias("to"), F.col("to").alias("far")), "to").select("cell_id", F.col("far").alias("to")))
        scratch.drop(hop)
        hop = two


def region_selection(ts: TrapStructure, selection: DataFrame | None = None, *, region_color: int = 1, trap_color: int = 2, river_color: int = 3) -> DataFrame:
    """(cell_id, color) of a selection of traps (default: the topmost ones; column trap, and ord for the
    order in which later ones override earlier ones; without it the number of the trap is the order).

    Cells of selected traps override rivers, rivers override catchments. A negative region color gives
    each selected trap a color of its own, counting up from its absolute value; river color 0 draws
    no rivers. Other cells are 0.
    """
    sel = (ts.toplevel() if selection is None else selection).select("trap", *(["ord"] if selection is not None and "ord" in selection.columns else []))
    if "ord" not in sel.columns:
        sel = sel.withColumn("ord", F.col("trap"))
    sel = sel.groupBy("trap").agg(F.max("ord").alias("ord"))
    if region_color < 0:
        from tarnflow.operators.components import dense_numbers

        sel = dense_numbers(sel.withColumn("ord", F.col("ord").cast("long")), "ord").withColumn("color", F.col("number") - 1 + abs(region_color)).drop("number")
    else:
        sel = sel.withColumn("color", F.lit(region_color).cast("long"))
    best = ts.members.join(sel, "trap").groupBy("region").agg(F.max(F.struct("ord", "trap", "color")).alias("b"))
    chosen = best.select("region", F.col("b.trap").alias("trap"), F.col("b.color").alias("color")).join(ts.traps.select("trap", "elevation"), "trap")
    cells = ts.regions.select("cell_id", "z", "region").join(chosen, "region", "left")
    if river_color:
        rivers = river_cells(ts, sel).select("cell_id").distinct().withColumn("river", F.lit(True))
        cells = cells.join(rivers, "cell_id", "left")
    else:
        cells = cells.withColumn("river", F.lit(None).cast("boolean"))
    color = F.when((F.col("region") > 0) & (F.col("z") <= F.col("elevation")), trap_color).when(F.col("river"), river_color).when(F.col("region") > 0, F.coalesce("color", F.lit(0).cast("long"))).otherwise(0)
    return cells.select("cell_id", color.cast("long").alias("color"))


def mass_balance(totals: DataFrame, tolerance: float = 1e-6) -> bool:
    """Whether rain equals what is stored, leaves and infiltrates."""
    t = totals.first()
    return bool(np.isclose(t["precipitation"], t["region_accum"] + t["offregion_runoff"] + t["used_infiltration"], rtol=tolerance))
