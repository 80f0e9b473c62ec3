"""Nested traps: which ponds merge into which when they fill.

Each round takes the lowest pass of every topmost trap; two traps whose lowest passes lead into each
other merge into a new one, whose boundary is theirs without the passes between them. Passes are
totally ordered and shared by both sides, so loops of more than two traps can't arise. All pairs of
a round merge at once; rounds are as many as the nesting is deep. Rows of traps that can't merge any
more (they spill out of the domain) leave the working set. Once the working set, whose rows are
counted in every round, is small enough for one task, the rounds that are left run there.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.functions.runtime import BROADCAST_ROWS, Scratch, broadcast_if_small, salted_join
from tarnflow.operators.basin import tree_volumes
from tarnflow.operators.components import dense_numbers, minimum_labels
from tarnflow.operators.field import spill_field
from tarnflow.operators.hierarchy import resolve_hierarchy
from tarnflow.operators.regions import spill_regions
from tarnflow.operators.spill import region_adjacency, spill_points
from tarnflow.sources.grid import Raster

_PASS = ["z_pass", "phase", "ord", "pos", "cell", "ncell"]
#: Passes (rows of the region graph) up to which the remaining rounds run in one task.
KERNEL_ROWS = 1_000_000
#: Regions, close together by number, whose passes are thinned out in one task where there are more than that.
FOREST_REGIONS = 30_000
#: Cells of the largest basin up to which volumes are summed basin by basin, each in one task.
KERNEL_CELLS = 8_000_000
_KERNEL_SCHEMA = "old long, trap long, elevation double, downstream_region long, current_region_cell long, downstream_region_cell long, level int"


def _rounds(pdf: pd.DataFrame, last: int, level: int) -> pd.DataFrame:
    """The rounds of ``trap_hierarchy`` over one table of passes. Rows with ``old`` are moves of a trap
    into ``trap``, the others new traps.

    Both lowest passes of a pair are fixed once both traps exist, so the pair merges in the round after
    the later of the two came to be. The rounds thus come from one walk over the passes, the lowest
    first: it is the lowest one of both its traps, and they merge unless one of them is final (it
    spills out of the domain or into a final one). The work does not grow with the number of rounds.
    """
    pdf = pdf.sort_values(["z_pass", "phase", "ord", "pos"], ignore_index=True)
    src, dst = pdf["src"].to_numpy(), pdf["dst"].to_numpy()
    tops = np.unique(np.concatenate([src, dst[dst > 0]]))
    n = len(tops)
    # traps that are no source any more are final; a pass out of the domain leads to -1
    final = np.ones(n, bool)
    final[np.searchsorted(tops, src)] = False
    final = final.tolist() + [False] * n
    a_of, b_of = np.searchsorted(tops, src).tolist(), np.where(dst > 0, np.searchsorted(tops, dst), -1).tolist()
    up, born = list(range(2 * n)), [level] * n + [0] * n
    least = list(range(n)) + [0] * n
    best = [-1] * (2 * n)
    pairs: list[tuple[int, int, int]] = []
    made = n

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for row, (a, b) in enumerate(zip(a_of, b_of, strict=True)):
        a = top(a)
        if b >= 0:
            b = top(b)
            if a == b:
                continue
        # a pass has a row from either side; each tells of its own source alone
        if best[a] < 0:
            best[a] = row
        if final[a] or b < 0 or final[b]:
            final[a] = True
        elif best[b] >= 0:
            up[a] = up[b] = made
            born[made] = 1 + max(born[a], born[b])
            least[made] = min(least[a], least[b])
            pairs.append((a, b, made))
            made += 1
    names = ["old", "trap", "elevation", "downstream_region", "current_region_cell", "downstream_region_cell", "level"]
    if not pairs:
        return pd.DataFrame(columns=names).astype({c: "Int64" for c in names if c != "elevation"})
    # numbers by round, and within a round by the lesser number of the two
    number = np.concatenate([tops, np.zeros(made - n, tops.dtype)])
    a, b, new = np.array(pairs).T
    rounds = np.array(born)[new]
    order = np.argsort(rounds, kind="stable")
    cuts = np.flatnonzero(np.diff(rounds[order])) + 1
    for part in np.split(order, cuts):
        lesser = np.minimum(number[a[part]], number[b[part]])
        number[new[part[np.argsort(lesser)]]] = last + 1 + np.arange(len(part))
        last += len(part)
    row = np.array(best)[new]
    have = row >= 0
    pick = lambda c, none: np.where(have, pdf[c].to_numpy()[np.maximum(row, 0)], none)
    moves = [pd.DataFrame({"old": number[x], "trap": number[new], "level": rounds}) for x in (a, b)]
    fresh = pd.DataFrame({"trap": number[new], "elevation": pick("z_pass", np.inf), "downstream_region": pick("dst_region", 0), "current_region_cell": pick("cell", 0), "downstream_region_cell": pick("ncell", 0), "level": rounds})
    return pd.concat([*moves, fresh], ignore_index=True).reindex(columns=names).astype({c: "Int64" for c in names if c != "elevation"})


def _forest(pdf: pd.DataFrame) -> pd.DataFrame:
    """The passes that are left after those whose two sides lower ones of the same table join already: such
    a pass is never the lowest one out of any set of regions. The outside is one side."""
    pdf = pdf.sort_values(["z_pass", "phase", "ord", "pos"], ignore_index=True)
    dst = np.maximum(pdf["dst"].to_numpy(), 0)
    ids, at = np.unique(np.concatenate([pdf["src"].to_numpy(), dst]), return_inverse=True)
    up, keep, was, kept = list(range(len(ids))), [], (-1, -1), False
    for a, b in zip(at[: len(pdf)].tolist(), at[len(pdf) :].tolist(), strict=True):
        if (b, a) != was:  # else the same pass from the other side
            x, y = a, b
            while up[x] != x:
                up[x] = x = up[up[x]]
            while up[y] != y:
                up[y] = y = up[up[y]]
            kept, up[x] = x != y, y
        keep.append(kept)
        was = (a, b)
    return pdf[np.array(keep, bool)]


def _kernel(last: int, level: int):
    return lambda pdf: _rounds(pdf, last, level)


def trap_hierarchy(adjacency: DataFrame, points: DataFrame, *, kernel_rows: int = KERNEL_ROWS) -> DataFrame:
    """All traps: trap, parent (null at the top), elevation, downstream_region, current_region_cell,
    downstream_region_cell, level.

    Traps 1..n are the regions. Higher ones follow by round and, within a round, by their least
    member. The downstream region of any trap is a region, not a trap.
    """
    spark = adjacency.sparkSession
    scratch = Scratch(spark, "traps")
    n_regions = points.agg(F.max("region")).first()[0] or 0
    base = points.select(F.col("region").alias("trap"), "elevation", "downstream_region", "current_region_cell", "downstream_region_cell", F.lit(0).alias("level"))
    traps = [scratch.put(base)]
    parents = []
    graph = scratch.put(adjacency.select("src", "dst", F.col("dst").alias("dst_region"), *_PASS))
    last, level = int(n_regions), 0
    if graph.count() > kernel_rows:
        near = F.floor(F.when(F.col("dst") > 0, F.least("src", "dst")).otherwise(F.col("src")) / FOREST_REGIONS)
        graph = scratch.put(graph.groupBy(near.alias("near")).applyInPandas(_forest, graph.schema))
    while True:
        if graph.count() <= kernel_rows:
            rest = scratch.put(graph.groupBy(F.lit(0).alias("all")).applyInPandas(_kernel(last, level), _KERNEL_SCHEMA))
            parents.append(rest.filter("old is not null").select("old", F.col("trap").alias("new")))
            traps.append(rest.filter("old is null").drop("old"))
            break
        best = graph.groupBy("src").agg(F.min(F.struct(*_PASS, "dst", "dst_region")).alias("m")).select("src", "m.*")
        best = scratch.put(best)
        a = best.filter("dst > src").select("src", "dst", "pos", "ord")
        b = best.select(F.col("src").alias("dst"), F.col("dst").alias("src"), "pos", "ord")
        pairs = a.join(b, ["src", "dst", "pos", "ord"]).select("src", "dst")
        merged = scratch.put(dense_numbers(pairs, "src").select((F.col("number") + last).alias("trap"), "src", "dst"))
        n = merged.count()
        if not n:
            break
        level += 1
        last += n
        moves = scratch.put(merged.select(F.col("src").alias("old"), F.col("trap").alias("new")).unionByName(merged.select(F.col("dst").alias("old"), F.col("trap").alias("new"))))
        parents.append(moves)
        small = broadcast_if_small(moves, 2 * n)
        # traps whose lowest pass leads out of the domain are final: they take no further part as sources
        ended = best.filter("dst <= 0").select("src")
        moved = graph.join(broadcast_if_small(ended, ended.count()), "src", "left_anti")
        moved = moved.join(small.withColumnsRenamed({"old": "src", "new": "src_new"}), "src", "left").join(small.withColumnsRenamed({"old": "dst", "new": "dst_new"}), "dst", "left")
        moved = moved.withColumn("src", F.coalesce("src_new", "src")).withColumn("dst", F.coalesce("dst_new", "dst")).filter("src <> dst")
        least = moved.groupBy("src", "dst").agg(F.min(F.struct(*_PASS, "dst_region")).alias("m")).select("src", "dst", "m.dst_region", *[f"m.{c}" for c in _PASS])
        old, graph = graph, scratch.put(least)
        scratch.drop(old, best)
        out = graph.groupBy("src").agg(F.min(F.struct(*_PASS, "dst_region")).alias("m"))
        zero = F.lit(0).cast("long")
        new = merged.select(F.col("trap").alias("src")).join(out, "src", "left")
        traps.append(scratch.put(new.select(F.col("src").alias("trap"), F.coalesce("m.z_pass", F.lit(float("inf"))).alias("elevation"), F.coalesce("m.dst_region", zero).alias("downstream_region"), F.coalesce("m.cell", zero).alias("current_region_cell"), F.coalesce("m.ncell", zero).alias("downstream_region_cell"), F.lit(level).alias("level"))))
    every = traps[0]
    for t in traps[1:]:
        every = every.unionByName(t)
    if not parents:
        return every.withColumn("parent", F.lit(None).cast("long"))
    up = parents[0]
    for p in parents[1:]:
        up = up.unionByName(p)
    return scratch.put(every.join(up.withColumnsRenamed({"old": "trap", "new": "parent"}), "trap", "left"))


def _climb(pdf: pd.DataFrame) -> pd.DataFrame:
    up = dict(zip(pdf["trap"].tolist(), pdf["parent"].tolist(), strict=True))
    region = pdf.loc[pdf["level"] == 0, "trap"].to_numpy()
    at, parts = region.copy(), []
    while len(at):
        parts.append(pd.DataFrame({"trap": at, "region": region}))
        nxt = np.array([up[t] for t in at.tolist()], dtype=float)
        go = ~np.isnan(nxt)
        at, region = nxt[go].astype(np.int64), region[go]
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"trap": [], "region": []}, dtype="int64")


def trap_regions(traps: DataFrame, *, kernel_rows: int = KERNEL_ROWS) -> DataFrame:
    """(trap, region): the regions of every trap; a region belongs to itself and all traps above it.

    At most ``kernel_rows`` traps climb to their parents in one task, more of them by frontier joins.
    """
    if traps.count() <= kernel_rows:
        return traps.select("trap", "parent", "level").groupBy(F.lit(0).alias("all")).applyInPandas(_climb, "trap long, region long")
    paths = resolve_hierarchy(traps, "trap", "parent", with_path=True)
    low = traps.filter("level = 0").select(F.col("trap").alias("node"))
    return paths.join(low, "node", "left_semi").select(F.explode("path").alias("trap"), F.col("node").alias("region"))


def _with_levels(cells: DataFrame, traps: DataFrame, members: DataFrame, broadcast_rows: int) -> DataFrame:
    """Cells (region, ...) with every trap of their region and its elevation. A region may hold a large
    share of all cells: its levels are sent to them, or the join is salted."""
    levels = members.join(traps.select("trap", "elevation"), "trap").select("trap", "region", "elevation")
    n = members.count()
    return cells.join(F.broadcast(levels), "region") if n <= broadcast_rows else salted_join(cells, levels, ["region"], ["cell_id"], Scratch(cells.sparkSession, "levels"))


def trap_volumes(regions: DataFrame, traps: DataFrame, members: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(trap, volume): sum of elevation - z over the cells of the trap's regions below its spill level.

    Not multiplied by a cell's area. A trap that nothing bounds has infinite volume, one without
    cells below its level 0.
    """
    wet = _with_levels(regions.filter("region > 0").select("region", "cell_id", "z"), traps, members, broadcast_rows).filter("z < elevation")
    sums = wet.groupBy("trap").agg(F.sum(F.col("elevation") - F.col("z")).alias("volume"))
    return traps.select("trap").join(sums, "trap", "left").withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def trap_footprints(regions: DataFrame, traps: DataFrame, members: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(trap, cell_id): cells of the trap's regions at or below its spill level."""
    return _with_levels(regions.filter("region > 0").select("region", "cell_id", "z"), traps, members, broadcast_rows).filter("z <= elevation").select("trap", "cell_id")


def sub_volumes(traps: DataFrame, volumes: DataFrame) -> DataFrame:
    """(trap, subvolume): the volumes of the immediate children together, 0 without children."""
    sums = traps.filter("parent is not null").select("trap", "parent").join(volumes, "trap").groupBy("parent").agg(F.sum("volume").alias("subvolume"))
    return traps.select("trap").join(sums.withColumnRenamed("parent", "trap"), "trap", "left").withColumn("subvolume", F.coalesce("subvolume", F.lit(0.0)))


def _basin_volumes(cells: pd.DataFrame, traps: pd.DataFrame) -> pd.DataFrame:
    traps = traps.sort_values("trap", ignore_index=True)
    trap, up = traps["trap"].to_numpy(), traps["parent"].to_numpy(dtype=float)
    parent = np.where(np.isnan(up), -1, np.searchsorted(trap, np.nan_to_num(up, nan=0.0))).astype(int)
    volume, sub = tree_volumes(cells["region"].to_numpy(), cells["z"].to_numpy(dtype=float), trap, parent, traps["elevation"].to_numpy(dtype=float))
    return pd.DataFrame({"trap": trap, "volume": volume, "subvolume": sub})


def nested_volumes(regions: DataFrame, traps: DataFrame, sizes: DataFrame, trap_basins: DataFrame) -> DataFrame:
    """(trap, volume, subvolume) as of ``trap_volumes`` and ``sub_volumes``, without a row for each pair of
    a cell and a trap over it: deep nests have hundreds of traps over a cell."""
    cells = regions.filter("region > 0").select("region", "z").join(sizes.select("region", "basin"), "region")
    below = traps.select("trap", "parent", "elevation").join(trap_basins, "trap")
    return cells.groupBy("basin").cogroup(below.groupBy("basin")).applyInPandas(_basin_volumes, "trap long, volume double, subvolume double")


def supertraps_of(members: DataFrame) -> DataFrame:
    """(region, traps): ascending list of the traps that hold the region (as many as the nesting is deep)."""
    return members.groupBy("region").agg(F.sort_array(F.collect_list("trap")).alias("traps"))


@dataclass
class TrapStructure:
    """All static results of one raster as DataFrames."""

    raster: Raster
    field: DataFrame
    regions: DataFrame
    adjacency: DataFrame
    spillpoints: DataFrame
    traps: DataFrame
    diagonals: bool = True

    def _keep(self, df: DataFrame) -> DataFrame:
        return Scratch(df.sparkSession, "structure").put(df)

    @cached_property
    def members(self) -> DataFrame:
        return self._keep(trap_regions(self.traps))

    @cached_property
    def _labels(self) -> DataFrame:
        """(id, basin) of regions and traps that are not the least of their basin. The lowest traps share the
        numbers of their regions; the pass of a trap with a parent leads into that parent."""
        links = self.traps.select(F.col("trap").alias("u"), F.coalesce("parent", "downstream_region").alias("v")).filter("v <> 0")
        return minimum_labels(links).select(F.col("u").alias("id"), F.col("v").alias("basin"))

    @cached_property
    def sizes(self) -> DataFrame:
        """(region, n, basin): cells and basin of every region."""
        n = self.regions.filter("region <> 0").groupBy("region").agg(F.count("*").alias("n"))
        return self._keep(n.join(self._labels.withColumnRenamed("id", "region"), "region", "left").withColumn("basin", F.coalesce("basin", "region")))

    @cached_property
    def trap_basins(self) -> DataFrame:
        """(trap, basin)"""
        return self._keep(self.traps.select("trap").join(self._labels.withColumnRenamed("id", "trap"), "trap", "left").withColumn("basin", F.coalesce("basin", "trap")))

    @cached_property
    def volumes(self) -> DataFrame:
        """(trap, volume, subvolume)"""
        largest = self.sizes.groupBy("basin").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
        if largest <= KERNEL_CELLS:
            return self._keep(nested_volumes(self.regions, self.traps, self.sizes, self.trap_basins))
        v = self._keep(trap_volumes(self.regions, self.traps, self.members))
        return self._keep(v.join(sub_volumes(self.traps, v), "trap"))

    @cached_property
    def footprints(self) -> DataFrame:
        return self._keep(trap_footprints(self.regions, self.traps, self.members))

    @property
    def supertraps(self) -> DataFrame:
        return supertraps_of(self.members)

    def numregions(self) -> int:
        return self.traps.filter("level = 0").count()

    def numtraps(self) -> int:
        return self.traps.count()

    def subtrapsof(self, trap: int) -> DataFrame:
        return self.traps.filter(F.col("parent") == trap).select("trap")

    def parentof(self, trap: int) -> DataFrame:
        return self.traps.filter(F.col("trap") == trap).select("parent")

    def toplevel(self) -> DataFrame:
        return self.traps.filter("parent is null").select("trap")


def analyze(raster: Raster, *, diagonals: bool = True, buildings: DataFrame | None = None, sinks: DataFrame | None = None, merge_outregions: bool = False) -> TrapStructure:
    """The full static analysis: directions, catchments, spill points, nested traps.

    ``merge_outregions`` makes all outside catchments one (-1), also as downstream region.
    """
    spark = raster.cells.sparkSession
    scratch = Scratch(spark, "analysis")
    field = spill_field(raster, diagonals=diagonals, buildings=buildings, sinks=sinks)
    regions = spill_regions(field, raster, diagonals=diagonals)
    adjacency = region_adjacency(regions, raster, diagonals=diagonals)
    points = scratch.put(spill_points(regions, adjacency))
    traps = trap_hierarchy(adjacency, points)
    if merge_outregions:
        out = F.when(F.col("region") < 0, F.lit(-1).cast("long")).otherwise(F.col("region"))
        regions = scratch.put(regions.withColumn("region", out))
        down = F.when(F.col("downstream_region") <= 0, F.lit(-1).cast("long")).otherwise(F.col("downstream_region"))
        points, traps = points.withColumn("downstream_region", down), scratch.put(traps.withColumn("downstream_region", down))
    return TrapStructure(raster, field, regions, adjacency, points, traps, diagonals)
