"""Spill points: the lowest pass out of every catchment, and the adjacency of catchments.

Every boundary between two regions is reduced at once to its lowest pass, so that all later rounds
work on the region graph and never on cells. Passes are totally ordered: by height, passes inside the
grid before exits over its edge, then by the order of scanning. Both regions of a pass see the same
order, so the lowest passes of regions that spill into each other always agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.functions.runtime import Scratch
from tarnflow.operators.field import DI, DJ, with_neighbours
from tarnflow.sources.grid import Raster

#: Scanning order of the pass between a cell and neighbour k, and whether the neighbour comes first.
_ORDER = (0, 0, 1, 1, 2, 2, 3, 3)
_NEIGHBOUR_FIRST = (True, False, True, False, True, False, False, True)


def _edge_order(nrows: int, ncols: int):
    i, j = F.col("i"), F.col("j")
    by_row = F.when((j == 1) | (j == ncols), 2 * i + F.when(j == 1, 0).otherwise(1))
    by_col = F.when((i == 1) | (i == nrows), 2 * nrows + 2 * j + F.when(i == 1, 0).otherwise(1))
    return F.least(by_row, by_col)


def region_boundaries(regions: DataFrame, raster: Raster, *, diagonals: bool = True) -> DataFrame:
    """All boundary passes of positive regions: src, dst, z_pass, phase, ord, pos, cell, ncell.

    dst is the other region, or 0 with ncell = cell at the edge of the grid. Masked cells (region 0)
    bound nothing.
    """
    near = with_neighbours(regions.select("cell_id", "i", "j", "z", "region"), ["z", "region"], diagonals)
    passes = []
    for k in range(8 if diagonals else 4):
        n = F.col(f"n{k}")
        other = F.col("cell_id") + DI[k] + DJ[k] * raster.nrows
        row = F.struct(
            n["region"].alias("dst"), F.greatest(F.col("z"), n["z"]).alias("z_pass"), F.lit(0).alias("phase"), F.lit(_ORDER[k]).cast("long").alias("ord"),
            (other if _NEIGHBOUR_FIRST[k] else F.col("cell_id")).alias("pos"), F.col("cell_id").alias("cell"), other.alias("ncell"),
        )
        passes.append(F.when((n["region"] != 0) & (n["region"] != F.col("region")), row))
    edge = _edge_order(raster.nrows, raster.ncols)
    out = F.struct(F.lit(0).cast("long").alias("dst"), F.col("z").alias("z_pass"), F.lit(1).alias("phase"), edge.cast("long").alias("ord"), F.col("cell_id").alias("pos"), F.col("cell_id").alias("cell"), F.col("cell_id").alias("ncell"))
    passes.append(F.when(edge.isNotNull(), out))
    own = near.filter("region > 0").select(F.col("region").alias("src"), F.explode(F.filter(F.array(*passes), lambda p: p.isNotNull())).alias("p"))
    return own.select("src", "p.*")


def region_adjacency(regions: DataFrame, raster: Raster, *, diagonals: bool = True) -> DataFrame:
    """The lowest pass of every ordered pair of adjacent regions (src > 0): columns as of the boundaries."""
    b = region_boundaries(regions, raster, diagonals=diagonals)
    best = b.groupBy("src", "dst").agg(F.min(F.struct("z_pass", "phase", "ord", "pos", "cell", "ncell")).alias("m"))
    return Scratch(regions.sparkSession, "adjacency").put(best.select("src", "dst", "m.*"))


def spill_points(regions: DataFrame, adjacency: DataFrame) -> DataFrame:
    """(region, downstream_region, current_region_cell, downstream_region_cell, elevation) of every
    positive region. Regions that nothing bounds have (0, 0, 0, infinity). downstream_region is
    negative if it drains out of the domain and 0 over the edge."""
    best = adjacency.groupBy("src").agg(F.min(F.struct("z_pass", "phase", "ord", "pos", "dst", "cell", "ncell")).alias("m"))
    every = regions.filter("region > 0").select(F.col("region").alias("src")).distinct()
    zero = F.lit(0).cast("long")
    return every.join(best, "src", "left").select(
        F.col("src").alias("region"), F.coalesce("m.dst", zero).alias("downstream_region"), F.coalesce("m.cell", zero).alias("current_region_cell"),
        F.coalesce("m.ncell", zero).alias("downstream_region_cell"), F.coalesce("m.z_pass", F.lit(float("inf"))).alias("elevation"),
    )
