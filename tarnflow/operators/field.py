"""Flow directions: the steepest way down from every cell.

Directions: 0 (i-1,j), 1 (i+1,j), 2 (i,j-1), 3 (i,j+1), 4 (i-1,j-1), 5 (i+1,j+1), 6 (i+1,j-1),
7 (i-1,j+1); -1 trap bottom, -2 building, -3 sink.

Neighbours come from two sorted windows, along i within a column and then along j within a row: two
exchanges of the raster, where a join with eight shifted copies would move it nine times.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.functions.runtime import Scratch
from tarnflow.sources.grid import Domain, Raster

DI = (-1, 1, 0, 0, -1, 1, 1, -1)
DJ = (0, 0, -1, 1, -1, 1, -1, 1)
OPPOSITE = (1, 0, 3, 2, 5, 4, 7, 6)
BOTTOM, BUILDING, SINK = -1, -2, -3


def with_neighbours(cells: DataFrame, values: list[str], diagonals: bool = True) -> DataFrame:
    """Adds n0..n7 (n0..n3 without diagonals): structs of the values of the neighbours, null if absent.

    The raster must be dense along rows: a diagonal neighbour beyond an absent cell is not seen.
    """
    down = Window.partitionBy("j").orderBy("i")
    across = Window.partitionBy("i").orderBy("j")
    own = F.struct(*values)
    col = cells.withColumn("_own", own)
    col = col.withColumn("_up", F.when(F.lag("i").over(down) == F.col("i") - 1, F.lag("_own").over(down)))
    col = col.withColumn("_down", F.when(F.lead("i").over(down) == F.col("i") + 1, F.lead("_own").over(down)))
    three = F.struct("_up", "_own", "_down") if diagonals else F.struct("_own")
    col = col.withColumn("_three", three)
    col = col.withColumn("_left", F.when(F.lag("j").over(across) == F.col("j") - 1, F.lag("_three").over(across)))
    col = col.withColumn("_right", F.when(F.lead("j").over(across) == F.col("j") + 1, F.lead("_three").over(across)))
    col = col.withColumns({"n0": F.col("_up"), "n1": F.col("_down"), "n2": F.col("_left._own"), "n3": F.col("_right._own")})
    if diagonals:
        col = col.withColumns({"n4": F.col("_left._up"), "n5": F.col("_right._down"), "n6": F.col("_left._down"), "n7": F.col("_right._up")})
    return col.drop("_own", "_up", "_down", "_three", "_left", "_right")


def mark_cells(cells: DataFrame, buildings: DataFrame | None = None, sinks: DataFrame | None = None) -> DataFrame:
    """Adds is_building and is_sink from tables of marked cells (i, j); null or outside cells mark nothing."""
    for name, mask in (("is_building", buildings), ("is_sink", sinks)):
        if mask is None:
            cells = cells.withColumn(name, F.lit(False))
        else:
            marked = mask.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).distinct().withColumn(name, F.lit(True))
            cells = cells.join(marked, ["i", "j"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return cells


def _mask(df: DataFrame) -> DataFrame:
    nan = F.lit(float("nan"))
    void = F.col("z").isNull()
    code = F.when(F.col("is_sink"), SINK).when(F.col("is_building"), BUILDING).when(~void, F.col("dir"))
    slope = F.when(F.col("is_sink") | F.col("is_building"), nan).when(~void, F.col("slope"))
    return df.withColumn("dir", code.cast("tinyint")).withColumn("slope", slope)


def _steepest(raster: Raster, marked: DataFrame, diagonals: bool) -> DataFrame:
    if "dx" in marked.columns:
        dx, dy = F.col("dx"), F.col("dy")
        rates = (1 / dx, 1 / dx, 1 / dy, 1 / dy) + (1 / F.sqrt(dx * dx + dy * dy),) * 4
    else:
        dx, dy = raster.steps
        rates = tuple(F.lit(x) for x in (1 / dx, 1 / dx, 1 / dy, 1 / dy) + (1 / math.sqrt(dx * dx + dy * dy),) * 4)
    high = marked.withColumn("_z", F.when(F.col("is_building"), float("inf")).otherwise(F.col("z")))
    near = with_neighbours(high, ["_z"], diagonals)
    n = 8 if diagonals else 4
    raw = [(F.col(f"n{k}._z") - F.col("_z")) * rates[k] for k in range(n)]
    slopes = [F.coalesce(raw[k], -raw[OPPOSITE[k]]) for k in range(n)]
    if diagonals:
        # where both cells of the first diagonal are off the grid, the second one does not count either
        first = slopes[4].isNotNull()
        slopes[6], slopes[7] = F.when(first, slopes[6]), F.when(first, slopes[7])
    near = near.withColumns({f"_s{k}": s for k, s in enumerate(slopes)})
    best = F.least(*[F.when(F.col(f"_s{k}").isNotNull(), F.struct(F.col(f"_s{k}").alias("s"), F.lit(k).alias("k"))) for k in range(n)])
    near = near.withColumn("_b", best)
    out = near.withColumn("slope", F.col("_b.s")).withColumn("dir", F.when(F.col("slope") < 0, F.col("_b.k")).otherwise(BOTTOM))
    return _mask(out).select("cell_id", "i", "j", "z", "dir", "slope", "is_building", "is_sink")


def spill_field(raster: Raster, *, diagonals: bool = True, buildings: DataFrame | None = None, sinks: DataFrame | None = None, domain: Domain | None = None) -> DataFrame:
    """Direction and slope of every cell (of ``domain``): cell_id, i, j, z, dir, slope, is_building, is_sink.

    Ties go to the lower code. A neighbour off the grid lies as far below as the opposite one lies
    above. Flat ground is a trap bottom. Buildings are infinitely high; a sink wins over a building.
    Cells with a null height are voids: null direction, absent for their neighbours. Rasters of fewer
    than two rows or columns are rejected. An empty table of cells gives no rows. Columns dx and dy of
    the cells, where there are, hold for the raster's own cell size.
    """
    if raster.nrows < 2 or raster.ncols < 2:
        raise ValueError("a raster needs at least two rows and two columns")
    sizes = ["dx", "dy"] if {"dx", "dy"} <= set(raster.cells.columns) else []
    cells = raster.cells.select("cell_id", "i", "j", "z", *sizes)
    if domain is not None:
        cells = cells.filter(domain.grown(1, raster.nrows, raster.ncols).contains())
    out = _steepest(raster, mark_cells(cells, buildings, sinks), diagonals)
    # written once: filters on the direction would otherwise be pushed down as copies of the whole stencil
    return Scratch(cells.sparkSession, "field").put(out if domain is None else out.filter(domain.contains()))


def update_spill_field(field: DataFrame, raster: Raster, domain: Domain, *, diagonals: bool = True, buildings: DataFrame | None = None, sinks: DataFrame | None = None, grow: int = 1) -> DataFrame:
    """The field after heights changed inside ``domain``: only the rectangle and ``grow`` cells around it
    are computed again; masks are applied to the whole grid. ``raster`` holds the new heights."""
    near = domain.grown(grow, raster.nrows, raster.ncols)
    new = spill_field(raster, diagonals=diagonals, buildings=buildings, domain=near).select("cell_id", F.col("dir").alias("new_dir"), F.col("slope").alias("new_slope"), F.lit(True).alias("renewed"))
    old = mark_cells(raster.cells.select("cell_id", "i", "j", "z"), buildings, sinks).join(field.select("cell_id", "dir", "slope"), "cell_id", "left")
    both = old.join(new, "cell_id", "left")
    both = both.withColumn("dir", F.when(F.col("renewed"), F.col("new_dir")).otherwise(F.col("dir"))).withColumn("slope", F.when(F.col("renewed"), F.col("new_slope")).otherwise(F.col("slope")))
    return _mask(both).select("cell_id", "i", "j", "z", "dir", "slope", "is_building", "is_sink")


def _concat(first: DataFrame, r1: Raster, second: DataFrame, r2: Raster, axis: str, diagonals: bool) -> tuple[DataFrame, Raster]:
    if (r1.ncols, r1.steps) != (r2.ncols, r2.steps) if axis == "i" else (r1.nrows, r1.steps) != (r2.nrows, r2.steps):
        raise ValueError("the rasters do not fit together")
    at = r1.nrows if axis == "i" else r1.ncols
    nrows, ncols = (r1.nrows + r2.nrows, r1.ncols) if axis == "i" else (r1.nrows, r1.ncols + r2.ncols)
    dx, dy = r1.steps
    moved = lambda df: df.withColumn(axis, F.col(axis) + at)
    both = first.unionByName(moved(second)).withColumn("cell_id", F.col("i") + (F.col("j") - 1) * nrows)
    cells = both.select("cell_id", "i", "j", "z")
    whole = Raster(cells, nrows, ncols, dx * nrows, dy * ncols)
    seam = Domain(at, at + 1, 1, ncols) if axis == "i" else Domain(1, nrows, at, at + 1)
    return update_spill_field(both, whole, seam, diagonals=diagonals, buildings=both.filter("is_building").select("i", "j"), sinks=both.filter("is_sink").select("i", "j"), grow=0), whole


def vconcat_fields(first: DataFrame, r1: Raster, second: DataFrame, r2: Raster, *, diagonals: bool = True) -> tuple[DataFrame, Raster]:
    """The field of two rasters on top of each other; only the two rows at the seam are computed again."""
    return _concat(first, r1, second, r2, "i", diagonals)


def hconcat_fields(first: DataFrame, r1: Raster, second: DataFrame, r2: Raster, *, diagonals: bool = True) -> tuple[DataFrame, Raster]:
    """The field of two rasters side by side."""
    return _concat(first, r1, second, r2, "j", diagonals)


def target_cell(nrows: int, ncols: int) -> Column:
    """The cell that a cell flows to: itself at bottoms, sinks and where it leaves the grid; null for
    buildings and voids."""
    d = F.col("dir")
    di = F.when(d.isin(0, 4, 7), -1).when(d.isin(1, 5, 6), 1).otherwise(0)
    dj = F.when(d.isin(2, 4, 6), -1).when(d.isin(3, 5, 7), 1).otherwise(0)
    i, j = F.col("i") + di, F.col("j") + dj
    inside = i.between(1, nrows) & j.between(1, ncols)
    return F.when(d >= 0, F.when(inside, i + (j - 1) * nrows).otherwise(F.col("cell_id"))).when(d.isin(BOTTOM, SINK), F.col("cell_id"))


def is_exit(nrows: int, ncols: int) -> Column:
    """Whether water leaves the domain at a cell: border bottoms, border cells that point outwards, sinks."""
    d = F.col("dir")
    out = (
        ((F.col("i") == 1) & d.isin(-1, 0, 4, 7)) | ((F.col("i") == nrows) & d.isin(-1, 1, 5, 6))
        | ((F.col("j") == 1) & d.isin(-1, 2, 4, 6)) | ((F.col("j") == ncols) & d.isin(-1, 3, 5, 7))
    )
    return F.coalesce(out | (d == SINK), F.lit(False))


def flow_edges(field: DataFrame, raster: Raster) -> DataFrame:
    """(cell_id, target) for every cell that flows to another one."""
    return field.select("cell_id", target_cell(raster.nrows, raster.ncols).alias("target")).filter("target <> cell_id")


def flat_edges(field: DataFrame, diagonals: bool = True) -> DataFrame:
    """Adjacent pairs of trap bottoms (cell_id, neighbour), each once."""
    ks = (1, 3, 5, 7) if diagonals else (1, 3)
    bottoms = field.filter(F.col("dir") == BOTTOM).select("cell_id", "i", "j")
    ends = bottoms.select(F.col("cell_id").alias("neighbour"), F.col("i").alias("ni"), F.col("j").alias("nj"))
    shifted = bottoms.select("cell_id", F.explode(F.array(*[F.struct((F.col("i") + DI[k]).alias("ni"), (F.col("j") + DJ[k]).alias("nj")) for k in ks])).alias("s"))
    return shifted.select("cell_id", "s.ni", "s.nj").join(ends, ["ni", "nj"]).select("cell_id", "neighbour")
