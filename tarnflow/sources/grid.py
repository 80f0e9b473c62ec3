"""Raster sources and sinks, rectangles and tilings.

A raster is a DataFrame cells(cell_id, i, j, z) with its size. cell_id = i + (j - 1) * nrows, 1-based
and column-major.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnflow.functions.runtime import Scratch, broadcast_if_small


@dataclass(frozen=True)
class Domain:
    """A rectangle of inclusive index ranges."""

    i_lo: int
    i_hi: int
    j_lo: int
    j_hi: int

    def size(self) -> tuple[int, int]:
        return max(0, self.i_hi - self.i_lo + 1), max(0, self.j_hi - self.j_lo + 1)

    def min(self, axis: int) -> int:
        return (self.i_lo, self.j_lo)[axis - 1]

    def max(self, axis: int) -> int:
        return (self.i_hi, self.j_hi)[axis - 1]

    def contains(self, i: str = "i", j: str = "j") -> Column:
        return F.col(i).between(self.i_lo, self.i_hi) & F.col(j).between(self.j_lo, self.j_hi)

    def grown(self, by: int, nrows: int, ncols: int) -> Domain:
        return Domain(max(1, self.i_lo - by), min(nrows, self.i_hi + by), max(1, self.j_lo - by), min(ncols, self.j_hi + by))


@dataclass(frozen=True)
class Raster:
    """Cells of one grid with its size; lengths are the physical extent (default: unit cells)."""

    cells: DataFrame = field(repr=False)
    nrows: int
    ncols: int
    len_x: float | None = None
    len_y: float | None = None

    @property
    def domain(self) -> Domain:
        return Domain(1, self.nrows, 1, self.ncols)

    @property
    def steps(self) -> tuple[float, float]:
        return (self.len_x or float(self.nrows)) / self.nrows, (self.len_y or float(self.ncols)) / self.ncols

    def with_cells(self, cells: DataFrame) -> Raster:
        return Raster(cells, self.nrows, self.ncols, self.len_x, self.len_y)


def raster_from_cells(df: DataFrame, nrows: int, ncols: int, len_x: float | None = None, len_y: float | None = None) -> Raster:
    """A raster of the columns i, j and z of ``df`` (any numeric z becomes a double)."""
    ij = df.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("z").cast("double").alias("z"))
    return Raster(ij.withColumn("cell_id", F.col("i") + (F.col("j") - 1) * nrows).select("cell_id", "i", "j", "z"), nrows, ncols, len_x, len_y)


def load_grid(spark: SparkSession, path: str, delim: str = ",") -> Raster:
    """Reads a headerless delimited text grid: line = i, field = j. Bad numbers and ragged lines raise.

    Large files are read in parallel splits: a line's number is its place in its split plus the lines of
    the splits before it. Several files follow each other by name; blank lines at the end are dropped.
    """
    scratch = Scratch(spark, "grid")
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), "value")
    text = scratch.put(text)  # ids of a split are consecutive; they are fixed here
    splits = text.groupBy("file", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    # one row a split
    before = F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1))
    splits = scratch.put(splits.select("file", "start", "first", F.coalesce(before, F.lit(0)).alias("before")))
    lines = text.join(broadcast_if_small(splits, splits.count()), ["file", "start"]).select((F.col("id") - F.col("first") + F.col("before") + 1).alias("i"), F.col("value").alias("line"))
    last = lines.filter("trim(line) <> ''").agg(F.max("i")).first()[0] or 0
    fields = lines.filter(F.col("i") <= last).select(F.col("i").cast("long").alias("i"), F.split("line", "\\Q" + delim + "\\E").alias("f"))
    shape = fields.agg(F.max("i"), F.min(F.size("f")), F.max(F.size("f"))).first()
    if shape[1] != shape[2]:
        raise ValueError(f"lines of {path} have {shape[1]} to {shape[2]} fields")
    cells = fields.select("i", F.posexplode("f").alias("j", "z")).select("i", (F.col("j") + 1).cast("long").alias("j"), F.trim("z").cast("double").alias("z"))
    return raster_from_cells(cells, shape[0], shape[2])


def load_grid_parts(spark: SparkSession, folder: str, delim: str = ",") -> Raster:
    """Reads what ``save_grid(numbered=True)`` wrote: every line carries its number, so parts are read in
    parallel and in any order."""
    fields = spark.read.text(folder).select(F.split("value", "\\Q" + delim + "\\E").alias("f"))
    rows = fields.select(F.col("f")[0].cast("long").alias("i"), F.posexplode(F.slice(F.col("f"), 2, F.size("f") - 1)).alias("j", "z"))
    cells = rows.select("i", (F.col("j") + 1).cast("long").alias("j"), F.col("z").cast("double").alias("z"))
    n, m = cells.agg(F.max("i"), F.max("j")).first()
    return raster_from_cells(cells, n, m)


def save_grid(raster: Raster, path: str, delim: str = ",", value: str = "z", numbered: bool = False) -> None:
    """Writes the raster as delimited text, lines in order of i (several part files, in order of their
    names, for a large one). ``numbered`` puts i in front of every line, for ``load_grid_parts``."""
    lines = raster.cells.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", F.col(value).cast("string").alias("s")))).alias("row"))
    joined = F.array_join(F.transform("row", lambda r: F.coalesce(r["s"], F.lit("NaN"))), delim)
    text = F.concat_ws(delim, F.col("i").cast("string"), joined) if numbered else joined
    lines.select("i", text.alias("value")).orderBy("i").select("value").write.mode("overwrite").text(path)


def test_data_dir(scale: str = "0.01") -> str:
    """Folder of the local test tables (``TARNFLOW_TESTDATA`` or the default place)."""
    return os.path.join(os.environ.get("TARNFLOW_TESTDATA", "/root/testdata"), f"sf{scale}")


def split_points(lo: int, hi: int, n: int) -> list[int]:
    """n + 1 equally spaced points in [lo, hi + 1], rounded down."""
    if n < 1 or n > hi - lo + 1:
        raise ValueError("the number of tiles must be between 1 and the length")
    return [lo + (hi + 1 - lo) * k // n for k in range(n + 1)]


def tile_domain(dom: Domain, nx: int, ny: int) -> tuple[list[Domain], list[int], list[int]]:
    """Regular tiling: (tiles, x split points, y split points)."""
    xs, ys = split_points(dom.i_lo, dom.i_hi, nx), split_points(dom.j_lo, dom.j_hi, ny)
    return tiles(xs, ys), xs, ys


def tiles(xsplit: Sequence[int], ysplit: Sequence[int]) -> list[Domain]:
    """Half-open rectangles between consecutive split points, x fastest."""
    return [Domain(a, b - 1, c, d - 1) for c, d in zip(ysplit, ysplit[1:], strict=False) for a, b in zip(xsplit, xsplit[1:], strict=False)]


def with_tiles(cells: DataFrame, doms: Sequence[Domain]) -> DataFrame:
    """Cells with the 1-based number of the tile that holds them (cells outside of all are dropped).

    The list of tiles is the caller's own and small: a range join against it is broadcast.
    """
    spark = cells.sparkSession
    table = spark.createDataFrame([(k + 1, d.i_lo, d.i_hi, d.j_lo, d.j_hi) for k, d in enumerate(doms)], "tile int, t_i_lo long, t_i_hi long, t_j_lo long, t_j_hi long")
    on = F.col("i").between(F.col("t_i_lo"), F.col("t_i_hi")) & F.col("j").between(F.col("t_j_lo"), F.col("t_j_hi"))
    return cells.join(F.broadcast(table), on).drop("t_i_lo", "t_i_hi", "t_j_lo", "t_j_hi")
