"""Flat areas: found by slope, made exactly level by cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.functions.runtime import Scratch
from tarnflow.operators.components import minimum_labels
from tarnflow.operators.field import with_neighbours
from tarnflow.sources.grid import Raster


def _clusters(cells: DataFrame, links: DataFrame) -> DataFrame:
    """(cell_id, cluster) of linked cells; the cluster is its least cell."""
    low = minimum_labels(links)
    named = low.select(F.col("u").alias("cell_id"), F.col("v").alias("cluster"))
    return named.unionByName(named.select(F.col("cluster").alias("cell_id"), "cluster").distinct())


def identify_flat_areas(raster: Raster, rel_tol: float, min_cluster_size: int, lengths: tuple[float, float] | None = None) -> DataFrame:
    """(cell_id, is_flat): cells of clusters of more than ``min_cluster_size`` cells that are joined by
    slopes below ``rel_tol`` times the steepest one.

    The slope of two neighbours (four directions) is the height difference over the whole length of
    the axis. Voids join nothing.
    """
    lx, ly = lengths or (raster.nrows, raster.ncols)
    scratch = Scratch(raster.cells.sparkSession, "flat")
    near = with_neighbours(raster.cells.select("cell_id", "i", "j", "z"), ["z"], diagonals=False)
    sx, sy = F.abs(F.col("n1.z") - F.col("z")) / lx, F.abs(F.col("n3.z") - F.col("z")) / ly
    slopes = scratch.put(near.select("cell_id", sx.alias("sx"), sy.alias("sy")))
    limit = (slopes.agg(F.max(F.greatest("sx", "sy"))).first()[0] or 0.0) * rel_tol
    down = slopes.filter(F.col("sx") < limit).select(F.col("cell_id").alias("u"), (F.col("cell_id") + 1).alias("v"))
    right = slopes.filter(F.col("sy") < limit).select(F.col("cell_id").alias("u"), (F.col("cell_id") + raster.nrows).alias("v"))
    named = scratch.put(_clusters(raster.cells, down.unionByName(right)))
    large = named.groupBy("cluster").agg(F.count("*").alias("n")).filter(F.col("n") > min_cluster_size)
    flat = named.join(large, "cluster", "left_semi").select("cell_id").withColumn("is_flat", F.lit(True))
    out = raster.cells.select("cell_id").join(flat, "cell_id", "left").withColumn("is_flat", F.coalesce("is_flat", F.lit(False)))
    # a single cell is a cluster of its own
    return out if min_cluster_size >= 1 else out.withColumn("is_flat", F.lit(True))


def mask_clusters(mask: DataFrame, raster: Raster, *, edge_quirk: bool = True) -> DataFrame:
    """(cell_id, cluster) of the cells of ``mask`` (cell_id, i, j), joined in four directions. With
    ``edge_quirk`` cells of the last row and of the last column do not start a link."""
    m = mask.select("cell_id", "i", "j")
    start = m.filter((F.col("i") < raster.nrows) & (F.col("j") < raster.ncols)) if edge_quirk else m
    ends = m.select(F.col("cell_id").alias("v"))
    below = start.filter(F.col("i") < raster.nrows).select(F.col("cell_id").alias("u"), (F.col("cell_id") + 1).alias("v"))
    right = start.filter(F.col("j") < raster.ncols).select(F.col("cell_id").alias("u"), (F.col("cell_id") + raster.nrows).alias("v"))
    links = below.unionByName(right).join(ends, "v", "left_semi").select("u", "v")
    return m.select("cell_id").join(_clusters(m, links), "cell_id", "left").select("cell_id", F.coalesce("cluster", "cell_id").alias("cluster"))


def flatten_grid(raster: Raster, mask: DataFrame, height: str = "min", *, edge_quirk: bool = True) -> Raster:
    """The raster with every cluster of the mask at its least, greatest or mean height."""
    agg = {"min": F.min, "max": F.max, "mean": F.avg}[height]
    named = mask_clusters(mask, raster, edge_quirk=edge_quirk)
    level = raster.cells.join(named, "cell_id").groupBy("cluster").agg(agg("z").alias("level"))
    cells = raster.cells.join(named, "cell_id", "left").join(level, "cluster", "left")
    return raster.with_cells(cells.select("cell_id", "i", "j", F.coalesce("level", "z").alias("z")))
