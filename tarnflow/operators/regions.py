"""Catchments: connected components of flow and flat edges.

Each tile of the raster is labelled on its own (one exchange of the raster); only the edges across
tile seams, a share of 4 / tile side of the cells, go into the global component search between tile
labels. Regions are numbered by their first cell in column-major order, catchments inside the domain
upwards from 1, those that leave it downwards from -1; masked cells are 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.functions.runtime import Scratch, broadcast_if_small
from tarnflow.operators.components import dense_numbers, local_labels, minimum_labels
from tarnflow.operators.field import BOTTOM, DI, DJ, flat_edges, is_exit, target_cell
from tarnflow.sources.grid import Domain, Raster

#: Side of the tiles that are labelled in one piece.
TILE = 256


def _label_tile(pdf: pd.DataFrame, flats: bool, diagonals: bool) -> pd.DataFrame:
    pdf = pdf.sort_values("cell_id", ignore_index=True)
    ids = pdf["cell_id"].to_numpy()
    i, j, d = pdf["i"].to_numpy(), pdf["j"].to_numpy(), pdf["dir"].to_numpy()
    i0, j0 = i.min(), j.min()
    box = np.full((i.max() - i0 + 1, j.max() - j0 + 1), -1)
    box[i - i0, j - j0] = np.arange(len(ids))
    us, vs = [], []
    target = pdf["target"].to_numpy()
    k = np.searchsorted(ids, target)
    k[k == len(ids)] = 0
    hit = ids[k] == target
    us.append(np.flatnonzero(hit))
    vs.append(k[hit])
    if flats:
        b = np.flatnonzero(d == BOTTOM)
        for s in (1, 3, 5, 7) if diagonals else (1, 3):
            ni, nj = i[b] - i0 + DI[s], j[b] - j0 + DJ[s]
            ok = (ni >= 0) & (nj >= 0) & (ni < box.shape[0]) & (nj < box.shape[1])
            other = box[ni[ok], nj[ok]]
            both = (other >= 0) & (d[np.maximum(other, 0)] == BOTTOM)
            us.append(b[ok][both])
            vs.append(other[both])
    label = local_labels(len(ids), np.concatenate(us), np.concatenate(vs))
    return pd.DataFrame({"cell_id": ids, "label": ids[label]})


def _tile(c: str, side: int):
    return F.floor((F.col(c) - 1) / side).cast("int")


def spill_regions(field: DataFrame, raster: Raster, *, diagonals: bool = True, tile: int = TILE) -> DataFrame:
    """(cell_id, i, j, z, dir, region) for the output of ``spill_field``.

    Buildings and voids are 0. A region is outside (negative) exactly if it holds an exit cell.
    """
    scratch = Scratch(field.sparkSession, "regions")
    base = field.select("cell_id", "i", "j", "z", "dir", target_cell(raster.nrows, raster.ncols).alias("target"), is_exit(raster.nrows, raster.ncols).alias("leaves"))
    base = scratch.put(base)
    live = base.filter("target is not null").withColumns({"ti": _tile("i", tile), "tj": _tile("j", tile)})
    local = live.select("ti", "tj", "cell_id", "i", "j", "dir", "target").groupBy("ti", "tj").applyInPandas(lambda p: _label_tile(p, True, diagonals), "cell_id long, label long")
    local = scratch.put(local)
    # seams: cells that flow into another tile, and adjacent bottoms on both sides of a seam
    tj_of = F.floor((F.floor((F.col("target") - 1) / raster.nrows)) / tile)
    ti_of = F.floor(((F.col("target") - 1) % raster.nrows) / tile)
    flow = live.filter((ti_of != F.col("ti")) | (tj_of != F.col("tj"))).select(F.col("cell_id").alias("a"), F.col("target").alias("b"))
    rim = lambda c: (F.col(c) % tile).isin(0, 1)
    flat = flat_edges(base.filter(rim("i") | rim("j")), diagonals).select(F.col("cell_id").alias("a"), F.col("neighbour").alias("b"))
    seams = flow.unionByName(flat)
    ends = local.select(F.col("cell_id").alias("a"), F.col("label").alias("u"))
    links = seams.join(ends, "a").join(ends.select(F.col("a").alias("b"), F.col("u").alias("v")), "b").select("u", "v")
    merged = minimum_labels(links, scratch).select(F.col("u").alias("label"), F.col("v").alias("root"))
    # one row a tile label: its least cell is the label itself
    leaving = local.join(base.filter("leaves").select("cell_id"), "cell_id", "left_semi").select("label").distinct().withColumn("out", F.lit(True))
    tops = local.select("label").distinct().join(merged, "label", "left").join(leaving, "label", "left")
    tops = scratch.put(tops.select("label", F.coalesce("root", "label").alias("root"), F.coalesce("out", F.lit(False)).alias("out")))
    roots = tops.groupBy("root").agg(F.max("out").alias("out"))
    numbered = dense_numbers(roots, "root", "out").select("root", F.when(F.col("out"), -F.col("number")).otherwise(F.col("number")).alias("region"))
    names = scratch.put(tops.join(numbered, "root").select("label", "region"))
    known = local.join(broadcast_if_small(names, names.count()), "label").select("cell_id", "region")
    out = base.select("cell_id", "i", "j", "z", "dir").join(known, "cell_id", "left")
    return scratch.put(out.withColumn("region", F.coalesce("region", F.lit(0).cast("long"))))


def update_spill_regions(old: DataFrame, field: DataFrame, raster: Raster, domain: Domain, *, diagonals: bool = True, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Regions after the field changed inside ``domain`` and the cell around it, and pairs (old_region, new_region).

    Only regions that meet the grown rectangle are labelled again; all others keep their cells, and
    the whole is numbered again. Equals labelling from scratch.
    """
    scratch = Scratch(field.sparkSession, "regions-update")
    near = domain.grown(2, raster.nrows, raster.ncols)
    touched = old.filter(near.contains()).select("region").distinct()
    again = old.join(touched, "region", "left_semi").select("cell_id")
    sub = field.join(again, "cell_id", "left_semi")
    part = spill_regions(sub, raster, diagonals=diagonals, tile=tile).select("cell_id", "region")
    kept = old.join(touched, "region", "left_anti").select("cell_id", "region")
    tagged = part.select("cell_id", F.lit(1).alias("src"), "region").unionByName(kept.select("cell_id", F.lit(0).alias("src"), "region"))
    first = tagged.filter("region <> 0").groupBy("src", "region").agg(F.min("cell_id").alias("root")).withColumn("out", F.col("region") < 0)
    numbered = dense_numbers(first, "root", "out").select("src", "region", F.when(F.col("out"), -F.col("number")).otherwise(F.col("number")).alias("new_region"))
    new = scratch.put(tagged.join(numbered, ["src", "region"], "left").select("cell_id", F.coalesce("new_region", F.lit(0).cast("long")).alias("region")))
    out = field.select("cell_id", "i", "j", "z", "dir").join(new, "cell_id")
    pairs = old.select("cell_id", F.col("region").alias("old_region")).join(new.withColumnRenamed("region", "new_region"), "cell_id").select("old_region", "new_region").distinct()
    return out, pairs


def remap(df: DataFrame, pairs: DataFrame, column: str = "region") -> DataFrame:
    """Replaces the values of a column by a table (old, new); values without a row stay."""
    m = pairs.select(F.col("old").alias(column), "new")
    return df.join(m, column, "left").withColumn(column, F.coalesce("new", column)).drop("new")
