"""Connected components of an undirected graph by minimum labels, and dense numbering of rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.functions.runtime import Scratch, salted_join

#: Edges up to which components are labelled in one task; they are counted first.
KERNEL_EDGES = 1_000_000


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    """Row count and an order-free hash of an edge set."""
    n, x = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return n, x or 0


def local_labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Least member of the component of each of n vertices 0..n-1, by minima and pointer jumping."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            break
        label = new
        keep = label[u] != label[v]
        u, v = u[keep], v[keep]
    return label


def _label_edges(pdf: pd.DataFrame) -> pd.DataFrame:
    ids, at = np.unique(np.concatenate([pdf["u"].to_numpy(), pdf["v"].to_numpy()]), return_inverse=True)
    label = local_labels(len(ids), at[: len(pdf)], at[len(pdf) :])
    low = label != np.arange(len(ids))
    return pd.DataFrame({"u": ids[low], "v": ids[label[low]]})


def minimum_labels(edges: DataFrame, scratch: Scratch | None = None, *, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """(u, v): every vertex u that is not the least of its component, with that least vertex v.

    Each round links the greater neighbours of a vertex, then the lesser ones, to the least of its
    neighbourhood. That halves chains and keeps components connected, so rounds grow with the
    logarithm of the longest chain. Minima are combined map-side and come back through a join that is
    salted where a vertex has a large share of the edges, so the edges of a hub are never in one task. At most
    ``kernel_edges`` edges are labelled in one task instead.
    """
    scratch = scratch or Scratch(edges.sparkSession, "labels")
    state = scratch.put(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = _fingerprint(state)
    if last[0] <= kernel_edges:
        return scratch.put(state.groupBy(F.lit(0).alias("all")).applyInPandas(_label_edges, "u long, v long"))
    while last[0]:
        both = symmetric(state)
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = salted_join(both.filter("v > u"), low, ["u"], ["v"], scratch).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.put(up)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        down = salted_join(large, low, ["u"], ["v"], scratch).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = scratch.put(down.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(state, large)
        now, state = _fingerprint(small), small
        if now == last:
            break
        last = now
    return state


def dense_numbers(rows: DataFrame, order: str, group: str | None = None, width: int = 1 << 16, out: str = "number") -> DataFrame:
    """Adds 1, 2, ... in ascending ``order`` (a bigint without repeats), within each value of ``group``.

    Rows are ranked inside ranges of ``width`` values; only the counts of the ranges pass through
    one task, not the rows.
    """
    keys = [group] if group else []
    ranged = rows.withColumn("_range", F.floor(F.col(order) / width).cast("long"))
    counts = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over((Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*keys, "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(order))
    return ranged.withColumn("_k", inner).join(offsets, [*keys, "_range"]).withColumn(out, (F.col("_k") + F.col("_before")).cast("long")).drop("_k", "_before", "_range")
