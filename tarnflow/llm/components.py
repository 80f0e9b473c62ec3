"""Groups of records linked by pairwise matches.

1. Peel: breadth-first frontier joins from the vertex of highest degree reach its component, which
   at scale is the giant one and shallow around its hub.
2. Remove: an anti-join takes that component's edges away. If the search did not end within
   ``levels`` frontiers, everything reached so far is one group anyway and is contracted to one
   vertex instead, so that no depth of the graph costs more than ``levels`` rounds here.
3. Label: what is left gets minimum labels. Plain propagation needs one round for each link of
   the longest chain; here each round links neighbours to the least neighbour (first the greater
   neighbours, then the lesser ones), which halves chains and keeps every component connected.

Edges of a hub are never grouped into one task: minima are combined map-side, and the join that
brings them back has one row for each vertex on its other side, which adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.functions.runtime import Scratch, broadcast_if_small
from tarnflow.operators.components import KERNEL_EDGES, minimum_labels, symmetric

#: Frontier rounds of the breadth-first search before what it has reached is contracted.
LEVELS = 6


def _peel(edges: DataFrame, levels: int, scratch: Scratch) -> tuple[DataFrame, int, bool]:
    """Vertices reached from the hub (column v), the least of them, and whether that is all of them."""
    both = symmetric(edges)
    degree = both.groupBy("u").agg(F.count("*").alias("d"))
    hub = degree.agg(F.max(F.struct("d", (-F.col("u")).alias("m"))).alias("b")).first()[0]
    spark = edges.sparkSession
    frontier = scratch.put(spark.createDataFrame([(-hub["m"],)], "v long"))
    seen, n = [frontier], 1
    for _ in range(levels):
        reached = both.join(broadcast_if_small(frontier.withColumnRenamed("v", "u"), n), "u").select("v").distinct()
        for part in seen:
            reached = reached.join(part, "v", "left_anti")
        frontier = scratch.put(reached)
        n = frontier.count()
        if not n:
            break
        seen.append(frontier)
    out = seen[0]
    for part in seen[1:]:
        out = out.unionByName(part)
    return out, out.agg(F.min("v")).first()[0], not n


def link_groups(pairs: DataFrame, left: str = "a", right: str = "b", *, levels: int = LEVELS, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """One group identifier for every record linked directly or through others: (member, group_id).

    ``group_id`` is the least member of the group. Pairs with a null side or of a record with itself
    link nothing, repeated pairs and either order count once. Records without a link have no row. An
    empty table gives an empty result. Other columns are ignored whatever they are called.
    """
    spark = pairs.sparkSession
    scratch = Scratch(spark, "groups")
    raw = pairs.select(F.col(left).cast("long").alias("x"), F.col(right).cast("long").alias("y")).filter("x <> y")
    edges = scratch.put(raw.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    if not edges.count():
        return spark.createDataFrame([], "member long, group_id long")
    reached, least, whole = _peel(edges, levels, scratch)
    reached = scratch.put(reached)
    if whole:
        rest = edges.join(reached.withColumnRenamed("v", "u"), "u", "left_anti")
        giant = reached.select(F.col("v").alias("member"), F.lit(least).cast("long").alias("group_id"))
    else:
        at = reached.withColumn("to", F.lit(least).cast("long"))
        moved = edges.join(at.withColumnRenamed("v", "u").withColumnRenamed("to", "u2"), "u", "left").join(at.withColumnRenamed("to", "v2"), "v", "left")
        rest = moved.select(F.coalesce("u2", "u").alias("u"), F.coalesce("v2", "v").alias("v")).filter("u <> v").distinct()
        giant = None
    stars = minimum_labels(rest, scratch, kernel_edges=kernel_edges)
    labels = stars.select(F.col("u").alias("member"), F.col("v").alias("group_id"))
    labels = labels.unionByName(labels.select(F.col("group_id").alias("member"), "group_id").distinct())
    if whole:
        return labels.unionByName(giant)
    top = stars.filter(F.col("u") == least).select("v").first()
    final = int(top[0]) if top else int(least)
    inside = reached.select(F.col("v").alias("member"), F.lit(final).cast("long").alias("group_id"))
    return labels.filter(F.col("member") != least).unionByName(inside.filter(F.col("member") != final) if top else inside)


def decided_links(pairs: DataFrame, left: str, right: str, verdict: str, order: str) -> DataFrame:
    """Pairs (a, b) whose last verdict is true; the row of the highest ``order`` decides.

    The order of the two sides does not matter; null orders count lowest, a null verdict links
    nothing, and of rows that tie in ``order`` the false one holds.
    """
    p = pairs.select(F.col(left).cast("long").alias("x"), F.col(right).cast("long").alias("y"), F.col(order).alias("o"), F.coalesce(F.col(verdict), F.lit(False)).alias("s")).filter("x <> y")
    best = p.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max(F.struct("o", (~F.col("s")).alias("no"))).alias("m"))
    return best.filter(~F.col("m.no")).select("a", "b")
