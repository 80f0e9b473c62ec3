"""Full hierarchies from parent links of unknown depth.

Every round is one frontier join: nodes whose pointer meets an already reached node take its root
and depth, the others double their stride. Round k thereby reaches the whole band of levels
[2^k, 2^(k+1)) below the roots, so a tree of depth d needs log2(d) joins and not d. A round that
reaches nothing proves that only loops and the branches into them are left (the levels of a tree
have no gap); the nodes that the doubled map still hits are then the loops. The nodes left over at that
point are counted; the loops among few enough of them are found in one task (three numbers a node, no
paths), those among more of them by joins. Paths are always made by the joins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.functions.runtime import Scratch

TREE, CYCLE, INTO_CYCLE = "tree", "cycle", "into_cycle"
#: Nodes that no root reaches (loops and what runs into them) up to which one task takes them apart.
KERNEL_ROWS = 1_000_000


def _reach(unreached: DataFrame, reached: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], DataFrame, int]:
    """Frontier joins with doubling stride until a round reaches nothing.

    unreached: node, jump, steps, path; reached: node, root, steps, path. Returns the frames of
    reached nodes, the frame that stays unreached and its row count.
    """
    done, left = [reached], unreached.count()
    while left:
        known = unreached.select("node", F.col("jump").alias("k_jump"), F.lit(None).cast("long").alias("k_root"), F.col("steps").alias("k_steps"), F.col("path").alias("k_path"))
        for part in done:
            known = known.unionByName(part.select("node", F.lit(None).cast("long").alias("k_jump"), F.col("root").alias("k_root"), F.col("steps").alias("k_steps"), F.col("path").alias("k_path")))
        met = unreached.select(F.col("node").alias("n"), "jump", "steps", "path").join(known.withColumnRenamed("node", "jump"), "jump")
        step = scratch.put(
            met.select(
                F.col("n").alias("node"), F.col("k_root").alias("root"), F.col("k_jump").alias("jump"),
                (F.col("steps") + F.col("k_steps")).alias("steps"), F.concat("path", "k_path").alias("path"),
            ),
            rebalance=True,
        )
        still = step.filter(F.col("root").isNull()).select("node", "jump", "steps", "path")
        n = still.count()
        done.append(step.filter(F.col("root").isNotNull()).select("node", "root", "steps", "path"))
        if n == left:
            done.pop()
            return done, unreached, left
        unreached, left = still, n
    return done, unreached, left


def _loops(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Of nodes that never meet a root (node, parent): those on a loop, with the loop's smallest node."""
    state = scratch.put(links.select("node", F.col("parent").alias("jump"), F.col("node").alias("low")))
    hit = -1
    while True:
        doubled = state.alias("a").join(state.select(F.col("node").alias("jump"), F.col("jump").alias("far"), F.col("low").alias("far_low")), "jump")
        nxt = scratch.put(doubled.select("node", F.col("far").alias("jump"), F.least("low", "far_low").alias("low"), (F.col("far_low") < F.col("low")).alias("moved")))
        image = nxt.select("jump").distinct()
        on_loop = nxt.join(image.withColumnRenamed("jump", "node"), "node", "left_semi")
        n, moved = on_loop.agg(F.count("*"), F.max(F.col("moved").cast("int"))).first()
        scratch.drop(state)
        state = nxt.drop("moved")
        state._scratch_path = nxt._scratch_path
        # The image of the doubled map stays the same: every node of it comes back to itself. Windows
        # that no longer lower the minimum tile the whole loop.
        if n == hit and not moved:
            return scratch.put(on_loop.select("node", "low"))
        hit = n


def _take_apart(pdf: pd.DataFrame) -> pd.DataFrame:
    """Loops and the branches into them, of nodes (node, parent) that never meet a root."""
    ids = np.sort(pdf["node"].to_numpy())
    order = np.argsort(pdf["node"].to_numpy())
    step = np.searchsorted(ids, pdf["parent"].to_numpy()[order])
    jump, low, span = step, np.arange(len(ids)), 1
    while True:
        low, jump, span = np.minimum(low, low[jump]), jump[jump], span * 2
        if span >= len(ids):
            break
    on = np.zeros(len(ids), bool)
    on[jump] = True
    to, steps = np.where(on, np.arange(len(ids)), step), np.where(on, 0, 1)
    while not on[to].all():
        steps, to = steps + steps[to], to[to]
    return pd.DataFrame({"node": ids, "root": ids[low[to]], "steps": steps, "outcome": np.where(on, CYCLE, INTO_CYCLE)})


def resolve_hierarchy(links: DataFrame, node: str = "node", parent: str = "parent", *, with_path: bool = False, kernel_rows: int = KERNEL_ROWS) -> DataFrame:
    """Root, depth, outcome and (on request) the full path of every node.

    Result: node, root, steps, outcome and, with ``with_path``, path (from the node to its root, or
    to the first node of the loop that it runs into). A node is a root if its parent is null or is
    no node. Rows with a null node are no nodes; repeated rows count once; of several parents of a
    node the smallest holds. Other columns are ignored whatever they are called. An empty table
    gives an empty result. On a loop root is the loop's smallest node and steps is 0.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "hierarchy")
    raw = links.select(F.col(node).cast("long").alias("node"), F.col(parent).cast("long").alias("parent"))
    one = raw.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("parent").alias("parent"))
    one = scratch.put(one)
    ids = one.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    tied = scratch.put(one.join(ids, "parent", "left").select("node", F.when(F.col("known"), F.col("parent")).alias("parent")))
    path = F.array("node") if with_path else F.array().cast("array<bigint>")
    roots = tied.filter(F.col("parent").isNull()).select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("steps"), path.alias("path"))
    inner = tied.filter(F.col("parent").isNotNull())
    start = inner.select("node", F.col("parent").alias("jump"), F.lit(1).cast("long").alias("steps"), path.alias("path"))
    done, left, n = _reach(start, roots, scratch)
    parts = [p.withColumn("outcome", F.lit(TREE)) for p in done]
    if n:
        bare = inner.join(left.select("node"), "node", "left_semi")
        apart = scratch.put(bare.groupBy(F.lit(0).alias("all")).applyInPandas(_take_apart, "node long, root long, steps long, outcome string")) if n <= kernel_rows else None
    if n and apart is not None and not with_path:
        parts.append(apart.select("node", "root", "steps", path.alias("path"), "outcome"))
    elif n:
        loops = _loops(bare, scratch) if apart is None else apart.filter(F.col("outcome") == CYCLE).select("node", F.col("root").alias("low"))
        on = loops.select("node", F.col("low").alias("root"), F.lit(0).cast("long").alias("steps"), path.alias("path"))
        parts.append(on.withColumn("outcome", F.lit(CYCLE)))
        off = bare.join(loops.select("node"), "node", "left_anti")
        start = off.select("node", F.col("parent").alias("jump"), F.lit(1).cast("long").alias("steps"), path.alias("path"))
        ran, _, _ = _reach(start, on, scratch)
        parts += [p.withColumn("outcome", F.lit(INTO_CYCLE)) for p in ran[1:]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    cols = ["node", "root", "steps", "outcome"] + (["path"] if with_path else [])
    return out.select(*cols)


def ancestor_pairs(resolved: DataFrame) -> DataFrame:
    """(ancestor, node, distance) from the paths of ``resolve_hierarchy(..., with_path=True)``.

    A node is no ancestor of itself. The pairs of an ancestor are all of its descendants; on a loop
    and beyond the first node of a loop there are none. Null paths give no pairs.
    """
    return resolved.select("node", F.posexplode("path").alias("distance", "ancestor")).filter("distance > 0").select("ancestor", "node", F.col("distance").cast("long").alias("distance"))


def latest_by(df: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """One row for each key: the values of its highest ``order``; null orders count lowest.

    Rows that tie in ``order`` are decided by the largest values, so the result does not depend on
    how rows arrive.
    """
    best = df.groupBy(key).agg(F.max(F.struct(F.col(order).alias("o"), *[F.col(v).alias(v) for v in values])).alias("b"))
    return best.select(key, *[F.col("b")[v].alias(v) for v in values])
