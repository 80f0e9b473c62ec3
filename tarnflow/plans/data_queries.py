"""Queries p1, p3 and p4 over the shared tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.functions.runtime import table
from tarnflow.operators.hierarchy import ancestor_pairs, latest_by, resolve_hierarchy
from tarnflow.operators.hotkeys import frequent_keys, key_profile
from tarnflow.operators.snapshots import snapshot_changes


def _links(spark: SparkSession, d: str) -> DataFrame:
    sp = latest_by(table(spark, d, "spillpoint"), "region", "revision", "downstream_region")
    return sp.select("region", F.when(F.col("downstream_region") > 0, F.col("downstream_region")).alias("downstream_region"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    got = resolve_hierarchy(_links(spark, d), "region", "downstream_region")
    return got.select(F.col("node").alias("region"), F.col("root").alias("root_region"), "steps", "outcome")


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    got = resolve_hierarchy(_links(spark, d), "region", "downstream_region", with_path=True)
    return got.select(F.col("node").alias("region"), F.col("root").alias("root_region"), "steps", "outcome", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    got = resolve_hierarchy(_links(spark, d), "region", "downstream_region", with_path=True)
    return ancestor_pairs(got).select(F.col("ancestor").alias("region"), F.col("node").alias("upstream_region"), F.col("distance").alias("steps"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(
        table(spark, d, "seq_trap"), series=["grid_id"], version="event_ix", key="trap",
        values=["filled", "amount", "runoff"], delivery="delivery", tolerance=1e-6,
    )


def p3_change_counts(spark: SparkSession, d: str) -> DataFrame:
    return p3_found(spark, d).groupBy("grid_id", "change_kind").agg(F.count("*").alias("n_changes"), F.countDistinct("trap").alias("n_traps"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    owned = table(spark, d, "cells").withColumn("region", F.when(F.col("region") != 0, F.col("region")))
    cells = frequent_keys(owned, "region", ["grid_id", "cell_id"], (1, 20))
    foot = frequent_keys(table(spark, d, "footprint"), "trap", ["grid_id", "trap", "cell_id"], (1, 20))
    return cells.select(F.lit("cells").alias("src_table"), F.col("key").alias("key_id")).unionByName(foot.select(F.lit("footprint").alias("src_table"), F.col("key").alias("key_id")))


def p4_region_profile(spark: SparkSession, d: str) -> DataFrame:
    got, _ = key_profile(table(spark, d, "cells"), "region", ["grid_id", "cell_id"], "z", extent=["i", "j"], quantiles=(0.1, 0.5, 0.9))
    return got.withColumnRenamed("key", "region")


def p4_trap_profile(spark: SparkSession, d: str) -> DataFrame:
    got, _ = key_profile(table(spark, d, "footprint"), "trap", ["grid_id", "cell_id"], "cell_id", extent=["cell_id"], quantiles=(0.5,))
    return got.select(F.col("key").alias("trap"), "n_items", "min_cell_id", "max_cell_id", F.col("q_50").cast("long").alias("median_cell_id"))


QUERIES = {f.__name__: f for f in (p1_found, p1_paths, p1_descendants, p3_found, p3_change_counts, p4_found, p4_region_profile, p4_trap_profile)}

_WALK = """
WITH RECURSIVE best AS (
  SELECT region, downstream_region AS d, row_number() OVER (PARTITION BY region ORDER BY revision DESC NULLS LAST, downstream_region DESC NULLS LAST) AS rn
  FROM spillpoint WHERE region IS NOT NULL),
link AS (
  SELECT b.region, CASE WHEN b.d > 0 AND k.region IS NOT NULL THEN b.d END AS nxt
  FROM best b LEFT JOIN (SELECT region FROM best WHERE rn = 1) k ON k.region = b.d WHERE b.rn = 1),
walk(region, cur, path, steps) AS (
  SELECT region, region, [region], 0 FROM link
  UNION ALL
  SELECT w.region, l.nxt, list_append(w.path, l.nxt), w.steps + 1
  FROM walk w JOIN link l ON l.region = w.cur WHERE l.nxt IS NOT NULL AND NOT list_contains(w.path, l.nxt)),
ends AS (
  SELECT w.region, w.cur, w.path, w.steps, l.nxt, list_position(w.path, l.nxt) AS hit
  FROM walk w JOIN link l ON l.region = w.cur WHERE l.nxt IS NULL OR list_contains(w.path, l.nxt)),
res AS (
  SELECT region, CASE WHEN nxt IS NULL THEN cur ELSE list_min(path[hit:]) END AS root_region,
    CAST(CASE WHEN nxt IS NULL THEN steps ELSE hit - 1 END AS BIGINT) AS steps,
    CASE WHEN nxt IS NULL THEN 'tree' WHEN hit = 1 THEN 'cycle' ELSE 'into_cycle' END AS outcome,
    CASE WHEN nxt IS NULL THEN path ELSE path[:hit] END AS path
  FROM ends)
"""

_SNAP = """
WITH top AS (SELECT grid_id, event_ix, max(delivery) AS delivery FROM seq_trap GROUP BY 1, 2),
heads AS (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY event_ix) AS sn FROM top),
r AS (SELECT DISTINCT h.grid_id, h.event_ix, h.sn, s.trap, s.filled, s.amount, s.runoff
      FROM seq_trap s JOIN heads h USING (grid_id, event_ix, delivery) WHERE s.trap IS NOT NULL),
ed AS (SELECT *, max(sn) OVER (PARTITION BY grid_id) AS last_sn FROM heads),
chg AS (
  SELECT coalesce(n.grid_id, o.grid_id) AS grid_id, coalesce(n.sn, o.sn + 1) AS sn, coalesce(n.trap, o.trap) AS trap,
    CASE WHEN o.trap IS NULL THEN 'added' WHEN n.trap IS NULL THEN 'removed'
      WHEN n.filled IS DISTINCT FROM o.filled
        OR NOT ((n.amount IS NULL AND o.amount IS NULL) OR coalesce(CASE WHEN isnan(n.amount) OR isnan(o.amount) THEN isnan(n.amount) AND isnan(o.amount) ELSE n.amount = o.amount OR abs(n.amount - o.amount) <= 0.000001 END, false))
        OR NOT ((n.runoff IS NULL AND o.runoff IS NULL) OR coalesce(CASE WHEN isnan(n.runoff) OR isnan(o.runoff) THEN isnan(n.runoff) AND isnan(o.runoff) ELSE n.runoff = o.runoff OR abs(n.runoff - o.runoff) <= 0.000001 END, false))
      THEN 'changed' END AS change_kind
  FROM r n FULL JOIN r o ON n.grid_id = o.grid_id AND n.trap = o.trap AND n.sn = o.sn + 1),
res AS (
  SELECT c.grid_id, e.event_ix, c.trap, c.change_kind FROM chg c JOIN ed e ON e.grid_id = c.grid_id AND e.sn = c.sn
  WHERE c.sn > 1 AND c.change_kind IS NOT NULL)
"""

ORACLES = {
    "p1_found": _WALK + "SELECT region, root_region, steps, outcome FROM res",
    "p1_paths": _WALK + "SELECT region, root_region, steps, outcome, array_to_string(path, '>') AS path FROM res",
    "p1_descendants": _WALK + "SELECT path[k + 1] AS region, region AS upstream_region, CAST(k AS BIGINT) AS steps FROM (SELECT region, path, unnest(range(1, len(path))) AS k FROM res)",
    "p3_found": _SNAP + "SELECT * FROM res",
    "p3_change_counts": _SNAP + "SELECT grid_id, change_kind, count(*) AS n_changes, count(DISTINCT trap) AS n_traps FROM res GROUP BY 1, 2",
    "p4_found": """
WITH c AS (SELECT DISTINCT region, grid_id, cell_id FROM cells), f AS (SELECT DISTINCT grid_id, trap, cell_id FROM footprint)
SELECT 'cells' AS src_table, region AS key_id FROM c WHERE region IS NOT NULL AND region <> 0 GROUP BY region
HAVING count(*) * 20 >= (SELECT count(*) FROM (SELECT DISTINCT grid_id, cell_id FROM cells))
UNION ALL
SELECT 'footprint', trap FROM f WHERE trap IS NOT NULL GROUP BY trap HAVING count(*) * 20 >= (SELECT count(*) FROM f)""",
    "p4_region_profile": """
WITH c AS (SELECT region, grid_id, cell_id, min(z) AS z, min(i) AS i, min(j) AS j FROM cells WHERE region IS NOT NULL GROUP BY 1, 2, 3)
SELECT region, count(*) AS n_items, count(z) AS n_values, min(z) AS low, max(z) AS high, min(i) AS min_i, max(i) AS max_i, min(j) AS min_j, max(j) AS max_j,
  quantile_disc(z, 0.1) AS q_10, quantile_disc(z, 0.5) AS q_50, quantile_disc(z, 0.9) AS q_90 FROM c GROUP BY region""",
    "p4_trap_profile": """
WITH f AS (SELECT DISTINCT grid_id, trap, cell_id FROM footprint WHERE trap IS NOT NULL)
SELECT trap, count(*) AS n_items, min(cell_id) AS min_cell_id, max(cell_id) AS max_cell_id, quantile_disc(cell_id, 0.5) AS median_cell_id FROM f GROUP BY trap""",
}
