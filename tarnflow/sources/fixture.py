"""The test raster derived from the lineitem table, with its companion masks and rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.functions.runtime import table
from tarnflow.sources.grid import Raster, raster_from_cells


def fixture_raster(spark: SparkSession, d: str) -> Raster:
    """Quantities summed into an n x n raster by order and part, then smoothed 5 x 5 in integers.

    The smoothing is separable: sums along i, then along j.
    """
    items = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    n = int((items.count() / 6) ** 0.5)
    raw = items.groupBy((F.col("l_orderkey") % n + 1).cast("long").alias("i"), (F.col("l_partkey") % n + 1).cast("long").alias("j")).agg(F.sum(F.round("l_quantity").cast("long")).alias("s"))
    offs = F.explode(F.array(*[F.lit(k) for k in range(-2, 3)]))
    one = raw.select("i", "j", "s", offs.alias("o")).select((F.col("i") + F.col("o")).alias("i"), "j", "s").filter(F.col("i").between(1, n)).groupBy("i", "j").agg(F.sum("s").alias("s"))
    two = one.select("i", "j", "s", offs.alias("o")).select("i", (F.col("j") + F.col("o")).alias("j"), "s").filter(F.col("j").between(1, n)).groupBy("i", "j").agg(F.sum("s").alias("s"))
    every = spark.range(1, n + 1).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))).alias("j"))
    span = lambda c: F.least(F.col(c) + 2, F.lit(n)) - F.greatest(F.col(c) - 2, F.lit(1)) + 1
    dense = every.join(two, ["i", "j"], "left").withColumn("s", F.coalesce("s", F.lit(0)))
    z = F.expr("s * 1000").cast("long")
    cells = dense.select("i", "j", F.floor(z / (span("i") * span("j"))).alias("z"))
    return raster_from_cells(cells, n, n)


def buildings(raster: Raster) -> DataFrame:
    return raster.cells.filter("(i * 31 + j * 17) % 101 = 0").select("i", "j")


def sinks(raster: Raster) -> DataFrame:
    return raster.cells.filter("(i * 13 + j * 29) % 211 = 0").select("i", "j")


def infiltration(raster: Raster) -> DataFrame:
    """(cell_id, infil) = (i + j) mod 3, to go with rain 2."""
    return raster.cells.select("cell_id", ((F.col("i") + F.col("j")) % 3).cast("double").alias("infil"))
