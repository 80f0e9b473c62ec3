"""The physical plans stay what they are meant to be."""

from pyspark.sql import functions as F

from tarnflow.functions.runtime import Scratch, bucket_count, co_partitioned, salted_join
from tarnflow.operators.field import with_neighbours
from tarnflow.operators.hotkeys import distinct_items
from tarnflow.operators.regions import remap


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_neighbours_take_two_exchanges(spark):
    cells = spark.range(100).select(F.col("id").alias("cell_id"), (F.col("id") % 10).alias("i"), F.floor(F.col("id") / 10).alias("j"), F.col("id").alias("z"))
    p = plan(with_neighbours(cells, ["z"]))
    assert p.count("Exchange hashpartitioning") == 2 and "Join" not in p and "Python" not in p


def test_distinct_items_share_one_exchange(spark):
    df = spark.range(100).select(F.col("id").alias("k"), F.col("id").alias("g"), F.col("id").alias("c"), F.lit(1.0).alias("v"))
    p = plan(distinct_items(df, "k", ["g", "c"], "v"))
    assert p.count("Exchange hashpartitioning") == 1 and "SinglePartition" not in p


def test_scans_read_only_what_is_used(spark, tmp_path):
    spark.range(10).select(F.col("id").alias("region"), F.lit("x").alias("wide"), F.lit(1).alias("other")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    p = plan(remap(df.select("region"), spark.createDataFrame([(1, 2)], "old long, new long")).filter("region > 3"))
    assert "wide" not in p and "other" not in p


def test_bucketed_sides_are_not_exchanged(spark):
    scratch = Scratch(spark, "plans")
    df = spark.range(1000).select((F.col("id") % 7).alias("s"), (F.col("id") % 50).alias("k"), F.floor(F.col("id") / 350).alias("ver"), F.col("id").alias("v"))
    t = scratch.put_bucketed(df, ["s", "k"], 5)
    old = t.select("s", "k", (F.col("ver") + 1).alias("ver"), F.col("v").alias("o"))
    with co_partitioned(spark):
        joined = t.hint("merge").join(old, ["s", "k", "ver"], "full")
        p = plan(joined)
        again = plan(scratch.put_bucketed(joined, ["s", "k"], 5, placed=True).hint("merge").join(t, ["s", "k", "ver"]))
        rows = joined.count()
    assert "SortMergeJoin" in p and "Exchange" not in p and "Exchange" not in again
    assert rows == df.join(old, ["s", "k", "ver"], "full").count()
    path = t._scratch_path
    scratch.drop(t)
    assert not __import__("os").path.exists(path)
    assert bucket_count(spark, 0) == 1 and bucket_count(spark, 10**10) == 5000


def test_salted_join(spark):
    scratch = Scratch(spark, "plans")
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 500).alias("k"), F.col("id").alias("x"))
    rows = rows.unionByName(spark.createDataFrame([(None, -1)], "k long, x long"))
    state = spark.range(0, 600, 2).unionByName(spark.createDataFrame([(1,), (1,)], "id long")).select(F.col("id").alias("k"), F.lit("s").alias("y"))
    got = salted_join(rows, state, ["k"], ["x"], scratch, parts=8)
    want = rows.join(state, "k")
    assert got.count() == want.count() and not got.exceptAll(want.select(*got.columns)).count()
