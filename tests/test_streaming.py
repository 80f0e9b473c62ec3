from tarnflow.streaming.state import current_state, rain_windows


def drain(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_state_of_a_growing_log(spark, tmp_path):
    rows = [(1, 1, 5.0, None), (1, 3, None, 7.0), (1, 2, 6.0, 1.0), (2, 1, None, None)]
    spark.createDataFrame(rows, "k long, o long, a double, b double").write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema("k long, o long, a double, b double").parquet(str(tmp_path / "log"))
    got = {tuple(r) for r in drain(spark, current_state(stream, "k", ["a", "b"], "o"), "state", "complete").collect()}
    assert got == {(1, 6.0, 7.0), (2, None, None)}


def test_windows(spark, tmp_path):
    df = spark.sql("SELECT timestamp '2024-01-01 00:00:10' AS t, 1.0D AS rate UNION ALL SELECT timestamp '2024-01-01 00:00:50', 3.0D UNION ALL SELECT timestamp '2024-01-01 00:01:05', 9.0D")
    df.write.parquet(str(tmp_path / "w"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "w"))
    got = sorted((r["mean_rate"], r["n"]) for r in drain(spark, rain_windows(stream, "t", "rate", "1 minute", "5 minutes"), "win", "complete").collect())
    assert got == [(2.0, 2), (9.0, 1)]
