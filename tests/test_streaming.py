from pyspark.sql import functions as F
from strandspark.streaming import monitors


def run(spark, tmp_path, rows, build, name):
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def events(spark):
    rows = [("a", 0, 1.0), ("a", 2, 3.0), ("a", 30, 5.0), ("b", 1, 2.0), ("a", 7200, 0.0)]
    return spark.createDataFrame(rows, "w string, s int, v double").select("w", F.timestamp_seconds(F.col("s") + 1_000_000).alias("ts"), "v")


def test_tumbling_samples(spark, tmp_path):
    got = run(spark, tmp_path, events(spark), lambda s: monitors.samples(s, ["w"], "v", "10 seconds", "1 minute"), "samples_out")
    assert {(r["w"], r["n"], r["mean"]) for r in got.collect()} == {("a", 2, 2.0), ("a", 1, None), ("b", 1, None)}


def test_lost_workers(spark, tmp_path):
    got = run(spark, tmp_path, events(spark), lambda s: monitors.sessions(s, "w", "5 seconds", "1 minute"), "sessions_out")
    assert sorted((r["w"], r["beats"]) for r in got.collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_duplicates(spark, tmp_path):
    twice = events(spark).unionByName(events(spark))
    got = run(spark, tmp_path, twice, lambda s: monitors.once(s, ["w", "v"]), "once_out")
    assert got.count() == 5


def test_latest_of_each_poll(spark, tmp_path):
    """A poll is given out once it is over; the last one, still open, isn't."""
    got = run(spark, tmp_path, events(spark), lambda s: monitors.latest(s, ["w"], "v", "10 seconds", "1 minute"), "latest_out")
    assert sorted((r["w"], r["last"]) for r in got.collect()) == [("a", 3.0), ("a", 5.0), ("b", 2.0)]


def test_overdue_tasks_of_a_stream(spark, tmp_path):
    build = lambda s: monitors.overdue(s.withColumn("expected", F.lit(0.5)).withColumn("elapsed", F.col("v") * 4), "expected", "elapsed").where("overdue")
    got = run(spark, tmp_path, events(spark), build, "overdue_out")
    assert sorted(r["v"] for r in got.collect()) == [3.0, 5.0]
