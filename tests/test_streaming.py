import time

from pyspark.sql import functions as F

from tidewell.operators import health
from tidewell.streaming import state


def test_states_equal_the_batch_windows(spark, tmp_path):
    rows = [(f"j{i % 3}", i, (i * 7) % 5 > 1) for i in range(60)]
    df = spark.createDataFrame(rows, "job string, n int, ok boolean").withColumn("ts", F.timestamp_seconds(F.col("n") * 60))
    df.where("n < 30").coalesce(1).write.parquet(str(tmp_path / "in"))
    df.where("n >= 30").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = state.job_states(stream, "job", "ts", "ok", "n").writeStream.format("memory").queryName("states").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = sorted((r["source_job_key"], r["ts"], r["consecutive_failures"], r["status"]) for r in spark.sql("select * from states").collect())
    batch = health.streaks(df, "job", ["n"], F.col("ok"), "ts").collect()
    assert got == sorted((r["job"], r["ts"], r["consecutive_failures"], r["status"]) for r in batch)


def test_a_second_run_appends_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (1, "a")], "k int, v string")
    df.write.parquet(str(tmp_path / "in"))
    for turn in range(2):
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        state.into_table(stream, str(tmp_path / "out"), str(tmp_path / f"check{turn}"), ["k"]).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_a_batch_reads_the_buckets_of_its_keys(spark, tmp_path):
    df = spark.range(2000).withColumn("v", F.col("id") % 7)
    df.write.parquet(str(tmp_path / "in"))
    state.into_table(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c1"), ["id"], buckets=32).awaitTermination()
    few = spark.range(1998, 2003).withColumn("v", F.lit(1).cast("long"))
    asked = sorted(r["b"] for r in few.select(state.bucket(["id"], 32).alias("b")).distinct().collect())
    plan = state.history(spark, str(tmp_path / "out"), ["id"], asked)
    read = [f.split("_bucket=")[1].split("/")[0] for f in plan.inputFiles()]
    files = spark.sparkContext._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [" in files and "_bucket" in files.split("PartitionFilters: [")[1].split("]")[0]
    assert len(asked) <= 5 and set(read) >= set(map(str, asked))
    few.write.parquet(str(tmp_path / "more"))
    state.into_table(spark.readStream.schema(df.schema).parquet(str(tmp_path / "more")), str(tmp_path / "out"), str(tmp_path / "c2"), ["id"], buckets=32).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 2003 and out.select("id").distinct().count() == 2003
    assert state.history(spark, str(tmp_path / "none"), ["id"], [1]) is None


def test_quarantines_end_without_a_receipt(spark, tmp_path):
    """Equal to the batch windows, and a release for each quarantine that the watermark passes before another receipt of its job."""
    hour = 3600
    rows = [("a", k, k * hour, False) for k in range(4)] + [("b", 9, 0, True), ("b", 10, hour, False)] + [("c", 20 + k, k * hour, False) for k in range(3)] + [("c", 30, 5 * hour, True)]
    later = [("z", 90, 40 * hour, True)], [("a", 91, 41 * hour, False), ("z", 92, 50 * hour, True)], [("z", 93, 90 * hour, True)], [("z", 94, 91 * hour, True)]
    for k, part in enumerate((rows, *later)):
        spark.createDataFrame(part, "job string, n int, s int, ok boolean").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_400)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files go by their time
    shape = spark.read.parquet(str(tmp_path / "in"))
    conf = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        stream = spark.readStream.schema(shape.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = state.quarantines(stream, "job", "ts", "ok", "n").writeStream.format("memory").queryName("quarantines").outputMode("append").start()
        query.processAllAvailable()
        query.stop()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    got = spark.sql("select source_job_key, (cast(ts as long) - 1700000400) div 3600 as h, consecutive_failures, status from quarantines").collect()
    batch = health.streaks(shape, "job", ["n"], F.col("ok"), "ts").collect()
    want = [(r["job"], int(r["s"]) // hour, r["consecutive_failures"], r["status"]) for r in batch]
    # a: quarantined from hour 3 to 27, and anew from 41 to 65; c is back at hour 5.
    assert sorted(map(tuple, got)) == sorted([*want, ("a", 27, 4, state.RELEASED), ("a", 65, 5, state.RELEASED)])


def test_deduplicated(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "n int, h string").withColumn("ts", F.timestamp_seconds("n"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = state.deduplicated(stream, "h", "ts").writeStream.format("memory").queryName("dedup").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("select count(distinct h) = count(*) as x from dedup").first()["x"] and spark.sql("select * from dedup").count() == 2
