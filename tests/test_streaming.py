import time

from pyspark.sql import functions as F

from gridloom.streaming import agents as A


def frames(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")



def test_stream_gives_what_the_batch_gives(spark, sf, tmp_path):
    df = frames(spark, sf)
    source = str(tmp_path / "in")
    for i, bounds in enumerate(((0, 300), (300, 700), (700, 1000))):
        ranked = df.orderBy("ts", "event_id").limit(bounds[1]).exceptAll(df.orderBy("ts", "event_id").limit(bounds[0]))
        ranked.coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1 if i < 2 else 0)
    stream = spark.readStream.schema(A.EVENT).option("maxFilesPerTrigger", 1).parquet(source)
    q = A.track_stream(stream).writeStream.format("memory").queryName("tracks").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.table("tracks").collect()))
    assert got == sorted(map(tuple, A.track_batch(df).collect())) and len(got) == 1000
    assert len(q.recentProgress) >= 3


def test_state_machine():
    state = A.start()
    assert A.step(state, 10.0, "view") == (True, True, False)
    assert A.step(state, 10.05, "click") == (False, True, False)
    assert A.step(state, -1.0, "click") == (False, False, False) and state[1] == 1
    assert A.step(state, 30.0, "view") == (True, True, True) and state[3] == 0
    for k in range(2):
        A.step(state, 100.0 * (k + 1), "purchase")
    assert A.step(state, 5.0, "view") == (True, True, True) and state[2:4] == [0, 1]
    for _ in range(3):
        A.step(state, None, "view")
    assert state[0] is None


def test_upserts_by_batch(spark, tmp_path):
    sink = A.upsert_sink(str(tmp_path / "poses"), ["camera"], "version")
    one = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "camera int, version int, pose string")
    two = spark.createDataFrame([(2, 3, "d"), (2, 2, "c"), (3, 1, "e")], "camera int, version int, pose string")
    sink(one, 0)
    sink(two, 1)
    sink(two, 1)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "poses/1")).collect())) == [(1, 1, "a"), (2, 3, "d"), (3, 1, "e")]


def test_windowed_counts_as_batch(spark, sf, tmp_path):
    df = frames(spark, sf)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(A.EVENT).parquet(str(tmp_path / "in"))
    q = A.windowed_counts(stream, late="100 days").writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("hours").collect())) == sorted(map(tuple, A.windowed_counts(df, late="100 days").collect()))


def test_silent_agents_time_out_once(spark, tmp_path):
    spark.createDataFrame([(7, 5), (8, 6)], "user_id long, event_id long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, event_id long").parquet(str(tmp_path / "in"))
    q = A.liveness(stream, silent_ms=1000).writeStream.format("memory").queryName("silent").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(40):
            q.awaitTermination(1)
            if spark.table("silent").count() >= 2:
                break
    finally:
        q.stop()
    assert sorted(map(tuple, spark.table("silent").collect())) == [(7, 5), (8, 6)]
