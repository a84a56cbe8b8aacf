from pixelframe.sources import testcube as tc
from pixelframe.streaming.periods import run_statistics


def test_stream_equals_batch(spark, tmp_path):
    runs = tc.runs(spark, "/root/testdata/sf0.001").drop("event_id")
    runs.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(runs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = run_statistics(stream, late="400 days").writeStream.outputMode("complete").format("memory").queryName("periods").start()
    try:
        q.processAllAvailable()
        got = spark.table("periods")
        want = run_statistics(runs)
        key = lambda r: (r.start, r.scenario_id, r.n, round(r.mean, 9), r.low, r.high)
        assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    finally:
        q.stop()
