import datetime as dt

from hearthline.streaming.live import resample_stream


def test_late_rows_and_bins(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    schema = "id long, property string, timestamp timestamp, value double"
    batches = [[(1, "t", at(1), 1.0), (1, "t", at(5), 3.0), (1, "t", at(6), 999.0)], [(1, "t", at(40), 7.0)], [(1, "t", at(2), 100.0), (1, "t", at(80), 9.0)]]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = resample_stream(stream, "15 minutes", "10 minutes", high=500).writeStream.outputMode("append").format("memory").queryName("bins").option("checkpointLocation", f"{tmp_path}/ck").start()
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q.processAllAvailable()
    q.stop()
    got = {r["timestamp"].minute: r["value"] for r in spark.table("bins").collect()}
    assert got == {0: 2.0, 30: 7.0}  # the late 100 came after its bin was closed
