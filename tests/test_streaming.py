from waymark.streaming import usage


def test_stream_usage_and_new_records(spark, tmp_path):
    schema = "seq long, business_name string, website string, instagram string, facebook string, whatsapp string, phone string, email string, address string, city string, source_url string, confidence string, ts timestamp, provider string"
    import datetime as dt

    row = lambda i, w: (i, "N", w, None, None, None, None, None, None, "UNKNOWN", "u", "LOW", dt.datetime(2024, 1, 1, i), "p")
    spark.createDataFrame([row(0, "a.com"), row(1, "a.com"), row(2, "b.com")], schema).write.parquet(f"{tmp_path}/in/1")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
    q = usage.usage(stream, "ts", "provider").writeStream.outputMode("complete").format("memory").queryName("used").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("SELECT sum(calls) FROM used").first()[0] == 3
    q = usage.keep_new(stream, f"{tmp_path}/known", f"{tmp_path}/cp")
    q.awaitTermination(60)
    assert sorted(r.seq for r in spark.read.parquet(f"{tmp_path}/known").collect()) == [0, 2]
    spark.createDataFrame([row(5, "b.com"), row(6, "c.com")], schema).write.parquet(f"{tmp_path}/in/2")
    q = usage.keep_new(stream, f"{tmp_path}/known", f"{tmp_path}/cp")
    q.awaitTermination(60)
    assert sorted(r.seq for r in spark.read.parquet(f"{tmp_path}/known").collect()) == [0, 2, 6]


def test_stream_sessions(spark, tmp_path):
    import datetime as dt

    rows = [("a", dt.datetime(2024, 1, 1, h)) for h in (0, 1, 2, 9, 10)] + [("b", dt.datetime(2024, 1, 1, 5))]
    spark.createDataFrame(rows, "user string, ts timestamp_ntz").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("user string, ts timestamp_ntz").parquet(f"{tmp_path}/in")
    q = usage.sessions(stream, "ts", "user").writeStream.outputMode("complete").format("memory").queryName("runs").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.key, r.n_events) for r in spark.sql("SELECT * FROM runs").collect()) == [("a", 2), ("a", 3), ("b", 1)]
