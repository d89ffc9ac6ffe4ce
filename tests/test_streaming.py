import datetime as dt

from panelforge.streaming.bars import bars

SCHEMA = "ts timestamp, asset string, price double, amount double"


def ticks():
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    return [(t(1), "a", 10.0, 1.0), (t(5), "a", 12.0, None), (t(3), "a", 8.0, 2.0), (t(4), "a", None, 9.0), (t(30), "a", 9.0, 1.0), (t(2), "b", 5.0, 1.0)]


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(ticks(), SCHEMA)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = bars(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("bars_out").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.table("bars_out").collect())
    assert got == sorted(tuple(r) for r in bars(df).collect())
    first = got[0]
    assert first[0] == "a" and first[2:] == (10.0, 12.0, 8.0, 12.0, 3.0, 3)
