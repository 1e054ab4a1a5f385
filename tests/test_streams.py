"""Periods of presence over several batches."""

from datetime import datetime, timedelta

from kerbline.streaming import feeds

START = datetime(2024, 5, 1)


def at(minutes):
    return START + timedelta(minutes=minutes)


def test_periods_close_once(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    batches = [
        # a is present from 0 to 20 (gap 10 minutes), out of order; b and one without a key once. The watermark goes to 20 - 5.
        [("a", 0), ("a", 9), ("b", 3), ("a", 20), ("a", 14), ("a", None), (None, 1)],
        # The watermark goes to 60 - 5: a's period ends. c has two periods that a row of the next batch joins.
        [("c", 49), ("c", 60)],
        # 56 is in time and joins 49 and 60; 30 is too late and left out.
        [("c", 56), ("a", 30)],
        # Everything up to 200 - 5 ends; a comes back after its state was dropped.
        [("a", 200)],
        [("d", 400)],
    ]
    got = []
    for k, rows in enumerate(batches):
        df = spark.createDataFrame([(key, None if m is None else at(m)) for key, m in rows], "key string, ts timestamp")
        df.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        made = feeds.periods(stream, "key", "ts", timedelta(minutes=10), "5 minutes")
        q = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
        rows_now = spark.read.schema(made.schema).parquet(out).collect()
        new = sorted(((r["key"], r["first"], r["last"]) for r in rows_now if r not in got), key=str)
        got = rows_now
        want = {
            0: [("b", at(3), at(3)), (None, at(1), at(1))],
            1: [("a", at(0), at(20))],
            2: [],
            3: [("c", at(49), at(60))],
            4: [("a", at(200), at(200))],
        }[k]
        assert new == sorted(want, key=str), k
        # Each period was given once, and what is left in state are the open ones.
        assert len(rows_now) == len({(r["key"], r["first"]) for r in rows_now})


def test_pause_of_the_gap_itself_goes_on_and_nothing_runs_in_python(spark, tmp_path):
    micro = timedelta(microseconds=1)
    rows = [("a", at(0)), ("a", at(10)), ("a", at(20) + micro), ("b", at(500))]
    spark.createDataFrame(rows, "key string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "in"))
    made = feeds.periods(stream, "key", "ts", timedelta(minutes=10), "0 seconds")
    assert "InPy" not in made._jdf.queryExecution().logical().toString() and "InPandas" not in made._jdf.queryExecution().logical().toString()
    q = made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.schema(made.schema).parquet(str(tmp_path / "out")).collect())
    assert got == [("a", at(0), at(10)), ("a", at(20) + micro, at(20) + micro)]
