"""Replayed streams: several batches give what one batch gives, and late rows are kept."""

import datetime as dt

from pyspark.sql import functions as F

from tierlift.streaming import event_windows as w

START = dt.datetime(2024, 1, 1)


def events(spark):
    rows = [(i, START + dt.timedelta(minutes=7 * i), i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, ts timestamp, k int")
    # Every tenth row comes two batches later, and is then long past the watermark.
    return df.withColumn("part", F.floor(F.col("id") / 50) + (F.col("id") % 10 == 9).cast("int") * 2)


def run(spark, folder, state, files=1):
    stream = w.file_stream(spark, folder, events(spark).drop("part"), files)
    w.store_closed(w.sliding_windows(stream, "ts", ["k"], "20 minutes", "10 minutes", "5 minutes",
                                     [F.count(F.lit(1)).alias("n")]), state)
    return w.closed(spark, state)


def test_batches_and_one_table_agree_but_for_late_rows(spark, tmp_path):
    df = events(spark)
    w.replay(df, "part", str(tmp_path / "in"))
    got = run(spark, str(tmp_path / "in"), str(tmp_path / "windows"))
    stream = w.file_stream(spark, str(tmp_path / "in"), df.drop("part"))
    w.store_late_rows(stream, "ts", w.last_window_end("ts", "20 minutes", "10 minutes"),
                      "5 minutes", str(tmp_path / "late"))
    late = w.late_rows(spark, str(tmp_path / "late"))
    late_ids = {r["id"] for r in late.collect()}
    assert late_ids and all(i % 10 == 9 for i in late_ids)
    # What is late came two batches after its neighbours; rows at the end of a batch may still be in time.
    assert {i for i in range(200) if i % 10 == 9 and i % 50 < 45} <= late_ids
    kept = df.where(~F.col("id").isin(late_ids))
    want = w.sliding_windows(kept, "ts", ["k"], "20 minutes", "10 minutes", "5 minutes",
                             [F.count(F.lit(1)).alias("n")])
    mark = START + dt.timedelta(minutes=7 * 199 - 5)
    assert sorted(map(tuple, got.collect())) == sorted(
        tuple(r) for r in want.collect() if r["window_end"] <= mark)


def test_restart_goes_on_after_the_checkpoint(spark, tmp_path):
    df = events(spark).where("id % 10 <> 9")
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    w.replay(df.where("part < 2"), "part", folder)
    first = run(spark, folder, state).count()
    w.replay(df.where("part >= 2"), "part", folder)
    twice = run(spark, folder, state)
    w.replay(df, "part", str(tmp_path / "all"))
    once = run(spark, str(tmp_path / "all"), str(tmp_path / "other"))
    assert 0 < first < twice.count()
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_sessions_on_a_table(spark):
    rows = [(1, START + dt.timedelta(minutes=m)) for m in (0, 4, 30, 33, 36)]
    df = spark.createDataFrame(rows, "k int, ts timestamp")
    got = w.sessions(df, "ts", ["k"], "5 minutes", "1 minute", [F.count(F.lit(1)).alias("n")])
    assert sorted((r["session_start"].minute, r["session_end"].minute, r["n"])
                  for r in got.collect()) == [(0, 9, 2), (30, 41, 3)]
