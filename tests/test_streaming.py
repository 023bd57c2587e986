"""Streaming operators over files, read to the end."""

import datetime

from fleetgauge.streaming import live

START = datetime.datetime(2026, 1, 1)


def run(spark, tmp_path, rows, build, mode):
    source, name = str(tmp_path / "in"), "live_" + tmp_path.name.replace("-", "_")
    data = [(k, c, START + datetime.timedelta(seconds=s), v) for k, c, s, v in rows]
    spark.createDataFrame(data, "test_id long, channel string, ts timestamp, v double").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("test_id long, channel string, ts timestamp, v double").parquet(source)
    started = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    started.awaitTermination(120)
    return spark.table(name).collect()


def test_gaps(spark, tmp_path):
    rows = [(1, "a", s, 0.0) for s in (0, 1, 2, 9, 10)]
    got = run(spark, tmp_path, rows, lambda s: live.gaps(s, 3.0, "1 minute"), "append")
    assert [r["end_at"] - r["start_at"] for r in got] == [7.0]


def test_sessions_and_slopes(spark, tmp_path):
    rows = [(1, "a", s, 1.0) for s in (0, 1, 30)]
    got = run(spark, tmp_path, rows, lambda s: live.pulse_sessions(s, "5 seconds", "1 second"), "complete")
    assert sorted(r["pulses"] for r in got) == [1, 2]


def test_slopes(spark, tmp_path):
    rows = [(1, "a", s, 2.0 * s) for s in range(0, 60, 10)]
    got = run(spark, tmp_path, rows, lambda s: live.sliding_slopes(s, "1 minute", "1 minute", "1 second"), "complete")
    assert [round(r["slope"], 6) for r in got] == [120.0]
