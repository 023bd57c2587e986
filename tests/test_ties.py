"""Results on the very edge of a rule agree with the SQL, signs of zero included."""

import datetime

import duckdb

from fleetgauge.plans import catalog


def test_difference_that_is_zero_but_for_rounding_keeps_its_sign(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    days = [(0, 73.65), (1, 77.38), (20, 62.2), (21, 119.19)]
    rows = [(k, start + datetime.timedelta(days=d), 1, "view", v) for k, (d, v) in enumerate(days)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    (found,) = catalog.QUERIES["interval_difference"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    ((test_id, channel, low, high, change),) = con.execute(catalog.ORACLES["interval_difference"]).fetchall()
    assert repr(high) == "-0.0" and change == "degraded"
    assert (found.test_id, found.channel, repr(found.low), repr(found.high), found.change) == (test_id, channel, repr(low), repr(high), change)
