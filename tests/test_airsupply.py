"""Results of actions and revisions on small records."""

from fleetgauge.operators import airsupply

KEYS = ["test_id"]
ACTIONS = "test_id long, name string, kind string, direction string, t_start double, t_end double, travel_max double, required double, band double"


def test_an_action_that_loses_its_position(spark):
    actions = spark.createDataFrame([(1, "x", "fail_safe_stroke", "close", 0.0, 10.0, 3.0, 300.0, 2.0)], ACTIONS)
    place = [50.0, 30.0, 10.0, 1.0, 0.0, 0.0, 5.0, 5.0, 5.0, 5.0, 5.0]
    kpa = [400.0, 290.0, 280.0, 310.0, 310.0, 299.0, 310.0, 310.0, 310.0, 310.0, 310.0]
    series = spark.createDataFrame([(1, k, float(k), p, v) for k, (p, v) in enumerate(zip(place, kpa, strict=True))], "test_id long, i long, t double, position double, pressure double")
    found = airsupply.action_results(actions, series, KEYS)
    row = found.first()
    assert (row["reached"], row["t_reached"], row["time_margin"], row["exit_t"], row["min_pressure"], row["min_pressure_t"], row["below_t0"], row["below_t1"]) == (True, 3.0, 0.0, 6.0, 280.0, 2.0, 1.0, 2.0)
    events = spark.createDataFrame([(1, "b", 1.5, 4.0), (1, "a", 1.5, 1.6), (1, "c", 6.0, 8.0), (1, "d", 2.0, 3.0)], "test_id long, device string, t0 double, t1 double")
    told = {r["kind"]: (r["device"], r["n_devices"]) for r in airsupply.findings(found, events, KEYS).collect()}
    assert told == {"pressure_below_requirement": ("a", 2), "safe_position_not_reached": ("c", 1)}
    passed = {r["metric"]: r["passes"] for r in airsupply.checks(found, KEYS).collect()}
    assert passed == {"min_supply_pressure": False, "stroke_time": True, "safe_position_reached": False}


def test_revisions(spark):
    kind = "test_id long, name string, stroke_time double, min_pressure double, time_margin double, pressure_margin double"
    a = spark.createDataFrame([(1, "x", 5.0, 300.0, 1.0, None)], kind)
    b = spark.createDataFrame([(1, "x", 4.0, 290.0, 1.0, 2.0), (1, "y", 1.0, 1.0, 1.0, 1.0)], kind)
    got = {(r["name"], r["metric"]): (r["delta"], r["improved"]) for r in airsupply.compare_actions(a, b, KEYS).collect()}
    assert got["x", "stroke_time"] == (-1.0, True) and got["x", "min_pressure"] == (-10.0, False)
    assert got["x", "time_margin"] == (0.0, None) and got["x", "pressure_margin"] == (None, None) and got["y", "stroke_time"] == (None, None)
    steps = spark.createDataFrame([(1, k, "update") for k in range(1, 6)], "test_id long, seq int, operation string")
    n = lambda k: spark.createDataFrame([(1, k)], "test_id long, n int")
    for first, second in ((2, 4), (4, 2)):
        assert [r["seq"] for r in airsupply.adjustments_between(steps, n(first), n(second), KEYS).orderBy("seq").collect()] == [3, 4]
