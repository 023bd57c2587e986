"""Cases in which a verdict would come out too good."""

import pytest
from pyspark.sql import functions as F

from fleetgauge.operators import calibration, fullstroke, switches, uncertainty

LIMITS = fullstroke.LIMITS


def record(spark, on, low=95.0, high=100.0, from_below=(90.0, 98.0)):
    """One open contact over a stroke from 0 to 100 % and back, 0.2 s apart; ``on`` says where it is on."""
    place = [0.0 if k < 20 else (k - 20) * 2.0 if k < 70 else 100.0 if k < 120 else 100 - (k - 120) * 2.0 if k < 170 else 0.0 for k in range(200)]
    bits = spark.createDataFrame([(1, "open", k, k * 0.2, int(on(k))) for k in range(200)], "test_id long, contact string, idx int, t double, bit int")
    position = spark.createDataFrame([(1, k, k * 0.2, v) for k, v in enumerate(place)], "test_id long, idx int, t double, v double")
    kinds = "test_id long, contact string, end string, act_low double, act_high double, rel_low double, rel_high double, debounce_s double, max_overlap_s double"
    return bits, position, spark.createDataFrame([(1, "open", "high", low, high, *from_below, 0.5, None)], kinds)


def judged(found):
    return found["verdicts"].first()["verdict"], sorted(r["kind"] for r in found["events"].collect())


@pytest.mark.parametrize(
    ("on", "verdict", "kinds"),
    [
        (lambda k: 69 <= k <= 121, "ok", []),
        (lambda k: 69 <= k <= 121 or k == 30, "exceedances", ["chatter"]),
        (lambda k: 25 <= k <= 165, "exceedances", ["missed_transition", "position_out_of_window", "position_out_of_window"]),
        (lambda k: k >= 69, "exceedances", ["missed_transition", "missed_transition"]),
        (lambda k: False, "exceedances", ["no_trigger_at_end"]),
    ],
)
def test_switch_verdicts(spark, on, verdict, kinds):
    got, events = judged(switches.analyse(*record(spark, on)))
    assert (got, events) == (verdict, kinds)


def test_a_contact_that_is_on_from_the_start_has_no_edge(spark):
    bits, position, specs = record(spark, lambda k: k < 10 or 69 <= k <= 121)
    found = switches.analyse(bits, position, specs)["edges"].collect()
    assert sorted((r["edge"], round(r["t"], 6)) for r in found) == [("actuate", 13.8), ("release", 2.0), ("release", 24.4)]


def test_a_contact_without_levels_gives_no_conclusion(spark):
    bits, position, specs = record(spark, lambda k: 69 <= k <= 121)
    assert judged(switches.analyse(bits.withColumn("bit", F.lit(None).cast("int")), position, specs))[0] == "no_conclusion"


def trials_of(spark, rows):
    return spark.createDataFrame(rows, "test_id long, trial int, metric string, value double")


def test_few_values_of_one_metric_dont_hide_another_that_fails(spark):
    rows = [(1, k, "deadband", 9.0 + k * 0.001) for k in range(100)] + [(1, k, "overshoot", 1.0) for k in range(20)]
    trials = trials_of(spark, rows)
    central = trials.groupBy("test_id", "metric").agg(F.avg("value").alias("value"))
    found = uncertainty.evaluate(trials, central, LIMITS, 100)
    assert {r["metric"]: r["status"] for r in found.collect() if r["n"]} == {"deadband": "fail", "overshoot": "indeterminate"}
    assert uncertainty.overall(found, uncertainty.valid_trials(trials, trials, 100), 100).first()["overall"] == "fail"


def test_a_test_whose_trials_all_fail_is_indeterminate(spark):
    tests = spark.createDataFrame([(7,)], "test_id long")
    none = trials_of(spark, [])
    central = spark.createDataFrame([(7, "deadband", 1.0)], "test_id long, metric string, value double")
    found = uncertainty.overall(uncertainty.evaluate(none, central, tests=tests), uncertainty.valid_trials(tests, none))
    assert [tuple(r) for r in found.collect()] == [(7, "indeterminate")]
    valid = uncertainty.valid_trials(tests, none).first()
    assert (valid["n_valid"], valid["n_failed"]) == (0, uncertainty.TRIALS)
    verdict = tests.join(found, "test_id").select(fullstroke.merged_verdict(F.lit("ok"), F.col("overall"))).first()[0]
    assert verdict == "indeterminate"


def test_readings_are_held_against_a_certificate_in_its_unit(spark):
    channels = spark.createDataFrame([(1, "position", "position", "mA", "2024-05-01", "2024-05-01", 4.0, 20.0)], "test_id long, channel string, measurement_type string, unit string, starts string, ends string, low double, high double")
    certs = spark.createDataFrame([(1, "position", "%", "2024-01-01", "2025-01-01", 3.0, 50.0, [(0.0, 0.0), (100.0, 100.0)])], "version_id long, cert_type string, cert_unit string, valid_from string, valid_until string, range_min double, range_max double, points array<struct<ind:double,ref:double>>")
    bindings = spark.createDataFrame([(1, "position", 1)], "test_id long, channel string, version_id long")
    ranges = spark.createDataFrame([(1, 0.0, 100.0)], "test_id long, range_low double, range_high double")
    assert calibration.apply_chain(channels, bindings, certs, ranges).first()["gate"] == "range_uncovered"
    assert calibration.apply_chain(channels.withColumn("low", F.lit(5.0)).withColumn("high", F.lit(11.0)), bindings, certs, ranges).first()["accepted"]
    assert calibration.apply_chain(channels.withColumn("unit", F.lit("bar")), bindings, certs, ranges).first()["gate"] == "unit_incompatible"


def test_an_uncorrected_reading_of_an_accepted_channel_is_an_error(spark):
    samples = spark.createDataFrame([(1, "position", 0, 0.0, 70.0, "%")], "test_id long, channel string, idx int, t double, v double, unit string")
    chain = spark.createDataFrame([(1, "position", 1, True)], "test_id long, channel string, version_id long, accepted boolean")
    certs = spark.createDataFrame([(1, "%", "position", [(0.0, 0.0), (50.0, 50.0)])], "version_id long, unit string, measurement_type string, points array<struct<ind:double,ref:double>>")
    ranges = spark.createDataFrame([(1, 0.0, 100.0)], "test_id long, range_low double, range_high double")
    with pytest.raises(Exception, match="leaves a reading uncorrected"):
        calibration.correct_samples(samples, chain, certs, ranges).collect()
