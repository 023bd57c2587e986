"""Records made from tables keep their places, and conversions made once a channel are those made once a sample."""

import re

import pytest
from pyspark.sql import functions as F

from fleetgauge.functions import units
from fleetgauge.operators import fullstroke, stats, uncertainty
from fleetgauge.plans import catalog, chain_queries, registry, stroke_records, supply_queries
from fleetgauge.sources.held import _HELD, hold, release

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_planner_knows_how_large_records_are(spark):
    found = stroke_records.grid(spark, SF)
    size = int(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert size >= 8 * found.count()


def test_samples_are_not_moved_to_meet_their_certificates(spark):
    plan = plan_of(catalog.QUERIES["calibration_correct"](spark, SF))
    assert not re.search(r"hashpartitioning\((test_id#\d+L, channel|version_id)", plan)


def test_conversion_is_that_of_every_sample(spark):
    c = F.col
    names = ["%", "mA", "mm", "in", "kPa", "bar", "psi", "degC", "K", "F", "sccm", "nm3/h", "gpm", "l/h", "furlong"]
    kinds = ["command", "position", "pressure", "temperature", "flow_gas", "flow_liquid"]
    pairs = spark.createDataFrame([(k, a, b, x) for k in kinds for a in names for b in names for x in (5.0, 45.0)], "kind string, a string, b string, high double")
    how = pairs.withColumn("how", units.conversion(c("a"), c("b"), c("kind"), F.lit(5.0), c("high"))).withColumn("v", F.explode(F.array(*[F.lit(x) for x in (-3.7, 0.0, 12.3, 100.1)])))
    found = how.select(units.converted(c("v"), c("how")).alias("x"), units.convert(c("v"), c("a"), c("b"), c("kind"), F.lit(5.0), c("high")).alias("y"))
    assert found.where("not (x <=> y)").count() == 0 and found.where("x is not null").count() > 100


def test_certificates_are_known_to_be_small(spark):
    assert int(str(chain_queries._certificates(spark)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 10_000


@pytest.mark.parametrize("name", ["flow_plateaus", "flow_points", "stroke_overshoot"])
def test_stretches_are_not_written_out_to_meet_points(spark, name):
    plan = plan_of(catalog.QUERIES[name](spark, SF))
    assert "FlatMapGroups" not in plan and "explode(sequence" not in plan
    assert not re.search(r"hashpartitioning\(test_id#\d+L, (i|__slice)#", plan)


def test_held_tables_are_not_broadcast(spark):
    rows = hold(spark.range(1000).selectExpr("id as test_id", "id % 7 as v"), "few")
    many = rows.select("test_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"))
    plan = plan_of(many.join(rows, "test_id"))
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    release(spark)


def test_fit_reads_points_made_once(spark):
    plan = plan_of(catalog.QUERIES["flow_curves"](spark, SF))
    assert "Range (0, 256" not in plan and "points-" in plan
    release(spark)


def test_branches_are_made_once(spark):
    plan = plan_of(catalog.QUERIES["stroke_hysteresis"](spark, SF))
    assert plan.count("Range (0, 240") == 2


@pytest.mark.parametrize("name", ["moved_boundaries", "leak_moved", "thrust_checks"])
def test_points_do_not_move_to_meet_boundaries(spark, name):
    plan = plan_of(catalog.QUERIES[name](spark, SF))
    assert not re.search(r"hashpartitioning\(test_id#\d+L?, (i|i_start|i_end)#", plan)
    # The records are dealt out once each time they are made, and never again.
    for part in plan.split("Exchange hashpartitioning(test_id")[1:]:
        assert "Range (0," not in part.split("Exchange")[0]


def test_points_do_not_move_to_meet_strokes(spark):
    plan = plan_of(catalog.QUERIES["thrust_phases"](spark, SF))
    assert not re.search(r"hashpartitioning\(test_id#\d+L?, stroke#", plan)


def test_slopes_ask_only_where_their_frames_begin(spark):
    rows = spark.range(40).selectExpr("id % 2 as test_id", "id * 1000000 as us", "id * 0.5 as y")
    assert "max(" not in plan_of(stats.trailing_slope(rows, ["test_id"], "us", "y", 10_000_000))


def test_blank_is_looked_up_once_a_test(spark):
    assert re.search(r"CASE WHEN \(i#\d+L? = i_hold#\d+L?\) THEN CASE WHEN", plan_of(catalog.QUERIES["leak_balance"](spark, SF)))


def test_seat_leak_verdicts_write_no_points(spark):
    release(spark)
    catalog.QUERIES["leak_verdicts"](spark, SF)
    held = [path.rsplit("/", 1)[1].split("-")[0] for path in _HELD[spark.sparkContext.applicationId]]
    assert sorted(held) == ["figures", "segments"]
    release(spark)


@pytest.mark.parametrize("name", ["stroke_deadband", "stroke_gap_blocks", "stroke_dropouts"])
def test_points_stay_with_their_test(spark, name):
    plan = plan_of(catalog.QUERIES[name](spark, SF))
    assert not re.search(r"hashpartitioning\(test_id#\d+L?, [a-z_]+#", plan)
    # A grid for the segments and one for the points, or one for each kind of dropout.
    assert plan.count("Range (0, 240") <= 2


def test_micros_are_rounded_seconds(spark):
    rows = spark.range(20000).selectExpr("(id - 5000) * 0.0004999995 as t").unionByName(spark.sql("select explode(array(1.0000005d, 0.0000005d, -2.0000005d, 123456.7890125d, 2e9d)) as t"))
    rows = rows.withColumn("a", stats.micros(F.col("t"))).withColumn("b", F.round(F.col("t") * 1e6).cast("long"))
    assert rows.where("not (a <=> b)").count() == 0


def test_gaps_beyond_a_segment_do_not_count(spark):
    segs = spark.createDataFrame([(1, 0, "opening", 0.0, 10.0), (1, 1, "dwell", 10.0, 20.0), (1, 2, "closing", 20.0, 30.0), (2, 0, "opening", 0.0, 10.0)], "test_id int, seg int, type string, t_start double, t_end double")
    gaps = spark.createDataFrame([(1, -5.0, 2.0), (1, 8.0, 21.0), (1, 9.0, 9.0), (1, 22.0, 23.0)], "test_id int, start_at double, end_at double")
    assert [tuple(r) for r in fullstroke.gap_blocks(segs, gaps, ["test_id"]).collect()] == [(1, 0, 0.4)]


def test_schemes_are_parsed_by_more_than_one_task(spark, monkeypatch):
    monkeypatch.setattr(registry, "SAMPLES_A_TASK", 2500)
    assert len(supply_queries.schemes(spark, SF).inputFiles()) > 1
    release(spark)


@pytest.mark.parametrize("name", ["supply_actions", "supply_findings"])
def test_actions_are_not_broadcast(spark, name):
    plan = plan_of(catalog.QUERIES[name](spark, SF))
    assert "BroadcastHashJoin" not in plan and "__slice" not in plan
    release(spark)


@pytest.mark.parametrize("name", ["stroke_metrics", "stroke_hysteresis"])
def test_points_are_made_once_for_segments_and_once_for_all_metrics(spark, name):
    plan = plan_of(catalog.QUERIES[name](spark, SF))
    made = len(re.findall(r"BroadcastNestedLoopJoin|CartesianProduct", plan))
    assert made == 2 and "MapInArrow" in plan


def test_points_of_trials_are_not_written(spark):
    rows = [(1, ch, i, i * 0.25, v + i) for ch, v in (("command", 0.0), ("position", 1.0), ("pressure", 300.0)) for i in range(8)]
    samples = spark.createDataFrame(rows, "test_id long, channel string, idx int, t double, v double")
    inputs = spark.createDataFrame([(1, "position", "accuracy", "channel", 0.1, "normal", False, "used")], "test_id long, channel string, kind string, source string, scale double, distribution string, per_point boolean, status string")
    jitter = spark.createDataFrame([(1, "position", 0.0)], "test_id long, channel string, jitter_s double")
    held = len(_HELD.get(spark.sparkContext.applicationId, []))
    found = uncertainty.trial_metrics(uncertainty.perturb_by(samples, inputs, jitter, 2, tasks=3), dealt=True)
    assert len(_HELD.get(spark.sparkContext.applicationId, [])) == held
    assert {(r["trial"], r["value"]) for r in found.where("metric = 'supply_min'").collect()} == {(1, 300.0), (2, 300.0)}


@pytest.mark.parametrize("name, times", [("trip_travel", 1), ("trip_stalls", 2), ("trip_rebounds", 2)])
def test_trips_are_observed_once_and_once_more_to_meet_their_travel(spark, name, times):
    plan = plan_of(catalog.QUERIES[name](spark, SF))
    assert len(re.findall(r"BroadcastNestedLoopJoin|CartesianProduct", plan)) == times
