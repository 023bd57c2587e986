"""Operators on small literals."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetgauge.functions import physics, units, verdicts
from fleetgauge.operators import calibration, interp, intervals, runs, stats, uncertainty
from fleetgauge.sources import series


def test_medians(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10)], "v double")
    row = df.agg(stats.upper_median("v").alias("u"), stats.lower_median("v").alias("l"), F.median("v").alias("m")).first()
    assert (row["u"], row["l"], row["m"]) == (3.0, 2.0, 2.5)


def test_merge_short_is_the_sequential_merge(spark):
    rng = random.Random(5)
    rows, expected = [], {}
    for key in range(60):
        seq = [(rng.choice([-1, 0, 1]), rng.choice([1, 5])) for _ in range(rng.randint(1, 12))]
        seq = [x for k, x in enumerate(seq) if k == 0 or x[0] != seq[k - 1][0]]
        rows += [(key, k + 1, v, float(k), float(k) + 1, n) for k, (v, n) in enumerate(seq)]
        out = []
        for v, n in seq:
            if v == 0 and n < 3 and out:
                out[-1][1] += n
            elif out and (out[-1][0] == v or out[-1][2]):
                out[-1] = [v, out[-1][1] + n, False]
            else:
                out.append([v, n, v == 0 and n < 3])
        merged = []
        for v, n, _ in out:
            if merged and merged[-1][0] == v:
                merged[-1][1] += n
            else:
                merged.append([v, n])
        expected[key] = [tuple(x) for x in merged]
    df = spark.createDataFrame(rows, "k int, run int, v int, start_at double, end_at double, n int")
    found = runs.merge_short(df, ["k"], "v", (F.col("v") == 0) & (F.col("n") < 3))
    got = {}
    for r in found.orderBy("k", "merged").collect():
        got.setdefault(r["k"], []).append((r["v"], r["n"]))
    assert got == expected


def test_interpolation_clamps_or_leaves_out(spark):
    known = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 10.0, 100.0)], "test_id int, idx int, t double, v double")
    asked = spark.createDataFrame([(1, -5.0), (1, 2.5), (1, 10.0), (1, 12.0)], "test_id int, t double")
    at = {r["t"]: r["v"] for r in interp.linear(asked, known, ["test_id"]).collect()}
    assert at == {-5.0: 0.0, 2.5: 25.0, 10.0: 100.0, 12.0: 100.0}
    at = {r["t"]: r["v"] for r in interp.linear(asked, known, ["test_id"], clamp=False).collect()}
    assert at == {-5.0: None, 2.5: 25.0, 10.0: 100.0, 12.0: None}


def test_align_needs_overlap(spark):
    rows = [(1, "a", k, k * 0.5, float(k)) for k in range(11)] + [(1, "b", k, 1.0 + k, 2.0 * k) for k in range(5)]
    rows += [(2, "a", 0, 0.0, 1.0), (2, "a", 1, 1.0, 1.0), (2, "b", 0, 5.0, 1.0), (2, "b", 1, 6.0, 1.0)]
    df = spark.createDataFrame(rows, "test_id int, channel string, idx int, t double, v double")
    got = interp.align(df, ["a", "b"]).orderBy("i").collect()
    assert {r["test_id"] for r in got} == {1}
    assert [(r["i"], r["t"], r["a"], r["b"]) for r in got] == [(k, 1.0 + 0.5 * k, 2.0 + k, 1.0 * k) for k in range(9)]


def test_clusters_and_overlaps(spark):
    a = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.2, 2.0), (1, 5.0, 6.0)], "k int, start_at double, end_at double")
    got = runs.cluster_by_gap(a, ["k"], "start_at", "end_at", 0.25).orderBy("cluster").collect()
    assert [(r["start_at"], r["end_at"], r["pulses"]) for r in got] == [(0.0, 2.0, 2), (5.0, 6.0, 1)]
    b = spark.createDataFrame([(1, 0.5, 1.5)], "k int, start_at double, end_at double")
    shares = {r["start_at"]: r["share"] for r in intervals.overlap_share(a, b, ["k"]).collect()}
    assert shares[0.0] == 0.5 and shares[1.2] == pytest.approx(0.375) and shares[5.0] == 0.0


def test_units_and_physics(spark):
    df = spark.createDataFrame([(1.0, "psi"), (2.0, " BAR "), (3.0, "torr")], "v double, u string")
    got = [r[0] for r in df.select(units.by_factor(F.col("v"), F.col("u"), units.PRESSURE_KPA)).collect()]
    assert got == [6.894757, 200.0, None]
    one = df.limit(1)
    gpm, psi = 0.227125, 6.894757
    cv = one.select(physics.liquid_cv(F.lit(gpm), F.lit(psi), F.lit(999.0))).first()[0]
    assert cv == pytest.approx(1.0, abs=2e-3)
    fahrenheit = one.select(units.temperature_c(F.lit(212.0), F.lit("F"))).first()[0]
    assert fahrenheit == pytest.approx(100.0)
    levels = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "v double").select(units.polarity(units.contact_level(F.col("v")), F.lit("nc")))
    assert [r[0] for r in levels.collect()] == [1, None, 0]


def test_conformance_touching_is_indeterminate(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (3.0, 4.0), (4.0, 5.0)], "a double, b double")
    got = [r[0] for r in df.select(verdicts.conformance(F.col("a"), F.col("b"), F.lit(3.0))).collect()]
    assert got == ["pass", "indeterminate", "indeterminate", "fail"]


def test_certificate_points(spark):
    df = spark.createDataFrame([([(0.0, 0.5), (10.0, 10.7)], 5.0), ([(0.0, 0.5), (10.0, 10.7)], 11.0), ([(1.0, 1.0), (0.0, 2.0)], 0.5)], "p array<struct<ind:double,ref:double>>, v double")
    got = df.select(calibration.increasing(F.col("p")), calibration.corrected(F.col("v"), F.col("p"))).collect()
    assert [r[0] for r in got] == [True, True, False]
    assert got[0][1] == pytest.approx(5.6) and got[1][1] is None


def test_trials_are_reproducible(spark):
    df = spark.createDataFrame([(1, "a", k, float(k), 50.0) for k in range(50)], "test_id long, channel string, idx int, t double, v double")
    one = uncertainty.perturb(df, 1.0, 0.5, 0.0, trials=200)
    two = uncertainty.perturb(df.repartition(3), 1.0, 0.5, 0.0, trials=200)
    key = ["trial", "idx"]
    assert one.orderBy(*key).select("v", "t").collect() == two.orderBy(*key).select("v", "t").collect()
    means = one.groupBy("trial").agg(F.avg("v").alias("m")).agg(F.stddev("m"), F.avg("m")).first()
    assert means[0] == pytest.approx(1.0, abs=0.2) and means[1] == pytest.approx(50.0, abs=0.3)
    assert uncertainty.intervals(one.groupBy("test_id", "trial").agg(F.avg("v").alias("m")), ["test_id"], "m", 200).first()["low"] < 49


def test_submissions_become_samples(spark, tmp_path):
    text = '{"test_id": 7, "valve_tag": "V", "phase": "pre", "test_started_at": "2026-01-01T00:00:00Z", "series": {"command": {"unit": "%", "points": [[0, 1], [0.5, 2]]}, "position": {"unit": "mA", "points": [[0.1, 4]]}}}'
    (tmp_path / "a.json").write_text(text)
    tests = series.read_submissions(spark, str(tmp_path), ["command", "position"])
    got = sorted(tuple(r) for r in series.samples_of(tests, ["command", "position"]).collect())
    assert got == [(7, "command", "%", 0, 0.0, 1.0), (7, "command", "%", 1, 0.5, 2.0), (7, "position", "mA", 0, 0.1, 4.0)]
    assert tests.select(series.parse_time("test_started_at")).first()[0].year == 2026
