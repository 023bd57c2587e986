"""Curve lookups against plain loops, and digests."""

import random

import pytest
from pyspark.sql import functions as F

from fleetgauge.operators import curves

POINTS = "array<struct<x: double, y: double>>"
BLANK = "array<struct<temp_c: double, pressure_kpa: double, rate: double>>"


def test_clamped(spark):
    curve = [(0.0, 10.0), (50.0, 20.0), (100.0, 0.0)]
    asked = {-5.0: 10.0, 0.0: 10.0, 25.0: 15.0, 50.0: 20.0, 75.0: 10.0, 100.0: 0.0, 120.0: 0.0, None: None}
    df = spark.createDataFrame([(x, curve) for x in asked], f"v double, points {POINTS}")
    got = {r["v"]: r["y"] for r in df.select("v", curves.clamped(F.col("v"), F.col("points")).alias("y")).collect()}
    assert got == asked
    empty = spark.createDataFrame([(1.0, []), (1.0, None)], f"v double, points {POINTS}")
    assert [r[0] for r in empty.select(curves.clamped(F.col("v"), F.col("points"))).collect()] == [None, None]


def test_spring_problem(spark):
    rising = [(0.0, 1300.0), (100.0, 3000.0)]
    cases = [
        (None, "fail_close", "spring_curve_missing"),
        ([], "fail_close", "spring_curve_invalid"),
        (rising[:1], "fail_close", "spring_curve_invalid"),
        (rising, "fail_close", None),
        (rising, None, None),
        (rising, "fail_open", "spring_curve_invalid"),
        (rising[::-1], "fail_open", "spring_curve_invalid"),
        ([(0.0, 3000.0), (100.0, 1300.0)], "fail_open", None),
        ([(0.0, 5.0), (100.0, 5.0)], "fail_open", "spring_curve_invalid"),
        ([(0.0, 5.0), (100.0, 5.0)], "fail_close", None),
        ([(0.0, -1.0), (100.0, 5.0)], "fail_close", "spring_curve_invalid"),
        ([(0.0, None), (100.0, 5.0)], "fail_close", "spring_curve_invalid"),
        ([(11.0, 1.0), (100.0, 5.0)], "fail_close", "spring_curve_coverage"),
        ([(10.5, 1.0), (89.5, 5.0)], "fail_close", None),
    ]
    df = spark.createDataFrame([(i, p, a) for i, (p, a, _) in enumerate(cases)], f"i int, points {POINTS}, action string")
    found = df.select("i", curves.spring_problem(F.col("points"), F.col("action"), F.lit(10.0), F.lit(90.0)).alias("code"))
    assert {r["i"]: r["code"] for r in found.collect()} == {i: code for i, (_, _, code) in enumerate(cases)}


def test_blank_rate(spark):
    rng = random.Random(3)
    rows, expected = [], {}
    for i in range(80):
        points = [(float(rng.randint(1, 4) * 10), float(rng.randint(1, 5) * 100), rng.random()) for _ in range(rng.randint(1, 4))]
        temp, pressure = rng.uniform(5, 45), rng.uniform(50, 550)
        rows.append((i, points, temp, pressure))
        by_temp = sorted(points, key=lambda p: p[0])
        if by_temp[0][0] == by_temp[-1][0]:
            expected[i] = min(by_temp, key=lambda p: abs(p[1] - pressure))[2]
        elif not by_temp[0][0] <= temp <= by_temp[-1][0]:
            expected[i] = by_temp[0 if temp < by_temp[0][0] else -1][2]
        else:
            a = [p for p in by_temp if p[0] <= temp][-1]
            b = [p for p in by_temp if p[0] >= temp][0]
            expected[i] = a[2] + (temp - a[0]) / (b[0] - a[0]) * (b[2] - a[2])
    df = spark.createDataFrame(rows, f"i int, points {BLANK}, temp double, pressure double")
    found = df.select("i", curves.blank_rate(F.col("points"), F.col("temp"), F.col("pressure")).alias("rate"))
    assert {r["i"]: r["rate"] for r in found.collect()} == pytest.approx(expected)


def test_certificate_digest(spark):
    schema = f"version_id int, points {POINTS}, " + ", ".join(f"{c} string" for c in curves.IDENTITY if c != "points")
    rest = [None] * (len(curves.IDENTITY) - 1)
    rows = [(1, [(0.0, 0.5)], *rest), (2, [(0.0, 0.5)], *rest), (3, [(0.0, 0.7)], *rest)]
    a, b, c = (r[0] for r in spark.createDataFrame(rows, schema).orderBy("version_id").select(curves.certificate_digest()).collect())
    assert a == b != c and a.startswith("sha256:") and len(a) == 71
