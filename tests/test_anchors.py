"""Chains of anchors and settled runs against their definitions."""

import random

import pytest
from pyspark.sql import functions as F

from fleetgauge.operators import anchors, fullstroke

KEYS = ["test_id"]


def first_short(runs):
    return next((k for k, (d, a, b, *_) in enumerate(runs) if b - a < (0.5 if d else 0.8)), None)


def settled(runs):
    """The definition: change the leftmost short run, join equal neighbours, begin anew."""
    while len(runs) > 1 and (k := first_short(runs)) is not None:
        d, a, b, i, j = runs[k]
        if d:
            runs = [*runs[:k], (0, a, b, i, j), *runs[k + 1 :]]
        elif k:
            p = runs[k - 1]
            runs = [*runs[: k - 1], (p[0], p[1], b, p[3], j), *runs[k + 1 :]]
        else:
            n = runs[1]
            runs = [(n[0], a, n[2], i, n[4]), *runs[2:]]
        out = []
        for r in runs:
            if out and out[-1][0] == r[0]:
                out[-1] = (*out[-1][:2], r[2], out[-1][3], r[4])
            else:
                out.append(r)
        runs = out
    return runs


def test_short_runs_settle_as_by_starting_anew(spark):
    draw = random.Random(4)
    rows, expected = [], set()
    for test in range(300):
        d, t, i, runs = draw.choice([-1, 0, 1]), 0.0, 0, []
        for _ in range(draw.randint(1, 14)):
            length = draw.choice([1, 2, 3, 4, 6, 7, 9, 20, 40])
            runs.append((d, t, t + length / 10, i, i + length))
            t, i, d = t + length / 10 + 0.1, i + length + 1, draw.choice([x for x in (-1, 0, 1) if x != d])
        rows += [(test, k, *r) for k, r in enumerate(runs)]
        expected |= {(test, k, r[0], r[3], r[4]) for k, r in enumerate(settled(runs))}
    frame = spark.createDataFrame(rows, "test_id long, run int, d int, a double, b double, i0 long, i1 long")
    got = {(r["test_id"], r["k"], r["d"], r["i0"], r["i1"]) for r in anchors.settle(frame, KEYS, 0.5, 0.8).collect()}
    assert got == expected


def test_short_runs_of_one_record(spark):
    runs = [(0, 0.0, 3.0, 0, 30), (1, 3.1, 3.3, 31, 33), (0, 3.4, 3.9, 34, 39), (1, 4.0, 9.0, 40, 90), (0, 9.1, 9.5, 91, 95), (1, 9.6, 12.0, 96, 120)]
    frame = spark.createDataFrame([(1, k, *r) for k, r in enumerate(runs)], "test_id long, run int, d int, a double, b double, i0 long, i1 long")
    assert [(r["d"], r["i0"], r["i1"]) for r in anchors.settle(frame, KEYS, 0.5, 0.8).orderBy("k").collect()] == [(0, 0, 39), (1, 40, 120)]


def stays(p, within, least, after):
    """(anchor, last) by the definition: the next anchor comes after a hit, else at the stretch's end or one on."""
    found, at = [], 0
    while at + 1 < len(p):
        last = next((k for k in range(at + 1, len(p)) if abs(p[k] - p[at]) >= within), len(p)) - 1
        if last - at >= least:
            found.append((at, last))
            at = after(last)
        else:
            at = max(last, at + 1)
    return found


@pytest.mark.parametrize("ahead", [1, 3])
def test_stretches_against_the_definition(spark, ahead):
    draw = random.Random(ahead)
    rows, expected = [], set()
    for test in range(60):
        p, v = [], 0.0
        for _ in range(draw.randint(1, 120)):
            v += draw.choice([0, 0, 0.1, -0.1, 0.3, 2.0])
            p.append(v)
        rows += [(test, k, k * 0.25, x) for k, x in enumerate(p)]
        expected |= {(test, a, b) for a, b in stays(p, 0.35, 3, lambda last: last + ahead)}
    frame = spark.createDataFrame(rows, "test_id long, i long, t double, v double")
    resume = None if ahead == 1 else lambda s: s["i"] + ahead
    found = anchors.held(frame, KEYS, "v", 0.35, lambda a, s: s["i"] - a["i"] >= 3, resume=resume)
    assert {(r["test_id"], r["anchor"]["i"], r["last"]["i"]) for r in found.collect()} == expected


def test_stick_slip_without_motion(spark):
    rows = spark.createDataFrame([(1, 0, "dwell", 0, 0.0, 1.0, 1.0)], "test_id long, seg int, type string, i long, t double, command double, position double")
    found = fullstroke.stick_slip(rows, KEYS)
    assert found.columns == ["test_id", "seg", "t_start", "t_end", "stuck_s", "command_change", "jump"] and found.count() == 0
    assert fullstroke.stick_slip(rows.withColumn("type", F.lit("opening")), KEYS).count() == 0
