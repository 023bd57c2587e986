"""Seat leaks, stem thrust and flow curves from submitted records to stored versions."""

import math

import pytest
from tests.test_records import CERTS, read

from fleetgauge.operators import records
from fleetgauge.sources import records as submitted
from fleetgauge.sources.store import Store, history

HEAD = {"submitted_at": "2024-05-02T08:00:00Z", "calibration_valid_until": "2025-01-01T00:00:00Z"}


@pytest.fixture(scope="module")
def no_certificates(spark):
    return spark.createDataFrame([], CERTS)


def adjustment(spark, *rows):
    """Rows of test_id, seq, type, segment_index, boundary, new_time."""
    return spark.createDataFrame([(t, s, kind, None, None, None, k, b, x, None, None, "looked at") for t, s, kind, k, b, x in rows], records.ADJUSTMENTS)


def seat(test_id, leak=0.0, closed_at=20, flow=None, **more):
    t = [float(k) for k in range(190)]
    series = {
        "command": {"unit": "%", "points": [[x, 0.0] for x in t]},
        "position": {"unit": "mA", "points": [[x, 4.08] for x in t]},
        "upstream_pressure": {"unit": "bar", "points": [[x, 7.0] for x in t]},
        "downstream_pressure": {"unit": "bar", "points": [[x, 2.0 + leak * max(k - 20, 0) / 600 + k % 3 * 1e-5] for k, x in enumerate(t)]},
        "downstream_temp": {"unit": "K", "points": [[x, 293.15 + 40 / (k + 10)] for k, x in enumerate(t)]},
    }
    if flow is not None:
        series["flow"] = {"unit": "nl/h", "points": [[x, flow * 60] for x in t]}
    point = lambda c, p, r: {"temp_c": c, "pressure_kpa": p, "recovery_rate_kpa_min": r}
    actions = [{"t": 2, "action": "close_command"}, {"t": 8, "action": "valve_closed"}, {"t": closed_at, "action": "downstream_isolated"}]
    rest = {
        "gas": {"compressibility_z": 1.0, "reference_temp_c": 0.0}, "closed_volume": {"downstream_volume_m3": 0.01}, "isolation": actions,
        "blank_baseline": {"points": [point(18, 190, 0.2), point(30, 260, 0.5)]},
    }
    return HEAD | {"kind": "seatleak", "test_id": test_id, "valve_tag": "L"} | rest | {"series": series} | more


def test_seat_leaks_from_record_to_versions(spark, tmp_path, no_certificates):
    cold = {"points": [{"temp_c": 5, "pressure_kpa": 200, "recovery_rate_kpa_min": 0.1}]}
    rows = [
        seat(1), seat(2, leak=0.3), seat(3, blank_baseline=cold), seat(4, isolation=[]), seat(5, leak=0.3, thresholds={"leak_rate_max_nl_min": 1.0, "cumulative_leak_max_nl": 5.0}),
        seat(6, flow=0.5), seat(7, closed_at=500), seat(8, closed_volume={}), seat(9, calibration_valid_until=None), seat(10, blank_baseline=cold | {"temp_margin_c": 30.0}),
        seat(11, leak=0.3, flow_direction="downstream_to_upstream"),
    ]
    good, rejected = read(spark, tmp_path / "in", rows)
    assert rejected.count() == 0
    made = records.seat_leak(submitted.of_kind(good, "seatleak"), no_certificates)
    store = Store(spark, str(tmp_path / "store"))
    store.publish("seatleak", made, good)
    got = {r["test_id"]: (r["verdict"], r["blocking"]) for r in store.latest("seatleak", "verdicts").collect()}
    assert got[1] == ("pass", "") and got[2] == ("fail", "") and got[5] == ("pass", "") and got[10] == ("pass", "")
    assert got[3] == ("no_conclusion", "blank_baseline_uncovered") and got[4] == ("no_conclusion", "not_isolated")
    assert got[6] == ("fail", "") and got[9] == ("no_conclusion", "calibration_missing")
    assert got[7][0] == "no_conclusion" and "no_overlap" in got[7][1] and "closed_volume_missing" in got[8][1]
    # Against the flow the pressure difference has the wrong sign.
    assert got[11] == ("no_conclusion", "insufficient_differential_pressure")
    failed = {(r["test_id"], r["metric"]) for r in store.latest("seatleak", "checks").where("not passes").collect()}
    assert {(2, "rate"), (2, "cumulative"), (6, "deviation_pct")} <= failed and not any(t in (1, 5, 10) for t, _ in failed)
    late = store.latest("seatleak", "exceedances").where("test_id = 2").first()
    assert late["kind"] in ("leak_rate", "cumulative_leak") and store.latest("seatleak", "periods").where("test_id = 2").count() >= 1

    again = good.where("test_id = 1")
    short = adjustment(spark, (1, 1, "boundary_move", None, "hold", 175.0))
    store.publish("seatleak", records.seat_leak(submitted.of_kind(again, "seatleak"), no_certificates, short), again, "ann")
    assert [(r["version"], r["author"]) for r in history(store, "seatleak", 1).collect()] == [(1, "auto"), (2, "ann")]
    assert store.latest("seatleak", "verdicts").where("test_id = 1").first()["blocking"] == "hold_too_short"
    assert store.latest("seatleak", "segments").where("test_id = 1").first()["t_hold"] == 175.0


def stem(test_id, acting="double_acting", drop=(), actuator=None, **more):
    place = [float(min(100, max(k - 50, 0) * 2, 100 if k < 150 else max(0, 100 - max(k - 200, 0) * 2))) for k in range(300)]

    def net(k):
        if k < 52:
            return -800.0 if k < 40 else -800.0 + (k - 40) * 290
        if k < 195:
            return 200.0 + k % 5 * 40 if k < 110 else 400.0
        return -200.0 + k % 3 * 30 if k < 250 else -3300.0

    t = [k / 5 for k in range(300)]
    spring = {"version": "s", "action": "fail_open", "force_unit": "kn", "points": [[0, 3.0], [100, 1.3]]}
    pa = [300 + net(k) / 20 if acting == "double_acting" else (3000 - 17 * place[k] - net(k)) / 20 for k in range(300)]
    pressures = {"supply_pressure": [520.0] * 300, "chamber_a_pressure": pa} | ({"chamber_b_pressure": [300.0] * 300} if acting == "double_acting" else {})
    signals = {"command": [100.0 if 45 <= k < 195 else 0.0 for k in range(300)], "position": place}
    series = {n: {"unit": "%", "points": [list(x) for x in zip(t, v, strict=True)]} for n, v in signals.items()}
    series |= {n: {"unit": "kPa", "points": [list(x) for x in zip(t, v, strict=True)]} for n, v in pressures.items() if n not in drop}
    made = {"actuator_type": acting, "area_a": {"value": 200, "unit": "cm2"}} | ({} if acting == "double_acting" else {"spring": spring}) | (actuator or {})
    return HEAD | {"kind": "stemthrust", "test_id": test_id, "valve_tag": "H", "actuator": made, "series": series} | more


def test_stem_thrust_from_record_to_versions(spark, tmp_path, no_certificates):
    short = {"spring": {"version": "s", "action": "fail_open", "force_unit": "n", "points": [[0, 3000], [80, 1640]]}}
    rows = [
        stem(1), stem(2, "single_acting"), stem(3, drop=("chamber_b_pressure",)), stem(4, "single_acting", actuator=short), stem(5, thresholds={"running_friction_max_n": 100.0, "supply_pressure_min_kpa": 600.0}),
        stem(6, actuator={"area_a": {"value": 1, "unit": "ft2"}}), stem(7, "single_acting", actuator={"spring": None}), stem(9, drop=("chamber_a_pressure",)),
    ]
    good, rejected = read(spark, tmp_path / "in", rows)
    assert rejected.count() == 0
    store = Store(spark, str(tmp_path / "store"))
    store.publish("stemthrust", records.stem_thrust(submitted.of_kind(good, "stemthrust"), no_certificates), good)
    got = {r["test_id"]: r for r in store.latest("stemthrust", "verdicts").collect()}
    assert {k: r["verdict"] for k, r in got.items()} == {1: "pass", 2: "pass", 3: "no_conclusion", 4: "no_conclusion", 5: "fail", 6: "no_conclusion", 7: "no_conclusion", 9: "no_conclusion"}
    assert "pressure_channel_missing" in got[3]["blocking"] and got[4]["blocking"] == "spring_curve_coverage" and got[5]["suspects"] == "actuator,valve_body"
    assert "unit area" in got[6]["blocking"] and "spring_curve_missing" in got[7]["blocking"] and got[9]["blocking"] == "no_overlap,pressure_channel_missing"
    figures = {r["test_id"]: r for r in store.latest("stemthrust", "metrics").collect()}
    assert figures[1]["seating"] == pytest.approx(3300, abs=1) and figures[2]["seating"] == pytest.approx(3300, abs=1)
    assert figures[1]["running_open"] == pytest.approx(figures[2]["running_open"], abs=1)

    again = good.where("test_id = 1")
    moved = adjustment(spark, (1, 1, "boundary_move", None, "opening running end", 16.0), (1, 2, "boundary_move", None, "opening running end", 15.0))
    store.publish("stemthrust", records.stem_thrust(submitted.of_kind(again, "stemthrust"), no_certificates, moved), again, "ann")
    ends = {r["version"]: r["i_end"] for r in store.table("stemthrust", "phases").where("test_id = 1 and type = 'opening' and phase = 'running'").collect()}
    assert ends[2] == 75 < ends[1]


def curve(test_id, factor=1.0, density=998.0, unit="m3/h", kind="linear", **more):
    rows = []
    for k in range(256):
        level, inside = k // 32, k % 32
        place = (level + 1) * 10.0 + max(inside - 27, 0) * 2.0
        x = place / 100
        share = {"linear": x, "quick_open": math.sqrt(x), "equal_percentage": 50 ** (x - 1)}[kind]
        flow = factor * 50 * share * 0.865 * math.sqrt(2.0 / (998 / 999))
        rows.append((k * 0.5, place, flow / (0.06 if unit == "l/min" else 1.0), 500.0, 300.0, 293.15))
    names = {"position": "%", "flow": unit, "upstream_pressure": "kPa", "downstream_pressure": "kPa", "temperature": "K"}
    series = {n: {"unit": u, "points": [[r[0], r[j + 1]] for r in rows]} for j, (n, u) in enumerate(names.items())}
    fluid = {"name": "water", "vapor_pressure_kpa": 2.34, "density_ref_temp_c": 20.0} | ({} if density is None else {"density_kg_m3": density})
    valve = {"rated_cv": 50.0, "size_dn_mm": 50, "trim": "t", "characteristic": kind}
    return HEAD | {"kind": "flowcurve", "test_id": test_id, "valve_tag": "F", "fluid": fluid, "valve": valve, "meter": {"full_scale": 80.0, "unit": "m3/h"}, "series": series} | more


def test_flow_curves_from_record_to_versions(spark, tmp_path, no_certificates):
    rows = [
        curve(1), curve(2, factor=0.6), curve(3, density=None), curve(4, unit="l/min", kind="quick_open"), curve(5, kind="equal_percentage"), curve(6, meter={"full_scale": 500.0, "unit": "l/min"}),
        curve(7, factor=0.6, thresholds={"blockage_scale_max": 0.5}), curve(8, valve={"rated_cv": 50.0, "characteristic": "odd"}), curve(9, calibration_valid_until="2024-01-01T00:00:00Z"),
    ]
    good, rejected = read(spark, tmp_path / "in", rows)
    assert rejected.count() == 0
    store = Store(spark, str(tmp_path / "store"))
    store.publish("flowcurve", records.flow_curve(submitted.of_kind(good, "flowcurve"), no_certificates), good)
    got = {r["test_id"]: r for r in store.latest("flowcurve", "verdicts").collect()}
    fine = "matches_nameplate"
    assert {k: r["verdict"] for k, r in got.items()} == {1: fine, 2: "suspect", 3: "no_conclusion", 4: fine, 5: fine, 6: fine, 7: fine, 8: "no_conclusion", 9: "no_conclusion"}
    assert got[2]["suspects"] == "blockage" and "property_missing" in got[3]["blocking"] and "valve_unknown" in got[8]["blocking"] and got[9]["blocking"] == "calibration_expired"
    # A full scale of 500 l/min is 30 m3/h, which the widest openings reach.
    over = {r["test_id"]: r["n"] for r in store.latest("flowcurve", "points").where("array_contains(codes, 'flow_overrange')").groupBy("test_id").count().withColumnRenamed("count", "n").collect()}
    assert set(over) == {6}
    assert store.latest("flowcurve", "curves").where("test_id = 1").first()["capacity_factor"] == pytest.approx(1.0, abs=0.01)

    again = good.where("test_id in (1, 2)")
    asked = adjustment(spark, *((1, k, "disable_point", k, None, None) for k in range(6)), (2, 1, "boundary_move", 1, "start", 20.0))
    store.publish("flowcurve", records.flow_curve(submitted.of_kind(again, "flowcurve"), no_certificates, asked), again, "ann")
    assert store.latest("flowcurve", "verdicts").where("test_id = 1").first()["blocking"] == "insufficient_adopted_points"
    starts = {r["version"]: r["t_start"] for r in store.table("flowcurve", "plateaus").where("test_id = 2 and plateau = 1").collect()}
    assert starts[1] < starts[2] == 20.0


def test_no_records_give_empty_tables(spark, tmp_path, no_certificates):
    good, _ = read(spark, tmp_path / "in", [curve(1), stem(2), seat(3)])
    for run, kind in ((records.seat_leak, "seatleak"), (records.flow_curve, "flowcurve")):
        made = run(submitted.of_kind(good.where("test_id = 9"), kind), no_certificates)
        assert made["verdicts"].count() == 0
