"""From submitted JSON records to stored versions, and what happens when a run breaks off."""

import json

import pytest
from pyspark.sql import functions as F

from fleetgauge.operators import records
from fleetgauge.sources import records as submitted
from fleetgauge.sources.store import Store, changed, history

CERTS = "version_id long, unit string, measurement_type string, points array<struct<ind:double,ref:double>>, standard_uncertainty double, valid_from timestamp, valid_until timestamp, range_min double, range_max double"


def command_at(i):
    i = min(max(i, 0), 239)
    return 10.0 if i < 20 else i - 10.0 if i < 100 else 90.0 if i < 140 else 230.0 - i if i < 220 else 10.0


def stroke(test_id, lag=1, low=False, **more):
    t = [k * 0.25 for k in range(240)]
    wave = [(0.01 * (k % 3)) for k in range(240)]
    series = {
        "command": {"unit": "%", "points": [[x, command_at(k)] for k, x in enumerate(t)]},
        "position": {"unit": "%", "points": [[x, command_at(k - lag) + wave[k]] for k, x in enumerate(t)]},
        "pressure": {"unit": "bar", "points": [[x, (2.0 if low and 40 <= k <= 60 else 4.0) + k % 4 * 0.01] for k, x in enumerate(t)]},
    }
    head = {"kind": "fullstroke", "test_id": test_id, "valve_tag": f"V{test_id}", "test_started_at": "2024-05-01T08:00:00Z", "submitted_at": "2024-05-02T08:00:00Z"}
    rest = {"conditions": {"load": "bench"}, "calibration_valid_until": "2025-01-01T00:00:00Z"}
    return head | rest | {"series": series} | more


def switch(test_id, **more):
    t = [k * 0.2 for k in range(200)]
    place = [0.0 if k < 20 else (k - 20) * 2.0 if k < 70 else 100.0 if k < 120 else 100 - (k - 120) * 2.0 if k < 170 else 0.0 for k in range(200)]
    series = {
        "position": {"unit": "%", "points": [list(x) for x in zip(t, place, strict=True)]},
        "open": {"unit": "bool", "points": [[x, float(69 <= k <= 121)] for k, x in enumerate(t)]},
        "closed": {"unit": "bool", "points": [[x, float(not (k < 24 or k > 167))] for k, x in enumerate(t)]},
    }
    contact = lambda p, a, r: {"polarity": p, "actuate_window_pct": a, "release_window_pct": r}
    spec = {"open": contact("NO", [95, 100], [90, 98]), "closed": contact("NC", [0, 5], [2, 12]), "debounce_s": 0.5, "mutual_exclusion": {"enabled": True, "max_overlap_s": 0.5}}
    head = {"kind": "limitswitch", "test_id": test_id, "valve_tag": "S", "submitted_at": "2024-05-02T08:00:00Z", "calibration_valid_until": "2025-01-01T00:00:00Z"}
    return head | {"conditions": {}, "switch": spec, "series": series} | more


def trip(test_id, stop=None):
    t = [k * 0.1 for k in range(300)]
    fall = lambda k: max(0.0, 80.0 - max(0, k - 55) * 2.0)
    series = {
        "trip": {"unit": "di", "points": [[x, float(k >= 50)] for k, x in enumerate(t)]},
        "command": {"unit": "%", "points": [[x, 80.0] for x in t]},
        "position": {"unit": "%", "points": [[x, max(fall(k), stop or 0.0)] for k, x in enumerate(t)]},
        "pressure": {"unit": "kPa", "points": [[x, max(0.0, 400.0 - max(0, k - 50) * 10.0)] for k, x in enumerate(t)]},
    }
    head = {"kind": "failsafe", "test_id": test_id, "valve_tag": "T", "submitted_at": "2024-05-02T08:00:00Z", "calibration_valid_until": "2025-01-01T00:00:00Z"}
    return head | {"fail_mode": "fail_close", "conditions": {"actuator_type": "spring_return"}, "series": series}


def read(spark, folder, rows, raw=()):
    folder.mkdir()
    for k, r in enumerate(rows):
        (folder / f"{k}.json").write_text(json.dumps(r))
    for k, text in enumerate(raw):
        (folder / f"raw{k}.json").write_text(text)
    return submitted.parse(submitted.read_texts(spark, str(folder)))


@pytest.fixture(scope="module")
def certificates(spark):
    when = ["2024-01-01 00:00:00", "2025-01-01 00:00:00"]
    rows = [(1, "%", "command", [(-5.0, -5.0), (105.0, 105.0)], 0.1, -5.0, 105.0), (2, "mA", "position", [(4.0, 4.08), (20.0, 20.08)], 0.01, 4.0, 20.0), (3, "kPa", "pressure", [(0.0, 0.0), (900.0, 900.0)], 1.0, 0.0, 900.0), (4, "mA", "position", [(4.0, 4.0), (20.0, 20.0)], 0.01, 4.0, 12.0)]
    frame = spark.createDataFrame([(v, u, m, p, s, *when, a, b) for v, u, m, p, s, a, b in rows], CERTS.replace("timestamp", "string"))
    return frame.withColumn("valid_from", F.to_timestamp("valid_from")).withColumn("valid_until", F.to_timestamp("valid_until"))


def test_bad_records_are_listed(spark, tmp_path):
    odd = [stroke(1), stroke(None), {"kind": "fullstroke", "series": {"command": {"unit": "%", "points": [[0, 1]]}}}, {"kind": "other"}, stroke(5) | {"series": stroke(5)["series"] | {"pressure": {"unit": "bar", "points": [[0, 1, 2]]}}}]
    good, rejected = read(spark, tmp_path / "in", odd, ["{broken", "[1, 2]"])
    assert good.count() == 2 and good.where("test_id is null").count() == 0
    assert sorted(r["reason"] for r in rejected.collect()) == ["bad_points pressure", "no_channel position,pressure", "no_object", "not_json", "unknown_kind"]


def test_kinds_keep_their_own_fields(spark, tmp_path):
    seat = {"kind": "seatleak", "test_id": 1, "gas": {"name": "air", "compressibility_z": 0.99}, "isolation": [{"t": 1.5, "action": "close", "note": "x"}], "series": {c: {"unit": "kPa", "points": [[0, 1]]} for c in submitted.CHANNELS["seatleak"]}}
    stem = {"kind": "stemthrust", "test_id": 2, "actuator": {"actuator_type": "double", "area_a": {"value": 200, "unit": "cm2"}, "spring": {"version": "s1", "points": [[0, 1300], [100, 3000]]}}, "series": {c: {"unit": "kPa", "points": [[0, 1]]} for c in submitted.CHANNELS["stemthrust"]}}
    air = {"kind": "airsupply", "test_id": 3, "events": [{"device": "d", "t_start_s": 1, "t_end_s": 2, "flow": {"value": 3, "unit": "sccm"}}], "actuator": {"load": {"value": 1, "unit": "n"}}}
    good, rejected = read(spark, tmp_path / "in", [seat, stem, air])
    assert rejected.count() == 0
    row = submitted.of_kind(good, "seatleak").first()
    assert row["gas"]["compressibility_z"] == 0.99 and row["isolation"][0]["action"] == "close" and row["range_high"] == 100.0
    row = submitted.of_kind(good, "stemthrust").first()
    assert row["area_a"]["unit"] == "cm2" and row["spring"]["points"] == [[0.0, 1300.0], [100.0, 3000.0]] and row["area_b"] is None
    assert submitted.of_kind(good, "airsupply").first()["events"][0]["flow"]["value"] == 3.0


def test_full_strokes_from_record_to_versions(spark, tmp_path, certificates):
    bound = {"command": 1, "position": 2, "pressure": 3}
    rows = [
        stroke(1), stroke(2, lag=40), stroke(3, low=True), stroke(4, calibration_valid_until="2024-01-01T00:00:00Z"), stroke(5, calibration_bindings=bound),
        stroke(6, calibration_bindings=bound | {"position": 4}), stroke(7, thresholds={"deadband_pct_max": 0.5}), stroke(8),
    ]
    good, _ = read(spark, tmp_path / "in", rows)
    made = records.full_stroke(submitted.of_kind(good, "fullstroke"), certificates)
    store = Store(spark, str(tmp_path / "store"))
    run = store.publish("fullstroke", made, good)
    got = {r["test_id"]: r for r in store.latest("fullstroke", "verdicts").collect()}
    assert {k: r["verdict"] for k, r in got.items()} == {1: "ok", 2: "exceedances", 3: "exceedances", 4: "no_conclusion", 5: "ok", 6: "no_conclusion", 7: "exceedances", 8: "ok"}
    assert got[3]["verdict"] == "exceedances" and "low_supply" in got[3]["kinds"]
    assert got[4]["blocking"] == "calibration_expired" and got[6]["blocking"] == "calibration position range_uncovered"
    assert got[7]["kinds"] == "deadband,reverse_hysteresis" and got[8]["kinds"] == ""
    shift = store.latest("fullstroke", "metrics").where("test_id in (1, 5) and metric = 'steady_state'").collect()
    assert abs(abs(shift[0]["value"] - shift[1]["value"]) - 0.5) < 0.1

    # The same run again changes nothing; a further run makes the next versions of its tests only.
    assert store.publish("fullstroke", made, good, run=run) == run and len(store.commits("fullstroke")) == 1
    cut = spark.createDataFrame([(1, 1, "exclusion", "pressure", 3, 9, None, None, None, None, None, "spikes"), (1, 2, "boundary_move", None, None, None, 1, "start", 6.0, None, None, "late")], records.ADJUSTMENTS)
    again = good.where("test_id = 1")
    made = records.full_stroke(submitted.of_kind(again, "fullstroke"), certificates, cut)
    store.publish("fullstroke", made, again, "ann")
    assert sorted((r["test_id"], r["version"]) for r in store.versions("fullstroke").collect()) == sorted([*((k, 1) for k in range(1, 9)), (1, 2)])
    assert [(r["version"], r["author"]) for r in history(store, "fullstroke", 1).collect()] == [(1, "auto"), (2, "ann")]
    starts = {r["version"]: r["t_start"] for r in store.table("fullstroke", "segments").where("test_id = 1 and seg = 1").collect()}
    assert starts[1] < starts[2] == 6.0
    assert store.latest("fullstroke", "excluded").where("test_id = 1").count() == 7
    told = changed(store.versions("fullstroke"), store.table("fullstroke", "metrics"), ["metric"], "value")
    assert told.where("test_id <> 1").count() == 0


def test_a_broken_run_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    tests = spark.createDataFrame([(1,), (2,)], "test_id long")
    table = lambda v: tests.withColumn("value", F.lit(v))
    assert store.latest("x", "verdicts") is None
    store.publish("x", {"verdicts": table(1), "more": table(1)}, tests)

    # Between two tables.
    broken = table(2).withColumn("value", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        store.publish("x", {"verdicts": table(2), "more": broken}, tests, run="r2")
    assert {r["value"] for r in store.latest("x", "verdicts").collect()} == {1} and len(store.commits("x")) == 1
    # Before the commit.
    with monkeypatch.context() as m:
        m.setattr(Store, "_claim", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            store.publish("x", {"verdicts": table(2), "more": table(2)}, tests, run="r2")
    assert {r["version"] for r in store.latest("x", "verdicts").collect()} == {1}
    # The same run once more.
    store.publish("x", {"verdicts": table(2), "more": table(2)}, tests, run="r2")
    assert {(r["value"], r["version"]) for r in store.latest("x", "more").collect()} == {(2, 2)}


def test_two_writers_never_share_a_version(spark, tmp_path, monkeypatch):
    tests = spark.createDataFrame([(1,), (2,)], "test_id long")
    one, two = Store(spark, str(tmp_path / "store")), Store(spark, str(tmp_path / "store"))
    claim, met = Store._claim, []

    def slow(self, kind, n, run):
        if not met:
            met.append(n)
            two.publish("x", {"verdicts": tests.where("test_id = 2").withColumn("value", F.lit("two"))}, tests.where("test_id = 2"), run="second")
        return claim(self, kind, n, run)

    monkeypatch.setattr(Store, "_claim", slow)
    one.publish("x", {"verdicts": tests.withColumn("value", F.lit("one"))}, tests, run="first")
    assert one.commits("x") == [(1, "second"), (2, "first")]
    assert sorted((r["test_id"], r["version"], r["value"]) for r in one.table("x", "verdicts").collect()) == [(1, 1, "one"), (2, 1, "two"), (2, 2, "one")]


def test_limit_switches_from_records(spark, tmp_path, certificates):
    stuck = switch(2)
    stuck["series"]["open"]["points"] = [[x, 0.0] for x, _ in stuck["series"]["open"]["points"]]
    good, _ = read(spark, tmp_path / "in", [switch(1), stuck, switch(3, thresholds={"edge_delay_s_max": 0.1})])
    made = records.limit_switch(submitted.of_kind(good, "limitswitch"), certificates)
    got = {r["test_id"]: r for r in made["verdicts"].collect()}
    assert got[1]["verdict"] == "ok", (got[1], made["events"].collect())
    assert got[2]["events"] == "no_trigger_at_end" and got[3]["failed"] == "closed edge_delay,open edge_delay"
    refs = made["references"].where("test_id = 2").first()
    assert refs["channel"] == "position" and [x["idx"] for x in refs["refs"]] == [67, 68, 122, 123]


def test_trips_from_records(spark, tmp_path, certificates):
    good, _ = read(spark, tmp_path / "in", [trip(1), trip(2, stop=30.0)])
    manual = spark.createDataFrame([(1, 1, "trip_move", None, None, None, None, None, 9.0, None, None, "x")], records.ADJUSTMENTS)
    rows = submitted.of_kind(good, "failsafe")
    got = {r["test_id"]: r for r in records.fail_safe(rows, certificates)["verdicts"].collect()}
    assert got[1]["verdict"] == "pass", got[1]
    assert got[2]["verdict"] != "pass" and got[1]["target"] == 0.0
    got = {r["test_id"]: r for r in records.fail_safe(rows, certificates, manual)["verdicts"].collect()}
    assert "manual_trip_not_bracketed" in got[1]["blocking"] and got[1]["verdict"] == "no_conclusion"


def test_uncertainty_from_records(spark, tmp_path, certificates):
    part = lambda v, u="%": {"kind": "accuracy", "value": v, "unit": u}
    sure = {"channels": {"position": {"accuracy": part(0.1)}}}
    wide = {"channels": {"position": {"accuracy": part(3.0)}}}
    bad = {"channels": {"position": {"accuracy": part(3.0, "bar")}}}
    good, _ = read(spark, tmp_path / "in", [stroke(1, uncertainty=sure), stroke(2, uncertainty=wide), stroke(3, uncertainty=bad), stroke(4)])
    made = records.full_stroke(submitted.of_kind(good, "fullstroke"), certificates, trials=40)
    got = {r["test_id"]: r["verdict"] for r in made["verdicts"].collect()}
    assert got == {1: "ok", 2: "indeterminate", 3: "ok", 4: "ok"}
    assert {r["test_id"] for r in made["uncertainty"].select("test_id").collect()} == {1, 2}
    assert [r["kind"] for r in made["issues"].where("test_id = 2").collect()] == ["uncertainty_indeterminate"]
