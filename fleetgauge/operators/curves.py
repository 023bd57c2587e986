"""Lookups in short curves that a row carries as an array, and certificate digests.

A curve has a handful of points, so it is searched in place by array functions;
rows need no join and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamped(x: Column, points: Column) -> Column:
    """Linear interpolation in an array of (x, y) that rises in x; outside of it the end's y.

    Null for a null ``x`` and for an empty or null curve.
    """
    upper = F.get(F.filter(points, lambda p: p["x"] >= x), F.lit(0))
    lower = F.try_element_at(F.filter(points, lambda p: p["x"] < x), F.lit(-1))
    share = (x - lower["x"]) / (upper["x"] - lower["x"])
    between = lower["y"] + share * (upper["y"] - lower["y"])
    return F.when(x.isNotNull(), F.coalesce(between, upper["y"], lower["y"]))


def spring_problem(points: Column, action: Column, travel_low: Column, travel_high: Column, margin: float = 0.5) -> Column:
    """Code of the first problem of a spring curve, null for a sound one.

    ``points`` are (x, y): position in percent and force in newtons, null where
    the unit is unknown.  Force has to rise with position if the spring closes
    (``action`` fail_close, also for null) and to fall if it opens.
    """
    pairs = F.sequence(F.lit(1), F.greatest(F.size(points) - 1, F.lit(1)))
    closes = F.coalesce(action, F.lit("fail_close")) == "fail_close"

    def ordered(i: Column) -> Column:
        a, b = F.get(points, i - 1), F.get(points, i)
        return (b["x"] > a["x"]) & ((b["y"] >= a["y"]) == closes)

    sound = (F.size(points) >= 2) & F.forall(points, lambda p: p["x"].isNotNull() & (p["y"] >= 0)) & F.forall(pairs, ordered)
    covers = (F.get(points, F.lit(0))["x"] <= travel_low + margin) & (F.try_element_at(points, F.lit(-1))["x"] >= travel_high - margin)
    return (
        F.when(points.isNull(), "spring_curve_missing")
        .when(~F.coalesce(sound, F.lit(False)), "spring_curve_invalid")
        .when(~F.coalesce(covers, F.lit(False)), "spring_curve_coverage")
    )


def blank_envelope(points: Column, temp_margin: float = 2.0, pressure_margin: float = 20.0) -> Column:
    """Struct temp_lo, temp_hi, pressure_lo, pressure_hi of a blank baseline with its margins."""
    temps, pressures = F.transform(points, lambda p: p["temp_c"]), F.transform(points, lambda p: p["pressure_kpa"])
    return F.struct(
        (F.array_min(temps) - temp_margin).alias("temp_lo"),
        (F.array_max(temps) + temp_margin).alias("temp_hi"),
        (F.array_min(pressures) - pressure_margin).alias("pressure_lo"),
        (F.array_max(pressures) + pressure_margin).alias("pressure_hi"),
    )


def blank_covers(envelope: Column, temp_lo: Column, temp_hi: Column, pressure_lo: Column, pressure_hi: Column) -> Column:
    """Whether a test's temperatures and pressures lie inside a blank envelope."""
    temps = (temp_lo >= envelope["temp_lo"]) & (temp_hi <= envelope["temp_hi"])
    return temps & (pressure_lo >= envelope["pressure_lo"]) & (pressure_hi <= envelope["pressure_hi"])


def blank_rate(points: Column, temp: Column, pressure: Column) -> Column:
    """Recovery rate of a blank baseline at a temperature, in its own unit.

    ``points`` have temp_c, pressure_kpa and rate.  A baseline of one
    temperature gives the rate at the nearest pressure, of equally near ones
    the first; others are interpolated in temperature, outside of it the end's
    rate.  Null for an empty baseline.
    """
    placed = F.array_sort(F.transform(points, lambda p, i: F.struct(p["temp_c"].alias("x"), i.alias("i"), p["pressure_kpa"].alias("p"), p["rate"].alias("y"))))
    near = F.array_min(F.transform(placed, lambda q: F.struct(F.abs(q["p"] - pressure).alias("d"), q["i"].alias("i"), q["y"].alias("y"))))["y"]
    first, last = F.get(placed, F.lit(0)), F.try_element_at(placed, F.lit(-1))
    inside = F.filter(
        F.sequence(F.lit(0), F.greatest(F.size(placed) - 2, F.lit(0))),
        lambda i: (F.get(placed, i)["x"] <= temp) & (F.get(placed, i + 1)["x"] >= temp),
    )
    at = F.get(inside, F.lit(0))
    a, b = F.get(placed, at), F.get(placed, at + 1)
    between = F.when(a["x"] == b["x"], a["y"]).otherwise(a["y"] + (temp - a["x"]) / (b["x"] - a["x"]) * (b["y"] - a["y"]))
    outside = F.when(temp < first["x"], first["y"]).when(temp > last["x"], last["y"])
    return F.when(first["x"] == last["x"], near).otherwise(F.coalesce(between, outside))


#: What identifies a certificate; ids and creation times don't.
IDENTITY = (
    "certificate_summary", "instrument_serial", "measurement_type", "points", "range_max", "range_min",
    "standard_uncertainty", "unit", "valid_from", "valid_until",
)


def certificate_digest() -> Column:
    """SHA-256 of the identifying columns as JSON, nulls included; equal for equal certificates.

    It is a digest of its own: other writers' JSON differs in how numbers look.
    """
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*IDENTITY), {"ignoreNullFields": "false"}), 256))
