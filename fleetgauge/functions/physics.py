"""Fluid and mechanical formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the flow equations.
FF_BASE, FF_SLOPE = 0.96, 0.28
CV_FACTOR, WATER_DENSITY = 0.865, 999.0
KPA_PER_BAR, KELVIN = 100.0, 273.15


def critical_ratio(vapour_kpa: Column, critical_kpa: Column) -> Column:
    return F.lit(FF_BASE) - F.lit(FF_SLOPE) * F.sqrt(vapour_kpa / critical_kpa)


def choked_drop(p1_abs: Column, vapour_kpa: Column, critical_kpa: Column, recovery: Column) -> Column:
    """Pressure drop from which the flow no longer grows."""
    return recovery * recovery * (p1_abs - critical_ratio(vapour_kpa, critical_kpa) * vapour_kpa)


def liquid_cv(flow_m3h: Column, drop_kpa: Column, density: Column) -> Column:
    """Flow coefficient; null unless flow, drop and density are positive."""
    value = flow_m3h / (F.lit(CV_FACTOR) * F.sqrt(drop_kpa / F.lit(KPA_PER_BAR) / (density / F.lit(WATER_DENSITY))))
    return F.when((flow_m3h > 0) & (drop_kpa > 0) & (density > 0), value)


def characteristic(position_pct: Column, kind: Column, rangeability: Column) -> Column:
    """Share of the rated coefficient at a position, clamped to 0..100 %."""
    x = F.least(F.greatest(position_pct / 100, F.lit(0.0)), F.lit(1.0))
    equal = F.pow(rangeability, x - 1)
    return F.when(kind == "linear", x).when(kind == "equal_percentage", equal).when(kind == "quick_opening", F.sqrt(x))


def standard_volume(p_kpa: Column, temp_c: Column, volume_m3: Column, z: Column, ref_c: Column, ref_kpa: Column) -> Column:
    """Litres at reference conditions of a gas in a closed volume."""
    return p_kpa * volume_m3 * 1000 * (ref_c + F.lit(KELVIN)) / (z * (temp_c + F.lit(KELVIN)) * ref_kpa)


def net_thrust(acting: Column, action: Column, pa: Column, pb: Column, area_a: Column, area_b: Column, spring_n: Column) -> Column:
    """Net stem force in N from chamber pressures in kPa, areas in m2 and the spring force."""
    a = pa * area_a * 1000
    double = a - pb * area_b * 1000
    return F.when(acting == "double", double).when(action == "fail_close", a - spring_n).otherwise(spring_n - a)


def piecewise(x: Column, points: list[tuple[float, float]]) -> Column:
    """Linear interpolation in an ascending list of points; null outside of it."""
    out = F.lit(None).cast("double")
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:], strict=False))):
        inside = (x >= x0) & (x <= x1)
        out = F.when(inside, F.lit(y0) + (x - F.lit(x0)) * F.lit((y1 - y0) / (x1 - x0))).otherwise(out)
    return out
