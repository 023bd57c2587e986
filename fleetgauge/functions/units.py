"""Unit normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit spellings and their factors to the base unit.
PRESSURE_KPA = {"kpa": 1.0, "mpa": 1000.0, "bar": 100.0, "psi": 6.894757, "kgf/cm2": 98.0665}
LIQUID_M3H = {"m3/h": 1.0, "m³/h": 1.0, "m3/min": 60.0, "m³/min": 60.0, "l/min": 0.06, "l/h": 0.001, "gpm": 0.227125, "gph": 0.227125 / 60.0}
GAS_NL_MIN = {"nl/min": 1.0, "nl/h": 1.0 / 60.0, "nml/min": 0.001, "sccm": 0.001, "slm": 1.0, "sl/min": 1.0, "nm3/h": 1000.0 / 60.0, "nm3/min": 1000.0}
AREA_M2 = {"cm2": 1e-4, "m2": 1.0, "in2": 6.4516e-4}
FORCE_N = {"n": 1.0, "kn": 1000.0}
TEMPERATURE_NAMES = {"c": ("c", "°c", "celsius", "degc"), "k": ("k", "kelvin"), "f": ("f", "°f", "fahrenheit")}
LENGTH_UNITS = ("mm", "cm", "in", "inch")
ABSOLUTE_ZERO_C = -273.15


def unit_key(unit: Column) -> Column:
    return F.lower(F.trim(unit))


def by_factor(value: Column, unit: Column, table: dict[str, float]) -> Column:
    """``value`` in the table's base unit; null for an unknown unit."""
    factors = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return value * F.try_element_at(factors, unit_key(unit))


def temperature_kind(unit: Column) -> Column:
    """c, k or f; null for an unknown unit."""
    out = F.lit(None).cast("string")
    for kind, names in TEMPERATURE_NAMES.items():
        out = F.when(unit_key(unit).isin(*names), kind).otherwise(out)
    return out


def temperature_c(value: Column, unit: Column) -> Column:
    """Degrees Celsius; null for an unknown unit."""
    kind = temperature_kind(unit)
    return F.when(kind == "c", value.cast("double")).when(kind == "k", value - 273.15).when(kind == "f", (value - 32.0) / 1.8)


def of_celsius(celsius: Column, unit: Column) -> Column:
    kind = temperature_kind(unit)
    return F.when(kind == "c", celsius).when(kind == "k", celsius + 273.15).when(kind == "f", celsius * 1.8 + 32.0)


def span_percent(value: Column, unit: Column, low: Column, high: Column, range_unit: Column) -> Column:
    """A position or command signal in percent of span; null where the units conflict."""
    u, r = unit_key(unit), unit_key(range_unit)
    span = high - low
    travel = F.when((u == r) & (span != 0), (value - low) / span * 100)
    percent = F.when((r == "%") & value.between(-10, 110), value)
    current = F.when((r == "%") & value.between(0, 25), (value - 4) / 16 * 100)
    return F.when(u == "%", percent).when(u == "ma", current).when(u.isin(*LENGTH_UNITS), travel)


def contact_level(value: Column) -> Column:
    """0 up to 0.3, 1 from 0.7 on, null between and for values that are no level."""
    return F.when(value <= 0.3, 0).when(value >= 0.7, 1)


def polarity(bit: Column, kind: Column) -> Column:
    """Bit of a normally closed contact inverted; null stays null."""
    return F.when(kind == "nc", 1 - bit).otherwise(bit)


def _known(unit: Column, table: dict[str, float]) -> Column:
    return F.coalesce(unit_key(unit).isin(*table), F.lit(False))


def same_family(kind: Column, unit: Column) -> Column:
    """Whether a unit belongs to a measurement type."""
    u = unit_key(unit)
    signal = u.isin("%", "ma")
    found = (
        F.when(kind == "command", signal)
        .when(kind == "position", signal | u.isin(*LENGTH_UNITS))
        .when(kind == "pressure", _known(unit, PRESSURE_KPA))
        .when(kind == "temperature", temperature_kind(unit).isNotNull())
        .when(kind == "flow_gas", _known(unit, GAS_NL_MIN))
        .when(kind == "flow_liquid", _known(unit, LIQUID_M3H))
    )
    return F.coalesce(found, F.lit(False))


def _table_of(kind: Column, unit: Column) -> Column:
    """Factor of a unit of a linear measurement type to its base unit."""
    one = F.lit(1.0)
    return F.when(kind == "pressure", by_factor(one, unit, PRESSURE_KPA)).when(kind == "flow_gas", by_factor(one, unit, GAS_NL_MIN)).when(kind == "flow_liquid", by_factor(one, unit, LIQUID_M3H))


def convert(value: Column, source: Column, target: Column, kind: Column, low: Column, high: Column) -> Column:
    """A value in another unit of the same family; null where units are incompatible or a travel has no span.

    Signals go by 4-20 mA, travel by the range's ends; lengths count as one unit.
    """
    a, b = unit_key(source), unit_key(target)
    span = high - low
    some = F.abs(span) >= 1e-12
    percent = (
        F.when(a == "%", value.cast("double"))
        .when(a == "ma", (value - 4.0) / 16.0 * 100.0)
        .when(a.isin(*LENGTH_UNITS) & some, (value - low) / span * 100.0)
    )
    signal = F.when(b == "%", percent).when(b == "ma", percent / 100.0 * 16.0 + 4.0).when(b.isin(*LENGTH_UNITS) & some, low + percent / 100.0 * span)
    lengths = a.isin(*LENGTH_UNITS) & b.isin(*LENGTH_UNITS)
    linear = value * _table_of(kind, source) / _table_of(kind, target)
    found = F.when(kind.isin("command", "position"), F.when(lengths, value.cast("double")).otherwise(signal)).when(kind == "temperature", of_celsius(temperature_c(value, source), target)).otherwise(linear)
    return F.when(same_family(kind, source) & same_family(kind, target), F.when(a == b, value.cast("double")).otherwise(found))


def conversion(source: Column, target: Column, kind: Column, low: Column, high: Column) -> Column:
    """What :func:`convert` does between two units, as a struct of numbers for :func:`converted`; null where it gives null.

    For rows with few pairs of units and many values: made once a pair, used once a value, with the same arithmetic.
    """
    a, b = unit_key(source), unit_key(target)
    span = high - low
    some = F.abs(span) >= 1e-12

    def step(minus, over=1.0, times=1.0) -> Column:
        return F.struct(*[(x if isinstance(x, Column) else F.lit(x)).cast("double").alias(n) for n, x in (("minus", minus), ("over", over), ("times", times))])

    def signal(unit: Column, to: bool) -> Column:
        current, travel = (step(-4.0, 100.0, 16.0), step(-low, 100.0, span)) if to else (step(4.0, 16.0, 100.0), step(low, span, 100.0))
        return F.when(unit == "%", step(0.0)).when(unit == "ma", current).when(unit.isin(*LENGTH_UNITS) & some, travel)

    def degrees(unit: Column, to: bool) -> Column:
        u = temperature_kind(unit)
        return F.when(u == "c", step(0.0)).when(u == "k", step(-273.15) if to else step(273.15)).when(u == "f", step(-32.0, 1.0, 1.8) if to else step(32.0, 1.8))

    same = (a == b) | (kind.isin("command", "position") & a.isin(*LENGTH_UNITS) & b.isin(*LENGTH_UNITS))
    there = F.when(same, step(0.0)).when(kind.isin("command", "position"), signal(a, False)).when(kind == "temperature", degrees(source, False)).otherwise(step(0.0, 1.0, _table_of(kind, source)))
    back = F.when(same, step(0.0)).when(kind.isin("command", "position"), signal(b, True)).when(kind == "temperature", degrees(target, True)).otherwise(step(0.0, _table_of(kind, target)))
    return F.when(same_family(kind, source) & same_family(kind, target), F.struct(there.alias("there"), back.alias("back")))


def converted(value: Column, how: Column) -> Column:
    """``value`` by a :func:`conversion`."""
    there, back = how["there"], how["back"]
    base = (value - there["minus"]) / there["over"] * there["times"]
    return base / back["over"] * back["times"] - back["minus"]


def convert_spread(value: Column, source: Column, target: Column, kind: Column, low: Column, high: Column) -> Column:
    """An uncertainty in another unit of the same family: slopes only, no zero points."""
    a, b = unit_key(source), unit_key(target)
    span = high - low

    def slope(unit: Column) -> Column:
        u = unit_key(unit)
        return F.when(u == "%", 1.0).when(u == "ma", 100.0 / 16.0).when(u.isin(*LENGTH_UNITS) & (F.abs(span) >= 1e-12), 100.0 / span)

    degrees = lambda unit: F.when(temperature_kind(unit) == "f", 1 / 1.8).otherwise(1.0)
    lengths = a.isin(*LENGTH_UNITS) & b.isin(*LENGTH_UNITS)
    ratio = (
        F.when(kind.isin("command", "position"), F.when(lengths, 1.0).otherwise(slope(source) / slope(target)))
        .when(kind == "temperature", degrees(source) / degrees(target))
        .otherwise(_table_of(kind, source) / _table_of(kind, target))
    )
    return F.when(same_family(kind, source) & same_family(kind, target), F.when(a == b, value.cast("double")).otherwise(value * ratio))


def conflict(kind: Column, unit: Column, range_unit: Column, low: Column, high: Column, range_span: Column) -> Column:
    """Why a whole channel with values from ``low`` to ``high`` can't be normalised; null if it can."""
    u, r = unit_key(unit), unit_key(range_unit)
    signal = (
        F.when((u == "%") & ((r != "%") | (low < -10) | (high > 110)), "percent_conflict")
        .when((u == "ma") & ((r != "%") | (low < 0) | (high > 25)), "current_conflict")
        .when(u.isin(*LENGTH_UNITS) & ((u != r) | (range_span == 0)), "travel_conflict")
        .when(~u.isin("%", "ma", *LENGTH_UNITS), "unknown_unit")
    )
    pressure = F.when(~_known(unit, PRESSURE_KPA), "unknown_unit").when(low < 0, "negative_pressure")
    temperature = F.when(temperature_kind(unit).isNull(), "unknown_unit").when(temperature_c(low, unit) < ABSOLUTE_ZERO_C, "below_absolute_zero")
    flow = F.when((kind == "flow_gas") & ~_known(unit, GAS_NL_MIN) | (kind == "flow_liquid") & ~_known(unit, LIQUID_M3H), "unknown_unit")
    return F.when(kind.isin("command", "position"), signal).when(kind == "pressure", pressure).when(kind == "temperature", temperature).otherwise(flow)


def normalised(kind: Column, value: Column, unit: Column, range_low: Column, range_high: Column, range_unit: Column) -> Column:
    """A sample in its channel's base unit: % of span, kPa, degrees C, Nl/min or m3/h."""
    signal = span_percent(value, unit, range_low, range_high, range_unit)
    return (
        F.when(kind.isin("command", "position"), signal)
        .when(kind == "pressure", by_factor(value, unit, PRESSURE_KPA))
        .when(kind == "temperature", temperature_c(value, unit))
        .when(kind == "flow_gas", by_factor(value, unit, GAS_NL_MIN))
        .when(kind == "flow_liquid", by_factor(value, unit, LIQUID_M3H))
    )


def quantity(value: Column, unit: Column, table: dict[str, float], allow_zero: bool = False) -> Column:
    """Struct (value, gap) of a declared quantity: its base value, or missing_value, unit_conflict or nonpositive."""
    base = by_factor(value, unit, table)
    low = value < 0 if allow_zero else value <= 0
    gap = F.when(value.isNull(), "missing_value").when(base.isNull(), "unit_conflict").when(low, "nonpositive")
    return F.struct(F.when(gap.isNull(), base).alias("value"), gap.alias("gap"))
