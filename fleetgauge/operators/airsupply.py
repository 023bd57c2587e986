"""Air supply around the solver: schemes in base units with their gaps, results of actions from stored series, revisions compared.

Schemes are records of kind airsupply with their fields (``sources.records``).
Series are given; nothing is simulated here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.functions import units
from fleetgauge.sources.held import hold

EPS = 1e-9
# Unit spellings and their factors to m3, and to Nl/min per kPa.
VOLUME_M3 = {"l": 1e-3, "m3": 1.0}
CONDUCTANCE = {"nl/min/kpa": 1.0, "nm3/h/kpa": 1000.0 / 60.0}


def quantities(schemes: DataFrame) -> DataFrame:
    """(test_id, field, value, gap): all declared quantities in base units, or unit_conflict with what is wrong: missing_value, unit_conflict or nonpositive."""
    c = F.col

    def one(field: str, of: Column, table: dict[str, float], zero: bool = True) -> Column:
        q = units.quantity(of["value"], of["unit"], table, zero)
        # Only where zero isn't allowed a sign matters.
        low = (q["gap"] == "nonpositive") & F.lit(zero)
        base = units.by_factor(of["value"], of["unit"], table)
        return F.struct(F.lit(field).alias("field"), F.when(low, base).otherwise(q["value"]).alias("value"), F.when(~F.coalesce(low, F.lit(False)), q["gap"]).alias("gap"))

    a = c("actuator")
    listed = [one("initial_chamber_pressure", a["initial_chamber_pressure"], units.PRESSURE_KPA)]
    listed += [one(f"chamber_{x}.{end}_volume", a[f"chamber_{x}"][f"{end}_volume"], VOLUME_M3, False) for x in "ab" for end in ("min", "max")]
    listed += [one(f"area_{x}", a[f"area_{x}"], units.AREA_M2, False) for x in "ab"]
    listed += [one(x, a[x], units.FORCE_N) for x in ("load", "friction")] + [one("port_conductance", a["port_conductance"], CONDUCTANCE, False)]
    listed += [one("header_pressure", c("supply.header_pressure"), units.PRESSURE_KPA, False), one("set_pressure", c("regulator.set_pressure"), units.PRESSURE_KPA, False)]
    listed += [one("tank.volume", c("tank.volume"), VOLUME_M3, False), one("tank.initial_pressure", c("tank.initial_pressure"), units.PRESSURE_KPA)]
    rows = schemes.select("test_id", F.explode(F.array(*listed)).alias("x")).select("test_id", "x.*")

    def many(column: str, name: Column, of: str, table: dict[str, float]) -> DataFrame:
        each = schemes.select("test_id", F.posexplode(column).alias("k", "e"))
        q = one("", c(f"e.{of}"), table)
        return each.select("test_id", name.alias("field"), q["value"].alias("value"), q["gap"].alias("gap"))

    flows = many("events", F.format_string("events[%d].flow", c("k")), "flow", units.GAS_NL_MIN)
    needs = many("actions", F.concat(F.lit("actions["), c("e.name"), F.lit("]")), "required_supply_pressure_min", units.PRESSURE_KPA)
    return rows.unionByName(flows).unionByName(needs)


def scheme_gaps(schemes: DataFrame, found: DataFrame) -> DataFrame:
    """(test_id, code, detail): unit_conflict, event_order and flow_curve_coverage of every scheme.

    The order of events is told by each one and the one before it in the
    declared list; a curve has to reach positive differences, and with a single
    point to begin there.
    """
    c = F.col
    gaps = found.where("gap is not null").select("test_id", F.lit("unit_conflict").alias("code"), F.concat_ws(" ", "field", "gap").alias("detail"))
    ends = found.where("field like 'chamber_%'").groupBy("test_id", F.substring("field", 1, 9).alias("chamber")).agg(
        F.max(F.when(c("field").endswith("min_volume"), c("value"))).alias("low"), F.max(F.when(c("field").endswith("max_volume"), c("value"))).alias("high")
    )
    gaps = gaps.unionByName(ends.where("high <= low").select("test_id", F.lit("unit_conflict").alias("code"), F.concat_ws(" ", "chamber", F.lit("volumes")).alias("detail")))
    known = {"dp_unit": units.PRESSURE_KPA, "flow_unit": units.GAS_NL_MIN}
    for name, table in known.items():
        unit = F.coalesce(f"regulator.{name}", F.lit("kPa")) if name == "dp_unit" else c(f"regulator.{name}")
        strange = ~F.coalesce(units.unit_key(unit).isin(*table), F.lit(False))
        gaps = gaps.unionByName(schemes.where(strange).select("test_id", F.lit("unit_conflict").alias("code"), F.lit(f"regulator {name}").alias("detail")))
    spring = c("actuator.spring").isNotNull() & ~F.coalesce(units.unit_key(F.coalesce("actuator.spring.force_unit", F.lit("n"))).isin(*units.FORCE_N), F.lit(False))
    gaps = gaps.unionByName(schemes.where(spring).select("test_id", F.lit("unit_conflict").alias("code"), F.lit("spring force_unit").alias("detail")))

    listed = schemes.select("test_id", F.posexplode("events").alias("k", "e")).select("test_id", "k", "e.device", c("e.t_start_s").alias("t0"), c("e.t_end_s").alias("t1"))
    before = F.lag("t0").over(Window.partitionBy("test_id").orderBy("k"))
    listed = listed.withColumn("late", c("t0") < before - EPS)
    backwards = listed.where("t1 <= t0").select("test_id", F.lit("event_order").alias("code"), F.concat_ws(" ", F.lit("ends before it starts:"), "device").alias("detail"))
    mixed = listed.groupBy("test_id").agg(F.bool_or("late").alias("late")).where("late").select("test_id", F.lit("event_order").alias("code"), F.lit("not in order of their starts").alias("detail"))
    gaps = gaps.unionByName(backwards).unionByName(mixed)

    top, low = F.array_max(F.transform("regulator.flow_curve", lambda p: p[0])), F.array_min(F.transform("regulator.flow_curve", lambda p: p[0]))
    short = (F.size("regulator.flow_curve") > 0) & (F.size("regulator.flow_curve") < 2) & (low <= 0)
    units_known = schemes.join(gaps.where("code = 'unit_conflict'").select("test_id").distinct(), "test_id", "left_anti")
    curves = schemes.where(short).select("test_id", F.lit("flow_curve_coverage").alias("code"), F.lit("one point without difference").alias("detail"))
    return gaps.unionByName(curves).unionByName(units_known.where(top <= 0).select("test_id", F.lit("flow_curve_coverage").alias("code"), F.lit("no positive difference").alias("detail")))


def action_results(actions: DataFrame, series: DataFrame, keys: list[str]) -> DataFrame:
    """One row per action (keys, name): reached, t_reached, stroke_time, time_margin, min_pressure, min_pressure_t, pressure_margin, final_position, exit_t, below_t0, below_t1.

    ``actions``: keys, name, kind, direction (open or close), t_start, t_end,
    travel_max, required, band.  ``series``: keys, i, t, position, pressure.
    Reached is the first point within ``band`` of the end of travel; exit_t the
    first one after it that is out again; below the first stretch with less
    than the required pressure.
    """
    c = F.col
    of = [*keys, "name"]
    # A test's actions go to its points as one array: no point moves or is sorted to meet one, and no table of
    # actions, however small its file, goes through the driver.
    asked = F.struct("name", "t_start", "t_end", "direction", "band", "required")
    listed = actions.groupBy(*keys).agg(F.collect_list(asked).alias("__all")).hint("shuffle_hash")
    during = F.filter("__all", lambda x: c("t").between(x["t_start"], x["t_end"]))
    points = series.join(listed, keys).select(*keys, "i", "t", "position", "pressure", F.explode(during).alias("__x"))
    target = F.when(c("__x.direction") == "open", 100.0).otherwise(0.0)
    inside = F.abs(c("position") - target) <= c("__x.band")
    low = F.coalesce(c("pressure") < c("__x.required"), F.lit(False))
    points = points.select(*keys, "__x.name", "position", "pressure", F.struct("t", "i").alias("__at"), inside.alias("inside"), low.alias("low"))
    # The first stretch of low pressure ends before the first point after its begin that isn't low.
    action = Window.partitionBy(*of)
    points = points.withColumn("t_reached", F.min(F.when(c("inside"), c("__at.t"))).over(action)).withColumn("__low", F.min(F.when(c("low"), c("__at"))).over(action))
    points = points.withColumn("__up", F.min(F.when(~c("low") & (c("__at") > c("__low")), c("__at"))).over(action))
    first = c("low") & F.coalesce(c("__at") < c("__up"), F.lit(True))
    found = points.groupBy(*of).agg(
        F.first("t_reached").alias("t_reached"), F.min("pressure").alias("min_pressure"), F.min_by("__at.t", F.struct("pressure", "__at.t")).alias("min_pressure_t"),
        F.max_by("position", "__at").alias("final_position"), F.min(F.when((c("__at.t") > c("t_reached")) & ~c("inside"), c("__at.t"))).alias("exit_t"),
        F.min(F.when(first, c("__at.t"))).alias("below_t0"), F.max(F.when(first, c("__at.t"))).alias("below_t1"),
    )
    rows = actions.join(found.hint("shuffle_hash"), of, "left")
    took = F.when(c("t_reached").isNotNull(), c("t_reached") - c("t_start"))
    return rows.select(
        *actions.columns, c("t_reached").isNotNull().alias("reached"), F.round("t_reached", 3).alias("t_reached"), F.round(took, 3).alias("stroke_time"), F.round(c("travel_max") - took, 3).alias("time_margin"),
        F.round("min_pressure", 2).alias("min_pressure"), F.round("min_pressure_t", 3).alias("min_pressure_t"), F.round(c("min_pressure") - c("required"), 2).alias("pressure_margin"),
        F.round("final_position", 3).alias("final_position"), F.round("exit_t", 3).alias("exit_t"), "below_t0", "below_t1",
    )


def findings(results: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, kind, t0, t1, device, n_devices): what went wrong with each action, with the device that began first in that stretch.

    ``events``: keys, device, t0, t1.  Stretches and events that only touch
    don't count.
    """
    c = F.col
    safe = c("kind") == "fail_safe_stroke"

    def finding(kind: str, when: Column, a: Column, b: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), a.alias("t0"), b.alias("t1")))

    slow = c("reached") & (c("stroke_time") > c("travel_max") + EPS)
    listed = F.array_compact(F.array(
        finding("pressure_below_requirement", c("below_t0").isNotNull(), c("below_t0"), c("below_t1")), finding("stroke_timeout", ~c("reached"), c("t_start"), c("t_end")),
        finding("stroke_timeout", slow, c("t_start"), c("t_reached")), finding("safe_position_not_reached", safe & ~c("reached"), c("t_start"), c("t_end")),
        finding("safe_position_not_reached", safe & c("exit_t").isNotNull(), c("exit_t"), c("t_end")),
    ))
    rows = hold(results.select(*keys, "name", F.explode(listed).alias("x")).select(*keys, "name", "x.*"), "findings")
    # A test's events go to its stretches as one array, as actions do to points.
    listed = events.where("t1 > t0").groupBy(*keys).agg(F.collect_list(F.struct("t0", "device", "t1")).alias("__events")).hint("merge")
    met = F.filter("__events", lambda e: (e["t0"] < c("t1") - EPS) & (e["t1"] > c("t0") + EPS) & (c("t1") - EPS > c("t0") + EPS))
    rows = rows.join(listed, keys, "left").withColumn("__met", F.coalesce(met, F.array().cast(listed.schema["__events"].dataType)))
    return rows.select(*keys, "name", "kind", "t0", "t1", F.array_min("__met")["device"].alias("device"), F.size("__met").cast("long").alias("n_devices"))


def checks(results: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, metric, value, low, high, passes) of every action; what isn't known fails."""
    c = F.col
    none = F.lit(None).cast("double")
    held = c("reached") & c("exit_t").isNull()
    listed = F.array_compact(F.array(
        F.struct(F.lit("min_supply_pressure").alias("metric"), c("min_pressure").alias("value"), c("required").alias("low"), none.alias("high")),
        F.struct(F.lit("stroke_time").alias("metric"), c("stroke_time").alias("value"), none.alias("low"), c("travel_max").alias("high")),
        F.when(c("kind") == "fail_safe_stroke", F.struct(F.lit("safe_position_reached").alias("metric"), held.cast("double").alias("value"), F.lit(1.0).alias("low"), none.alias("high"))),
    ))
    rows = results.select(*keys, "name", F.explode(listed).alias("x")).select(*keys, "name", "x.*")
    return rows.withColumn("passes", F.coalesce(c("value") >= c("low") - EPS, c("value") <= c("high") + EPS, F.lit(False)))


#: Metrics of two revisions, and which sign of a change is an improvement.
COMPARED = {"stroke_time": -1, "min_pressure": 1, "time_margin": 1, "pressure_margin": 1}
TOTALS = ("min_tank_pressure_kpa", "air_to_actuator_nl", "events_consumed_nl", "max_reg_dp_kpa")


def compare_actions(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, metric, a, b, delta, improved) of the actions of revision b against those of revision a of the same scheme."""
    c = F.col

    def long(rows: DataFrame, side: str) -> DataFrame:
        return rows.select(*keys, "name", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), c(m).cast("double").alias(side)) for m in COMPARED])).alias("x")).select(*keys, "name", "x.*")

    better = F.create_map(*[F.lit(x) for pair in COMPARED.items() for x in pair])
    both = long(b, "b").join(long(a, "a"), [*keys, "name", "metric"], "left")
    delta = F.round(c("b") - c("a"), 4)
    return both.select(*keys, "name", "metric", "a", "b", delta.alias("delta"), F.when(delta != 0, delta * F.element_at(better, c("metric")) > 0).alias("improved"))


def compare_totals(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total, a, b, delta) of the totals (keys and the columns of ``TOTALS``) of two revisions."""
    c = F.col

    def long(rows: DataFrame, side: str) -> DataFrame:
        return rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("total"), c(m).cast("double").alias(side)) for m in TOTALS])).alias("x")).select(*keys, "x.*")

    both = long(a, "a").join(long(b, "b"), [*keys, "total"], "full_outer")
    return both.select(*keys, "total", "a", "b", F.round(c("b") - c("a"), 4).alias("delta"))


def adjustments_between(adjustments: DataFrame, a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The adjustments (keys, seq, ...) that one revision has and the other hasn't; ``a`` and ``b`` (keys, n) say how many each has."""
    both = a.select(*keys, F.col("n").alias("__a")).join(b.select(*keys, F.col("n").alias("__b")), keys)
    rows = adjustments.join(both, keys)
    return rows.where((F.col("seq") > F.least("__a", "__b")) & (F.col("seq") <= F.greatest("__a", "__b"))).drop("__a", "__b")
