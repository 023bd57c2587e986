"""Gas seat leak: isolation order, segments, evidence gates, mass balance, exceedance, cross-check and verdict.

``grid`` has the keys, i, t, position, p_up, p_down and temp; ``tests`` per test
volume_m3, z, ref_c, ref_kpa, sign (1 or -1) and blank (array of temp_c, pressure_kpa, rate),
and, where they differ from the defaults, the blank's temp_margin and pressure_margin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.functions import physics
from fleetgauge.operators import curves, interp, runs, stats
from fleetgauge.sources.held import hold

#: Default limits.
LIMITS = {
    "rate": 0.05, "cumulative": 0.2, "min_dp_kpa": 100.0, "closed_band": 2.0, "drift": 0.5, "stabilise_s": 15.0, "hold_s": 60.0,
    "coverage": 0.9, "slope_c_min": 0.5, "slope_window_s": 15.0, "dwell_s": 10.0, "deviation_pct": 25.0,
}
#: Actions in the order they must be taken.
ORDER = ("close_command", "valve_closed", "downstream_isolated", "hold_start", "hold_end")


def isolation(actions: DataFrame, keys: list[str]) -> DataFrame:
    """Per test the first time of each ordered action, and how many conflicts the record has.

    Conflicts are repeated ordered actions, ordered actions that don't come
    strictly later than the one before them, and vents opened or the upstream
    isolated while the volume is closed.
    """
    c = F.col
    place = F.array_position(F.array(*[F.lit(a) for a in ORDER]), c("action"))
    rows = actions.withColumn("place", place).withColumn("at", F.row_number().over(Window.partitionBy(*keys, "action").orderBy("t", "idx")))
    ordered = rows.where((c("place") > 0) & (c("at") == 1))
    late = ordered.withColumn("before", F.lag("t").over(Window.partitionBy(*keys).orderBy("place")))
    times = [F.max(F.when(c("action") == a, c("t"))).alias(f"t_{a}") for a in ORDER]
    known = late.groupBy(*keys).agg(*times, F.count_if(c("before") >= c("t")).alias("disorder"))
    repeats = rows.groupBy(*keys).agg(F.count_if((c("place") > 0) & (c("at") > 1)).alias("repeats"))
    leaks = rows.where(c("action").isin("vent_opened", "upstream_isolated")).join(known, keys)
    inside = (c("t") >= c("t_downstream_isolated")) & (c("t_hold_end").isNull() | (c("t") <= c("t_hold_end")))
    leaks = leaks.groupBy(*keys).agg(F.count_if(inside).alias("broken"))
    both = known.join(repeats, keys, "left").join(leaks, keys, "left").fillna(0, ["repeats", "broken"])
    return both.withColumn("conflicts", c("disorder") + c("repeats") + c("broken")).drop("disorder", "repeats", "broken")


def slopes(grid: DataFrame, keys: list[str], value: str, window_s: float) -> DataFrame:
    """``grid`` with the trailing slope of ``value`` per minute (column slope)."""
    rows = grid.withColumn("__us", stats.micros(F.col("t")))
    return stats.trailing_slope(rows, keys, "__us", value, round(window_s * 1e6)).drop("__us")


def delineate(grid: DataFrame, derived: DataFrame, keys: list[str], limits: dict[str, float] = LIMITS) -> DataFrame:
    """Per isolated test i_iso, i_hold, i_end, their times, how the hold's start was found, and gaps.

    The hold begins at the recorded action, else where the temperature's slope
    has calmed down and never again is twice as steep; it ends at the recorded
    action or with the record.
    """
    c = F.col
    rows = slopes(grid, keys, "temp", limits["slope_window_s"]).join(derived.where("t_downstream_isolated is not null"), keys)
    rows = rows.withColumn("steep", F.abs("slope"))
    back = Window.partitionBy(*keys).orderBy(c("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("worst", F.max("steep").over(back))

    rows = rows.withColumn("__p", F.struct("i", "t", F.lag("t").over(Window.partitionBy(*keys).orderBy("i")).alias("before")))

    def nearest(name: str) -> Column:
        return F.when(F.first(name).isNotNull(), F.min(F.struct(F.abs(c("t") - c(name)), "__p"))["__p"])

    whole = Window.partitionBy(*keys)
    rows = rows.withColumn("iso", F.coalesce(F.min(F.when(c("t") >= c("t_downstream_isolated"), c("__p"))).over(whole), F.max("__p").over(whole)))
    calm = (c("i") >= F.greatest("iso.i", F.lit(1))) & (c("steep") <= limits["slope_c_min"]) & (c("worst") <= 2 * limits["slope_c_min"])
    found = rows.groupBy(*keys).agg(
        F.first("iso").alias("iso"), nearest("t_hold_start").alias("declared"), F.min(F.when(calm, c("__p"))).alias("calm"), F.coalesce(nearest("t_hold_end"), F.max("__p")).alias("end")
    )
    found = found.withColumn("hold", F.coalesce("declared", "calm")).withColumn("start", F.when(c("declared").isNotNull(), "declared").when(c("calm").isNotNull(), "calm"))
    points = {"i_iso": "iso.i", "t_iso": "iso.t", "i_hold": "hold.i", "t_hold": "hold.t", "t_stable": "hold.before", "i_end": "end.i", "t_end": "end.t"}
    found = found.select(*keys, "start", *(c(x).alias(n) for n, x in points.items()))
    gaps = _length_gaps(c("i_hold").isNull(), limits)
    return found.select(*keys, "i_iso", "i_hold", "i_end", "t_iso", "t_hold", "t_end", "start", gaps.alias("gaps"))


def _length_gaps(unsettled: Column, limits: dict[str, float]) -> Column:
    c = F.col
    return F.array_compact(F.array(
        F.when(unsettled, "stabilization_not_reached"),
        F.when(c("t_stable") - c("t_iso") < limits["stabilise_s"], "stabilization_too_short"),
        F.when(c("t_end") - c("t_hold") < limits["hold_s"], "hold_too_short"),
    ))


def move_boundaries(segs: DataFrame, grid: DataFrame, moves: DataFrame, keys: list[str]) -> DataFrame:
    """``segs`` (i_iso, i_hold, i_end) after manual moves (keys, seq, boundary isolation, hold or end, new_time) in order; a move that would pass a neighbour is not applied."""
    known = grid.select(*keys, "t", F.col("i").alias("idx"), F.col("t").alias("v"))
    asked = moves.select(*keys, F.col("new_time").cast("double").alias("t"), "seq", "boundary")
    placed = interp.nearest_of_few(asked, known, keys).withColumn("i_new", F.col("near.idx"))
    steps = placed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "boundary", "i_new"))).alias("steps"))
    start = F.struct(*[F.col(n).cast("long").alias(n) for n in ("i_iso", "i_hold", "i_end")])

    def step(s: Column, m: Column) -> Column:
        i = m["i_new"]
        iso = F.when((m["boundary"] == "isolation") & (i < s["i_hold"] - 1), i).otherwise(s["i_iso"])
        hold = F.when((m["boundary"] == "hold") & (i > s["i_iso"]) & (i < s["i_end"]), i).otherwise(s["i_hold"])
        end = F.when((m["boundary"] == "end") & (i > s["i_hold"]), i).otherwise(s["i_end"])
        return F.struct(iso.alias("i_iso"), hold.alias("i_hold"), end.alias("i_end"))

    both = segs.join(steps, keys, "left").withColumn("__s", F.when(F.col("steps").isNull(), start).otherwise(F.aggregate("steps", start, step)))
    for name in ("i_iso", "i_hold", "i_end"):
        both = both.withColumn(name, F.col(f"__s.{name}"))
    return both.drop("steps", "__s")


def segments(grid: DataFrame, derived: DataFrame, keys: list[str], moves: DataFrame | None = None, limits: dict[str, float] = LIMITS) -> DataFrame:
    """:func:`delineate` with manual moves, and t_action, when the volume was closed by the record.

    Times and lengths are those after the moves; a hold whose start could not
    be found stays a gap wherever a move puts it.
    """
    c = F.col
    found = delineate(grid, derived, keys, limits)
    if moves is not None:
        moved = move_boundaries(found, grid, moves, keys).drop("t_iso", "t_hold", "t_end")
        rows = grid.select(*keys, "i", "t").join(moved, keys)
        at = lambda i: F.max(F.when(c("i") == i, c("t")))
        times = rows.groupBy(*keys).agg(at(c("i_iso")).alias("t_iso"), at(c("i_hold")).alias("t_hold"), at(c("i_end")).alias("t_end"), at(c("i_hold") - 1).alias("t_stable"))
        gaps = _length_gaps(F.array_contains("gaps", "stabilization_not_reached"), limits)
        found = moved.join(times, keys).withColumn("gaps", gaps).drop("t_stable")
    return found.join(derived.select(*keys, c("t_downstream_isolated").alias("t_action")), keys)


def hold_rows(grid: DataFrame, segs: DataFrame, tests: DataFrame, keys: list[str], limits: dict[str, float] = LIMITS) -> DataFrame:
    """All grid points from before the hold to its end with veq, net (blank-corrected signal), cumulative, rate, and in_hold."""
    c = F.col
    closed = c("t_action" if "t_action" in segs.columns else "t_iso").alias("t_closed")
    rows = grid.join(segs.where("i_hold is not null").select(*keys, "i_hold", "i_end", "t_hold", closed), keys).join(tests, keys).where(c("i") <= c("i_end"))
    rows = rows.withColumn("in_hold", c("i") >= c("i_hold"))
    whole = Window.partitionBy(*keys)
    inside = lambda name: F.when(c("in_hold"), c(name))
    rows = rows.withColumn("temp_mean", F.avg(inside("temp")).over(whole)).withColumn("p_median", F.median(inside("p_down")).over(whole))
    # The blank is one of the test: it is looked up at the hold's first point only, the others see it there.
    looked_up = F.when(c("i") == c("i_hold"), curves.blank_rate(c("blank"), c("temp_mean"), c("p_median")))
    rows = rows.withColumn("__blank", looked_up).withColumn("blank_rate", F.max("__blank").over(whole)).drop("__blank")
    veq = physics.standard_volume(c("p_down"), c("temp"), c("volume_m3"), c("z"), c("ref_c"), c("ref_kpa"))
    rows = rows.withColumn("blank_nl_min", physics.standard_volume(c("blank_rate"), c("temp_mean"), c("volume_m3"), c("z"), c("ref_c"), c("ref_kpa"))).withColumn("veq", veq)
    rows = rows.withColumn("net", c("sign") * (c("veq") - c("blank_nl_min") * (c("t") - c("t_hold")) / 60))
    first = F.max(F.when(c("i") == c("i_hold"), c("net"))).over(whole)
    rows = rows.withColumn("cumulative", F.round(c("net") - first, 6))
    return slopes(rows, keys, "net", limits["slope_window_s"]).withColumnRenamed("slope", "rate")


def balance(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per test the mean rate over the hold (least squares), the largest windowed rate, the cumulative leak and the blank's share."""
    return rows.where("in_hold").groupBy(*keys).agg(*_balances())


def _balances() -> list[Column]:
    """The aggregates of :func:`balance` over a test's points, those outside of the hold left out."""
    inside = lambda x: F.when(F.col("in_hold"), x)
    t, x = inside(F.col("t")), inside((F.col("t") - F.col("t_hold")) / 60)
    return [
        F.round(F.regr_slope(inside(F.col("net")), x), 6).alias("rate_mean"), F.round(F.max(inside(F.col("rate"))), 6).alias("rate_max"), F.max_by("cumulative", inside(F.col("i"))).alias("cumulative"),
        F.round(F.first("blank_nl_min"), 6).alias("blank_nl_min"), F.round(F.first("temp_mean"), 3).alias("temp_mean"), F.round(F.max(t) - F.min(t), 3).alias("hold_s"),
    ]


def first_exceedance(rows: DataFrame, keys: list[str], limits: dict[str, float] = LIMITS) -> DataFrame:
    """Per test the earlier of a rate over the limit for the whole dwell and a cumulative leak over its limit: t, kind, value."""
    c = F.col
    hold = rows.where("in_hold").withColumn("__us", stats.micros(c("t")))
    ahead = Window.partitionBy(*keys).orderBy("__us").rangeBetween(0, round(limits["dwell_s"] * 1e6))
    hold = hold.withColumn("low", F.min("rate").over(ahead)).withColumn("long", F.max("t").over(ahead) - c("t") >= limits["dwell_s"] - 1e-9)
    rate = F.when((c("rate") > limits["rate"]) & (c("low") > limits["rate"]) & c("long"), F.struct(F.round("t", 3).alias("t"), F.lit("leak_rate").alias("kind"), F.round("rate", 6).alias("value")))
    total = F.when(c("cumulative") > limits["cumulative"], F.struct(F.round("t", 3).alias("t"), F.lit("cumulative_leak").alias("kind"), c("cumulative").alias("value")))
    found = hold.groupBy(*keys).agg(F.min_by(rate, F.when(rate.isNotNull(), c("i"))).alias("a"), F.min_by(total, F.when(total.isNotNull(), c("i"))).alias("b"))
    first = F.when(c("b").isNull() | (c("a.t") <= c("b.t")), c("a")).otherwise(c("b"))
    return found.withColumn("x", first).where("x is not null").select(*keys, "x.*")


def gates(rows: DataFrame, keys: list[str], coverage: DataFrame, limits: dict[str, float] = LIMITS) -> DataFrame:
    """Per test the hold's evidence and the codes of what it lacks; ``coverage`` (keys, coverage) is that of the temperature."""
    return _judged(rows.groupBy(*keys).agg(*_evidence(rows)), keys, coverage, limits)


def _evidence(rows: DataFrame) -> list[Column]:
    """The aggregates of :func:`gates` over a test's points."""
    c = F.col
    # The position at isolation is interpolated between the two grid points around it.
    below, above = F.max_by("position", F.when(c("t") <= c("t_closed"), c("i"))), F.min_by("position", F.when(c("t") >= c("t_closed"), c("i")))
    t0, t1 = F.max(F.when(c("t") <= c("t_closed"), c("t"))), F.min(F.when(c("t") >= c("t_closed"), c("t")))
    at = F.when(t1 > t0, below + (above - below) * (F.first("t_closed") - t0) / (t1 - t0)).otherwise(F.coalesce(below, above))
    inside = lambda x: F.when(c("in_hold"), x)
    dp = c("sign") * (c("p_up") - c("p_down"))
    margins = [F.first(n).alias(n) for n in ("temp_margin", "pressure_margin") if n in rows.columns]
    return [
        F.round(at, 3).alias("position_at_isolation"), F.max(inside(c("position"))).alias("position_max"), (F.max(inside(c("position"))) - F.min(inside(c("position")))).alias("position_drift"),
        F.round(F.median(inside(dp)), 2).alias("dp_median"), F.round(F.min(inside(dp)), 2).alias("dp_min"), F.min(inside(c("temp"))).alias("temp_lo"), F.max(inside(c("temp"))).alias("temp_hi"),
        F.min(inside(c("p_down"))).alias("p_lo"), F.max(inside(c("p_down"))).alias("p_hi"), F.first("blank").alias("blank"), *margins,
    ]


def _judged(found: DataFrame, keys: list[str], coverage: DataFrame, limits: dict[str, float]) -> DataFrame:
    """:func:`gates` of the aggregates of :func:`_evidence`."""
    c = F.col
    found = found.join(coverage.select(*keys, "coverage"), keys, "left")
    margins = [n for n in ("temp_margin", "pressure_margin") if n in found.columns]
    covered = curves.blank_covers(curves.blank_envelope(c("blank"), *map(c, ("temp_margin", "pressure_margin") if margins else ())), c("temp_lo"), c("temp_hi"), c("p_lo"), c("p_hi"))
    unsteady = (c("position_at_isolation") > limits["closed_band"]) | (c("position_max") > limits["closed_band"]) | (c("position_drift") > limits["drift"])
    codes = F.array_compact(F.array(
        F.when(unsteady, "closed_position_unstable"), F.when(c("dp_median") < limits["min_dp_kpa"], "insufficient_differential_pressure"),
        F.when(c("coverage") < limits["coverage"], "temperature_dropout"), F.when(~covered, "blank_baseline_uncovered"),
    ))
    return found.select(*keys, "position_at_isolation", F.round("position_max", 3).alias("position_max"), F.round("position_drift", 3).alias("position_drift"), "dp_median", "dp_min", F.round("coverage", 3).alias("coverage"), codes.alias("gaps"))


def cross_check(flow: DataFrame, found: DataFrame, keys: list[str], limits: dict[str, float] = LIMITS) -> DataFrame:
    """Mean metered flow in the hold (keys, v at grid points, coverage) against the mass balance; judged from half coverage on."""
    c = F.col
    means = flow.groupBy(*keys).agg(F.avg("v").alias("flow_mean"), F.first("coverage").alias("coverage"))
    both = means.join(found.select(*keys, "rate_mean"), keys).where((c("coverage") >= 0.5) & c("flow_mean").isNotNull())
    balance_ = F.coalesce("rate_mean", F.lit(0.0))
    off = F.abs(c("flow_mean") - balance_) / F.greatest(F.lit(limits["rate"]), F.abs(balance_)) * 100
    return both.select(*keys, F.round("flow_mean", 6).alias("flow_mean"), F.round(off, 2).alias("deviation"), (off <= limits["deviation_pct"]).alias("agrees"))


def exceed_periods(rows: DataFrame, keys: list[str], limit: float = LIMITS["rate"]) -> DataFrame:
    """Stretches of the hold whose windowed rate is over the limit; points without rate end them."""
    return runs.periods_where(rows.where("in_hold"), keys, ["i"], F.col("rate") > limit, "t")


def checks(found: DataFrame, keys: list[str], crossed: DataFrame | None = None, limits: dict[str, float] = LIMITS) -> DataFrame:
    """Balances (and ``crossed``, of :func:`cross_check`) against their limits: keys, metric, value, high, passes; a hold without mean rate fails."""
    c = F.col
    listed = [F.struct(F.lit(m).alias("metric"), c(v).cast("double").alias("value"), F.lit(limits[m]).alias("high")) for m, v in (("rate", "rate_mean"), ("cumulative", "cumulative"))]
    rows = found.select(*keys, F.explode(F.array(*listed)).alias("x")).select(*keys, "x.*")
    rows = rows.withColumn("passes", F.coalesce(c("value") <= c("high"), F.lit(False)))
    if crossed is not None:
        rows = rows.unionByName(crossed.select(*keys, F.lit("deviation_pct").alias("metric"), c("deviation").alias("value"), F.lit(limits["deviation_pct"]).alias("high"), c("agrees").alias("passes")))
    return rows


def analyse(
    grid: DataFrame, actions: DataFrame, tests: DataFrame, coverage: DataFrame | None, keys: list[str],
    flow: DataFrame | None = None, moves: DataFrame | None = None, limits: dict[str, float] = LIMITS,
    blocks: DataFrame | None = None, temperature: DataFrame | None = None, meter: DataFrame | None = None, points: bool = True,
    segs: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Segments, balances, gates, exceedances, checks and verdicts of all tests: gaps first, then failed checks and issues.

    The temperature's coverage of the hold and the metered flow at its grid
    points are given (``coverage``, ``flow``) or taken from the samples
    (``temperature``, ``meter``: keys, idx, t, v).  ``blocks`` (keys, code) are
    gaps found before.  Without ``points`` the hold's points are not written:
    balance and evidence take one pass over them as they are made, exceedances
    and periods make them again.  ``segs`` are held :func:`segments` if they are
    known already.
    """
    c = F.col
    derived = isolation(actions, keys)
    segs = hold(segments(grid, derived, keys, moves, limits), "segments") if segs is None else segs
    rows = hold_rows(grid, segs, tests, keys, limits)
    rows = hold(rows, "rows") if points else rows

    def covered(samples: DataFrame) -> DataFrame:
        held = samples.join(segs.where("i_hold is not null").select(*keys, "t_hold", "t_end"), keys)
        return interp.coverage(held, keys, c("t_hold"), c("t_end")).select(*keys, "coverage")

    if temperature is not None:
        coverage = covered(temperature)
    if meter is not None:
        metered = interp.linear(rows.where("in_hold").select(*keys, "t"), meter, keys, clamp=False)
        flow = metered.join(covered(meter), keys)
    figures = hold(rows.groupBy(*keys).agg(*_balances(), *_evidence(rows), F.bool_or("in_hold").alias("__held")), "figures")
    found = figures.where("__held").select(*keys, "rate_mean", "rate_max", "cumulative", "blank_nl_min", "temp_mean", "hold_s")
    evidence = _judged(figures, keys, coverage, limits)
    crossed = None if flow is None else cross_check(flow, found, keys, limits)
    both = tests.select(*keys).join(derived.select(*keys, "conflicts"), keys, "left").join(segs.select(*keys, c("gaps").alias("g1")), keys, "left")
    both = both.join(evidence.select(*keys, c("gaps").alias("g2")), keys, "left").join(found, keys, "left")
    empty = F.array().cast("array<string>")
    early = F.array_compact(F.array(F.when(c("conflicts") > 0, "isolation_sequence_conflict"), F.when(c("g1").isNull(), "not_isolated")))
    told = F.concat(early, F.coalesce("g1", empty), F.coalesce("g2", empty))
    if blocks is not None:
        both = both.join(blocks.groupBy(*keys).agg(F.collect_set("code").alias("g3")), keys, "left")
        told = F.concat(told, F.coalesce("g3", empty))
    gaps = F.array_sort(F.array_distinct(told))
    failed = c("rate_mean").isNull() | (c("rate_mean") > limits["rate"]) | (c("cumulative") > limits["cumulative"])
    if crossed is not None:
        both = both.join(crossed.select(*keys, "agrees"), keys, "left")
        failed = failed | F.coalesce(~c("agrees"), F.lit(False))
    verdict = F.when(F.size(gaps) > 0, "no_conclusion").when(failed, "fail").otherwise("pass")
    verdicts = both.select(*keys, F.array_join(gaps, ",").alias("gaps"), "rate_mean", "cumulative", verdict.alias("verdict"))
    return {
        "segments": segs, "balance": found, "gates": evidence, "exceedances": first_exceedance(rows, keys, limits), "periods": exceed_periods(rows, keys, limits["rate"]),
        "checks": checks(found, keys, crossed, limits), "verdicts": verdicts,
    }
