"""Partial strokes: boundaries, phases, metrics and evidence gaps on a common grid.

``grid`` has the keys, i, t, command and position; ``specs`` per test start_pct,
direction (open or close), target_pct, max_pct and, where known, permit_t.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.operators import runs, stats

#: Default limits.
LIMITS = {
    "baseline_s": 2.0, "settle_band": 1.0, "settle_dwell_s": 1.0, "command_step": 2.0, "move": 0.5, "move_s": 0.3, "breakaway_delay": 5.0, "reach_tolerance": 0.5,
    "overshoot": 2.0, "speed": 0.5, "hold_drift": 1.0, "return_time": 10.0, "residual": 1.0,
}
PHASES = (("permit", "permit_t", "command_t"), ("stroke", "command_t", "target_t"), ("hold", "target_t", "return_t"), ("return", "return_t", "settled_t"))


def first_where(rows: DataFrame, keys: list[str], rule: Column, name: str) -> DataFrame:
    """``rows`` with the index of the first point of their key at which ``rule`` holds, on every row."""
    return rows.withColumn(name, F.min(F.when(rule, F.col("i"))).over(Window.partitionBy(*keys)))


def sustained(value: Column, least: float, keys: list[str], seconds: float) -> Column:
    """Whether ``value`` stays at or above ``least`` from a point on to ``seconds`` later, both included."""
    ahead = Window.partitionBy(*keys).orderBy("__us").rangeBetween(0, round(seconds * 1e6))
    return F.min(value).over(ahead) >= least


def boundaries(grid: DataFrame, specs: DataFrame, keys: list[str], overrides: DataFrame | None = None, limits: dict[str, float] = LIMITS) -> DataFrame:
    """One row per test: baselines, the times of command, move, target, return and settling, metrics, gaps.

    Every boundary is looked for from the one before on; ``overrides`` (keys,
    boundary, t) put it at the nearest grid point instead.  ``causal`` is false
    if the boundaries don't follow one another.
    """
    c = F.col
    whole = Window.partitionBy(*keys)
    rows = grid.join(specs, keys).withColumn("__us", stats.micros(c("t")))
    rows = rows.withColumn("sign", F.when(c("direction") == "open", 1.0).otherwise(-1.0)).withColumn("t0", F.min("t").over(whole))
    early = c("t") <= c("t0") + limits["baseline_s"] + 1e-9
    base = rows.where(early).groupBy(*keys).agg(stats.lower_median("command").alias("c0"), stats.lower_median("position").alias("p0"))
    rows = rows.join(base, keys)
    if overrides is not None:
        given = overrides.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("boundary", "t"))).alias("__o"))
        rows = rows.join(given, keys, "left")
    else:
        rows = rows.withColumn("__o", F.lit(None).cast("map<string,double>"))
    rows = rows.withColumn("gone", c("sign") * (c("position") - c("p0"))).withColumn("step", c("sign") * (c("command") - c("c0")))

    def place(rows: DataFrame, name: str, rule: Column) -> DataFrame:
        asked = F.try_element_at("__o", F.lit(name))
        near = F.min(F.when(asked.isNotNull(), F.struct(F.abs(c("t") - asked), "i"))).over(whole)["i"]
        return rows.withColumn(f"i_{name}", F.coalesce(near, F.min(F.when(rule, c("i"))).over(whole)))

    rows = place(rows, "command", c("step") >= limits["command_step"])
    rows = rows.withColumn("held", sustained(c("gone"), limits["move"], keys, limits["move_s"]))
    rows = place(rows, "move", (c("i") >= c("i_command")) & c("held"))
    rows = place(rows, "target", (c("i") >= c("i_command")) & (c("gone") >= c("target_pct")))
    after = c("i") >= c("i_command")
    most = F.max(F.when(after, F.struct(c("gone").alias("gone"), (-c("i")).alias("col2")))).over(whole)
    rows = rows.withColumn("i_most", -most["col2"]).withColumn("most", most["gone"])
    rows = place(rows, "return", (c("i") > F.coalesce("i_target", "i_most")) & (c("step") < limits["command_step"]))
    out = F.abs(c("position") - c("p0")) > limits["settle_band"]
    ahead = Window.partitionBy(*keys).orderBy("__us").rangeBetween(0, round(limits["settle_dwell_s"] * 1e6))
    rows = rows.withColumn("calm", F.max(out.cast("int")).over(ahead) == 0)
    rows = place(rows, "settled", (c("i") >= c("i_return")) & c("calm"))
    names = ("command", "move", "target", "return", "settled")
    at = [F.round(F.min(F.when(c("i") == c(f"i_{n}"), c("t"))), 3).alias(f"{n}_t") for n in names]
    inside = c("i").between(c("i_target"), c("i_return"))
    found = rows.groupBy(*keys).agg(
        *at, F.first("permit_t").alias("permit_t"), F.round(F.first("p0"), 4).alias("position_0"), F.round(F.first("c0"), 4).alias("command_0"), F.first("start_pct").alias("start_pct"), F.first("target_pct").alias("target_pct"),
        F.first("max_pct").alias("max_pct"), F.round(F.first("most"), 4).alias("effective_travel"), F.round(F.max(F.when(inside, c("gone"))) - F.min(F.when(inside, c("gone"))), 4).alias("hold_drift"),
        F.round(F.abs(F.max_by("position", "i") - F.first("p0")), 4).alias("residual"), F.max("t").alias("record_end"),
    )
    found = found.withColumn("breakaway_delay", F.round(c("move_t") - c("command_t"), 3)).withColumn("return_time", F.round(c("settled_t") - c("return_t"), 3)).withColumn("total_time", F.round(c("settled_t") - c("command_t"), 3))
    found = found.withColumn("overshoot", F.round(F.greatest(F.lit(0.0), c("effective_travel") - c("target_pct")), 4))
    order = [c("permit_t"), c("command_t"), c("target_t"), c("return_t"), c("settled_t")]
    wrong = [F.coalesce(a > b, F.lit(False)) for k, a in enumerate(order) for b in order[k + 1 :]]
    causal = ~wrong[0]
    for w in wrong[1:]:
        causal = causal & ~w
    gaps = F.array_compact(F.array(
        F.when(c("position_0").isNull() | c("command_0").isNull(), "insufficient_baseline"), F.when(F.abs(c("position_0") - c("start_pct")) > limits["settle_band"] + 1e-9, "start_position_mismatch"), F.when(c("command_t").isNull(), "no_command_step"),
        F.when(c("effective_travel") > c("max_pct") + 1e-9, "travel_over_limit"), F.when(c("command_t").isNotNull() & c("target_t").isNull(), "target_not_reached"), F.when(c("return_t").isNotNull() & c("settled_t").isNull(), "not_settled"),
    ))
    return found.withColumn("causal", causal).withColumn("gaps", gaps)


def checks(found: DataFrame, time_limits: DataFrame, keys: list[str], limits: dict[str, float] = LIMITS) -> DataFrame:
    """Metrics against their limits: keys, metric, value, low, high, passes.

    ``time_limits``: keys, time_limit_s, of the whole stroke.  A missing delay
    or return fails; speed and hold drift are only checked where they are
    known, the return once it has begun, and nothing without a command step.  A
    stroke that doesn't settle counts to the record's end.
    """
    c = F.col
    none = F.lit(None).cast("double")
    speed = F.when(c("target_t") > c("move_t"), F.round(c("target_pct") / (c("target_t") - c("move_t")), 3))
    total = F.round(F.coalesce("settled_t", "record_end") - c("command_t"), 3)
    table = {
        "breakaway_delay": (c("breakaway_delay"), none, F.lit(limits["breakaway_delay"]), F.lit(True)),
        "effective_travel": (c("effective_travel"), F.round(c("target_pct") - limits["reach_tolerance"], 6), none, F.lit(True)),
        "overshoot": (c("overshoot"), none, F.lit(limits["overshoot"]), F.lit(True)),
        "avg_speed": (speed, F.lit(limits["speed"]), none, speed.isNotNull()),
        "hold_drift": (c("hold_drift"), none, F.lit(limits["hold_drift"]), c("hold_drift").isNotNull()),
        "return_time": (c("return_time"), none, F.lit(limits["return_time"]), c("return_t").isNotNull()),
        "residual": (c("residual"), none, F.lit(limits["residual"]), F.lit(True)),
        "total_time": (total, none, c("time_limit_s"), F.lit(True)),
    }
    listed = [F.when(due, F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value"), low.alias("low"), high.cast("double").alias("high"))) for m, (v, low, high, due) in table.items()]
    rows = found.where("command_t is not null").join(time_limits, keys, "left").select(*keys, F.explode(F.array_compact(F.array(*listed))).alias("x")).select(*keys, "x.*")
    fine = F.coalesce(c("value") >= c("low") - 1e-9, c("value") <= c("high") + 1e-9, F.lit(False))
    return rows.withColumn("passes", fine)


def issues(found: DataFrame, keys: list[str]) -> DataFrame:
    """What the stroke did not do: keys, kind."""
    c = F.col
    stepped = c("command_t").isNotNull()
    rules = {
        "no_movement": stepped & c("move_t").isNull(),
        "target_not_reached": c("move_t").isNotNull() & c("target_t").isNull(),
        "return_not_observed": stepped & c("return_t").isNull(),
        "not_settled": c("return_t").isNotNull() & c("settled_t").isNull(),
    }
    return found.select(*keys, F.explode(F.array_compact(F.array(*[F.when(rule, kind) for kind, rule in rules.items()]))).alias("kind"))


def by_hand(grid: DataFrame, specs: DataFrame, keys: list[str], overrides: DataFrame, limits: dict[str, float] = LIMITS) -> tuple[DataFrame, DataFrame]:
    """(boundaries with the manual ones of ``overrides``, tests (keys) whose manual boundaries are refused since they don't follow one another)."""
    found = boundaries(grid, specs, keys, overrides, limits)
    return found.where("causal"), found.where("not causal").select(*keys)


def phases(found: DataFrame, keys: list[str]) -> DataFrame:
    """The four phases between known boundaries: keys, phase, t_start, t_end."""
    listed = [F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(F.lit(n).alias("phase"), F.col(a).alias("t_start"), F.col(b).alias("t_end"))) for n, a, b in PHASES]
    return found.select(*keys, F.explode(F.array_compact(F.array(*listed))).alias("x")).select(*keys, "x.*")


def inactive(bits: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Stretches in the windows (keys, low, high) in which a contact is not 1; null counts as not 1."""
    rows = bits.join(windows, keys).where(F.col("t").between(F.col("low"), F.col("high")))
    return runs.periods_where(rows, keys, ["t", "idx"], ~F.coalesce(F.col("bit") == 1, F.lit(False)), "t")
