"""Comparison of analyses: compatibility with a reference, trends and drifts of metrics, roll-up.

``items`` has one row per analysis: group (what is compared), id, ts, and the
columns that the rules look at.  The earliest item of a group is its reference.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.functions import verdicts

Rule = Callable[[Column, Callable[[str], Column]], Column]


def same(name: str) -> Rule:
    """Whether a column differs from the reference's; null equals null."""
    return lambda ref, mine: ~mine(name).eqNullSafe(ref[name])


def within(name: str, tolerance: float) -> Rule:
    """Whether a column is off the reference's by more than ``tolerance``; a missing one on one side only counts too."""
    return lambda ref, mine: F.coalesce(F.abs(mine(name) - ref[name]) > tolerance, mine(name).isNull() != ref[name].isNull())


def within_share(name: str, share: float) -> Rule:
    """As :func:`within`, relative to the reference's value."""
    return lambda ref, mine: F.coalesce(F.abs(mine(name) - ref[name]) > share * F.abs(ref[name]), mine(name).isNull() != ref[name].isNull())


#: What must agree, by kind of test: reason -> rule.
FAILSAFE: dict[str, Rule] = {
    **{n: same(n) for n in ("load", "medium", "actuator_type", "thresholds")},
    "supply_pressure_kpa": within_share("supply_pressure_kpa", 0.10), "ambient_temp_c": within("ambient_temp_c", 5.0), "window_s": within_share("window_s", 0.10),
}
SEAT: dict[str, Rule] = {
    **{n: same(n) for n in ("valve_id", "gas", "flow_direction", "seat")}, "molar_mass": within("molar_mass", 0.5), "differential_kpa": within_share("differential_kpa", 0.10),
}
THRUST: dict[str, Rule] = {
    **{n: same(n) for n in ("actuator_type", "stem_direction", "spring_version", "load", "medium")}, "area_a": within_share("area_a", 0.02), "area_b": within_share("area_b", 0.02),
}
FLOW: dict[str, Rule] = {
    **{n: same(n) for n in ("trim", "fluid", "flow_direction", "meter", "nameplate")}, "density": within("density", 0.5), "vapor_pressure": within("vapor_pressure", 5.0),
}
SWITCH: dict[str, Rule] = {n: same(n) for n in ("channel_map", "polarity", "debounce_s", "mutual_exclusion", "windows", "thresholds")}
PARTIAL: dict[str, Rule] = {n: same(n) for n in ("trim", "start_pct", "direction", "target_pct")}


def compatible(items: DataFrame, group: str, rules: dict[str, Rule], blocked: Column | None = None) -> DataFrame:
    """``items`` with reasons (array, empty for the reference) and comparable.

    ``blocked`` says that an item has no conclusion; it is not comparable
    whatever its conditions, but may be the reference.
    """
    first = Window.partitionBy(group).orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = items.withColumn("__ref", F.first(F.struct(*items.columns)).over(first))
    reasons = F.array_compact(F.array(*[F.when(rule(F.col("__ref"), F.col), name) for name, rule in rules.items()]))
    if blocked is not None:
        reasons = F.concat(F.when(blocked, F.array(F.lit("no_conclusion"))).otherwise(F.array().cast("array<string>")), reasons)
    return rows.withColumn("reasons", reasons).withColumn("comparable", F.size("reasons") == 0).drop("__ref")


def pair_reasons(pairs: DataFrame) -> DataFrame:
    """Pre and post strokes (prefixes pre_, post_: verdict, accepted, directions, span) with the reasons against comparing them."""
    c = F.col
    both = F.array(F.lit("opening"), F.lit("closing"))
    reasons = F.array_compact(F.array(
        F.when(c("pre_verdict") == "no_conclusion", "pre_no_conclusion"), F.when(c("post_verdict") == "no_conclusion", "post_no_conclusion"),
        F.when(~c("pre_accepted"), "pre_chain_rejected"), F.when(~c("post_accepted"), "post_chain_rejected"),
        F.when(F.size(F.array_except(both, c("pre_directions"))) + F.size(F.array_except(both, c("post_directions"))) > 0, "direction_missing"),
        F.when(F.abs(c("pre_span") - c("post_span")) > 5.0, "command_span"),
    ))
    return pairs.withColumn("reasons", reasons)


def pair_deltas(pre: DataFrame, post: DataFrame, keys: list[str], limits: DataFrame) -> DataFrame:
    """Per metric (keys, metric, value on both sides; limits: metric, limit) delta pre - post, improved, within_threshold, still_exceeding."""
    c = F.col
    both = pre.select(*keys, "metric", c("value").alias("pre")).join(post.select(*keys, "metric", c("value").alias("post")), [*keys, "metric"], "full_outer").join(F.broadcast(limits), "metric")
    delta = c("pre") - c("post")
    return both.select(*keys, "metric", "pre", "post", F.round(delta, 4).alias("delta"), (delta > 0).alias("improved"), (c("post") <= c("limit")).alias("within_threshold"), F.coalesce(c("post") > c("limit"), F.lit(False)).alias("still_exceeding"))


def trends(values: DataFrame, group: str, specs: DataFrame) -> DataFrame:
    """Per group and metric the class of the change from its first to its last value.

    ``values``: group, id, ts, metric, value; ``specs`` (a small table):
    metric, worse (1, -1 or 0), rel_tol, abs_tol.
    """
    c = F.col
    some = values.where("value is not null").groupBy(group, "metric")
    ends = some.agg(F.min_by("value", F.struct("ts", "id")).alias("first"), F.max_by("value", F.struct("ts", "id")).alias("last"), F.count(F.lit(1)).alias("n"))
    rows = values.select(group).distinct().crossJoin(F.broadcast(specs)).join(ends, [group, "metric"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    change = (c("last") - c("first")) * c("worse")
    limit = F.greatest("abs_tol", c("rel_tol") * F.abs("first"))
    state = F.when(c("n") < 2, "inconclusive").when(change > limit, "degrading").when(change < -limit, "improving").otherwise("stable")
    return rows.select(group, "metric", "first", "last", "n", state.alias("trend"))


def drifts(values: DataFrame, group: str, metric: str, abs_tol: float) -> DataFrame:
    """Per group whether a metric has shifted by more than ``abs_tol`` either way."""
    rows = values.where((F.col("metric") == metric) & F.col("value").isNotNull()).groupBy(group)
    ends = rows.agg(F.min_by("value", F.struct("ts", "id")).alias("first"), F.max_by("value", F.struct("ts", "id")).alias("last"), F.count(F.lit(1)).alias("n"))
    state = F.when(F.col("n") < 2, "inconclusive").when(F.abs(F.col("last") - F.col("first")) > abs_tol, "shifted").otherwise("stable")
    return ends.select(group, "first", "last", "n", state.alias("trend"))


def roll_up(items: DataFrame, classes: DataFrame, group: str) -> DataFrame:
    """Per group the overall class: inconclusive with fewer than two comparable items, degrading with any degrading or shifted metric."""
    n = items.groupBy(group).agg(F.count_if("comparable").alias("n_comparable"))
    listed = classes.groupBy(group).agg(F.collect_list(F.when(F.col("trend") == "shifted", "degrading").otherwise(F.col("trend"))).alias("c"))
    has = lambda x: F.array_contains("c", x)
    calm = F.forall("c", lambda x: x.isin("stable", "inconclusive"))
    state = F.when(F.col("n_comparable") < 2, "inconclusive").when(has("degrading"), "degrading").when(F.coalesce(calm, F.lit(True)), "stable").when(has("improving"), "improving").otherwise("mixed")
    return n.join(listed, group, "left").select(group, "n_comparable", state.alias("overall"))


def analyse(items: DataFrame, values: DataFrame, group: str, rules: dict[str, Rule], specs: DataFrame, blocked: Column | None = None) -> dict[str, DataFrame]:
    """Compatibility, trends of the comparable items and their roll-up."""
    judged = compatible(items, group, rules, blocked)
    used = values.join(judged.where("comparable").select(group, "id"), [group, "id"], "left_semi")
    classes = trends(used, group, specs)
    return {"items": judged, "trends": classes, "overall": roll_up(judged, classes, group)}


def interval_differences(pre: DataFrame, post: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals (keys, metric, low, high) of pre less post, and whether that is an improvement."""
    a = pre.select(*keys, "metric", F.col("low").alias("a0"), F.col("high").alias("a1"))
    both = a.join(post.select(*keys, "metric", F.col("low").alias("b0"), F.col("high").alias("b1")), [*keys, "metric"])
    low, high, state = verdicts.difference(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1"))
    return both.select(*keys, "metric", F.round(low, 4).alias("low"), F.round(high, 4).alias("high"), state.alias("state"))
