"""Stroke records on a common grid: command segments, travel, holds and balances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.operators import intervals, runs


def _along(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("i")


def segments(grid: DataFrame, keys: list[str], command: str, rows_ahead: int, threshold: float) -> DataFrame:
    """Maximal stretches of one command direction: keys, run, direction, i_start, i_end, t_start, t_end, target.

    The direction is the sign of the slope over the next ``rows_ahead`` grid
    points beyond ``threshold``; the target is the command at the start of the
    following segment, for the last one the command at its end.
    """
    ahead = _along(keys).rowsBetween(0, rows_ahead)
    c, t = F.last(command).over(ahead) - F.col(command), F.last("t").over(ahead) - F.col("t")
    slope = F.when(t > 0, c / t).otherwise(0.0)
    rows = grid.withColumn("__slope", slope)
    sign = F.when(F.col("__slope") > threshold, 1).when(F.col("__slope") < -threshold, -1).otherwise(0)
    rows = runs.mark_runs(rows.withColumn("direction", sign), keys, ["i"], F.col("direction"))
    found = rows.groupBy(*keys, "run").agg(
        F.first("direction").alias("direction"), F.min("i").alias("i_start"), F.max("i").alias("i_end"),
        F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.min_by(command, "i").alias("c_start"), F.max_by(command, "i").alias("c_end"),
    )
    following = F.lead("c_start").over(Window.partitionBy(*keys).orderBy("run"))
    return found.withColumn("target", F.coalesce(following, F.col("c_end"))).drop("c_start", "c_end")


def travel(grid: DataFrame, segs: DataFrame, keys: list[str], position: str, band: float) -> DataFrame:
    """Per motion segment the first time, up to the end of the next segment, at which the position is within ``band`` of the target; null if there is none."""
    ordered = Window.partitionBy(*keys).orderBy("run")
    reach = segs.withColumn("i_last", F.coalesce(F.lead("i_end").over(ordered), F.col("i_end"))).where("direction <> 0")
    points = grid.select(*keys, F.col("i").alias("__i"), F.col("t").alias("__t"), F.col(position).alias("__p"))
    both = intervals.points_within(points, reach, keys, "__i", "i_start", "i_last")
    reached = F.min(F.when(F.abs(F.col("__p") - F.col("target")) <= band, F.col("__t")))
    found = both.groupBy(*keys, "run", "direction").agg(F.max("t_start").alias("t_start"), F.max("t_end").alias("t_end"), reached.alias("reached_at"))
    response = F.col("reached_at") - F.col("t_start")
    return found.withColumn("total_response", response).withColumn("travel", F.when(F.col("reached_at").isNotNull(), F.greatest(F.lit(0.0), F.col("reached_at") - F.col("t_end"))))


def hold_start(grid: DataFrame, keys: list[str], slope: Column, calm: float, never: float) -> DataFrame:
    """Per key the first grid point whose slope is within ``calm`` while no later one leaves ``never``."""
    rows = grid.withColumn("__slope", F.abs(slope))
    back = Window.partitionBy(*keys).orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__worst", F.max("__slope").over(back))
    return rows.groupBy(*keys).agg(F.min(F.when((F.col("__slope") <= calm) & (F.col("__worst") <= never), F.col("i"))).alias("hold_i"))


def sustained_from(grid: DataFrame, keys: list[str], value: Column, least: float, rows_ahead: int) -> DataFrame:
    """Per key the first grid point from which ``value`` stays at or above ``least`` over the next rows."""
    ahead = _along(keys).rowsBetween(0, rows_ahead)
    rows = grid.withColumn("__value", value).withColumn("__low", F.min("__value").over(ahead)).withColumn("__n", F.count(F.lit(1)).over(ahead))
    held = (F.col("__low") >= least) & (F.col("__n") == rows_ahead + 1)
    return rows.groupBy(*keys).agg(F.min(F.when(held, F.col("i"))).alias("sustained_i"))


def balance(grid: DataFrame, keys: list[str], volume: Column, blank_per_min: float) -> DataFrame:
    """Slope per minute and total change of a gas inventory less the blank rate since the start."""
    start = F.min("t").over(Window.partitionBy(*keys))
    rows = grid.withColumn("__min", (F.col("t") - start) / 60).withColumn("__y", volume - F.lit(blank_per_min) * F.col("__min"))
    slope = F.when(F.max("__min") > F.min("__min"), F.regr_slope("__y", "__min"))
    total = F.max_by("__y", "i") - F.min_by("__y", "i")
    return rows.groupBy(*keys).agg(slope.alias("rate"), total.alias("total"))


def verdicts_of(tests: DataFrame, blocked: Column, rules: dict[str, Column]) -> DataFrame:
    """``tests`` with the codes of the rules that hold (comma-joined) and the verdict."""
    codes = F.array_join(F.array_compact(F.array(*[F.when(rule, code) for code, rule in rules.items()])), ",")
    rows = tests.withColumn("issues", codes)
    verdict = F.when(blocked, "no_conclusion").when(F.col("issues") != "", "exceedances").otherwise("ok")
    return rows.withColumn("verdict", verdict)
