"""Runs of equal values, clusters of runs, and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mark_runs(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str = "run") -> DataFrame:
    """``rows`` with the number of the maximal run of equal ``value`` each lies in (null equals null)."""
    ordered = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag("__value").over(ordered)
    first = F.row_number().over(ordered) == 1
    new = (first | ~F.col("__value").eqNullSafe(before)).cast("int")
    marked = rows.withColumn("__value", value).withColumn("__new", new)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn(name, F.sum("__new").over(so_far)).drop("__value", "__new")


def run_lengths(rows: DataFrame, keys: list[str], order: list[str], value: str, at: str) -> DataFrame:
    """One row per run: keys, run, value, start and end of ``at``, n."""
    marked = mark_runs(rows, keys, order, F.col(value))
    return marked.groupBy(*keys, "run").agg(
        F.first(value).alias(value), F.min(at).alias("start_at"), F.max(at).alias("end_at"), F.count(F.lit(1)).alias("n")
    )


def merge_short(runs: DataFrame, keys: list[str], value: str, short: Column) -> DataFrame:
    """Short runs take the value of the run before (the first ones of the run after), then equal neighbours join.

    ``runs`` has run, start_at, end_at; n is summed.
    """
    ordered = Window.partitionBy(*keys).orderBy("run")
    kept = runs.withColumn("__keep", F.when(~short, F.col(value)))
    back = F.last("__keep", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    # In descending order the frame grows, so each row costs one step.
    falling = Window.partitionBy(*keys).orderBy(F.col("run").desc())
    ahead = F.last("__keep", ignorenulls=True).over(falling.rowsBetween(Window.unboundedPreceding, 0))
    relabelled = kept.withColumn(value, F.coalesce(back, ahead, F.col(value))).drop("__keep")
    marked = mark_runs(relabelled, keys, ["run"], F.col(value), "merged")
    return marked.groupBy(*keys, "merged").agg(
        F.first(value).alias(value), F.min("start_at").alias("start_at"), F.max("end_at").alias("end_at"), F.sum("n").alias("n")
    )


def cluster_by_gap(intervals: DataFrame, keys: list[str], start: str, end: str, gap: float) -> DataFrame:
    """One row per cluster of intervals whose gaps, from the latest end so far to the next start, are at most ``gap``."""
    ordered = Window.partitionBy(*keys).orderBy(start, end)
    latest = F.max(end).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col(start) - latest <= gap, 0).otherwise(1)
    marked = intervals.withColumn("__new", new)
    marked = marked.withColumn("cluster", F.sum("__new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "cluster").agg(F.min(start).alias("start_at"), F.max(end).alias("end_at"), F.count(F.lit(1)).alias("pulses"))


def periods_where(rows: DataFrame, keys: list[str], order: list[str], over: Column, at: str, *aggs: Column) -> DataFrame:
    """Contiguous stretches in which ``over`` holds: keys, start_at, end_at, n and ``aggs``."""
    flagged = rows.withColumn("__over", F.coalesce(over, F.lit(False)))
    marked = mark_runs(flagged, keys, order, F.col("__over")).where("__over")
    found = marked.groupBy(*keys, "run").agg(F.min(at).alias("start_at"), F.max(at).alias("end_at"), F.count(F.lit(1)).alias("n"), *aggs)
    return found.drop("run")


def longest(stretches: DataFrame, keys: list[str], length: str = "n", start: str = "start_at") -> DataFrame:
    """Per key the longest stretch, of equal ones the first."""
    best = F.max_by(F.struct(*[c for c in stretches.columns if c not in keys]), F.struct(F.col(length), -F.col(start)))
    return stretches.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.*")


def forward_fill(rows: DataFrame, keys: list[str], order: list[str], value: str, initial: Column) -> DataFrame:
    """``value`` with nulls replaced by the last value before, ``initial`` before the first."""
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(so_far), initial))


def dropouts(samples: DataFrame, keys: list[str], gap_factor: float = 3.0, frozen_min: int = 5, unchecked: tuple[str, ...] = ("command",)) -> DataFrame:
    """Gaps and frozen stretches of every channel: keys, channel, kind, start_at, end_at.

    A gap is a spacing of more than ``gap_factor`` times the channel's upper
    median; frozen are ``frozen_min`` or more exactly equal values in a row,
    except in the ``unchecked`` channels, whose plateaus are meant.
    """
    of = [*keys, "channel"]
    along = Window.partitionBy(*of).orderBy("t", "idx")
    spaced = samples.withColumn("before", F.lag("t").over(along)).withColumn("dt", F.col("t") - F.col("before"))
    # The median is put on each spacing by a window: no sample is made twice or moves to meet it.
    median = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY dt DESC)").over(Window.partitionBy(*of))
    wide = spaced.withColumn("median", F.coalesce(median, F.lit(1.0))).where(F.col("dt") > gap_factor * F.col("median"))
    gaps = wide.select(*of, F.lit("gap").alias("kind"), F.col("before").alias("start_at"), F.col("t").alias("end_at"))
    still = run_lengths(samples.where(~F.col("channel").isin(*unchecked)), of, ["t", "idx"], "v", "t").where(F.col("n") >= frozen_min)
    return gaps.unionByName(still.select(*of, F.lit("frozen").alias("kind"), "start_at", "end_at"))


def blocked_contacts(samples: DataFrame, keys: list[str], level: Column) -> DataFrame:
    """(keys, n_illegal) of contacts with any value that is neither level: evidence that can't be judged."""
    rows = samples.withColumn("__level", level)
    return rows.groupBy(*keys).agg(F.count_if(F.col("__level").isNull()).alias("n_illegal")).where("n_illegal > 0")
