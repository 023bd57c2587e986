"""Resampling, step-hold and nearest lookups, as unions with windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.operators.stats import upper_median


def grid_of(samples: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    """Common grid per test over the time all channels cover: keys, i, t, step.

    The step is the least upper-median spacing of the channels, clamped to
    ``[low, high]``; tests whose channels don't overlap give no rows.
    """
    ordered = Window.partitionBy(*keys, "channel").orderBy("t", "idx")
    spaced = samples.withColumn("dt", F.col("t") - F.lag("t").over(ordered))
    channels = spaced.groupBy(*keys, "channel").agg(F.min("t").alias("first"), F.max("t").alias("last"), upper_median("dt").alias("dt"))
    step = F.least(F.greatest(F.min(F.coalesce("dt", F.lit(1.0))), F.lit(low)), F.lit(high))
    spans = channels.groupBy(*keys).agg(F.max("first").alias("t0"), F.min("last").alias("t1"), step.alias("step"))
    spans = spans.where("t1 > t0")
    n = F.floor((F.col("t1") - F.col("t0")) / F.col("step"))
    points = spans.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), n)))
    return points.select(*keys, "i", (F.col("t0") + F.col("i") * F.col("step")).alias("t"), "step")


def _around(points: DataFrame, samples: DataFrame, keys: list[str], carry: list[str]) -> DataFrame:
    """``points`` (keys, t, ...) with the sample at or before (``p_``) and at or after (``n_``) each."""
    kept = [c for c in points.columns if c not in (*keys, "t")]
    value = F.struct("t", *carry)
    known = samples.select(*keys, "t", value.alias("__s"), F.lit(0).alias("__kind"), *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in kept], F.col("idx").alias("__idx"))
    asked = points.select(*keys, "t", F.lit(None).cast(known.schema["__s"].dataType).alias("__s"), F.lit(1).alias("__kind"), *kept, F.lit(None).cast("long").alias("__idx"))
    both = known.withColumn("__idx", F.col("__idx").cast("long")).unionByName(asked)
    up = Window.partitionBy(*keys).orderBy("t", "__kind", "__idx").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys).orderBy(F.col("t").desc(), "__kind", F.col("__idx").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("p", F.last("__s", ignorenulls=True).over(up)).withColumn("n", F.last("__s", ignorenulls=True).over(down))
    return found.where("__kind = 1").select(*keys, "t", *kept, "p", "n")


def linear(points: DataFrame, samples: DataFrame, keys: list[str], clamp: bool = True) -> DataFrame:
    """``points`` with ``v``: interpolated between samples; outside of them the end value, or null without ``clamp``."""
    found = _around(points, samples, keys, ["v"])
    span = F.col("n.t") - F.col("p.t")
    between = F.when(span > 0, F.col("p.v") + (F.col("n.v") - F.col("p.v")) * (F.col("t") - F.col("p.t")) / span).otherwise(F.col("p.v"))
    both = F.col("p").isNotNull() & F.col("n").isNotNull()
    v = F.when(both, between)
    if clamp:
        v = F.coalesce(v, F.col("p.v"), F.col("n.v"))
    return found.withColumn("v", v).drop("p", "n")


def step_hold(points: DataFrame, samples: DataFrame, keys: list[str], carry: list[str]) -> DataFrame:
    """``points`` with the last sample at or before each; before the first sample, the first one."""
    found = _around(points, samples, keys, carry)
    held = F.coalesce("p", "n")
    return found.withColumn("held", held).drop("p", "n")


def nearest(points: DataFrame, samples: DataFrame, keys: list[str]) -> DataFrame:
    """``points`` with the nearest sample's idx, t and v; of equally near ones the earlier."""
    found = _around(points, samples, keys, ["idx", "v"])
    before, after = F.col("t") - F.col("p.t"), F.col("n.t") - F.col("t")
    near = F.when(F.col("p").isNull() | (after < before), F.col("n")).otherwise(F.col("p"))
    return found.withColumn("near", F.when(F.col("n").isNull(), F.col("p")).otherwise(near)).drop("p", "n")


def nearest_of_few(points: DataFrame, samples: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`nearest` for a few points a key, as manual moves are: they go to the samples, which stay where they lie.

    A key without samples gives no row.
    """
    c = F.col
    kept = [x for x in points.columns if x not in keys]
    few = points.groupBy(*keys).agg(F.collect_list(F.struct(*kept)).alias("__few"))
    both = samples.select(*keys, F.struct("t", "idx", "v").alias("__s")).join(few, keys).select(*keys, "__s", F.explode("__few").alias("__p"))
    near = F.min(F.struct(F.abs(c("__s.t") - c("__p.t")).alias("off"), "__s"))["__s"]
    return both.groupBy(*keys, "__p").agg(near.alias("near")).select(*keys, *[c(f"__p.{x}").alias(x) for x in kept], "near")


def align(samples: DataFrame, channels: list[str], low: float = 0.02, high: float = 1.0, keys: list[str] | None = None) -> DataFrame:
    """Wide table of all ``channels`` on their common grid: keys (by default test_id), i, t, one column per channel."""
    keys = keys or ["test_id"]
    wanted = samples.where(F.col("channel").isin(channels))
    has_all = wanted.groupBy(*keys).agg(F.countDistinct("channel").alias("n")).where(F.col("n") == len(channels))
    wanted = wanted.join(has_all.select(*keys), keys, "left_semi")
    grid = grid_of(wanted, keys, low, high)
    each = grid.withColumn("channel", F.explode(F.array(*[F.lit(c) for c in channels])))
    filled = linear(each.select(*keys, "channel", "t", "i"), wanted, [*keys, "channel"])
    pivoted = [F.max(F.when(F.col("channel") == c, F.col("v"))).alias(c) for c in channels]
    return filled.groupBy(*keys, "i").agg(F.max("t").alias("t"), *pivoted)


def coverage(samples: DataFrame, keys: list[str], low: Column, high: Column) -> DataFrame:
    """Share of the samples expected in ``[low, high)`` that are there, at most 1.

    Expected is the window over the lower median of the positive spacings.
    """
    ordered = Window.partitionBy(*keys).orderBy("t", "idx")
    dt = F.col("t") - F.lag("t").over(ordered)
    spaced = samples.withColumn("dt", F.when(dt > 0, dt))
    inside = (F.col("t") >= low) & (F.col("t") < high)
    counted = spaced.groupBy(*keys).agg(
        F.sum(inside.cast("int")).alias("n"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY dt)").alias("dt_median"), (F.max(high) - F.max(low)).alias("width")
    )
    expected = F.greatest(F.lit(1.0), F.col("width") / F.col("dt_median"))
    return counted.select(*keys, "n", F.least(F.lit(1.0), F.col("n") / expected).alias("coverage"))
