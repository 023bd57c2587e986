"""Manual exclusions: index ranges applied one after another, and time windows to ignore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.operators import intervals


def apply_ranges(samples: DataFrame, exclusions: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept samples, removed samples with reason).

    ``exclusions``: keys, seq, low, high (inclusive), reason.  Each range goes
    by the positions left after the ranges before it; a sample's position is
    followed through them, so no sort is needed.  ``samples`` has idx 0, 1, ...
    """
    listed = exclusions.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", F.greatest("low", F.lit(0)).alias("low"), "high", "reason"))).alias("__e"))
    rows = samples.join(listed, keys, "left")
    start = F.struct(F.col("idx").cast("long").alias("at"), F.lit(None).cast("string").alias("reason"))

    def step(s: Column, e: Column) -> Column:
        hit = s["at"].between(e["low"], e["high"])
        after = s["at"] - F.greatest(e["high"] - e["low"] + 1, F.lit(0))
        at = F.when(hit, None).when(s["at"] > e["high"], after).otherwise(s["at"])
        return F.struct(at.cast("long").alias("at"), F.when(hit, e["reason"]).otherwise(s["reason"]).alias("reason"))

    where = F.when(F.col("__e").isNull(), start).otherwise(F.aggregate("__e", start, step))
    rows = rows.withColumn("__w", where).drop("__e")
    kept = rows.where("__w.at is not null").withColumn("new_idx", F.col("__w.at")).drop("__w")
    removed = rows.where("__w.at is null").withColumn("reason", F.col("__w.reason")).drop("__w")
    return kept, removed


def outside_windows(intervals_: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals (start_at, end_at) that touch none of the windows (low, high) of their key."""
    return intervals.untouched(intervals_, windows, keys, F.col("start_at"), F.col("end_at"))
