"""Gaps, pulse clusters and slopes over a stream of samples.

The batch operators need a test's whole record; these need only the recent
past, with a watermark for late samples.  Input: test_id, channel, ts
(timestamp), v.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def pulse_sessions(samples: DataFrame, gap: str, late: str) -> DataFrame:
    """Clusters of high samples closer than ``gap``, as session windows."""
    high = samples.where(F.col("v") >= 0.7).withWatermark("ts", late)
    found = high.groupBy("test_id", "channel", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("pulses"))
    return found.select("test_id", "channel", F.col("w.start").alias("start_at"), F.col("w.end").alias("end_at"), "pulses")


def sliding_slopes(samples: DataFrame, width: str, step: str, late: str, least: int = 3) -> DataFrame:
    """Least-squares slope per minute in sliding windows with at least ``least`` samples."""
    windowed = samples.withWatermark("ts", late).groupBy("test_id", "channel", F.window("ts", width, step).alias("w"))
    slope = F.regr_slope("v", F.unix_micros("ts") / F.lit(6e7))
    found = windowed.agg(F.count(F.lit(1)).alias("n"), slope.alias("slope"))
    enough = F.when(F.col("n") >= least, F.col("slope"))
    return found.select("test_id", "channel", F.col("w.start").alias("start_at"), F.col("w.end").alias("end_at"), "n", enough.alias("slope"))


GAPS = "test_id long, channel string, start_at double, end_at double"


def gaps(samples: DataFrame, longest_s: float, late: str) -> DataFrame:
    """Spacings of more than ``longest_s`` seconds within a channel; the state is the last sample's time."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        times = sorted(t for pdf in batches for t in pdf["at"])
        found = []
        for t in times:
            if last is not None and t - last > longest_s:
                found.append((*key, last, t))
            last = t if last is None else max(last, t)
        state.update((last,))
        yield pd.DataFrame(found, columns=["test_id", "channel", "start_at", "end_at"])

    timed = samples.withWatermark("ts", late).withColumn("at", F.unix_micros("ts") / F.lit(1e6))
    grouped = timed.select("test_id", "channel", "at").groupBy("test_id", "channel")
    return grouped.applyInPandasWithState(run, GAPS, "last double", "append", GroupStateTimeout.NoTimeout)
