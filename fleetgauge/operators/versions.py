"""Append-only analysis versions and comparisons between revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(analyses: DataFrame, key: str = "test_id", version: str = "version") -> DataFrame:
    """The row of the highest version per key."""
    rest = [c for c in analyses.columns if c != key]
    return analyses.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("last")).select(key, "last.*")


def next_version(analyses: DataFrame, key: str = "test_id", version: str = "version") -> DataFrame:
    """The version the next analysis of each key gets."""
    return analyses.groupBy(key).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("next_version"))


def deltas(a: DataFrame, b: DataFrame, keys: list[str], metric: str, better: int) -> DataFrame:
    """Change of ``metric`` from revision a to b by key; ``better`` is the sign of an improvement."""
    left = a.select(*keys, F.col(metric).alias("a"))
    both = left.join(b.select(*keys, F.col(metric).alias("b")), keys, "left")
    change = F.col("b") - F.col("a")
    kind = F.when(change.isNull(), "missing").when(change == 0, "unchanged").when(change * better > 0, "improved").otherwise("degraded")
    return both.withColumn("delta", change).withColumn("change", kind)


def first_overlapping(events: DataFrame, actions: DataFrame, keys: list[str]) -> DataFrame:
    """Per action the device of the first event (by start, then name) that overlaps it, and how many do.

    ``events``: keys, device, t0, t1; ``actions``: keys, action, a0, a1.
    """
    both = actions.join(events, keys).where((F.col("t0") < F.col("a1")) & (F.col("t1") > F.col("a0")))
    return both.groupBy(*keys, "action").agg(F.min_by("device", F.struct("t0", "device")).alias("device"), F.count(F.lit(1)).alias("n"))
