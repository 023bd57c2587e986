"""Discrete contacts: levels, debounced intervals, window entries and local direction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.functions import units
from fleetgauge.operators import runs


def bits_of(samples: DataFrame, level: Column, kind: Column) -> DataFrame:
    """``samples`` with ``bit``: 0, 1 or null for a level that is neither, inverted for kind ``nc``."""
    return samples.withColumn("bit", units.polarity(units.contact_level(level), kind))


def illegal_runs(bits: DataFrame, keys: list[str], kept: int = 8) -> DataFrame:
    """Contiguous samples without a legal level, with the first ``kept`` of their values."""
    ordered = F.array_sort(F.collect_list(F.struct("t", "idx", "v")))
    first = F.transform(F.slice(ordered, 1, kept), lambda x: x["v"])
    return runs.periods_where(bits, keys, ["t", "idx"], F.col("bit").isNull(), "t", first.alias("first_values"))


def active_runs(bits: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of 1: keys, start_at, end_at, n, active_until (next legal sample), released (that sample is 0)."""
    # In descending order the frame grows, so each row costs one step.
    later = Window.partitionBy(*keys).orderBy(F.col("t").desc(), F.col("idx").desc()).rowsBetween(Window.unboundedPreceding, -1)
    following = F.last(F.when(F.col("bit").isNotNull(), F.struct("t", "bit")), ignorenulls=True).over(later)
    last = F.max_by("__next", F.struct("t", "idx"))
    found = runs.periods_where(bits.withColumn("__next", following), keys, ["t", "idx"], F.col("bit") == 1, "t", last.alias("next"))
    return found.select(*keys, "start_at", "end_at", "n", F.col("next.t").alias("active_until"), (F.col("next.bit") == 0).alias("released"))


def debounced(bits: DataFrame, keys: list[str], debounce_s: float) -> DataFrame:
    """Active runs joined over gaps of at most ``debounce_s``: several are chatter, a lone shorter one is a glitch."""
    found = runs.cluster_by_gap(active_runs(bits, keys), keys, "start_at", "end_at", debounce_s)
    lone = (F.col("pulses") == 1) & (F.col("end_at") - F.col("start_at") < debounce_s)
    return found.withColumn("kind", F.when(F.col("pulses") > 1, "chatter").when(lone, "glitch").otherwise("stable"))


def window_entries(samples: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    """Stays of ``v`` in ``[low, high]``: keys, start_at, end_at, n, dwell, from_below (null at the start of the record)."""
    before = F.lag("v").over(Window.partitionBy(*keys).orderBy("t", "idx"))
    rows = samples.withColumn("__below", before < low)
    came = F.min_by("__below", F.struct("t", "idx"))
    found = runs.periods_where(rows, keys, ["t", "idx"], F.col("v").between(low, high), "t", came.alias("from_below"))
    return found.withColumn("dwell", F.col("end_at") - F.col("start_at"))


def local_slopes(edges: DataFrame, samples: DataFrame, keys: list[str], half_us: int, flat: float) -> DataFrame:
    """``edges`` (keys, us, edge) with the slope of the samples around them per day and its sign.

    Edges and samples go through one window over their union, so no pairs are
    made; slopes within ``flat`` have sign 0.
    """
    known = samples.select(*keys, "us", "v", F.lit(None).cast(edges.schema["edge"].dataType).alias("edge"))
    asked = edges.select(*keys, "us", F.lit(None).cast("double").alias("v"), "edge")
    frame = Window.partitionBy(*keys).orderBy("us").rangeBetween(-half_us, half_us)
    rows = known.unionByName(asked)
    day = (F.col("us") - F.min("us").over(Window.partitionBy(*keys))) / F.lit(86.4e9)
    rows = rows.withColumn("__x", F.when(F.col("v").isNotNull(), day))
    varies = F.max("__x").over(frame) > F.min("__x").over(frame)
    rows = rows.withColumn("slope", F.when(varies, F.regr_slope("v", "__x").over(frame))).where("edge is not null")
    sign = F.when(F.col("slope") > flat, 1).when(F.col("slope") < -flat, -1).when(F.col("slope").isNotNull(), 0)
    return rows.select(*keys, "us", "edge", "slope", sign.alias("direction"))
