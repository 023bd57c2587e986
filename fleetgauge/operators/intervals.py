"""Joins of intervals and points, always within an equal key and a common slice of the axis.

A slice has about the mean length of the intervals, and each interval is listed
once in every slice that it touches.  So long records with many intervals don't
pair everything with everything.  Anti-joins need no pairs at all: one sort tells
how far the intervals reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _slices(ranges: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """Per key the width of a slice: the mean length of its intervals, at least a ten-thousandth of their span."""
    span = (F.max(high) - F.min(low)) / 10000
    width = F.greatest(F.avg(F.col(high) - F.col(low)), span, F.lit(1e-6))
    return ranges.groupBy(*keys).agg(width.cast("double").alias("__width"), F.min(low).alias("__first"), F.max(high).alias("__last"))


def _slice(at: str | Column) -> Column:
    return F.floor((F.col(at) if isinstance(at, str) else at) / F.col("__width"))


def points_within(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, low: str, high: str) -> DataFrame:
    """Pairs of a point and an interval with ``at`` in ``[low, high]``, with the columns of both."""
    width = _slices(ranges, keys, low, high)
    listed = ranges.join(width, keys).withColumn("__slice", F.explode(F.sequence(_slice(low), _slice(high)))).drop("__width", "__first", "__last")
    placed = points.join(width, keys).withColumn("__slice", _slice(at)).drop("__width", "__first", "__last")
    return placed.join(listed, [*keys, "__slice"]).where(F.col(at).between(F.col(low), F.col(high))).drop("__slice")


def overlaps(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of intervals (start_at, end_at) with a common part of positive length, and that length.

    Columns of ``b`` besides the keys get the prefix ``b_``.  A pair meets in
    all slices it shares and is taken in the first of them.
    """
    other = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in keys])
    width = _slices(a, keys, "start_at", "end_at")
    left = a.where("end_at > start_at").join(width, keys).withColumn("__slice", F.explode(F.sequence(_slice("start_at"), _slice("end_at"))))
    right = other.join(width, keys).where("b_end_at > b_start_at and b_end_at > __first and b_start_at < __last")
    touched = F.sequence(_slice(F.greatest("b_start_at", "__first")), _slice(F.least("b_end_at", "__last")))
    right = right.withColumn("__slice", F.explode(touched)).drop("__width", "__first", "__last")
    both = left.join(right, [*keys, "__slice"]).where((F.col("b_start_at") < F.col("end_at")) & (F.col("b_end_at") > F.col("start_at")))
    both = both.where(F.col("__slice") == _slice(F.greatest("start_at", "b_start_at"))).drop("__slice", "__width", "__first", "__last")
    return both.withColumn("overlap", F.least("end_at", "b_end_at") - F.greatest("start_at", "b_start_at"))


def overlap_share(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Per interval of ``a`` the share of it that intervals of ``b`` cover (0 where none does); repeated intervals stay apart."""
    each = a.select(*keys, "start_at", "end_at").distinct()
    covered = overlaps(each, b, keys).groupBy(*keys, "start_at", "end_at").agg(F.sum("overlap").alias("covered"))
    found = a.join(covered, [*keys, "start_at", "end_at"], "left").withColumn("covered", F.coalesce("covered", F.lit(0.0)))
    length = F.col("end_at") - F.col("start_at")
    return found.withColumn("share", F.when(length > 0, F.col("covered") / length))


def untouched(rows: DataFrame, ranges: DataFrame, keys: list[str], start: Column, end: Column) -> DataFrame:
    """``rows`` whose ``[start, end]`` has no point in common with any of the inclusive ranges (low, high) of their key.

    One sort per key: of the ranges that begin up to a row's end, the farthest
    end so far says whether one reaches its start; no pairs are made.
    """
    asked = rows.select(*keys, F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("__row"), end.alias("__at"), start.alias("__from"), F.lit(1).alias("__kind"), F.lit(None).alias("__reach"))
    kind = rows.schema
    known = ranges.select(*keys, F.lit(None).cast(kind).alias("__row"), F.col("low").alias("__at"), F.lit(None).alias("__from"), F.lit(0).alias("__kind"), F.col("high").alias("__reach"))
    so_far = Window.partitionBy(*keys).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    both = asked.unionByName(known.where("__at is not null")).withColumn("__reach", F.max("__reach").over(so_far))
    free = F.coalesce(F.col("__reach") < F.col("__from"), F.lit(True))
    return both.where((F.col("__kind") == 1) & free).select("__row.*")


def outside(rows: DataFrame, ranges: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rows`` whose ``value`` lies in none of the inclusive ranges (low, high) of their key."""
    return untouched(rows, ranges, keys, F.col(value), F.col(value))


def without_match(points: DataFrame, others: DataFrame, keys: list[str], at: str, before: Column, after: Column) -> DataFrame:
    """``points`` without any of ``others`` (keys, other_at) in ``[at - before, at + after]``."""
    ranges = others.select(*keys, F.col("other_at").alias("low"), F.col("other_at").alias("high"))
    return untouched(points, ranges, keys, F.col(at) - before, F.col(at) + after)
