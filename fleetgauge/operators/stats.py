"""Medians, slopes, fits and rank statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upper_median(name: str) -> Column:
    """Element n // 2 of the sorted values."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {name} DESC)")


def lower_median(name: str) -> Column:
    """Element (n - 1) // 2 of the sorted values."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {name})")


def micros(t: Column) -> Column:
    """Seconds as whole microseconds, halves away from zero.

    Rounding a double goes through its decimal text; from one second on adding a half gives the same.
    """
    us = t * 1e6
    return F.when(t.between(1.0, 1e9), F.floor(us + 0.5)).otherwise(F.round(us).cast("long"))


def trailing_slope(rows: DataFrame, keys: list[str], us: str, y: str, window_us: int, least: int = 3) -> DataFrame:
    """Per row the least-squares slope of ``y`` per minute over the last ``window_us`` microseconds.

    Null with fewer than ``least`` rows or if they span less than 0.8 of the window.
    """
    frame = Window.partitionBy(*keys).orderBy(us).rangeBetween(-window_us, 0)
    x = F.col("__x")
    centred = rows.withColumn("__x", (F.col(us) - F.min(us).over(Window.partitionBy(*keys))) / F.lit(6e7))
    slope = F.regr_slope(F.col(y), x).over(frame)
    # A frame ends with its own row's time: only its begin is asked for, as each aggregate goes over the whole frame for every row.
    began = F.min(us).over(frame)
    enough = (F.count(F.lit(1)).over(frame) >= least) & (F.col(us) - began >= 0.8 * window_us)
    spread = F.col(us) > began
    return centred.withColumn("slope", F.when(enough & spread, slope)).drop("__x")


def through_origin(x: Column, y: Column) -> Column:
    """Factor of the least-squares line through the origin."""
    return F.sum(x * y) / F.sum(x * x)


def average_rank(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Rank of ``value`` within keys, ties sharing the mean of their ranks."""
    ordered = Window.partitionBy(*keys).orderBy(value)
    peers = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return rows.withColumn(name, F.rank().over(ordered) + (peers - 1) / 2)


def spearman(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation per key, null if either side doesn't vary."""
    ranked = average_rank(average_rank(rows, keys, x, "__rx"), keys, y, "__ry")
    varies = (F.min("__rx") < F.max("__rx")) & (F.min("__ry") < F.max("__ry"))
    return ranked.groupBy(*keys).agg(F.when(varies, F.corr("__rx", "__ry")).alias("rho"), F.count(F.lit(1)).alias("n"))


def interval(name: str, probability: float) -> Column:
    """Central interval as an array of two linear quantiles."""
    a = (1 - probability) / 2
    return F.percentile(name, F.array(F.lit(a), F.lit(1 - a)))



def fused(a: Column, b: Column, c: Column) -> Column:
    """``a * b + c`` rounded once: what the product and the sum lose is added at the end."""

    def halves(x: Column) -> tuple[Column, Column]:
        high = x * 134217729.0 - (x * 134217729.0 - x)
        return high, x - high

    (ah, al), (bh, bl) = halves(a), halves(b)
    product = a * b
    lost = ((ah * bh - product) + ah * bl + al * bh) + al * bl
    total = product + c
    grown = total - product
    return total + ((product - (total - grown)) + (c - grown) + lost)


def fused_interval(name: str, probability: float) -> Column:
    """:func:`interval` to the last digit of the SQL's quantiles, for what goes by the sign of a difference.

    The values of a group are one array, so groups are one channel of a test.
    """
    a = (1 - probability) / 2

    def quantile(x: Column, q: float) -> Column:
        at = (F.size(x) - 1) * F.lit(q)
        k = F.floor(at).cast("int")
        low, high, part = F.get(x, k), F.get(x, k + 1), at - k
        return F.when(part == 0, low).otherwise(fused(low, 1 - part, high * part))

    values = F.array_sort(F.collect_list(name))
    return F.when(F.size(values) > 0, F.array(quantile(values, a), quantile(values, 1 - a)))


def signed_round(x: Column, digits: int) -> Column:
    """``x`` rounded; one that rounds to zero keeps its sign, as the class made of it goes by that."""
    rounded = F.round(x, digits)
    return F.when(rounded == 0, x * 0.0).otherwise(rounded)
