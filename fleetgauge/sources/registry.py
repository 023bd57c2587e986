"""Registries of valves and certificates, stored analyses, and replayed adjustments, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def new_valves(submitted: DataFrame, valves: DataFrame) -> DataFrame:
    """``submitted`` (tag, ...) with state: empty_tag, exists, repeated (a later row of the same tag) or created."""
    known = valves.select("tag", F.lit(True).alias("__known")).distinct()
    at = F.row_number().over(Window.partitionBy("tag").orderBy("seq"))
    rows = submitted.withColumn("__at", at).join(known, "tag", "left")
    state = F.when(F.coalesce(F.trim("tag"), F.lit("")) == "", "empty_tag").when(F.col("__known"), "exists").when(F.col("__at") > 1, "repeated").otherwise("created")
    return rows.withColumn("state", state).drop("__known", "__at")


def valves_with_tests(valves: DataFrame, tests: DataFrame) -> DataFrame:
    """Every valve with its number of tests and their ids in order; none for a valve without tests."""
    listed = tests.groupBy("valve_id").agg(F.count(F.lit(1)).alias("n_tests"), F.array_sort(F.collect_list("test_id")).alias("test_ids"))
    return valves.join(listed, "valve_id", "left").fillna(0, ["n_tests"])


def certificates_of(certificates: DataFrame, serial: str | None = None, kind: str | None = None) -> DataFrame:
    """Certificates of an instrument and a measurement type, where given, in order of their ids."""
    rows = certificates
    if serial is not None:
        rows = rows.where(F.col("serial") == serial)
    if kind is not None:
        rows = rows.where(F.col("measurement_type") == kind)
    return rows.orderBy("version_id")


def analysis_of(analyses: DataFrame, test_id: int, version: int | None = None) -> DataFrame:
    """One stored analysis of a test: the given version, else the last."""
    rows = analyses.where(F.col("test_id") == test_id)
    return rows.where(F.col("version") == version) if version is not None else rows.orderBy(F.desc("version")).limit(1)


def replay(events: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    """Device events after the overrides (keys, seq, device, operation add, update or remove, t_start, t_end, flow), with their state.

    Overrides of one device follow each other by seq: an update changes the
    given fields, add needs an absent device and all fields, update and remove
    a present one; where that doesn't hold the device's state is ``invalid``.
    """
    fields = ("t_start", "t_end", "flow")
    steps = overrides.groupBy(*keys, "device").agg(F.array_sort(F.collect_list(F.struct("seq", "operation", *fields))).alias("__steps"))
    base = events.select(*keys, "device", F.struct(F.lit("present").alias("state"), *fields).alias("__now"))
    both = base.join(steps, [*keys, "device"], "full_outer")
    absent = F.struct(F.lit("absent").alias("state"), *[F.lit(None).cast("double").alias(f) for f in fields])

    def step(now: Column, m: Column) -> Column:
        present = now["state"] == "present"
        whole = m["t_start"].isNotNull() & m["t_end"].isNotNull() & m["flow"].isNotNull()
        fine = F.when(m["operation"] == "add", ~present & whole).otherwise(present)
        state = F.when((now["state"] == "invalid") | ~fine, "invalid").when(m["operation"] == "remove", "absent").otherwise("present")
        return F.struct(state.alias("state"), *[F.coalesce(m[f], now[f]).alias(f) for f in fields])

    now = F.coalesce("__now", absent)
    last = F.when(F.col("__steps").isNull(), now).otherwise(F.aggregate("__steps", now, step))
    return both.select(*keys, "device", last.alias("x")).select(*keys, "device", "x.*").where("state <> 'absent'")


def rounded(rows: DataFrame, digits: dict[str, int]) -> DataFrame:
    """``rows`` with the named series rounded for storage."""
    for name, n in digits.items():
        rows = rows.withColumn(name, F.round(name, n))
    return rows
