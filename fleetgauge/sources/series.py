"""Samples in long form: test_id, channel, idx, t (seconds), v."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = T.ArrayType(T.ArrayType(T.DoubleType()))
SERIES = T.StructType([T.StructField("unit", T.StringType()), T.StructField("points", POINTS)])


RANGE = "struct<min:double,max:double,unit:string>"
CONDITIONS = "struct<load:string,medium:string,supply_pressure_kpa:double,ambient_temp_c:double,actuator_type:string,note:string>"
COMPONENT = "struct<value:double,unit:string,distribution:string>"
CHANNEL_COMPONENTS = f"struct<resolution:{COMPONENT},accuracy:{COMPONENT},zero_drift:{COMPONENT},calibration:{COMPONENT},time_jitter_s:double>"
UNCERTAINTY = f"struct<channels:map<string,{CHANNEL_COMPONENTS}>,n_samples:int,seed:bigint,interval_prob:double>"
HEADER = ("valve_tag", "valve_description", "phase", "test_started_at", "submitted_at", "calibration_valid_until")


def submission_schema(channels: list[str]) -> T.StructType:
    """Schema of one submitted test record with the given channels."""
    series = T.StructType([T.StructField(c, SERIES) for c in channels])
    head = "test_id long, " + ", ".join(f"{name} string" for name in HEADER)
    rest = f"range {RANGE}, conditions {CONDITIONS}, thresholds map<string,double>, uncertainty {UNCERTAINTY}, calibration_bindings map<string,bigint>"
    schema = T.StructType.fromDDL(f"{head}, {rest}")
    return schema.add("series", series)


def read_submissions(spark: SparkSession, path: str, channels: list[str]) -> DataFrame:
    """Test records from JSON files; a record that breaks the schema fails the read.

    A record without id gets one from its valve, phase, start and file.
    """
    rows = spark.read.schema(submission_schema(channels)).option("multiLine", True).option("mode", "FAILFAST").json(path)
    made = F.xxhash64("valve_tag", "phase", "test_started_at", F.col("_metadata.file_path"))
    return rows.withColumn("test_id", F.coalesce("test_id", made))


def samples_of(tests: DataFrame, channels: list[str]) -> DataFrame:
    """Long samples of test records, one row per point."""
    each = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"series.{c}.unit").alias("unit"), F.col(f"series.{c}.points").alias("points")) for c in channels])
    rows = tests.select("test_id", F.explode(each).alias("s"))
    rows = rows.select("test_id", "s.channel", "s.unit", F.posexplode("s.points").alias("idx", "p"))
    return rows.select("test_id", "channel", "unit", "idx", F.get("p", F.lit(0)).alias("t"), F.get("p", F.lit(1)).alias("v"))


def samples_of_events(events: DataFrame) -> DataFrame:
    """The event table as samples: a user is a test, an event type a channel."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.select(F.col("user_id").alias("test_id"), F.col("event_type").alias("channel"), "event_id", us.alias("us"), F.col("value").alias("v"))
    start = F.min("us").over(Window.partitionBy("test_id"))
    idx = F.row_number().over(Window.partitionBy("test_id", "channel").orderBy("us", "event_id")) - 1
    return rows.withColumn("t", (F.col("us") - start) / F.lit(1e6)).withColumn("idx", idx)


def parse_time(text):
    """Lenient ISO timestamp; without zone it is UTC, null if unreadable."""
    return F.try_to_timestamp(text)


def write_results(tables: dict[str, DataFrame], path: str, kind: str) -> None:
    """Append result tables, one folder each, under ``kind``."""
    for name, df in tables.items():
        df.withColumn("kind", F.lit(kind)).write.mode("append").partitionBy("kind").parquet(f"{path}/{name}")


def export_json(results: DataFrame, path: str) -> None:
    """One JSON document per result row."""
    results.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
