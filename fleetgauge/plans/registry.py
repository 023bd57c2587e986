"""Registry of queries and the DuckDB SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Samples of made records that one task takes.
SAMPLES_A_TASK = 250_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The event table as samples, for oracles.
SAMPLES_SQL = """s AS (
  SELECT user_id AS test_id, event_type AS channel, event_id, epoch_us(ts) AS us, value AS v,
    (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6::DOUBLE AS t,
    (row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts), event_id) - 1)::INT AS idx
  FROM events)"""


def query(name: str, oracle: str | None = None):
    """Registers a function of (spark, sf_dir) under ``name``."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(tests: DataFrame, key: str, points: int) -> DataFrame:
    """``tests`` dealt out by their key over tasks enough for ``points`` samples each.

    What is made of these rows keeps their places, so windows, groups and
    joins by the key move none of the samples again.
    """
    tasks = max(1, -(-tests.count() * points // SAMPLES_A_TASK))
    return tests.repartition(tasks, key)


def sampled(tests: DataFrame, key: str, points: int) -> DataFrame:
    """``tests`` as of :func:`dealt`, each with its samples' index i = 0 ... ``points`` - 1.

    A product with the indexes, not an exploded array: the planner takes
    exploded rows for as small as the table and broadcasts whole records.
    """
    indexes = tests.sparkSession.range(points).select(F.col("id").cast("int").alias("i"))
    return dealt(tests, key, points).crossJoin(F.broadcast(indexes))
