"""All registered queries over the provided tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetgauge.plans import chain_queries, curve_queries, flow_queries, leak_queries, record_queries, registry_queries, series_queries, stroke_queries, supply_queries, switch_queries, table_queries, thrust_queries, trip_queries
from fleetgauge.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "chain_queries", "curve_queries", "flagship", "flow_queries", "leak_queries", "record_queries", "registry_queries", "stroke_queries", "supply_queries", "switch_queries", "table_queries", "thrust_queries", "trip_queries"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps in every channel of every test."""
    return series_queries.series_gaps(spark, sf_dir)
