"""Queries that look values up in short curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.operators import curves
from fleetgauge.plans.registry import SAMPLES_SQL, query
from fleetgauge.plans.series_queries import KEYS, samples

SPRING = [(0.0, 1300.0), (50.0, 2000.0), (100.0, 3000.0)]
BLANK = [(10.0, 400.0, 0.2), (20.0, 500.0, 0.5), (40.0, 450.0, 0.6)]


def _literal(rows, names):
    return F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names, strict=True)]) for row in rows])


@query("spring_force", f"""WITH {SAMPLES_SQL}
SELECT test_id, channel, idx, round(CASE WHEN v <= 0 THEN 1300.0 WHEN v <= 50 THEN 1300 + v / 50 * 700 WHEN v <= 100 THEN 2000 + (v - 50) / 50 * 1000 WHEN v > 100 THEN 3000.0 END::DOUBLE, 5) AS force FROM s""")  # fmt: skip
def spring_force(spark, sf_dir):
    """Force of one spring at each sample's position."""
    force = curves.clamped(F.col("v"), _literal(SPRING, ["x", "y"]))
    return samples(spark, sf_dir).select(*KEYS, "idx", F.round(force, 5).alias("force"))


@query("blank_rates", f"""WITH {SAMPLES_SQL}
SELECT test_id, channel, idx, round(CASE WHEN v / 2 <= 10 THEN 0.2 WHEN v / 2 <= 20 THEN 0.2 + (v / 2 - 10) / 10 * 0.3 WHEN v / 2 <= 40 THEN 0.5 + (v / 2 - 20) / 20 * 0.1 WHEN v / 2 > 40 THEN 0.6 END::DOUBLE, 6) AS rate,
  v / 2 BETWEEN 8 AND 42 AND v + 400 BETWEEN 380 AND 520 AS covered FROM s""")  # fmt: skip
def blank_rates(spark, sf_dir):
    """Blank recovery rate at each sample's temperature, and whether the baseline covers it."""
    temp, pressure = F.col("v") / 2, F.col("v") + 400
    baseline = _literal(BLANK, ["temp_c", "pressure_kpa", "rate"])
    covered = curves.blank_covers(curves.blank_envelope(baseline), temp, temp, pressure, pressure)
    return samples(spark, sf_dir).select(*KEYS, "idx", F.round(curves.blank_rate(baseline, temp, pressure), 6).alias("rate"), covered.alias("covered"))
