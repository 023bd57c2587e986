"""Partial strokes and registries over the provided tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.operators import partial
from fleetgauge.plans.registry import query, sampled, table
from fleetgauge.sources import registry

KEYS = ["test_id"]


def grid(spark, sf_dir):
    """Partial strokes, one per customer: 20 s at 10 Hz, 10 % from 100 %, the nation sets lag and faults."""
    n, i = F.col("c_nationkey"), F.col("i")
    rows = sampled(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey", 200)
    command = 100.0 - F.when(i.between(30, 89) & (n != 7), 12.0).otherwise(0.0)
    reach = F.when(n == 3, 6.0).when(n == 5, 16.0).otherwise(11.0)
    lag = n % 4 * 2
    gone = F.least(reach, F.greatest(i - 30 - lag, F.lit(0)) * 0.5) * F.when(n == 7, 0.0).otherwise(1.0)
    back = F.greatest(F.when(n == 9, 2.0).otherwise(0.0), reach - F.greatest(i - 90 - lag, F.lit(0)) * 0.5) * F.when(n == 7, 0.0).otherwise(1.0)
    position = 100.0 - F.least(gone, back) - F.when(n == 11, 3.0).otherwise(0.0)
    return rows.select(F.col("c_custkey").alias("test_id"), i.cast("long").alias("i"), (i / 10.0).alias("t"), command.alias("command"), position.alias("position"))


def specs(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("test_id"), F.lit(100.0).alias("start_pct"), F.lit("close").alias("direction"), F.lit(10.0).alias("target_pct"), F.lit(15.0).alias("max_pct"), F.lit(1.0).alias("permit_t"))


PARTIAL_SQL = """p0 AS (SELECT c_custkey AS test_id, c_nationkey AS n, i, i / 10.0::DOUBLE AS t, CASE c_nationkey WHEN 3 THEN 6.0 WHEN 5 THEN 16.0 ELSE 11.0 END::DOUBLE AS reach, c_nationkey % 4 * 2 AS lag FROM customer, range(200) x(i)),
p1 AS (SELECT test_id, n, i, t, CASE WHEN i BETWEEN 30 AND 89 AND n <> 7 THEN 12.0 ELSE 0.0 END::DOUBLE AS step, least(least(reach, greatest(i - 30 - lag, 0) * 0.5), greatest(CASE WHEN n = 9 THEN 2.0 ELSE 0.0 END, reach - greatest(i - 90 - lag, 0) * 0.5))::DOUBLE * CASE WHEN n = 7 THEN 0 ELSE 1 END AS gone FROM p0),
p2 AS (SELECT *, min(gone) OVER (PARTITION BY test_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) >= 0.5 AS held, max((abs(gone) > 1)::INT) OVER (PARTITION BY test_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING) = 0 AS calm FROM p1),
p3 AS (SELECT test_id, any_value(n) AS n, min(i) FILTER (WHERE step >= 2) AS ic FROM p2 GROUP BY test_id),
p4 AS (SELECT p2.test_id, any_value(p3.n) AS n, any_value(ic) AS ic, min(i) FILTER (WHERE i >= ic AND held) AS im, min(i) FILTER (WHERE i >= ic AND gone >= 10) AS it, arg_max(i, (gone, -i)) FILTER (WHERE i >= ic) AS ix, max(gone) FILTER (WHERE i >= ic) AS most, arg_max(gone, i) AS lastg FROM p2 JOIN p3 ON p3.test_id = p2.test_id GROUP BY p2.test_id),
p5 AS (SELECT p2.test_id, min(i) FILTER (WHERE i > coalesce(it, ix) AND step < 2) AS ir FROM p2 JOIN p4 ON p4.test_id = p2.test_id GROUP BY p2.test_id),
p6 AS (SELECT p2.test_id, min(i) FILTER (WHERE i >= ir AND calm) AS ise FROM p2 JOIN p5 ON p5.test_id = p2.test_id GROUP BY p2.test_id),
pz AS (SELECT p4.*, ir, ise FROM p4 JOIN p5 USING (test_id) JOIN p6 USING (test_id))"""


@query("partial_boundaries", f"""WITH {PARTIAL_SQL} SELECT test_id, ic / 10.0::DOUBLE AS command_t, im / 10.0::DOUBLE AS move_t, it / 10.0::DOUBLE AS target_t, ir / 10.0::DOUBLE AS return_t, ise / 10.0::DOUBLE AS settled_t, most AS effective_travel, round((im - ic) / 10.0, 3)::DOUBLE AS breakaway_delay,
  round((ise - ir) / 10.0, 3)::DOUBLE AS return_time, greatest(0.0, most - 10) AS overshoot, array_to_string(list_filter([CASE WHEN n = 11 THEN 'start_position_mismatch' END, CASE WHEN ic IS NULL THEN 'no_command_step' END, CASE WHEN most > 15 THEN 'travel_over_limit' END,
  CASE WHEN ic IS NOT NULL AND it IS NULL THEN 'target_not_reached' END, CASE WHEN ir IS NOT NULL AND ise IS NULL THEN 'not_settled' END], lambda x: x IS NOT NULL), ',') AS gaps FROM pz""")  # fmt: skip
def partial_boundaries(spark, sf_dir):
    """Boundaries, metrics and gaps of every partial stroke."""
    found = partial.boundaries(grid(spark, sf_dir), specs(spark, sf_dir), KEYS)
    found = found.withColumn("overshoot", F.when(F.col("command_t").isNotNull(), F.col("overshoot")).otherwise(F.lit(0.0)))
    return found.select("test_id", "command_t", "move_t", "target_t", "return_t", "settled_t", "effective_travel", "breakaway_delay", "return_time", "overshoot", F.array_join("gaps", ",").alias("gaps"))


@query("partial_phases", f"""WITH {PARTIAL_SQL} SELECT test_id, 'permit' AS phase, 1.0::DOUBLE AS t_start, ic / 10.0::DOUBLE AS t_end FROM pz WHERE ic IS NOT NULL UNION ALL SELECT test_id, 'stroke', ic / 10.0, it / 10.0 FROM pz WHERE it IS NOT NULL
  UNION ALL SELECT test_id, 'hold', it / 10.0, ir / 10.0 FROM pz WHERE it IS NOT NULL AND ir IS NOT NULL UNION ALL SELECT test_id, 'return', ir / 10.0, ise / 10.0 FROM pz WHERE ir IS NOT NULL AND ise IS NOT NULL""")  # fmt: skip
def partial_phases(spark, sf_dir):
    """Permit, stroke, hold and return of every partial stroke."""
    return partial.phases(partial.boundaries(grid(spark, sf_dir), specs(spark, sf_dir), KEYS), KEYS)


_DUE = "ic IS NOT NULL"
CHECK_SQL = f"""{PARTIAL_SQL}, hd AS (SELECT p2.test_id, round(max(gone) - min(gone), 4) AS drift FROM p2 JOIN pz ON pz.test_id = p2.test_id AND i BETWEEN it AND ir GROUP BY p2.test_id),
rs AS (SELECT test_id, round(abs(gone), 4) AS residual FROM p2 WHERE i = 199),
ck AS (
  SELECT test_id, 'breakaway_delay' AS metric, round((im - ic) / 10.0, 3)::DOUBLE AS value, NULL::DOUBLE AS low, 5.0::DOUBLE AS high FROM pz WHERE {_DUE}
  UNION ALL SELECT test_id, 'effective_travel', most, 9.5, NULL FROM pz WHERE {_DUE}
  UNION ALL SELECT test_id, 'overshoot', greatest(0.0, most - 10), NULL, 2.0 FROM pz WHERE {_DUE}
  UNION ALL SELECT test_id, 'avg_speed', round(10 / ((it - im) / 10.0), 3), 0.5, NULL FROM pz WHERE it > im
  UNION ALL SELECT test_id, 'hold_drift', drift, NULL, 1.0 FROM pz JOIN hd USING (test_id) WHERE {_DUE}
  UNION ALL SELECT test_id, 'return_time', round((ise - ir) / 10.0, 3), NULL, 10.0 FROM pz WHERE ir IS NOT NULL
  UNION ALL SELECT test_id, 'residual', residual, NULL, 1.0 FROM pz JOIN rs USING (test_id) WHERE {_DUE}
  UNION ALL SELECT test_id, 'total_time', round((coalesce(ise, 199) - ic) / 10.0, 3), NULL, 8.0 + test_id % 3 FROM pz WHERE {_DUE})"""


@query("partial_checks", f"WITH {CHECK_SQL} SELECT test_id, metric, round(value, 3) + 0.0 AS value, low, high, coalesce(value >= low - 1e-9, value <= high + 1e-9, false) AS passes FROM ck")
def partial_checks(spark, sf_dir):
    """Metrics of every partial stroke against its limits."""
    found = partial.boundaries(grid(spark, sf_dir), specs(spark, sf_dir), KEYS)
    limits = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("test_id"), (8.0 + F.col("c_custkey") % 3).alias("time_limit_s"))
    return partial.checks(found, limits, KEYS).withColumn("value", F.round("value", 3) + 0.0)


@query("partial_issues", f"""WITH {PARTIAL_SQL} SELECT test_id, 'no_movement' AS kind FROM pz WHERE ic IS NOT NULL AND im IS NULL
  UNION ALL SELECT test_id, 'target_not_reached' FROM pz WHERE im IS NOT NULL AND it IS NULL UNION ALL SELECT test_id, 'return_not_observed' FROM pz WHERE ic IS NOT NULL AND ir IS NULL
  UNION ALL SELECT test_id, 'not_settled' FROM pz WHERE ir IS NOT NULL AND ise IS NULL""")
def partial_issues(spark, sf_dir):
    """What partial strokes did not do."""
    return partial.issues(partial.boundaries(grid(spark, sf_dir), specs(spark, sf_dir), KEYS), KEYS)


@query("registry_new_valves", """WITH s AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 50 = 0 THEN ' ' ELSE 'V' || o_custkey END AS tag FROM orders), a AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY seq) AS at_ FROM s)
SELECT seq, tag, CASE WHEN trim(tag) = '' THEN 'empty_tag' WHEN EXISTS (SELECT 1 FROM supplier WHERE 'V' || s_suppkey = tag) THEN 'exists' WHEN at_ > 1 THEN 'repeated' ELSE 'created' END AS state FROM a""")  # fmt: skip
def registry_new_valves(spark, sf_dir):
    """Which submitted valves are created."""
    tag = F.when(F.col("o_orderkey") % 50 == 0, " ").otherwise(F.concat(F.lit("V"), F.col("o_custkey")))
    submitted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), tag.alias("tag"))
    return registry.new_valves(submitted, table(spark, sf_dir, "supplier").select(F.concat(F.lit("V"), F.col("s_suppkey")).alias("tag")))


@query("registry_valves", """SELECT c_custkey AS valve_id, count(o_orderkey) AS n_tests, min(o_orderkey) AS first_test, max(o_orderkey) AS last_test FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def registry_valves(spark, sf_dir):
    """Valves with their tests."""
    valves = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("valve_id"))
    found = registry.valves_with_tests(valves, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("valve_id"), F.col("o_orderkey").alias("test_id")))
    return found.select("valve_id", "n_tests", F.array_min("test_ids").alias("first_test"), F.array_max("test_ids").alias("last_test"))


@query("registry_replay", """WITH e AS (SELECT p_partkey AS scheme_id, d AS device, p_size::DOUBLE AS t_start, p_size + 5.0::DOUBLE AS t_end, 100.0::DOUBLE AS flow, p_size AS z FROM part, (VALUES ('a'), ('b')) v(d))
SELECT scheme_id, device, CASE WHEN device = 'b' AND z % 3 = 1 THEN 'invalid' ELSE 'present' END AS state, t_start, t_end, CASE WHEN device = 'a' AND z % 3 = 0 THEN 70.0 WHEN device = 'b' AND z % 3 = 1 THEN 9.0 ELSE flow END AS flow FROM e WHERE NOT (device = 'a' AND z % 3 = 2)
UNION ALL SELECT p_partkey, 'c', 'present', 1.0, 2.0, 3.0 FROM part WHERE p_size % 3 = 0""")  # fmt: skip
def registry_replay(spark, sf_dir):
    """Device events after updates, removals and additions."""
    z = F.col("p_size")
    part = table(spark, sf_dir, "part")
    events = part.select(F.col("p_partkey").alias("scheme_id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("device"), z.cast("double").alias("t_start"), (z + 5.0).alias("t_end"), F.lit(100.0).alias("flow"))

    def change(seq, device, operation, when, t0=None, t1=None, flow=None):
        number = lambda x: F.lit(x).cast("double")
        return F.when(when, F.struct(F.lit(seq).alias("seq"), F.lit(device).alias("device"), F.lit(operation).alias("operation"), number(t0).alias("t_start"), number(t1).alias("t_end"), number(flow).alias("flow")))

    steps = F.array_compact(F.array(
        change(1, "a", "update", z % 3 == 0, flow=80.0), change(2, "a", "update", z % 3 == 0, flow=70.0), change(3, "c", "add", z % 3 == 0, 1.0, 2.0, 3.0),
        change(4, "b", "add", z % 3 == 1, flow=9.0), change(5, "a", "remove", z % 3 == 2),
    ))
    overrides = part.select(F.col("p_partkey").alias("scheme_id"), F.explode(steps).alias("x")).select("scheme_id", "x.*")
    return registry.replay(events, overrides, ["scheme_id"])
