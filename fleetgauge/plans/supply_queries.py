"""Air-supply schemes as submitted records, and results of actions over the stroke records, one of each per part."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.operators import airsupply
from fleetgauge.plans import stroke_records
from fleetgauge.plans.registry import dealt, query, table
from fleetgauge.plans.stroke_records import GRID_SQL, KEYS
from fleetgauge.sources import records
from fleetgauge.sources.held import hold


#: Samples that take as long as one text made and parsed.
TEXT = 50


def schemes(spark, sf_dir):
    """JSON text of a scheme for every part, read back as records; the part's numbers set units and order."""
    z, key = F.col("p_size"), F.col("p_partkey")

    def q(value, unit):
        return F.struct(F.lit(value).cast("double").alias("value") if not hasattr(value, "cast") else value.cast("double").alias("value"), (F.lit(unit) if isinstance(unit, str) else unit).alias("unit"))

    chamber = F.struct(q(F.when(z % 10 == 9, 3.0).otherwise(0.5), "l").alias("min_volume"), q(2.0, "l").alias("max_volume"))
    actuator = F.struct(
        chamber.alias("chamber_a"), chamber.alias("chamber_b"), q(z, F.when(z % 8 == 3, "ft2").otherwise("cm2")).alias("area_a"), q(z - 1, "cm2").alias("area_b"), q(0.0, "n").alias("load"), q(1.5, "kN").alias("friction"),
        q(6.0, "Nm3/h/kPa").alias("port_conductance"), q(F.when(z % 7 != 1, 2.0), "bar").alias("initial_chamber_pressure"),
    )
    curve = F.when(z % 6 == 2, F.array(F.array(F.lit(-5.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))).otherwise(F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(100.0), F.lit(900.0))))
    regulator = F.struct(q(4.0, "bar").alias("set_pressure"), F.when(z % 11 == 4, "torr").otherwise("kPa").alias("dp_unit"), F.lit("Nl/min").alias("flow_unit"), curve.alias("flow_curve"))

    def event(device, t0, t1):
        return F.struct(F.lit(device).alias("device"), t0.cast("double").alias("t_start_s"), t1.cast("double").alias("t_end_s"), q(50.0, "slm").alias("flow"))

    events = F.array(event("d1", F.lit(1), F.lit(1) + z % 5), event("d2", z % 4, F.lit(9)))
    action = F.struct(F.lit("open").alias("name"), q(3.0, "bar").alias("required_supply_pressure_min"))
    text = F.to_json(F.struct(
        F.lit("airsupply").alias("kind"), key.alias("test_id"), actuator.alias("actuator"), F.struct(q(6.0, "bar").alias("header_pressure")).alias("supply"), regulator.alias("regulator"),
        F.struct(q(0.1, "m3").alias("volume"), q(5.0, "bar").alias("initial_pressure")).alias("tank"), events.alias("events"), F.array(action).alias("actions"),
    ))
    # A small file of many parts is one task's input, but each of its texts takes as long as ``TEXT`` samples do.
    # The dealt parts are held, as the planner takes the parser's filter past an exchange.
    parts = hold(dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", TEXT), "parts")
    texts = parts.select(key.cast("string").alias("source"), text.alias("text"))
    # Parsed once; every gap reads the fields.
    return hold(records.of_kind(records.parse(texts)[0], "airsupply"), "schemes")


_FIXED = ", ".join(
    f"('{n}', {v}, {g})"
    for n, v, g in (
        ("initial_chamber_pressure", "CASE WHEN z % 7 <> 1 THEN 200.0 END", "CASE WHEN z % 7 = 1 THEN 'missing_value' END"),
        *((f"chamber_{x}.min_volume", "CASE WHEN z % 10 = 9 THEN 0.003 ELSE 0.0005 END", "NULL") for x in "ab"), *((f"chamber_{x}.max_volume", "0.002", "NULL") for x in "ab"),
        ("area_a", "CASE WHEN z % 8 <> 3 THEN z * 1e-4 END", "CASE WHEN z % 8 = 3 THEN 'unit_conflict' END"), ("area_b", "CASE WHEN z > 1 THEN (z - 1) * 1e-4 END", "CASE WHEN z <= 1 THEN 'nonpositive' END"),
        ("load", "0.0", "NULL"), ("friction", "1500.0", "NULL"), ("port_conductance", "100.0", "NULL"), ("header_pressure", "600.0", "NULL"), ("set_pressure", "400.0", "NULL"), ("tank.volume", "0.1", "NULL"),
        ("tank.initial_pressure", "500.0", "NULL"), ("events[0].flow", "50.0", "NULL"), ("events[1].flow", "50.0", "NULL"), ("actions[open]", "300.0", "NULL"),
    )
)
QUANTITY_SQL = f"""s AS (SELECT p_partkey AS test_id, p_size AS z FROM part),
q AS (SELECT test_id, z, field, value::DOUBLE AS value, gap::VARCHAR AS gap FROM s, LATERAL (SELECT * FROM (VALUES {_FIXED}) v(field, value, gap)))"""


@query("supply_quantities", f"WITH {QUANTITY_SQL} SELECT test_id, field, round(value, 9) AS value, gap FROM q")
def supply_quantities(spark, sf_dir):
    """Every quantity of every scheme in base units, or why not."""
    return airsupply.quantities(schemes(spark, sf_dir)).withColumn("value", F.round("value", 9))


@query("supply_gaps", f"""WITH {QUANTITY_SQL},
u AS (
  SELECT test_id, 'unit_conflict' AS code, field || ' ' || gap AS detail FROM q WHERE gap IS NOT NULL
  UNION ALL SELECT test_id, 'unit_conflict', x || ' volumes' FROM s, (VALUES ('chamber_a'), ('chamber_b')) v(x) WHERE z % 10 = 9
  UNION ALL SELECT test_id, 'unit_conflict', 'regulator dp_unit' FROM s WHERE z % 11 = 4)
SELECT * FROM u UNION ALL SELECT test_id, 'event_order', 'ends before it starts: d1' FROM s WHERE z % 5 = 0
UNION ALL SELECT test_id, 'event_order', 'not in order of their starts' FROM s WHERE z % 4 = 0
UNION ALL SELECT test_id, 'flow_curve_coverage', 'no positive difference' FROM s WHERE z % 6 = 2 AND test_id NOT IN (SELECT test_id FROM u)""")
def supply_gaps(spark, sf_dir):
    """All gaps of all schemes, gathered in one pass."""
    rows = schemes(spark, sf_dir)
    return airsupply.scheme_gaps(rows, airsupply.quantities(rows))


def actions(spark, sf_dir):
    z = F.col("p_size")
    listed = F.array(
        F.struct(F.lit("up").alias("name"), F.lit("powered_stroke").alias("kind"), F.lit("open").alias("direction"), F.lit(5.0).alias("t_start"), F.lit(34.0).alias("t_end"), (F.lit(18.0) + z % 5).alias("travel_max")),
        F.struct(F.lit("down").alias("name"), F.lit("fail_safe_stroke").alias("kind"), F.lit("close").alias("direction"), F.lit(35.0).alias("t_start"), (F.lit(52.0) + z % 9).alias("t_end"), F.lit(25.0).alias("travel_max")),
    )
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("test_id"), z, F.explode(listed).alias("x"))
    return rows.select("test_id", "x.*", F.lit(402.0).alias("required"), F.lit(12.0).alias("band"))


def devices(spark, sf_dir):
    z = F.col("p_size")
    listed = F.array(F.struct(F.lit("b").alias("device"), (z % 30).cast("double").alias("t0"), (z % 30 + 12.0).alias("t1")), F.struct(F.lit("a").alias("device"), F.lit(14.0).alias("t0"), (F.lit(14.0) + z).alias("t1")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("test_id"), F.explode(listed).alias("x")).select("test_id", "x.*")


ACTION_SQL = f"""{GRID_SQL},
ac AS (
  SELECT p_partkey AS test_id, 'up' AS name, 'powered_stroke' AS kind, 'open' AS direction, 5.0::DOUBLE AS t_start, 34.0::DOUBLE AS t_end, 18.0::DOUBLE + p_size % 5 AS travel_max, 402.0::DOUBLE AS required, 12.0::DOUBLE AS band, 100 AS target FROM part
  UNION ALL SELECT p_partkey, 'down', 'fail_safe_stroke', 'close', 35.0, 52.0::DOUBLE + p_size % 9, 25.0, 402.0, 12.0, 0 FROM part),
pt AS (SELECT ac.*, i, t, position, pressure, abs(position - target) <= band AS inside FROM ac JOIN g ON g.test_id = ac.test_id AND t BETWEEN t_start AND t_end),
pr AS (SELECT *, min(CASE WHEN inside THEN t END) OVER (PARTITION BY test_id, name) AS tr, CASE WHEN (pressure < required) = lag(pressure < required) OVER (PARTITION BY test_id, name ORDER BY i) THEN 0 ELSE 1 END AS new FROM pt),
pu AS (SELECT *, sum(new) OVER (PARTITION BY test_id, name ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM pr),
bl AS (SELECT test_id, name, min(t0) AS below_t0, arg_min(t1, t0) AS below_t1 FROM (SELECT test_id, name, min(t) AS t0, max(t) AS t1 FROM pu WHERE pressure < required GROUP BY test_id, name, run) GROUP BY ALL),
fa AS (SELECT test_id, name, any_value(tr) AS tr, min(pressure) AS mp, arg_min(t, (pressure, t)) AS mt, arg_max(position, i) AS fp, min(t) FILTER (WHERE t > tr AND NOT inside) AS ex FROM pr GROUP BY ALL),
ar AS (
  SELECT ac.test_id, name, kind, direction, t_start, t_end, travel_max, required, band, tr IS NOT NULL AS reached, round(tr, 3) AS t_reached, round(tr - t_start, 3) AS stroke_time, round(travel_max - (tr - t_start), 3) AS time_margin,
    round(mp, 2) AS min_pressure, round(mt, 3) AS min_pressure_t, round(mp - required, 2) AS pressure_margin, round(fp, 3) AS final_position, round(ex, 3) AS exit_t, below_t0, below_t1
  FROM ac LEFT JOIN fa USING (test_id, name) LEFT JOIN bl USING (test_id, name))"""


@query("supply_actions", f"WITH {ACTION_SQL} SELECT * FROM ar")
def supply_actions(spark, sf_dir):
    """Stroke times, margins and stretches of low pressure of every action."""
    return airsupply.action_results(actions(spark, sf_dir), stroke_records.grid(spark, sf_dir), KEYS)


@query("supply_findings", f"""WITH {ACTION_SQL},
fd AS (
  SELECT test_id, name, 'pressure_below_requirement' AS kind, below_t0 AS t0, below_t1 AS t1 FROM ar WHERE below_t0 IS NOT NULL UNION ALL SELECT test_id, name, 'stroke_timeout', t_start, t_end FROM ar WHERE NOT reached
  UNION ALL SELECT test_id, name, 'stroke_timeout', t_start, t_reached FROM ar WHERE reached AND stroke_time > travel_max + 1e-9
  UNION ALL SELECT test_id, name, 'safe_position_not_reached', t_start, t_end FROM ar WHERE kind = 'fail_safe_stroke' AND NOT reached
  UNION ALL SELECT test_id, name, 'safe_position_not_reached', exit_t, t_end FROM ar WHERE kind = 'fail_safe_stroke' AND exit_t IS NOT NULL),
dv AS (SELECT p_partkey AS test_id, 'b' AS device, (p_size % 30)::DOUBLE AS d0, p_size % 30 + 12.0::DOUBLE AS d1 FROM part UNION ALL SELECT p_partkey, 'a', 14.0, 14.0 + p_size FROM part)
SELECT fd.test_id, name, kind, t0, t1, arg_min(device, (d0, device)) AS device, count(device) AS n_devices FROM fd LEFT JOIN dv ON dv.test_id = fd.test_id AND d0 < t1 - 1e-9 AND d1 > t0 + 1e-9 GROUP BY ALL""")
def supply_findings(spark, sf_dir):
    """What went wrong with actions, and the device that began first meanwhile."""
    return airsupply.findings(supply_actions(spark, sf_dir), devices(spark, sf_dir), KEYS)


@query("supply_checks", f"""WITH {ACTION_SQL}, ck AS (
  SELECT test_id, name, 'min_supply_pressure' AS metric, min_pressure AS value, required AS low, NULL::DOUBLE AS high FROM ar UNION ALL SELECT test_id, name, 'stroke_time', stroke_time, NULL, travel_max FROM ar
  UNION ALL SELECT test_id, name, 'safe_position_reached', CASE WHEN reached AND exit_t IS NULL THEN 1.0 ELSE 0.0 END, 1.0, NULL FROM ar WHERE kind = 'fail_safe_stroke')
SELECT *, coalesce(value >= low - 1e-9, value <= high + 1e-9, false) AS passes FROM ck""")
def supply_checks(spark, sf_dir):
    """Actions against their limits."""
    return airsupply.checks(supply_actions(spark, sf_dir), KEYS)


@query("supply_revision_totals", """WITH t AS (SELECT l_suppkey AS test_id, l_linestatus AS side, min(l_quantity) AS min_tank_pressure_kpa, sum(l_tax) AS air_to_actuator_nl, sum(l_discount) AS events_consumed_nl, max(l_quantity) AS max_reg_dp_kpa FROM lineitem GROUP BY ALL),
u AS (SELECT test_id, side, total, value FROM t UNPIVOT (value FOR total IN (min_tank_pressure_kpa, air_to_actuator_nl, events_consumed_nl, max_reg_dp_kpa)))
SELECT test_id, total, round(max(value) FILTER (WHERE side = 'F'), 6) AS a, round(max(value) FILTER (WHERE side = 'O'), 6) AS b, round(max(value) FILTER (WHERE side = 'O') - max(value) FILTER (WHERE side = 'F'), 4) + 0.0 AS delta FROM u GROUP BY ALL""")
def supply_revision_totals(spark, sf_dir):
    """Totals of two revisions of each scheme."""
    line = table(spark, sf_dir, "lineitem")

    def side(x):
        totals = [F.min("l_quantity").alias("min_tank_pressure_kpa"), F.sum("l_tax").alias("air_to_actuator_nl"), F.sum("l_discount").alias("events_consumed_nl"), F.max("l_quantity").alias("max_reg_dp_kpa")]
        return line.where(F.col("l_linestatus") == x).groupBy(F.col("l_suppkey").alias("test_id")).agg(*totals)

    found = airsupply.compare_totals(side("F"), side("O"), KEYS)
    return found.select("test_id", "total", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), (F.col("delta") + 0.0).alias("delta"))
