"""Fail-safe analysis with its default limits, over trip records made from the part table.

One test per part: 27 s at 10 Hz, tripped at 5 s.  The part's size sets mode,
delay, and faults: a stall midway, a rebound, a stop short of the end, travel
the wrong way, slow pressure decay.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.operators import failsafe
from fleetgauge.plans.registry import query, sampled, table

KEYS = ["test_id"]
STEP_S = 0.1


def trips(spark, sf_dir):
    z = F.col("p_size")
    mode = F.when(z % 3 == 0, "fail_close").when(z % 3 == 1, "fail_open").otherwise("fail_in_place")
    acting = F.when(z % 2 == 0, "double_acting").otherwise("spring_return")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("test_id"), F.lit(5.0).alias("trip_time"), mode.alias("mode"), acting.alias("acting"))


def grid(spark, sf_dir):
    """(test_id, i, t, position, pressure)."""
    z, i = F.col("p_size"), F.col("i")
    rows = sampled(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", 271)
    ran = F.greatest(i - 50 - z % 7 * 3, F.lit(0))
    ran = F.when(z % 5 == 0, F.least(ran, F.greatest(F.lit(10), ran - 12))).otherwise(ran)
    gone = F.least(ran * 2.0, F.when(z % 17 == 9, 40.0).otherwise(50.0))
    gone = F.when(z % 13 == 7, -gone).otherwise(gone)
    gone = F.when((z % 11 == 3) & i.between(150, 160), gone - 7.5).otherwise(gone)
    away = F.when(z % 3 == 0, -gone).when(z % 3 == 1, gone).otherwise(F.least(F.greatest(i - 50, F.lit(0)) * 0.01, z / 10.0))
    kpa = F.greatest(F.when(z % 4 == 1, 100.0).otherwise(20.0), 400.0 - F.greatest(i - 50, F.lit(0)) * 10.0)
    return rows.select(F.col("p_partkey").alias("test_id"), i.cast("long").alias("i"), (i / 10.0).alias("t"), (50.0 + away).alias("position"), kpa.alias("pressure"))


def rows(spark, sf_dir):
    return failsafe.observed(grid(spark, sf_dir), trips(spark, sf_dir), KEYS)


TRIP_SQL = """a0 AS (SELECT p_partkey AS test_id, p_size AS z, i, greatest(i - 50 - p_size % 7 * 3, 0) AS r0 FROM part, range(271) x(i)),
a1 AS (SELECT *, CASE WHEN z % 5 = 0 THEN least(r0, greatest(10, r0 - 12)) ELSE r0 END AS r FROM a0),
a2 AS (SELECT *, least(r * 2.0, CASE WHEN z % 17 = 9 THEN 40.0 ELSE 50.0 END)::DOUBLE * CASE WHEN z % 13 = 7 THEN -1 ELSE 1 END - CASE WHEN z % 11 = 3 AND i BETWEEN 150 AND 160 THEN 7.5 ELSE 0 END AS gone FROM a1),
g AS (SELECT test_id, z, i, i / 10.0::DOUBLE AS t, 50.0::DOUBLE + CASE z % 3 WHEN 0 THEN -gone WHEN 1 THEN gone ELSE least(greatest(i - 50, 0) * 0.01::DOUBLE, z / 10.0::DOUBLE) END AS position,
  greatest(CASE WHEN z % 4 = 1 THEN 100 ELSE 20 END, 400 - greatest(i - 50, 0) * 10)::DOUBLE AS pressure, CASE z % 3 WHEN 0 THEN 'fail_close' WHEN 1 THEN 'fail_open' ELSE 'fail_in_place' END AS mode,
  CASE z % 3 WHEN 0 THEN -1 WHEN 1 THEN 1 END AS sg, CASE z % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 100.0 END::DOUBLE AS target FROM a2),
bs AS (SELECT test_id, percentile_disc(0.5) WITHIN GROUP (ORDER BY position) AS p0, percentile_disc(0.5) WITHIN GROUP (ORDER BY pressure) AS kpa0 FROM g WHERE i BETWEEN 40 AND 49 GROUP BY test_id),
w AS (SELECT g.*, p0, kpa0 FROM g JOIN bs USING (test_id) WHERE i BETWEEN 50 AND 250),
m0 AS (SELECT *, sg * (position - p0) AS way, sg * (position - p0) / abs(target - p0) AS share, abs(position - target) > 2 AS o FROM w WHERE mode <> 'fail_in_place'),
m1 AS (SELECT *, min(i) FILTER (WHERE way >= 0.5) OVER (PARTITION BY test_id) AS i_move, count(*) FILTER (WHERE share >= 0.9) OVER (PARTITION BY test_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS held FROM m0),
m2 AS (SELECT test_id, max(-way) >= 2 AND max(way) < 0.5 * any_value(abs(target - p0)) AS wrong_direction, any_value(i_move) AS i_move, min(t) FILTER (WHERE i = i_move) AS t_move, min(t) FILTER (WHERE i >= i_move AND held = 2) AS t_90,
  min(i) FILTER (WHERE NOT o) AS i_band, arg_max(position, i) AS final, max(t) AS t_end, coalesce(max(i) FILTER (WHERE o) + 1, 50) AS i_tail, any_value(target) AS target FROM m1 GROUP BY test_id),
tv AS (SELECT test_id, wrong_direction, CASE WHEN NOT wrong_direction THEN round(t_move - 5, 3) END AS delay, CASE WHEN NOT wrong_direction THEN round(t_90 - t_move, 3) END AS t90, round(final, 3) AS final_position, target,
  NOT wrong_direction AND i_tail <= 250 AND t_end - i_tail / 10.0::DOUBLE >= 1.5 AS settled, CASE WHEN NOT wrong_direction AND i_tail <= 250 AND t_end - i_tail / 10.0::DOUBLE >= 1.5 THEN round(i_tail / 10.0::DOUBLE + 1.5 - 5, 3) END AS settle_time,
  CASE WHEN wrong_direction OR i_tail > 250 THEN 0.0 ELSE round(t_end - i_tail / 10.0::DOUBLE, 3) END AS stable_tail, i_move, i_band FROM m2)"""


@query("trip_travel", f"WITH {TRIP_SQL} SELECT * FROM tv")
def trip_travel(spark, sf_dir):
    """Delay, held t90, settling and direction of every trip."""
    return failsafe.travel(rows(spark, sf_dir), KEYS, STEP_S)


REBOUND_SQL = """ra AS (SELECT m0.* FROM m0 JOIN tv USING (test_id) WHERE NOT wrong_direction AND i >= i_band),
rb AS (SELECT *, CASE WHEN o = lag(o) OVER (PARTITION BY test_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM ra),
rc AS (SELECT *, sum(new) OVER (PARTITION BY test_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM rb),
rd AS (SELECT *, CASE WHEN o THEN run WHEN new = 1 AND run > 1 THEN run - 1 END AS ep FROM rc),
rbd AS (SELECT test_id, round(min(t), 3) AS t_start, round(max(t), 3) AS t_end, round(arg_max(t, (sg * (target - position), -i)), 3) AS t_peak, round(arg_max(position, (sg * (target - position), -i)), 3) AS peak,
  round(abs(arg_max(position, (sg * (target - position), -i)) - any_value(target)), 3) AS magnitude FROM rd WHERE ep IS NOT NULL GROUP BY test_id, ep)"""


@query("trip_rebounds", f"WITH {TRIP_SQL}, {REBOUND_SQL} SELECT * FROM rbd")
def trip_rebounds(spark, sf_dir):
    """Departures from the safe band after it was reached."""
    r = rows(spark, sf_dir)
    return failsafe.rebounds(r, failsafe.travel(r, KEYS, STEP_S), KEYS)


STALL_SQL = """sp AS (SELECT w.test_id, i, t, position AS p, coalesce(i_band, 250) AS last, i_move FROM w JOIN tv USING (test_id) WHERE NOT wrong_direction AND i >= i_move AND i <= coalesce(i_band, 250)),
sf AS (SELECT a.test_id, a.i, min(b.i) AS far FROM sp a JOIN sp b ON b.test_id = a.test_id AND b.i > a.i AND abs(b.p - a.p) >= 0.5 GROUP BY ALL),
sj AS (SELECT sp.*, coalesce(far - 1, last) AS j FROM sp LEFT JOIN sf USING (test_id, i)),
sh AS (SELECT a.*, b.t AS tj, b.p AS pj, b.t - a.t >= 0.8 AND j - a.i >= 2 AS hit, CASE WHEN b.t - a.t >= 0.8 AND j - a.i >= 2 THEN j + 1 ELSE greatest(a.i + 1, j) END AS nxt FROM sj a JOIN sp b ON b.test_id = a.test_id AND b.i = a.j),
sw AS (SELECT test_id, min(i) AS i FROM sp GROUP BY test_id UNION ALL SELECT sw.test_id, nxt FROM sw JOIN sh USING (test_id, i) WHERE nxt < last),
stl AS (SELECT test_id, round(t, 3) AS t_start, round(tj, 3) AS t_end, round(tj - t, 3) AS duration, round(abs(pj - p), 3) AS move FROM sw JOIN sh USING (test_id, i) WHERE hit AND i < last)"""


@query("trip_stalls", f"WITH RECURSIVE {TRIP_SQL}, {STALL_SQL} SELECT * FROM stl")
def trip_stalls(spark, sf_dir):
    """Stalls between onset and safe band."""
    r = rows(spark, sf_dir)
    return failsafe.stalls(r, failsafe.travel(r, KEYS, STEP_S), KEYS)


DECAY_SQL = """pd AS (SELECT test_id, round(any_value(kpa0), 2) AS kpa0, round(arg_max(pressure, i), 2) AS kpa_end, round(min(pressure), 2) AS kpa_min, round((any_value(kpa0) - arg_max(pressure, i)) / any_value(kpa0) * 100, 2) AS decay,
  round(min(t - 5) FILTER (WHERE pressure <= 50), 3) AS below_residual, any_value(z % 2 = 1 AND z % 3 <> 2) AS judged FROM w GROUP BY test_id)"""


@query("trip_pressure_decay", f"WITH {TRIP_SQL}, {DECAY_SQL} SELECT * FROM pd")
def trip_pressure_decay(spark, sf_dir):
    """Pressure decay after the trip."""
    return failsafe.pressure_decay(rows(spark, sf_dir), KEYS)


DRIFT_SQL = """df AS (SELECT test_id, round(max(abs(position - p0)), 3) AS max_drift, round(arg_max(abs(position - p0), i), 3) AS end_drift FROM w WHERE mode = 'fail_in_place' GROUP BY test_id)"""


@query("trip_drift", f"WITH {TRIP_SQL}, {DRIFT_SQL} SELECT *, end_drift <= 2 AS settled FROM df")
def trip_drift(spark, sf_dir):
    """Drift of the tests that must stay in place."""
    return failsafe.drift(rows(spark, sf_dir), KEYS)


@query("trip_verdicts", f"""WITH RECURSIVE {TRIP_SQL}, {REBOUND_SQL}, {STALL_SQL}, {DECAY_SQL}, {DRIFT_SQL},
mg AS (SELECT test_id, max(magnitude) AS rebound, count(*) AS n_rebounds FROM rbd GROUP BY test_id), ns AS (SELECT test_id, count(*) AS n_stalls FROM stl GROUP BY test_id),
al AS (SELECT pd.*, tv.* EXCLUDE (test_id), coalesce(rebound, 0) AS rb, coalesce(n_rebounds, 0) AS nr, coalesce(n_stalls, 0) AS nst, max_drift, end_drift, tv.test_id IS NOT NULL AND NOT coalesce(wrong_direction, false) AS tr
  FROM pd LEFT JOIN tv USING (test_id) LEFT JOIN mg USING (test_id) LEFT JOIN ns USING (test_id) LEFT JOIN df USING (test_id)),
vv AS (SELECT test_id, array_to_string(list_filter([CASE WHEN tr AND NOT settled THEN 'not_settled_at_window_end' END, CASE WHEN wrong_direction THEN 'wrong_direction' END], lambda x: x IS NOT NULL), ',') AS gaps,
  array_to_string(list_filter([CASE WHEN wrong_direction THEN 'direction' END, CASE WHEN tr AND (delay IS NULL OR delay > 2) THEN 'response_delay' END, CASE WHEN tr AND (t90 IS NULL OR t90 > 8) THEN 't90' END,
    CASE WHEN tr AND abs(final_position - target) > 2 THEN 'final_position' END, CASE WHEN max_drift IS NOT NULL AND end_drift > 2 OR tr AND NOT settled THEN 'settled' END, CASE WHEN tr AND rb > 5 THEN 'max_rebound' END,
    CASE WHEN max_drift > 2 THEN 'drift' END, CASE WHEN judged AND kpa_end > 50 THEN 'pressure_residual' END, CASE WHEN judged AND decay < 90 THEN 'pressure_decay' END], lambda x: x IS NOT NULL), ',') AS failed,
  array_to_string(list_filter([CASE WHEN tr AND delay IS NULL THEN 'no_movement' END, CASE WHEN nr > 0 THEN 'rebound' END, CASE WHEN nst > 0 THEN 'mid_travel_stall' END], lambda x: x IS NOT NULL), ',') AS issues FROM al)
SELECT *, CASE WHEN gaps <> '' THEN 'no_conclusion' WHEN failed <> '' OR issues <> '' THEN 'fail' ELSE 'pass' END AS verdict FROM vv""")  # fmt: skip
def trip_verdicts(spark, sf_dir):
    """The whole fail-safe analysis, from grid to verdict."""
    return failsafe.analyse(grid(spark, sf_dir), trips(spark, sf_dir), KEYS, STEP_S).select("test_id", "gaps", "failed", "issues", "verdict")


def samples(spark, sf_dir):
    """Commands of every test: 60 %, lost by half a second before the trip for some."""
    z, i = F.col("p_size"), F.col("i")
    part = sampled(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", 60)
    lost = F.when((i >= 46 + z % 6) & (z % 2 == 0), 20.0).otherwise(60.0 + i % 3)
    return part.select(F.col("p_partkey").alias("test_id"), i.alias("idx"), (i / 10.0).alias("t"), lost.alias("v"))


@query("trip_command_loss", """WITH s AS (SELECT p_partkey AS test_id, i / 10.0::DOUBLE AS t, CASE WHEN i >= 46 + p_size % 6 AND p_size % 2 = 0 THEN 20.0 ELSE 60.0 + i % 3 END::DOUBLE AS v FROM part, range(60) x(i)),
b AS (SELECT test_id, percentile_disc(0.5) WITHIN GROUP (ORDER BY v) AS baseline FROM s WHERE t >= 4.0 AND t < 5.0 - 0.6::DOUBLE GROUP BY test_id)
SELECT test_id, baseline, max(t) FILTER (WHERE abs(v - baseline) >= 5) AS t_loss, 5.0 - max(t) FILTER (WHERE abs(v - baseline) >= 5) AS lead FROM s JOIN b USING (test_id) WHERE t < 5 GROUP BY ALL""")  # fmt: skip
def trip_command_loss(spark, sf_dir):
    """Last command sample before the trip that has left its baseline, and its lead."""
    return failsafe.command_loss(samples(spark, sf_dir), trips(spark, sf_dir), KEYS)


def bits(spark, sf_dir):
    """Trip contacts: one pulse, some chatter, some come again."""
    z, i = F.col("p_size"), F.col("i")
    part = sampled(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", 200)
    on = i.between(50, 120) & ~((z % 3 == 0) & (i == 53)) & ~((z % 5 == 0) & i.between(80, 90))
    return part.select(F.col("p_partkey").alias("test_id"), i.alias("idx"), (i / 10.0).alias("t"), on.cast("int").alias("bit"))


@query("trip_location", """WITH b AS (SELECT p_partkey AS test_id, p_size AS z, i / 10.0::DOUBLE AS t, i BETWEEN 50 AND 120 AND NOT (p_size % 3 = 0 AND i = 53) AND NOT (p_size % 5 = 0 AND i BETWEEN 80 AND 90) AS o, i FROM part, range(200) x(i)),
n AS (SELECT *, CASE WHEN o = lag(o) OVER (PARTITION BY test_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM b), r AS (SELECT *, sum(new) OVER (PARTITION BY test_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM n),
p AS (SELECT test_id, run, min(t) AS a, max(t) AS e FROM r WHERE o GROUP BY ALL), c AS (SELECT *, CASE WHEN a - lag(e) OVER (PARTITION BY test_id ORDER BY a) <= 0.25 THEN 0 ELSE 1 END AS new FROM p),
d AS (SELECT *, sum(new) OVER (PARTITION BY test_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS cl FROM c)
SELECT test_id, min(a) AS trip_time, count(*) FILTER (WHERE cl = 1) > 1 AS chatter, max(cl) - 1 AS retriggers FROM d GROUP BY test_id""")  # fmt: skip
def trip_location(spark, sf_dir):
    """Trip times from the contact's pulses."""
    return failsafe.locate_trip(bits(spark, sf_dir), KEYS)


@query("trip_edges", """WITH b AS (SELECT p_partkey AS test_id, i AS idx, i / 10.0::DOUBLE AS t, (i BETWEEN 50 AND 120 AND NOT (p_size % 3 = 0 AND i = 53) AND NOT (p_size % 5 = 0 AND i BETWEEN 80 AND 90))::INT AS bit FROM part, range(200) x(i)),
e AS (SELECT *, lag(bit) OVER (PARTITION BY test_id ORDER BY idx) AS before FROM b) SELECT test_id, idx, t, bit FROM e WHERE before = 0 AND bit = 1""")  # fmt: skip
def trip_edges(spark, sf_dir):
    """Rising edges of the trip contact."""
    return failsafe.rising_edges(bits(spark, sf_dir), KEYS)


@query("trip_manual", """WITH t AS (SELECT p_partkey AS test_id, 4.9 + p_size % 4 * 0.1 AS trip_time, CASE WHEN p_size % 3 = 0 THEN [5.0, 5.4] ELSE [5.0] END || CASE WHEN p_size % 5 = 0 THEN [9.1] ELSE [] END AS es FROM part)
SELECT test_id, trip_time::DOUBLE AS trip_time, list_min(list_transform(es, lambda e: abs(e - trip_time))) <= 0.1 AS bracketed FROM t""")  # fmt: skip
def trip_manual(spark, sf_dir):
    """Manual trip times, and whether an edge of the contact stands by them."""
    at = F.round(F.lit(4.9) + F.col("p_size") % 4 * 0.1, 1)
    manual = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("test_id"), at.alias("trip_time"))
    return failsafe.manual_trip(failsafe.rising_edges(bits(spark, sf_dir), KEYS), manual, KEYS, F.lit(0.1 + 1e-9))


@query("trip_frozen", """WITH f AS (SELECT p_partkey AS test_id, (3 + p_size % 5)::DOUBLE AS a, (3 + p_size % 5 + 3)::DOUBLE AS b, (p_size % 7)::DOUBLE AS v, CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN 100 ELSE 5 END AS target FROM part)
SELECT test_id, a AS start_at, b AS end_at, v AS value, CASE WHEN greatest(0, least(b, 5) - a) > (b - a) / 2 OR abs(v - target) <= 2 THEN 'in_band_platform' ELSE 'frozen' END AS kind FROM f""")  # fmt: skip
def trip_frozen(spark, sf_dir):
    """Frozen stretches, harmless before the trip and in the safe band."""
    z = F.col("p_size")
    frozen = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("test_id"), (3 + z % 5).cast("double").alias("start_at"), (6 + z % 5).cast("double").alias("end_at"), (z % 7).cast("double").alias("value"))
    t = trips(spark, sf_dir)
    return failsafe.benign_frozen(frozen, t, t.select("test_id", F.lit(5.0).alias("p0")), KEYS)


@query("trip_position_loss", """SELECT p_partkey AS test_id, round((least(25.0, 4 + p_size / 2.0) - 5) / 20, 6) AS share, (least(25.0, 4 + p_size / 2.0) - 5) / 20 > 1 - 0.8::DOUBLE AS lost FROM part WHERE p_size > 2
UNION ALL SELECT p_partkey, 0.0, false FROM part WHERE p_size <= 2""")  # fmt: skip
def trip_position_loss(spark, sf_dir):
    """Share of the observation window without a usable position."""
    events = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("test_id"), F.lit(4.0).alias("start_at"), (4 + F.col("p_size") / 2.0).alias("end_at"))
    return failsafe.position_loss(events, trips(spark, sf_dir), KEYS)
