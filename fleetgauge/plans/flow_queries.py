"""Flow-curve analysis with its default limits, over records made from the customer table.

One test per customer: eight plateaus from 10 to 80 %, 16 s each, at 2 Hz.  The
nation sets characteristic, capacity, pressures, temperature and faults; some
plateaus have a small step inside.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.operators import flowcurve
from fleetgauge.plans.registry import query, sampled, table
from fleetgauge.sources.held import hold

KEYS = ["test_id"]
STEP_S = 0.5


def valves(spark, sf_dir):
    n = F.col("c_nationkey")
    kind = F.get(F.array(F.lit("linear"), F.lit("equal_percentage"), F.lit("quick_opening")), n % 3)
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("test_id"), F.lit(101.325).alias("atm"), F.when(n != 11, 998.0).alias("density"), F.lit(2.34).alias("pv"), F.lit(22120.0).alias("pc"),
        F.lit(0.9).alias("recovery"), F.lit(20.0).alias("ref_c"), F.lit(15.0).alias("band_c"), F.lit(80.0).alias("full_scale"), kind.alias("kind"), F.lit(50.0).alias("rated_cv"), F.lit(50.0).alias("ratio"),
    )


def grid(spark, sf_dir):
    """(test_id, i, t, position, flow, p1, p2, temperature)."""
    n, key, i = F.col("c_nationkey"), F.col("c_custkey"), F.col("i")
    rows = sampled(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey", 256)
    level, inside = F.floor(i / 32), i % 32
    step = F.when(inside >= 16, 1.0).otherwise(0.0) * F.when((key % 5 == 0) & (level == 2), 1.2).when((key % 7 == 0) & (level == 4), 3.0).otherwise(0.0)
    rows = rows.withColumn("position", (level + 1) * 10.0 + F.greatest(inside - 27, F.lit(0)) * 2.0 + F.when(inside < 28, step).otherwise(0.0))
    p1 = F.lit(500.0) + n
    p2 = F.when(n == 3, p1 - 10).when(n == 6, F.lit(20.0)).otherwise(300.0)
    x = F.when(n % 9 == 4, 100 - F.col("position")).otherwise(F.col("position")) / 100
    share = F.when(n % 3 == 0, x).when(n % 3 == 1, F.pow(F.lit(50.0), x - 1)).otherwise(F.sqrt(x))
    flow = (0.7 + n % 8 * 0.1) * 50 * share * 0.865 * F.sqrt((p1 - p2) / 100 / (998.0 / 999))
    noise = F.when((key % 11 == 0) & (level == 1), (i % 2) * 0.3 * flow).otherwise(0.0)
    return rows.select(key.alias("test_id"), i.cast("long").alias("i"), (i * 0.5).alias("t"), "position", (flow + noise).alias("flow"), p1.alias("p1"), p2.alias("p2"), (F.lit(20.0) + n % 4 * 6).alias("temperature"))


def velocity():
    return flowcurve.window_velocity(KEYS, "position", STEP_S)


PLATEAU_SQL = """c AS (SELECT c_custkey AS test_id, c_nationkey AS n, i, i // 32 AS lv, i % 32 AS ins FROM customer, range(256) x(i)),
c2 AS (SELECT *, i * 0.5::DOUBLE AS t, ((lv + 1) * 10 + greatest(ins - 27, 0) * 2 + CASE WHEN ins BETWEEN 16 AND 27 THEN CASE WHEN test_id % 5 = 0 AND lv = 2 THEN 1.2 WHEN test_id % 7 = 0 AND lv = 4 THEN 3.0 ELSE 0 END ELSE 0 END)::DOUBLE AS position,
  (500 + n)::DOUBLE AS p1, (CASE n WHEN 3 THEN 490 + n WHEN 6 THEN 20 ELSE 300 END)::DOUBLE AS p2, (20 + n % 4 * 6)::DOUBLE AS temperature FROM c),
c3 AS (SELECT *, CASE WHEN n % 9 = 4 THEN 100 - position ELSE position END / 100 AS x FROM c2),
c4 AS (SELECT *, (0.7 + n % 8 * 0.1)::DOUBLE * 50 * CASE n % 3 WHEN 0 THEN x WHEN 1 THEN pow(50.0::DOUBLE, x - 1) ELSE sqrt(x) END * 0.865::DOUBLE * sqrt((p1 - p2) / 100 / (998.0::DOUBLE / 999)) AS f0 FROM c3),
g AS (SELECT *, f0 + CASE WHEN test_id % 11 = 0 AND lv = 1 THEN i % 2 * 0.3 * f0 ELSE 0 END AS flow FROM c4),
v AS (SELECT *, (last_value(position) OVER w - first_value(position) OVER w) / (last_value(t) OVER w - first_value(t) OVER w) AS vel FROM g WINDOW w AS (PARTITION BY test_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
vn AS (SELECT *, abs(vel) <= 0.5 AS st, CASE WHEN (abs(vel) <= 0.5) = lag(abs(vel) <= 0.5) OVER (PARTITION BY test_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM v),
vr AS (SELECT *, sum(new) OVER (PARTITION BY test_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM vn),
sr AS (SELECT test_id, min(i) AS a, max(i) AS b FROM vr WHERE st GROUP BY test_id, run HAVING max(t) - min(t) >= 3),
sm AS (SELECT sr.*, (SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY position DESC) FROM g WHERE g.test_id = sr.test_id AND g.i BETWEEN a AND b) AS md FROM sr),
sn AS (SELECT *, CASE WHEN a * 0.5 - lag(b) OVER w * 0.5 <= 1.5 AND abs(md - lag(md) OVER w) <= 2 THEN 0 ELSE 1 END AS new FROM sm WINDOW w AS (PARTITION BY test_id ORDER BY a)),
sg AS (SELECT *, sum(new) OVER (PARTITION BY test_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS grp FROM sn),
pl0 AS (SELECT test_id, grp - 1 AS plateau, min(a) AS i_start, max(b) AS i_end FROM sg GROUP BY test_id, grp),
pl1 AS (SELECT p.*, i_start * 0.5::DOUBLE AS t_start, i_end * 0.5::DOUBLE AS t_end, (SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY position DESC) FROM g WHERE g.test_id = p.test_id AND g.i BETWEEN i_start AND i_end) AS position FROM pl0 p),
pl AS (SELECT *, CASE WHEN coalesce(lead(position) OVER w >= position, position >= lag(position) OVER w, true) THEN 'ascending' ELSE 'descending' END AS direction FROM pl1 WINDOW w AS (PARTITION BY test_id ORDER BY plateau))"""


@query("flow_plateaus", f"WITH {PLATEAU_SQL} SELECT test_id, plateau, i_start, i_end, t_start, t_end, position, direction FROM pl")
def flow_plateaus(spark, sf_dir):
    """Steady plateaus, neighbours with nearly the same position merged."""
    return flowcurve.plateaus(grid(spark, sf_dir), KEYS, velocity())


POINT_SQL = f"""{PLATEAU_SQL},
ps AS (SELECT p.test_id, p.plateau, any_value(n) AS n, any_value(t_start) AS t_start, any_value(t_end) AS t_end, any_value(direction) AS direction, count(*) AS n_points, round(median(g.position), 4) AS position, round(max(g.position) - min(g.position), 4) AS peak_to_peak,
  round(median(flow) FILTER (WHERE t >= t_start + 0.5 OR i = i_end), 6) AS flow, round(stddev_pop(flow) FILTER (WHERE t >= t_start + 0.5 OR i = i_end) / abs(avg(flow) FILTER (WHERE t >= t_start + 0.5 OR i = i_end)) * 100, 3) AS flow_cv,
  round(median(p1), 3) AS p1, round(median(p2), 3) AS p2, round(median(temperature), 3) AS temperature FROM pl p JOIN g ON g.test_id = p.test_id AND i BETWEEN i_start AND i_end GROUP BY p.test_id, p.plateau),
cc AS (SELECT *, CASE WHEN flow <= 0 THEN 'nonpositive_flow' WHEN p1 - p2 <= 0 THEN 'insufficient_differential_pressure' WHEN abs(temperature - 20) > 15 THEN 'property_out_of_range' WHEN n = 11 THEN 'property_missing'
  WHEN p1 - p2 > 0.81 * (p1 + 101.325 - (0.96 - 0.28 * sqrt(2.34 / 22120.0)) * 2.34) THEN CASE WHEN p2 + 101.325 < 2.34 THEN 'flashing' ELSE 'cavitation' END END AS code FROM ps),
cd AS (SELECT *, list_filter([CASE WHEN n_points < 3 OR t_end - t_start < 3 THEN 'plateau_too_short' END, CASE WHEN plateau = 7 AND test_id % 13 = 0 THEN 'manual_disabled' END, CASE WHEN peak_to_peak > 1.5 OR flow_cv > 5 THEN 'plateau_drift' END,
  CASE WHEN flow <= 0 THEN 'nonpositive_flow' WHEN flow >= 80 THEN 'flow_overrange' END, code, CASE WHEN p1 - p2 > 0 AND p1 - p2 < 20 AND coalesce(code NOT IN ('flashing', 'cavitation'), true) THEN 'insufficient_differential_pressure' END], lambda x: x IS NOT NULL) AS codes FROM cc),
pt AS (SELECT *, len(codes) = 0 AS adopted, CASE WHEN len(codes) = 0 THEN round(flow / (0.865 * sqrt((p1 - p2) / 100 / (998 / 999.0))), 4) END AS cv FROM cd)"""


def disabled(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_custkey % 13 = 0").select(F.col("c_custkey").alias("test_id"), F.lit(7).alias("plateau"))


def points(spark, sf_dir):
    found = flowcurve.plateaus(grid(spark, sf_dir), KEYS, velocity())
    stats = flowcurve.statistics(grid(spark, sf_dir), found, KEYS)
    return flowcurve.convert(stats, valves(spark, sf_dir), KEYS, disabled(spark, sf_dir))


@query("flow_points", f"WITH {POINT_SQL} SELECT test_id, plateau, n_points, position, peak_to_peak, round(flow, 4) AS flow, round(flow_cv, 2) AS flow_cv, array_to_string(codes, ',') AS codes, adopted, round(cv, 3) AS cv FROM pt")
def flow_points(spark, sf_dir):
    """Statistics, exclusion codes and coefficients of the plateaus."""
    p = points(spark, sf_dir).withColumn("codes", F.array_join("codes", ","))
    return p.select("test_id", "plateau", "n_points", "position", "peak_to_peak", F.round("flow", 4).alias("flow"), F.round("flow_cv", 2).alias("flow_cv"), "codes", "adopted", F.round("cv", 3).alias("cv"))


def _share(x: str) -> str:
    return f"CASE n % 3 WHEN 0 THEN {x} / 100 WHEN 1 THEN pow(50.0::DOUBLE, {x} / 100 - 1) ELSE sqrt({x} / 100) END"


CURVE_SQL = f"""{POINT_SQL},
ff AS (SELECT *, {_share("position")} AS f, {_share("(100 - position)")} AS gm, cv + 1e-9 < lag(cv) OVER (PARTITION BY test_id ORDER BY position, plateau) AS falls,
  rank() OVER (PARTITION BY test_id ORDER BY position) + (count(*) OVER (PARTITION BY test_id, position) - 1) / 2 AS rx, rank() OVER (PARTITION BY test_id ORDER BY cv) + (count(*) OVER (PARTITION BY test_id, cv) - 1) / 2 AS ry FROM pt WHERE adopted),
fk AS (SELECT *, sum(cv * f) OVER w / sum(50 * f * f) OVER w AS k, sum(cv * gm) OVER w / sum(50 * gm * gm) OVER w AS km FROM ff WINDOW w AS (PARTITION BY test_id)),
cu AS (SELECT test_id, count(*) AS n_adopted, any_value(k) AS k0, sqrt(avg(pow(cv - k * 50 * f, 2))) AS r0, sqrt(avg(pow(cv - km * 50 * gm, 2))) AS rm0,
  round(min((cv - k * 50 * f) / (k * 50 * f) * 100), 2) AS residual_low, round(max((cv - k * 50 * f) / (k * 50 * f) * 100), 2) AS residual_high, count(*) FILTER (WHERE falls) AS inversions, round(max(cv) / min(cv), 2) AS turndown,
  CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN corr(rx, ry) END AS rho0 FROM fk GROUP BY test_id HAVING count(*) >= 3),
cv_ AS (SELECT *, round(k0, 4) AS capacity_factor, round(r0 / (50 * k0) * 100, 2) AS rmse_pct, round(r0, 4) AS rmse, round(rm0, 4) AS rmse_mirrored, coalesce(rho0 >= 0.9 AND inversions = 0, false) AS monotonic, round(rho0, 3) AS rho FROM cu),
cs AS (SELECT *, list_filter([CASE WHEN rmse_pct <= 15 AND capacity_factor < 0.85 THEN 'blockage' END, CASE WHEN rmse_pct <= 15 AND capacity_factor > 1.15 THEN 'erosion' END,
  CASE WHEN (rmse > 0 AND rmse_mirrored < 0.6 * rmse) OR coalesce(rho <= -0.9, false) THEN 'reversed_installation' END], lambda x: x IS NOT NULL) AS sus,
  residual_low >= -15 AND residual_high <= 15 AND monotonic AND (rmse_pct > 15 OR capacity_factor BETWEEN 0.85 AND 1.15) AS checks_pass FROM cv_)"""


@query("flow_curves", f"""WITH {CURVE_SQL} SELECT test_id, n_adopted, round(capacity_factor, 3) AS capacity_factor, round(rmse_pct, 1) AS rmse_pct, round(residual_low, 1) + 0.0 AS residual_low, round(residual_high, 1) + 0.0 AS residual_high,
  inversions, round(turndown, 1) AS turndown, rho, monotonic, array_to_string(sus, ',') AS suspects, checks_pass FROM cs""")  # fmt: skip
def flow_curves(spark, sf_dir):
    """Fitted characteristic of every test, its residuals and suspects."""
    # A fit reads its points four times, and they are few: eight of 256 samples.
    c = flowcurve.fit(hold(points(spark, sf_dir), "points"), KEYS)
    return c.select(
        "test_id", "n_adopted", F.round("capacity_factor", 3).alias("capacity_factor"), F.round("rmse_pct", 1).alias("rmse_pct"), (F.round("residual_low", 1) + 0.0).alias("residual_low"), (F.round("residual_high", 1) + 0.0).alias("residual_high"),
        "inversions", F.round("turndown", 1).alias("turndown"), "rho", "monotonic", F.array_join("suspects", ",").alias("suspects"), "checks_pass",
    )


@query("flow_verdicts", f"""WITH {CURVE_SQL}, ms AS (SELECT test_id, count(*) FILTER (WHERE list_contains(codes, 'property_missing')) AS m FROM pt GROUP BY test_id),
bo AS (SELECT c_custkey AS test_id, CASE WHEN m IS NULL THEN 'no_plateau' WHEN checks_pass IS NULL THEN 'insufficient_adopted_points' WHEN m > 0 THEN 'property_missing' END AS blocking, coalesce(array_to_string(sus, ','), '') AS suspects, sus, checks_pass
  FROM customer LEFT JOIN ms ON ms.test_id = c_custkey LEFT JOIN cs ON cs.test_id = c_custkey)
SELECT test_id, blocking, suspects, CASE WHEN blocking IS NOT NULL THEN 'no_conclusion' WHEN len(sus) > 0 OR NOT checks_pass THEN 'suspect' ELSE 'matches_nameplate' END AS verdict FROM bo""")  # fmt: skip
def flow_verdicts(spark, sf_dir):
    """The whole flow-curve analysis, from grid to verdict."""
    return flowcurve.analyse(grid(spark, sf_dir), valves(spark, sf_dir), KEYS, velocity(), disabled(spark, sf_dir))["verdicts"]
