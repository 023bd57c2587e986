"""Seat-leak analysis with its default limits, over hold records made from the customer table.

One test per customer: 190 s at 1 Hz, isolated at 20 s.  The nation sets the
leak, temperatures and faults; some record the hold's start and end.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.operators import seatleak
from fleetgauge.plans.registry import query, sampled, table
from fleetgauge.sources.held import hold

KEYS = ["test_id"]


def tests(spark, sf_dir):
    def point(t, p, r):
        return F.struct(F.lit(t).alias("temp_c"), F.lit(p).alias("pressure_kpa"), F.lit(r).alias("rate"))

    blank = F.array(point(18.0, 190.0, 0.2), point(30.0, 260.0, 0.5))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("test_id"), F.lit(0.01).alias("volume_m3"), F.lit(1.0).alias("z"), F.lit(0.0).alias("ref_c"), F.lit(101.325).alias("ref_kpa"), F.lit(1).alias("sign"), blank.alias("blank")
    )


def grid(spark, sf_dir):
    """(test_id, i, t, position, p_up, p_down, temp)."""
    k, n, i = F.col("c_custkey"), F.col("c_nationkey"), F.col("i")
    rows = sampled(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey", 190)
    temp = 20.0 + 40.0 / (i + 10) + F.when(n % 6 == 5, i * 0.02).otherwise(0.0)
    leak = F.greatest(i - 20, F.lit(0)) * (n * 0.02) / 60.0 * F.when((n == 20) & (i > 120), 3.0).otherwise(1.0)
    position = F.when(n == 8, 3.0).otherwise(0.5) + F.when((n == 9) & (i > 150), 0.8).otherwise(0.0) + k % 3 * 0.01
    p_up = F.when(n == 7, 250.0).otherwise(700.0)
    p_down = 200.0 + leak * 10 + F.when(n == 10, 90.0).otherwise(0.0) + (i % 3) * 0.001
    return rows.select(k.alias("test_id"), i.cast("long").alias("i"), i.cast("double").alias("t"), position.alias("position"), p_up.alias("p_up"), p_down.alias("p_down"), temp.alias("temp"))


def actions(spark, sf_dir):
    """Isolation records: in order for most, repeated, out of order or vented for some."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")

    def act(t, name, when=None):
        s = F.struct(F.lit(t).cast("double").alias("t"), F.lit(name).alias("action"))
        return s if when is None else F.when(when, s)

    listed = F.array_compact(F.array(
        act(2, "close_command"), F.when(n == 12, act(1, "valve_closed")).otherwise(act(8, "valve_closed")), act(20, "downstream_isolated"), act(80, "hold_start", k % 2 == 0), act(170, "hold_end", k % 4 == 0),
        act(30, "downstream_isolated", n == 13), act(100, "vent_opened", n == 14), act(185, "upstream_isolated", n == 15),
    ))
    return table(spark, sf_dir, "customer").select(k.alias("test_id"), F.posexplode(listed).alias("idx", "x")).select("test_id", "idx", "x.*")


def coverage(spark, sf_dir):
    return tests(spark, sf_dir).select("test_id", F.when(F.col("test_id") % 37 == 0, 0.7).otherwise(1.0).alias("coverage"))


ISOLATION_SQL = """iso AS (SELECT c_custkey AS test_id, c_nationkey AS n, 2.0::DOUBLE AS t_close_command, CASE c_nationkey WHEN 12 THEN 1.0 ELSE 8.0 END::DOUBLE AS t_valve_closed, 20.0::DOUBLE AS t_downstream_isolated,
  CASE WHEN c_custkey % 2 = 0 THEN 80.0 END::DOUBLE AS t_hold_start, CASE WHEN c_custkey % 4 = 0 THEN 170.0 END::DOUBLE AS t_hold_end,
  CASE WHEN c_nationkey IN (12, 13, 14) OR (c_nationkey = 15 AND c_custkey % 4 <> 0) THEN 1 ELSE 0 END AS conflicts FROM customer)"""


@query("leak_isolation", f"WITH {ISOLATION_SQL} SELECT * EXCLUDE (n) FROM iso")
def leak_isolation(spark, sf_dir):
    """First times of the isolation's actions, and its conflicts."""
    return seatleak.isolation(actions(spark, sf_dir), KEYS)


SEGMENT_SQL = f"""{ISOLATION_SQL},
g AS (SELECT c_custkey AS test_id, c_nationkey AS n, i, i::DOUBLE AS t, CASE c_nationkey WHEN 8 THEN 3.0 ELSE 0.5 END::DOUBLE + CASE WHEN c_nationkey = 9 AND i > 150 THEN 0.8 ELSE 0 END + c_custkey % 3 * 0.01::DOUBLE AS position,
  CASE c_nationkey WHEN 7 THEN 250.0 ELSE 700.0 END::DOUBLE AS p_up, 200.0::DOUBLE + greatest(i - 20, 0) * (c_nationkey * 0.02::DOUBLE) / 60.0::DOUBLE * CASE WHEN c_nationkey = 20 AND i > 120 THEN 3.0 ELSE 1.0 END * 10 + CASE c_nationkey WHEN 10 THEN 90.0 ELSE 0.0 END + i % 3 * 0.001::DOUBLE AS p_down,
  20.0::DOUBLE + 40.0::DOUBLE / (i + 10) + CASE WHEN c_nationkey % 6 = 5 THEN i * 0.02::DOUBLE ELSE 0 END AS temp FROM customer, range(190) x(i)),
sl AS (SELECT *, CASE WHEN count(*) OVER w >= 3 AND max(t) OVER w - min(t) OVER w >= 12 THEN abs(regr_slope(temp, t / 60) OVER w) END AS steep FROM g WINDOW w AS (PARTITION BY test_id ORDER BY i ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)),
sw AS (SELECT *, max(steep) OVER (PARTITION BY test_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS worst FROM sl),
cm AS (SELECT test_id, min(i) FILTER (WHERE i >= 20 AND steep <= 0.5 AND worst <= 1.0) AS calm FROM sw GROUP BY test_id),
sg AS (SELECT test_id, n, 20 AS i_iso, coalesce(t_hold_start::BIGINT, calm) AS i_hold, coalesce(t_hold_end::BIGINT, 189) AS i_end, CASE WHEN t_hold_start IS NOT NULL THEN 'declared' WHEN calm IS NOT NULL THEN 'calm' END AS start, conflicts FROM iso JOIN cm USING (test_id)),
sgg AS (SELECT *, list_filter([CASE WHEN i_hold IS NULL THEN 'stabilization_not_reached' END, CASE WHEN i_hold - 1 - i_iso < 15 THEN 'stabilization_too_short' END, CASE WHEN i_end - i_hold < 60 THEN 'hold_too_short' END], lambda x: x IS NOT NULL) AS gaps FROM sg)"""


@query("leak_segments", f"WITH {SEGMENT_SQL} SELECT test_id, i_iso, i_hold, i_end, i_iso::DOUBLE AS t_iso, i_hold::DOUBLE AS t_hold, i_end::DOUBLE AS t_end, start, array_to_string(gaps, ',') AS gaps FROM sgg")
def leak_segments(spark, sf_dir):
    """Stabilisation and hold of every test."""
    found = seatleak.delineate(grid(spark, sf_dir), seatleak.isolation(actions(spark, sf_dir), KEYS), KEYS)
    return found.withColumn("gaps", F.array_join("gaps", ","))


def moves(spark, sf_dir):
    k = F.col("c_custkey")
    steps = F.array(F.struct(F.lit(1).alias("seq"), F.lit("hold").alias("boundary"), F.lit(90.2).alias("new_time")), F.struct(F.lit(2).alias("seq"), F.lit("end").alias("boundary"), F.when(k % 5 == 0, 85.0).otherwise(160.0).alias("new_time")))
    return table(spark, sf_dir, "customer").where(k % 3 == 0).select(k.alias("test_id"), F.explode(steps).alias("x")).select("test_id", "x.*")


@query("leak_moved", f"""WITH {SEGMENT_SQL} SELECT test_id, i_iso, CASE WHEN test_id % 3 = 0 AND i_hold IS NOT NULL OR test_id % 3 = 0 THEN 90 ELSE i_hold END AS i_hold, CASE WHEN test_id % 3 = 0 AND test_id % 5 <> 0 THEN 160 ELSE i_end END AS i_end FROM sgg""")
def leak_moved(spark, sf_dir):
    """Segments after manual moves; those that would pass a neighbour stay."""
    g = grid(spark, sf_dir)
    found = seatleak.delineate(g, seatleak.isolation(actions(spark, sf_dir), KEYS), KEYS)
    return seatleak.move_boundaries(found, g, moves(spark, sf_dir), KEYS).select("test_id", "i_iso", "i_hold", "i_end")


def rows(spark, sf_dir):
    g = grid(spark, sf_dir)
    segs = seatleak.delineate(g, seatleak.isolation(actions(spark, sf_dir), KEYS), KEYS)
    return seatleak.hold_rows(g, segs, tests(spark, sf_dir), KEYS)


BALANCE_SQL = f"""{SEGMENT_SQL},
h0 AS (SELECT g.*, i_hold, i_end, g.i >= i_hold AS inh FROM g JOIN sgg USING (test_id) WHERE i_hold IS NOT NULL AND g.i <= i_end),
h1 AS (SELECT *, avg(temp) FILTER (WHERE inh) OVER (PARTITION BY test_id) AS tm, 0.01::DOUBLE * 1000 * 273.15::DOUBLE / 101.325::DOUBLE AS cf FROM h0),
h2 AS (SELECT *, CASE WHEN tm <= 18 THEN 0.2 WHEN tm >= 30 THEN 0.5 ELSE 0.2 + (tm - 18) / 12 * 0.3::DOUBLE END * cf / (tm + 273.15) AS qb, p_down * cf / (temp + 273.15) AS veq FROM h1),
h3 AS (SELECT *, veq - qb * (t - i_hold) / 60 AS net FROM h2),
h4 AS (SELECT *, round(net - max(CASE WHEN i = i_hold THEN net END) OVER (PARTITION BY test_id), 6) AS cum, CASE WHEN count(*) OVER w >= 3 AND max(t) OVER w - min(t) OVER w >= 12 THEN regr_slope(net, t / 60) OVER w END AS rate FROM h3 WINDOW w AS (PARTITION BY test_id ORDER BY i ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)),
ba AS (SELECT test_id, regr_slope(net, (t - i_hold) / 60) AS rate_mean, max(rate) AS rate_max, arg_max(cum, i) AS cumulative, any_value(qb) AS qb, any_value(tm) AS tm, max(t) - min(t) AS hold_s FROM h4 WHERE inh GROUP BY test_id)"""


@query("leak_balance", f"WITH {BALANCE_SQL} SELECT test_id, round(round(rate_mean, 6), 4) + 0.0 AS rate_mean, round(round(rate_max, 6), 4) + 0.0 AS rate_max, round(round(cumulative, 6), 4) + 0.0 AS cumulative, round(round(qb, 6), 4) AS blank_nl_min, round(tm, 3) AS temp_mean, hold_s FROM ba")
def leak_balance(spark, sf_dir):
    """Mass balance of the hold, less the blank."""
    found = seatleak.balance(rows(spark, sf_dir), KEYS)
    return found.select("test_id", *[(F.round(n, 4) + 0.0).alias(n) for n in ("rate_mean", "rate_max", "cumulative")], F.round("blank_nl_min", 4).alias("blank_nl_min"), "temp_mean", "hold_s")


@query("leak_exceedance", f"""WITH {BALANCE_SQL},
e AS (SELECT *, min(rate) OVER w > 0.05 AND max(t) OVER w - t >= 10 - 1e-9 AND rate > 0.05 AS hit FROM h4 WHERE inh WINDOW w AS (PARTITION BY test_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING)),
f AS (SELECT test_id, min(t) FILTER (WHERE hit) AS a, min(t) FILTER (WHERE cum > 0.2) AS b, arg_min(rate, i) FILTER (WHERE hit) AS av, arg_min(cum, i) FILTER (WHERE cum > 0.2) AS bv FROM e GROUP BY test_id)
SELECT test_id, CASE WHEN b IS NULL OR a <= b THEN a ELSE b END AS t, CASE WHEN b IS NULL OR a <= b THEN 'leak_rate' ELSE 'cumulative_leak' END AS kind, round(round(CASE WHEN b IS NULL OR a <= b THEN av ELSE bv END, 6), 4) AS value FROM f WHERE a IS NOT NULL OR b IS NOT NULL""")  # fmt: skip
def leak_exceedance(spark, sf_dir):
    """When a test first leaks too much."""
    return seatleak.first_exceedance(rows(spark, sf_dir), KEYS).withColumn("value", F.round("value", 4))


GATE_SQL = """gt AS (SELECT test_id, round(max(position) FILTER (WHERE i = 20), 3) AS pi, max(position) FILTER (WHERE inh) AS pm, max(position) FILTER (WHERE inh) - min(position) FILTER (WHERE inh) AS pr, round(median(p_up - p_down) FILTER (WHERE inh), 2) AS dp, round(min(p_up - p_down) FILTER (WHERE inh), 2) AS dmin,
  min(temp) FILTER (WHERE inh) AS tl, max(temp) FILTER (WHERE inh) AS th, min(p_down) FILTER (WHERE inh) AS pl, max(p_down) FILTER (WHERE inh) AS ph, CASE WHEN test_id % 37 = 0 THEN 0.7 ELSE 1.0 END::DOUBLE AS cov FROM h4 GROUP BY test_id),
gc AS (SELECT *, list_filter([CASE WHEN pi > 2 OR pm > 2 OR pr > 0.5 THEN 'closed_position_unstable' END, CASE WHEN dp < 100 THEN 'insufficient_differential_pressure' END, CASE WHEN cov < 0.9 THEN 'temperature_dropout' END,
  CASE WHEN NOT (tl >= 16 AND th <= 32 AND pl >= 170 AND ph <= 280) THEN 'blank_baseline_uncovered' END], lambda x: x IS NOT NULL) AS codes FROM gt)"""


@query("leak_gates", f"WITH {BALANCE_SQL}, {GATE_SQL} SELECT test_id, pi AS position_at_isolation, round(pm, 3) AS position_max, round(pr, 3) AS position_drift, dp AS dp_median, dmin AS dp_min, cov AS coverage, array_to_string(codes, ',') AS gaps FROM gc")
def leak_gates(spark, sf_dir):
    """Evidence that the hold gives, and what it lacks."""
    return seatleak.gates(rows(spark, sf_dir), KEYS, coverage(spark, sf_dir)).withColumn("gaps", F.array_join("gaps", ","))


def flow(spark, sf_dir, segs=None):
    """Metered flow at the hold's points (of known ``segs``, if given), for every third test."""
    r = rows(spark, sf_dir) if segs is None else seatleak.hold_rows(grid(spark, sf_dir), segs, tests(spark, sf_dir), KEYS)
    r = r.where("in_hold and test_id % 3 = 0")
    return r.select("test_id", (F.lit(0.02) + F.col("test_id") % 7 * 0.03 + F.col("i") % 2 * 0.01).alias("v"), F.when(F.col("test_id") % 4 == 1, 0.4).otherwise(0.9).alias("coverage"))


FLOW_SQL = """fm AS (SELECT test_id, avg(0.02::DOUBLE + test_id % 7 * 0.03::DOUBLE + i % 2 * 0.01::DOUBLE) AS m FROM h4 WHERE inh AND test_id % 3 = 0 AND test_id % 4 <> 1 GROUP BY test_id),
fx AS (SELECT test_id, m, abs(m - round(rate_mean, 6)) / greatest(0.05, abs(round(rate_mean, 6))) * 100 AS dev FROM fm JOIN ba USING (test_id))"""


@query("leak_cross_check", f"WITH {BALANCE_SQL}, {FLOW_SQL} SELECT test_id, round(round(m, 6), 4) AS flow_mean, round(round(dev, 2), 1) AS deviation, dev <= 25 AS agrees FROM fx")
def leak_cross_check(spark, sf_dir):
    """Metered flow against the mass balance."""
    found = seatleak.balance(rows(spark, sf_dir), KEYS)
    return seatleak.cross_check(flow(spark, sf_dir), found, KEYS).select("test_id", F.round("flow_mean", 4).alias("flow_mean"), F.round("deviation", 1).alias("deviation"), "agrees")


@query("leak_verdicts", f"""WITH {BALANCE_SQL}, {GATE_SQL}, {FLOW_SQL},
av AS (SELECT s.test_id, list_sort(list_distinct((CASE WHEN conflicts > 0 THEN ['isolation_sequence_conflict'] ELSE [] END) || s.gaps || coalesce(codes, []))) AS gs, round(rate_mean, 6) AS rm, cumulative, dev FROM sgg s LEFT JOIN gc ON gc.test_id = s.test_id LEFT JOIN ba ON ba.test_id = s.test_id LEFT JOIN fx ON fx.test_id = s.test_id)
SELECT test_id, array_to_string(gs, ',') AS gaps, round(round(rm, 6), 4) + 0.0 AS rate_mean, round(round(cumulative, 6), 4) + 0.0 AS cumulative, CASE WHEN len(gs) > 0 THEN 'no_conclusion' WHEN rm IS NULL OR rm > 0.05 OR cumulative > 0.2 OR coalesce(dev > 25, false) THEN 'fail' ELSE 'pass' END AS verdict FROM av""")  # fmt: skip
def leak_verdicts(spark, sf_dir):
    """The whole seat-leak analysis, from isolation record to verdict."""
    g, acts = grid(spark, sf_dir), actions(spark, sf_dir)
    segs = hold(seatleak.segments(g, seatleak.isolation(acts, KEYS), KEYS), "segments")
    found = seatleak.analyse(g, acts, tests(spark, sf_dir), coverage(spark, sf_dir), KEYS, flow(spark, sf_dir, segs), points=False, segs=segs)["verdicts"]
    return found.withColumn("rate_mean", F.round("rate_mean", 4) + 0.0).withColumn("cumulative", F.round("cumulative", 4) + 0.0)
