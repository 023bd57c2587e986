"""Queries that follow a record through contacts, segments, balances and comparisons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetgauge.functions import physics
from fleetgauge.operators import contacts, stats, stroke
from fleetgauge.plans.registry import SAMPLES_SQL, query, table
from fleetgauge.plans.series_queries import ALIGN_SQL, DAY, KEYS, aligned, channel, deadband_reversal, incomplete_travel, samples

BIT_SQL = f"""{SAMPLES_SQL},
b AS (SELECT *, CASE WHEN channel = 'error' THEN 1 - raw ELSE raw END AS bit FROM (SELECT *, CASE WHEN v / 100 <= 0.3 THEN 0 WHEN v / 100 >= 0.7 THEN 1 END AS raw FROM s))"""

ISLANDS_SQL = """n AS (SELECT *, CASE WHEN o IS DISTINCT FROM lag(o) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM f WINDOW w AS (PARTITION BY test_id, channel ORDER BY t, idx)),
g AS (SELECT *, sum(new) OVER (PARTITION BY test_id, channel ORDER BY t, idx ROWS UNBOUNDED PRECEDING) AS run FROM n)"""


def contact_samples(spark, sf_dir):
    kind = F.when(F.col("channel") == "error", "nc").otherwise("no")
    return contacts.bits_of(samples(spark, sf_dir), F.col("v") / 100, kind)


@query("illegal_contacts", f"""WITH {BIT_SQL}, f AS (SELECT *, bit IS NULL AS o FROM b), {ISLANDS_SQL}
SELECT test_id, channel, round(min(t), 6) AS start_at, round(max(t), 6) AS end_at, count(*) AS n, round(list_sum(list(v ORDER BY t, idx)[1:8]), 6) AS first_sum FROM g WHERE o GROUP BY test_id, channel, run""")  # fmt: skip
def illegal_contacts(spark, sf_dir):
    """Stretches of samples that are neither on nor off."""
    found = contacts.illegal_runs(contact_samples(spark, sf_dir), KEYS)
    first = F.aggregate("first_values", F.lit(0.0), lambda a, x: a + x)
    return found.select(*KEYS, F.round("start_at", 6).alias("start_at"), F.round("end_at", 6).alias("end_at"), "n", F.round(first, 6).alias("first_sum"))


@query("active_intervals", f"""WITH {BIT_SQL}, l AS (SELECT test_id, channel, t, idx, bit FROM b WHERE bit IS NOT NULL),
f AS (SELECT *, coalesce(bit = 1, false) AS o FROM b), {ISLANDS_SQL},
r AS (SELECT test_id, channel, min(t) AS a, max(t) AS z, max(idx) AS last_idx, count(*) AS n FROM g WHERE o GROUP BY test_id, channel, run),
x AS (SELECT r.test_id, r.channel, r.last_idx, min(l.idx) AS next_idx FROM r JOIN l ON l.test_id = r.test_id AND l.channel = r.channel AND l.idx > r.last_idx GROUP BY ALL)
SELECT r.test_id, r.channel, round(a, 6) AS start_at, round(z, 6) AS end_at, n, round(l.t, 6) AS active_until, l.bit = 0 AS released
FROM r LEFT JOIN x ON x.test_id = r.test_id AND x.channel = r.channel AND x.last_idx = r.last_idx LEFT JOIN l ON l.test_id = r.test_id AND l.channel = r.channel AND l.idx = x.next_idx""")  # fmt: skip
def active_intervals(spark, sf_dir):
    """Active stretches of each contact up to the next legal sample."""
    found = contacts.active_runs(contact_samples(spark, sf_dir), KEYS)
    return found.select(*KEYS, *[F.round(c, 6).alias(c) for c in ("start_at", "end_at", "active_until")], "n", "released")


@query("debounced_contacts", f"""WITH {BIT_SQL}, f AS (SELECT *, coalesce(bit = 1, false) AS o FROM b), {ISLANDS_SQL},
p AS (SELECT test_id, channel, min(t) AS a, max(t) AS z FROM g WHERE o GROUP BY test_id, channel, run),
q AS (SELECT *, CASE WHEN a - max(z) OVER (PARTITION BY test_id, channel ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 172800.0 THEN 0 ELSE 1 END AS fresh FROM p),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY test_id, channel ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS cluster FROM q)
SELECT test_id, channel, cluster::BIGINT AS cluster, round(min(a), 6) AS start_at, round(max(z), 6) AS end_at, count(*) AS pulses,
  CASE WHEN count(*) > 1 THEN 'chatter' WHEN max(z) - min(a) < 172800.0 THEN 'glitch' ELSE 'stable' END AS kind FROM c GROUP BY test_id, channel, cluster""")  # fmt: skip
def debounced_contacts(spark, sf_dir):
    """Contact intervals after a debounce of two days, with chatter and glitches."""
    found = contacts.debounced(contact_samples(spark, sf_dir), KEYS, 2 * DAY)
    return found.withColumn("start_at", F.round("start_at", 6)).withColumn("end_at", F.round("end_at", 6))


@query("window_entries", f"""WITH {SAMPLES_SQL}, f AS (SELECT *, coalesce(v BETWEEN 20 AND 60, false) AS o, lag(v) OVER (PARTITION BY test_id, channel ORDER BY t, idx) < 20 AS below FROM s), {ISLANDS_SQL}
SELECT test_id, channel, round(min(t), 6) AS start_at, round(max(t), 6) AS end_at, count(*) AS n, first(below ORDER BY t, idx) AS from_below, round(max(t) - min(t), 6) AS dwell FROM g WHERE o GROUP BY test_id, channel, run""")  # fmt: skip
def window_entries(spark, sf_dir):
    """Stays inside a window, how long they last and from which side they begin."""
    found = contacts.window_entries(samples(spark, sf_dir), KEYS, 20.0, 60.0)
    return found.select(*KEYS, "n", "from_below", *[F.round(c, 6).alias(c) for c in ("start_at", "end_at", "dwell")])


@query("local_direction", f"""WITH {SAMPLES_SQL}, e AS (SELECT test_id, event_id, us FROM s WHERE channel = 'error'), w AS (SELECT test_id, us, v, us / 86.4e9::DOUBLE AS x FROM s WHERE channel = 'view' AND v IS NOT NULL),
j AS (SELECT e.test_id, e.event_id, CASE WHEN max(x) > min(x) THEN regr_slope(w.v, x - e.us / 86.4e9::DOUBLE) END AS slope FROM e LEFT JOIN w ON w.test_id = e.test_id AND w.us BETWEEN e.us - 432000000000 AND e.us + 432000000000 GROUP BY e.test_id, e.event_id)
SELECT test_id, event_id, round(slope, 5) AS slope, CASE WHEN slope > 0.5 THEN 1 WHEN slope < -0.5 THEN -1 WHEN slope IS NOT NULL THEN 0 END AS direction FROM j""")  # fmt: skip
def local_direction(spark, sf_dir):
    """Slope of the views within five days of each error."""
    s = samples(spark, sf_dir)
    edges = channel(s, "error").select("test_id", "us", F.col("event_id").alias("edge"))
    found = contacts.local_slopes(edges, channel(s, "view"), ["test_id"], 432_000_000_000, 0.5)
    return found.select("test_id", F.col("edge").alias("event_id"), F.round("slope", 5).alias("slope"), "direction")


SEGMENT_SQL = f"""{ALIGN_SQL},
sl AS (SELECT *, last_value(click) OVER w - click AS dc, last_value(t) OVER w - t AS dt FROM a WINDOW w AS (PARTITION BY test_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
di AS (SELECT *, CASE WHEN dt > 0 AND dc / dt > 0.00005 THEN 1 WHEN dt > 0 AND dc / dt < -0.00005 THEN -1 ELSE 0 END AS direction FROM sl),
ne AS (SELECT *, CASE WHEN direction IS DISTINCT FROM lag(direction) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM di WINDOW w AS (PARTITION BY test_id ORDER BY i)),
ru AS (SELECT *, sum(new) OVER (PARTITION BY test_id ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM ne),
sg AS (SELECT test_id, run, any_value(direction) AS direction, min(i) AS i_start, max(i) AS i_end, min(t) AS t_start, max(t) AS t_end, arg_min(click, i) AS c0, arg_max(click, i) AS c1 FROM ru GROUP BY test_id, run),
se AS (SELECT *, coalesce(lead(c0) OVER w, c1) AS target, coalesce(lead(i_end) OVER w, i_end) AS i_last FROM sg WINDOW w AS (PARTITION BY test_id ORDER BY run))"""


def command_runs(spark, sf_dir):
    return stroke.segments(aligned(spark, sf_dir), ["test_id"], "click", 3, 0.00005)


@query("command_segments", f"""WITH {SEGMENT_SQL} SELECT test_id, run, direction, i_start, i_end, round(t_start, 3) AS t_start, round(t_end, 3) AS t_end, round(target, 6) AS target FROM se""")
def command_segments(spark, sf_dir):
    """Rising, falling and resting stretches of the command and where they lead."""
    found = command_runs(spark, sf_dir)
    return found.select("test_id", "run", "direction", "i_start", "i_end", F.round("t_start", 3).alias("t_start"), F.round("t_end", 3).alias("t_end"), F.round("target", 6).alias("target"))


@query("travel_times", f"""WITH {SEGMENT_SQL},
re AS (SELECT se.test_id, run, direction, any_value(t_start) AS t_start, any_value(t_end) AS t_end, min(a.t) FILTER (WHERE abs(a."view" - target) <= 5) AS reached FROM se JOIN a ON a.test_id = se.test_id AND a.i BETWEEN i_start AND i_last WHERE direction <> 0 GROUP BY se.test_id, run, direction)
SELECT test_id, run, direction, round(reached - t_start, 3) AS total_response, CASE WHEN reached IS NOT NULL THEN round(greatest(0.0, reached - t_end), 3) END AS travel FROM re""")  # fmt: skip
def travel_times(spark, sf_dir):
    """Response and settling time of each motion segment."""
    found = stroke.travel(aligned(spark, sf_dir), command_runs(spark, sf_dir), ["test_id"], "view", 5.0)
    return found.select("test_id", "run", "direction", F.round("total_response", 3).alias("total_response"), F.round("travel", 3).alias("travel"))


@query("hold_start", f"""WITH {ALIGN_SQL}, sl AS (SELECT *, abs((click - lag(click) OVER w) / (t - lag(t) OVER w)) * 3600 AS s FROM a WINDOW w AS (PARTITION BY test_id ORDER BY i)),
mx AS (SELECT *, max(s) OVER (PARTITION BY test_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS worst FROM sl)
SELECT test_id, min(i) FILTER (WHERE s <= 0.5 AND worst <= 2.0) AS hold_i FROM mx GROUP BY test_id""")  # fmt: skip
def hold_start(spark, sf_dir):
    """First calm grid point after which the command stays calm."""
    w = Window.partitionBy("test_id").orderBy("i")
    slope = (F.col("click") - F.lag("click").over(w)) / (F.col("t") - F.lag("t").over(w)) * 3600
    rows = aligned(spark, sf_dir).withColumn("slope", slope)
    return stroke.hold_start(rows, ["test_id"], F.col("slope"), 0.5, 2.0)


@query("sustained_move", f"""WITH {ALIGN_SQL}, z AS (SELECT *, abs("view" - first_value("view") OVER (PARTITION BY test_id ORDER BY i)) AS moved FROM a),
h AS (SELECT *, min(moved) OVER w AS low, count(*) OVER w AS n FROM z WINDOW w AS (PARTITION BY test_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
SELECT test_id, min(i) FILTER (WHERE low >= 10 AND n = 4) AS sustained_i FROM h GROUP BY test_id""")  # fmt: skip
def sustained_move(spark, sf_dir):
    """First grid point from which the position stays away from its start."""
    start = F.first("view").over(Window.partitionBy("test_id").orderBy("i"))
    rows = aligned(spark, sf_dir).withColumn("moved", F.abs(F.col("view") - start))
    return stroke.sustained_from(rows, ["test_id"], F.col("moved"), 10.0, 3)


@query("mass_balance", f"""WITH {ALIGN_SQL}, y AS (SELECT *, (t - min(t) OVER (PARTITION BY test_id)) / 60 AS x FROM a),
z AS (SELECT *, ("view" + 101.325::DOUBLE) * 0.01::DOUBLE * 1000 * (0.0::DOUBLE + 273.15::DOUBLE) / (1.0::DOUBLE * (click / 10 + 273.15::DOUBLE) * 101.325::DOUBLE) - 0.0001::DOUBLE * x AS y FROM y)
SELECT test_id, CASE WHEN max(x) > min(x) THEN round(regr_slope(y, x), 7) END AS rate, round(arg_max(y, i) - arg_min(y, i), 6) AS total FROM z GROUP BY test_id""")  # fmt: skip
def mass_balance(spark, sf_dir):
    """Gas inventory of a closed volume at reference conditions, less the blank rate."""
    volume = physics.standard_volume(F.col("view") + 101.325, F.col("click") / 10, F.lit(0.01), F.lit(1.0), F.lit(0.0), F.lit(101.325))
    found = stroke.balance(aligned(spark, sf_dir), ["test_id"], volume, 0.0001)
    return found.select("test_id", F.round("rate", 7).alias("rate"), F.round("total", 6).alias("total"))


@query("stroke_verdict", f"""WITH {ALIGN_SQL},
z AS (SELECT *, first_value("view") OVER w AS v0, first_value(click) OVER w AS c0 FROM a WINDOW w AS (PARTITION BY test_id ORDER BY i)),
m AS (SELECT test_id, min(i) FILTER (WHERE abs("view" - v0) >= 5) AS moved FROM z GROUP BY test_id),
db AS (SELECT test_id, round(max(abs(click - c0)), 6) AS deadband FROM z JOIN m USING (test_id) WHERE i < coalesce(moved, 1e18) GROUP BY test_id),
it AS (SELECT test_id, max("view") < max(click) - 2 OR min("view") > min(click) + 2 AS incomplete, count(*) AS n FROM a GROUP BY test_id),
j AS (SELECT test_id, n, concat_ws(',', CASE WHEN deadband > 10 THEN 'deadband' END, CASE WHEN incomplete THEN 'incomplete_travel' END) AS issues FROM it LEFT JOIN db USING (test_id))
SELECT test_id, issues, CASE WHEN n < 20 THEN 'no_conclusion' WHEN issues <> '' THEN 'exceedances' ELSE 'ok' END AS verdict FROM j""")  # fmt: skip
def stroke_verdict(spark, sf_dir):
    """Issues of each stroke and its verdict; short records give no conclusion."""
    points = aligned(spark, sf_dir).groupBy("test_id").agg(F.count(F.lit(1)).alias("points"))
    tests = incomplete_travel(spark, sf_dir).join(deadband_reversal(spark, sf_dir), "test_id", "left").join(points, "test_id")
    rules = {"deadband": F.col("deadband") > 10, "incomplete_travel": F.col("incomplete")}
    return stroke.verdicts_of(tests, F.col("points") < 20, rules).select("test_id", "issues", "verdict")


@query("trip_baseline", f"""WITH {SAMPLES_SQL}, p AS (SELECT test_id, min(t) AS trip FROM s WHERE channel = 'error' GROUP BY test_id),
w AS (SELECT s.test_id, s.t, s.v, trip FROM s JOIN p USING (test_id) WHERE channel = 'view' AND t < trip),
b AS (SELECT test_id, any_value(trip) AS trip, percentile_disc(0.5) WITHIN GROUP (ORDER BY v) AS baseline, count(*) AS n FROM w WHERE t >= trip - 864000.0 GROUP BY test_id)
SELECT b.test_id, round(any_value(b.trip), 6) AS trip_at, any_value(baseline) AS baseline, any_value(n) AS n, round(max(t) FILTER (WHERE abs(v - baseline) >= 5), 6) AS loss_at FROM b JOIN w USING (test_id) GROUP BY b.test_id""")  # fmt: skip
def trip_baseline(spark, sf_dir):
    """Low median before the first error, and the last sample before it that lies off."""
    s = samples(spark, sf_dir)
    trips = channel(s, "error").groupBy("test_id").agg(F.min("t").alias("trip"))
    before = channel(s, "view").select("test_id", "t", "v").join(trips, "test_id").where("t < trip")
    recent = before.where(F.col("t") >= F.col("trip") - 10 * DAY)
    base = recent.groupBy("test_id").agg(stats.lower_median("v").alias("baseline"), F.count(F.lit(1)).alias("n"))
    off = F.max(F.when(F.abs(F.col("v") - F.col("baseline")) >= 5, F.col("t")))
    found = before.join(base, "test_id").groupBy("test_id").agg(F.round(F.max("trip"), 6).alias("trip_at"), F.max("baseline").alias("baseline"), F.max("n").alias("n"), F.round(off, 6).alias("loss_at"))
    return found


@query("pre_post_compare", f"""WITH {SAMPLES_SQL},
h AS (SELECT test_id, channel, count(*) FILTER (WHERE t < 1296000.0) AS n0, count(*) FILTER (WHERE t >= 1296000.0) AS n1, max(v) FILTER (WHERE t < 1296000.0) - min(v) FILTER (WHERE t < 1296000.0) AS a, max(v) FILTER (WHERE t >= 1296000.0) - min(v) FILTER (WHERE t >= 1296000.0) AS b FROM s GROUP BY ALL)
SELECT test_id, channel, round(a - b, 6) AS delta, a - b > 0 AS improved, b <= 80 AS within_threshold, concat_ws(',', CASE WHEN n0 < 3 THEN 'pre_too_short' END, CASE WHEN n1 < 3 THEN 'post_too_short' END, CASE WHEN abs(a - b) > 0.5 * a THEN 'span_differs' END) AS reasons FROM h""")  # fmt: skip
def pre_post_compare(spark, sf_dir):
    """Spread of each channel before and after day 15, and why the two may not be compared."""
    s = samples(spark, sf_dir).withColumn("v0", F.when(F.col("t") < 15 * DAY, F.col("v"))).withColumn("v1", F.when(F.col("t") >= 15 * DAY, F.col("v")))
    early = (F.col("t") < 15 * DAY).cast("int")
    found = s.groupBy(*KEYS).agg(F.sum(early).alias("n0"), F.sum(1 - early).alias("n1"), (F.max("v0") - F.min("v0")).alias("a"), (F.max("v1") - F.min("v1")).alias("b"))
    delta = F.col("a") - F.col("b")
    reasons = F.concat_ws(",", F.when(F.col("n0") < 3, "pre_too_short"), F.when(F.col("n1") < 3, "post_too_short"), F.when(F.abs(delta) > 0.5 * F.col("a"), "span_differs"))
    return found.select(*KEYS, F.round(delta, 6).alias("delta"), (delta > 0).alias("improved"), (F.col("b") <= 80).alias("within_threshold"), reasons.alias("reasons"))


@query("frozen_conditions", """WITH r AS (SELECT o_custkey, o_orderkey, o_orderpriority, o_totalprice, first_value(o_orderpriority) OVER w AS p0, first_value(o_totalprice) OVER w AS x0 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
c AS (SELECT *, concat_ws(',', CASE WHEN o_orderpriority IS DISTINCT FROM p0 THEN 'priority' END, CASE WHEN abs(o_totalprice - x0) > 0.5 * abs(x0) THEN 'price' END) AS reasons FROM r)
SELECT o_custkey, o_orderkey, reasons, reasons = '' AS compatible, count(*) FILTER (WHERE reasons = '') OVER (PARTITION BY o_custkey) AS comparable FROM c""")  # fmt: skip
def frozen_conditions(spark, sf_dir):
    """Which orders share the conditions of the customer's earliest one."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").withColumn("p0", F.first("o_orderpriority").over(w)).withColumn("x0", F.first("o_totalprice").over(w))
    price = F.abs(F.col("o_totalprice") - F.col("x0")) > 0.5 * F.abs(F.col("x0"))
    rows = rows.withColumn("reasons", F.concat_ws(",", F.when(~F.col("o_orderpriority").eqNullSafe(F.col("p0")), "priority"), F.when(price, "price")))
    comparable = F.sum((F.col("reasons") == "").cast("int")).over(Window.partitionBy("o_custkey"))
    return rows.select("o_custkey", "o_orderkey", "reasons", (F.col("reasons") == "").alias("compatible"), comparable.alias("comparable"))


@query("adjustment_replay", f"""WITH {SAMPLES_SQL}, k AS (SELECT test_id, max((us, event_id)) FILTER (WHERE channel = 'error') AS gone FROM s GROUP BY test_id),
l AS (SELECT s.*, (us, event_id) AS stamp FROM s JOIN k USING (test_id) WHERE channel IN ('signup', 'purchase') AND (gone IS NULL OR (us, event_id) > gone))
SELECT test_id, arg_max(event_id, stamp) AS event_id, arg_max(channel, stamp) AS action, arg_max(v, stamp) AS v, count(*) AS applied FROM l GROUP BY test_id""")  # fmt: skip
def adjustment_replay(spark, sf_dir):
    """Last addition or update of each test behind its last removal."""
    at = F.struct("us", "event_id")
    s = samples(spark, sf_dir).withColumn("at", at)
    gone = channel(s, "error").groupBy("test_id").agg(F.max("at").alias("gone"))
    kept = s.where(F.col("channel").isin("signup", "purchase")).join(gone, "test_id", "left").where("gone is null or at > gone")
    return kept.groupBy("test_id").agg(F.max_by("event_id", "at").alias("event_id"), F.max_by("channel", "at").alias("action"), F.max_by("v", "at").alias("v"), F.count(F.lit(1)).alias("applied"))


@query("flow_point_codes", """WITH p AS (SELECT p_partkey, p_size - 5 AS q, p_retailprice / 10 - 92 AS dp, p_retailprice / 4 AS p1, p_size * 1.0::DOUBLE AS pv FROM part),
c AS (SELECT *, 0.81::DOUBLE * (p1 - (0.96::DOUBLE - 0.28::DOUBLE * sqrt(pv / 220.64::DOUBLE)) * pv) AS choked FROM p)
SELECT p_partkey, coalesce(CASE WHEN q <= 0 THEN 'nonpositive_flow' END, CASE WHEN dp <= 1 THEN 'insufficient_dp' END, CASE WHEN p1 - dp <= 0 THEN 'pressure_physical' END, CASE WHEN dp >= choked THEN 'cavitation' END, 'adopted') AS code, round(CASE WHEN q > 0 AND dp > 0 THEN q / (0.865::DOUBLE * sqrt(dp / 100 / (998.0::DOUBLE / 999.0::DOUBLE))) END, 6) AS cv FROM c""")  # fmt: skip
def flow_point_codes(spark, sf_dir):
    """First reason to leave a measured point out, and its flow coefficient."""
    part = table(spark, sf_dir, "part")
    q, dp, p1, pv = F.col("p_size") - 5, F.col("p_retailprice") / 10 - 92, F.col("p_retailprice") / 4, F.col("p_size").cast("double")
    choked = physics.choked_drop(p1, pv, F.lit(220.64), F.lit(0.9))
    code = F.coalesce(F.when(q <= 0, "nonpositive_flow"), F.when(dp <= 1, "insufficient_dp"), F.when(p1 - dp <= 0, "pressure_physical"), F.when(dp >= choked, "cavitation"), F.lit("adopted"))
    return part.select("p_partkey", code.alias("code"), F.round(physics.liquid_cv(q, dp, F.lit(998.0)), 6).alias("cv"))
