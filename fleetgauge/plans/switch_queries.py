"""Limit-switch analysis over two kinds of records.

``switch_*``: one open contact per customer at 5 Hz: the valve opens from 4 s to
14 s, stays until 24 s and closes.  The nation sets chatter, late edges, missing
triggers, welded contacts and illegal levels.

``contact_*``: the events of a user as samples: views are the position, clicks
the open contact and purchases the closed one, so every kind of contradiction
occurs.  Some stretches are ignored, as by a person's decision.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.operators import switches
from fleetgauge.plans.registry import SAMPLES_SQL, query, sampled, table
from fleetgauge.sources.series import samples_of_events

KEYS = ["test_id"]
DEBOUNCE_S = 0.5
CLOCK = 20000.0


def _points(spark, sf_dir):
    return sampled(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("test_id"), F.col("c_nationkey").alias("n")), "test_id", 200)


def position(spark, sf_dir):
    i = F.col("i")
    v = F.when(i < 20, 0.0).when(i < 70, (i - 20) * 2.0).when(i < 120, 100.0).when(i < 170, 100.0 - (i - 120) * 2.0).otherwise(0.0)
    return _points(spark, sf_dir).select("test_id", i.alias("idx"), (i / 5.0).alias("t"), v.alias("v"))


def bits(spark, sf_dir):
    n, i = F.col("n"), F.col("i")
    start, stop = F.lit(69) + F.when(n % 7 == 2, 6).otherwise(0), F.lit(121)
    on = i.between(start, stop) & ~((n % 5 == 1) & i.isin(70, 72)) & (n % 11 != 3)
    on = on | ((n % 13 == 5) & (i > 121)) | ((n % 8 == 6) & (i == 30))
    bit = F.when((n % 6 == 4) & i.between(122, 124), None).otherwise(on.cast("int"))
    return _points(spark, sf_dir).select("test_id", i.alias("idx"), (i / 5.0).alias("t"), bit.alias("bit"))


def _spec(rows, contact, end, act, rel, overlap):
    values = [("act_low", act[0]), ("act_high", act[1]), ("rel_low", rel[0]), ("rel_high", rel[1]), ("debounce_s", DEBOUNCE_S), ("max_overlap_s", overlap)]
    return rows.select("test_id", F.lit(contact).alias("contact"), F.lit(end).alias("end"), *(F.lit(v).cast("double").alias(n) for n, v in values))


def customer_record(spark, sf_dir):
    """What an analysis takes: bits, position and specs."""
    tests = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("test_id"))
    rows = bits(spark, sf_dir).withColumn("contact", F.lit("open"))
    return rows, position(spark, sf_dir), _spec(tests, "open", "high", (95.0, 100.0), (90.0, 98.0), None)


def event_record(spark, sf_dir):
    """Bits, position, specs and ignored stretches of the events' records."""
    rows = samples_of_events(table(spark, sf_dir, "events")).withColumn("t", F.col("t") / CLOCK)
    v = F.col("v")
    level = F.when(v < 25, 0).when(v >= 30, 1)
    contact = F.when(F.col("channel") == "click", "open").otherwise("closed")
    bit_rows = rows.where("channel in ('click', 'purchase')").select("test_id", contact.alias("contact"), "idx", "t", "v", level.alias("bit"))
    place = rows.where("channel = 'view'").select("test_id", "idx", "t", F.least(v, F.lit(100.0)).alias("v"))
    tests = rows.select("test_id").distinct()
    specs = _spec(tests, "open", "high", (60.0, 100.0), (40.0, 80.0), 1.0).unionByName(_spec(tests, "closed", "low", (0.0, 20.0), (5.0, 35.0), 1.0))
    ignored = tests.where("test_id % 7 = 0").select("test_id", F.lit("open").alias("contact"), F.lit(20.0).alias("t_start"), F.lit(50.0).alias("t_end"))
    return bit_rows, place, specs, ignored


_LEVELS = """CASE WHEN c_nationkey % 6 = 4 AND i BETWEEN 122 AND 124 THEN NULL ELSE
  ((i BETWEEN 69 + CASE WHEN c_nationkey % 7 = 2 THEN 6 ELSE 0 END AND 121 AND NOT (c_nationkey % 5 = 1 AND i IN (70, 72)) AND c_nationkey % 11 <> 3)
    OR (c_nationkey % 13 = 5 AND i > 121) OR (c_nationkey % 8 = 6 AND i = 30))::INT END"""

#: The records: b (bits), p (position), sp (specs), ig (ignored stretches).
CUSTOMER_SQL = f"""b AS (SELECT c_custkey AS test_id, 'open' AS contact, i, i / 5.0::DOUBLE AS t, {_LEVELS} AS bit FROM customer, range(200) x(i)),
p AS (SELECT c_custkey AS test_id, i, i / 5.0::DOUBLE AS t,
  (CASE WHEN i < 20 THEN 0 WHEN i < 70 THEN (i - 20) * 2 WHEN i < 120 THEN 100 WHEN i < 170 THEN 100 - (i - 120) * 2 ELSE 0 END)::DOUBLE AS v FROM customer, range(200) x(i)),
sp AS (SELECT c_custkey AS test_id, 'open' AS contact, 'high' AS until, 95.0 AS al, 100.0 AS ah, 90.0 AS rl, 98.0 AS rh, {DEBOUNCE_S} AS wait, NULL::DOUBLE AS lap FROM customer),
ig AS (SELECT test_id, contact, 0.0 AS t_start, 0.0 AS t_end FROM sp WHERE false)"""

EVENT_SQL = f"""{SAMPLES_SQL}, s1 AS (SELECT test_id, channel, idx AS i, t / {CLOCK}::DOUBLE AS t, v FROM s),
b AS (SELECT test_id, CASE channel WHEN 'click' THEN 'open' ELSE 'closed' END AS contact, i, t, CASE WHEN v < 25 THEN 0 WHEN v >= 30 THEN 1 END AS bit FROM s1 WHERE channel IN ('click', 'purchase')),
p AS (SELECT test_id, i, t, least(v, 100.0)::DOUBLE AS v FROM s1 WHERE channel = 'view'),
sp AS (SELECT DISTINCT test_id, contact, until, al, ah, rl, rh, {DEBOUNCE_S} AS wait, 1.0 AS lap
  FROM s1, (VALUES ('open', 'high', 60.0, 100.0, 40.0, 80.0), ('closed', 'low', 0.0, 20.0, 5.0, 35.0)) x(contact, until, al, ah, rl, rh)),
ig AS (SELECT DISTINCT test_id, 'open' AS contact, 20.0 AS t_start, 50.0 AS t_end FROM s1 WHERE test_id % 7 = 0)"""

#: Clusters of active runs: ad.
ADOPTED_SQL = """lg AS (
  SELECT b.*, wait, lead(bit) OVER w AS nb, lead(t) OVER w AS nt, lead(i) OVER w AS ni, lag(t) OVER w IS NULL AS begins,
    min(CASE WHEN bit IS NOT NULL THEN t END) OVER (PARTITION BY test_id, contact ORDER BY t, i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS lt,
    CASE WHEN coalesce(bit = 1, false) = lag(coalesce(bit = 1, false)) OVER w THEN 0 ELSE 1 END AS new
  FROM b JOIN sp USING (test_id, contact) WINDOW w AS (PARTITION BY test_id, contact ORDER BY t, i)),
rn AS (SELECT *, sum(new) OVER (PARTITION BY test_id, contact ORDER BY t, i ROWS UNBOUNDED PRECEDING) AS run FROM lg),
r1 AS (
  SELECT test_id, contact, run, wait, min(t) AS a, max(t) AS e, min(i) AS ai, max(i) AS ei, bool_or(begins) AS begins,
    arg_max({'nb': nb, 'nt': nt, 'ni': ni, 'lt': lt}, i) AS x
  FROM rn WHERE bit = 1 GROUP BY ALL),
c1 AS (SELECT *, CASE WHEN a - lag(e) OVER w <= wait + 1e-9 THEN 0 ELSE 1 END AS nw FROM r1 WINDOW w AS (PARTITION BY test_id, contact ORDER BY a)),
c2 AS (SELECT *, sum(nw) OVER (PARTITION BY test_id, contact ORDER BY a ROWS UNBOUNDED PRECEDING) AS cl FROM c1),
c3 AS (
  SELECT test_id, contact, cl, wait, min(a) AS t_start, max(e) AS t_end, count(*) AS n_runs, arg_max(x, a) AS x, min(ai) AS i_start, max(ei) AS i_end, bool_or(begins) AS begins,
    min(a) FILTER (WHERE e - a >= wait - 1e-9) AS steady, min(ai) FILTER (WHERE e - a >= wait - 1e-9) AS steady_i
  FROM c2 GROUP BY ALL),
ad AS (
  SELECT test_id, contact, t_start, t_end, n_runs, CASE WHEN n_runs = 1 AND t_end - t_start < wait - 1e-9 THEN 'glitch' ELSE 'adopted' END AS kind,
    CASE WHEN n_runs > 1 THEN coalesce(steady, t_end) END AS chatter_until, CASE WHEN x.nb = 0 THEN x.nt END AS release_t, CASE WHEN x.nb = 0 THEN x.nt ELSE x.lt END AS active_until,
    i_start, i_end, CASE WHEN x.nb = 0 THEN x.ni END AS i_release, CASE WHEN n_runs > 1 THEN coalesce(steady_i, i_end) END AS i_chatter, begins
  FROM c3)"""

#: Kept intervals kn, crossings cr, edges ed.
EDGE_SQL = ADOPTED_SQL + """,
k0 AS (
  SELECT * EXCLUDE (kind), kind, t_start AS a, CASE kind WHEN 'adopted' THEN coalesce(active_until, t_end) ELSE t_end END AS e FROM ad
  UNION ALL SELECT * EXCLUDE (kind), 'chatter', t_start, chatter_until FROM ad WHERE chatter_until IS NOT NULL),
kn AS (SELECT * FROM k0 WHERE NOT EXISTS (SELECT 1 FROM ig WHERE ig.test_id = k0.test_id AND ig.contact = k0.contact AND k0.a <= ig.t_end + 1e-9 AND k0.e >= ig.t_start - 1e-9)),
pl AS (SELECT *, lag(v) OVER w AS was, lead(v) OVER w AS nxt FROM p WINDOW w AS (PARTITION BY test_id ORDER BY t, i)),
wn AS (
  SELECT test_id, contact, 'actuate' AS what, al AS lo, ah AS hi, until = 'high' AS up FROM sp
  UNION ALL SELECT test_id, contact, 'release', rl, rh, until = 'low' FROM sp),
io AS (
  SELECT test_id, contact, what, t, i, v BETWEEN lo - 1e-9 AND hi + 1e-9 AS inside, coalesce(was BETWEEN lo - 1e-9 AND hi + 1e-9, false) AS before,
    coalesce(nxt BETWEEN lo - 1e-9 AND hi + 1e-9, false) AS later, CASE WHEN up THEN v >= was - 1e-9 ELSE v <= was + 1e-9 END AS towards
  FROM pl JOIN wn USING (test_id)),
cr AS (
  SELECT x.test_id, x.contact, x.what, x.t, x.i, any_value(x.towards) AS towards, min(y.t) AS t_leave, min(y.i) AS i_leave
  FROM io x JOIN io y ON y.test_id = x.test_id AND y.contact = x.contact AND y.what = x.what AND y.inside AND NOT y.later AND y.i >= x.i
  WHERE x.inside AND NOT x.before GROUP BY ALL),
ex AS (SELECT test_id, contact, t, i FROM pl JOIN sp USING (test_id)
  WHERE CASE WHEN until = 'high' THEN was >= rl - 1e-9 AND v < rl - 1e-9 ELSE was <= rh + 1e-9 AND v > rh + 1e-9 END),
e0 AS (
  SELECT test_id, contact, 'actuate' AS edge, t_start AS t, i_start AS i FROM kn WHERE kind = 'adopted' AND NOT begins
  UNION ALL SELECT test_id, contact, 'release', release_t, i_release FROM kn WHERE kind = 'adopted' AND release_t IS NOT NULL),
e1 AS (
  SELECT e.*, {'t': q.t, 'v': q.v} AS pb, {'t': r.t, 'v': r.v} AS pa
  FROM e0 e ASOF LEFT JOIN p q ON q.test_id = e.test_id AND q.t <= e.t ASOF LEFT JOIN p r ON r.test_id = e.test_id AND r.t >= e.t),
fit AS (SELECT e.test_id, e.t, count(*) AS n, regr_slope(p.v, p.t) AS slope FROM (SELECT DISTINCT test_id, t FROM e0) e JOIN p ON p.test_id = e.test_id AND p.t BETWEEN e.t - 0.6 AND e.t + 0.6 GROUP BY ALL),
e2 AS (
  SELECT e1.*, CASE WHEN pb.t IS NOT NULL AND pa.t IS NOT NULL THEN CASE WHEN pa.t > pb.t THEN pb.v + (pa.v - pb.v) * (e1.t - pb.t) / (pa.t - pb.t) ELSE pb.v END END AS position,
    CASE WHEN n >= 2 THEN CASE WHEN isfinite(slope) THEN slope ELSE 0 END
      WHEN pb.t IS NOT NULL AND pa.t IS NOT NULL THEN CASE WHEN pa.t > pb.t THEN (pa.v - pb.v) / (pa.t - pb.t) ELSE 0 END END AS slope
  FROM e1 LEFT JOIN fit USING (test_id, t)),
dl AS (
  SELECT e.test_id, e.contact, e.edge, e.t, round(e.t - coalesce(max(c.t) FILTER (WHERE c.t <= e.t + 1e-9), min(c.t) FILTER (WHERE c.t > e.t + 1e-9)), 6) AS delay
  FROM e0 e JOIN cr c ON c.test_id = e.test_id AND c.contact = e.contact AND c.what = e.edge AND c.towards GROUP BY e.test_id, e.contact, e.edge, e.t),
ed AS (
  SELECT test_id, contact, edge, t, i, position, CASE WHEN slope > 0.5 THEN 1 WHEN slope < -0.5 THEN -1 WHEN slope IS NOT NULL THEN 0 END AS direction,
    position BETWEEN CASE edge WHEN 'actuate' THEN al ELSE rl END - 1e-9 AND CASE edge WHEN 'actuate' THEN ah ELSE rh END + 1e-9 AS in_window, delay,
    CASE WHEN (edge = 'actuate') = (until = 'high') THEN 1 ELSE -1 END AS expected
  FROM e2 LEFT JOIN dl USING (test_id, contact, edge, t) JOIN sp USING (test_id, contact))"""

#: Events ev, metrics mt, checks ck, gaps gp.
VERDICT_SQL = EDGE_SQL + """,
off AS (SELECT * FROM io JOIN sp USING (test_id, contact)),
sa AS (SELECT x.*, y.bit, row_number() OVER (PARTITION BY x.test_id, x.contact, x.w, x.t, x.i ORDER BY y.t > x.t, CASE WHEN y.t <= x.t THEN -y.t ELSE y.t END, CASE WHEN y.t <= x.t THEN -y.i ELSE y.i END) AS k
  FROM (SELECT test_id, contact, 'in' AS w, t, i, t_leave, i_leave FROM cr WHERE what = 'actuate' UNION ALL SELECT test_id, contact, 'out', t, i, NULL, NULL FROM ex) x
  JOIN b y ON y.test_id = x.test_id AND y.contact = x.contact),
iv AS (SELECT test_id, contact, t_start, coalesce(active_until, 'infinity'::DOUBLE) AS until, i_start, i_end FROM kn WHERE kind = 'adopted'),
fin AS (SELECT test_id, max(t) AS t, arg_max(v, t) AS v, arg_max(i, t) AS i FROM p GROUP BY test_id),
il AS (SELECT *, CASE WHEN (bit IS NULL) = lag(bit IS NULL) OVER w THEN 0 ELSE 1 END AS new FROM b WINDOW w AS (PARTITION BY test_id, contact ORDER BY t, i)),
ir AS (SELECT *, sum(new) OVER (PARTITION BY test_id, contact ORDER BY t, i ROWS UNBOUNDED PRECEDING) AS run FROM il),
ev AS (
  SELECT test_id, 'illegal_state' AS kind, contact, min(t) AS t_start, max(t) AS t_end, contact AS channel, min(i) AS i_start, max(i) AS i_end
    FROM (SELECT * FROM ir WHERE bit IS NULL) GROUP BY test_id, contact, run
  UNION ALL SELECT test_id, 'chatter', contact, a, e, contact, i_start, CASE kind WHEN 'chatter' THEN i_chatter ELSE i_end END FROM kn WHERE kind IN ('chatter', 'glitch')
  UNION ALL SELECT test_id, 'position_out_of_window', contact, t, t, contact, i, i FROM ed WHERE NOT in_window
  UNION ALL SELECT test_id, 'order_reversal', contact, t, t, contact, i, i FROM ed WHERE position IS NOT NULL AND direction = -expected
  UNION ALL SELECT test_id, 'order_reversal', contact, t, t, contact, i, i FROM ed WHERE position IS NOT NULL AND edge = 'actuate'
    AND EXISTS (SELECT 1 FROM iv WHERE iv.test_id = ed.test_id AND iv.contact <> ed.contact AND iv.t_start - 1e-9 <= ed.t AND ed.t < iv.until)
  UNION ALL SELECT o.test_id, 'both_active', 'both', greatest(o.t_start, c.t_start),
      CASE WHEN isinf(least(o.until, c.until)) THEN (SELECT max(t) FROM b WHERE b.test_id = o.test_id) ELSE least(o.until, c.until) END, 'both',
      CASE WHEN o.t_start >= c.t_start THEN o.i_start ELSE c.i_start END, CASE WHEN o.t_start >= c.t_start THEN o.i_end ELSE c.i_end END
    FROM iv o JOIN iv c ON c.test_id = o.test_id AND o.contact = 'open' AND c.contact = 'closed' JOIN sp ON sp.test_id = o.test_id AND sp.contact = 'open'
    WHERE least(o.until, c.until) - greatest(o.t_start, c.t_start) > lap + 1e-9
  UNION ALL SELECT sa.test_id, 'no_trigger_at_end', sa.contact, sa.t, t_leave, 'position', sa.i, i_leave FROM sa JOIN sp USING (test_id, contact)
    WHERE w = 'in' AND k = 1 AND t_leave - sa.t >= 1 AND coalesce(bit <> 1, true)
    AND NOT EXISTS (SELECT 1 FROM ed WHERE ed.test_id = sa.test_id AND ed.contact = sa.contact AND edge = 'actuate' AND ed.t BETWEEN sa.t - (wait + 1e-9) AND sa.t + (1 + 1e-9))
  UNION ALL SELECT sa.test_id, 'missed_transition', sa.contact, sa.t, sa.t, 'position', greatest(0, sa.i - 1), sa.i FROM sa JOIN sp USING (test_id, contact)
    WHERE w = 'out' AND k = 1 AND bit = 1
    AND NOT EXISTS (SELECT 1 FROM ed WHERE ed.test_id = sa.test_id AND ed.contact = sa.contact AND edge = 'release' AND ed.t BETWEEN sa.t - (wait + 1e-9) AND sa.t + (1 + 1e-9))
  UNION ALL SELECT test_id, 'missed_transition', contact, fin.t, fin.t, 'position', greatest(0, fin.i - 1), fin.i
    FROM (SELECT test_id, contact, arg_max(coalesce(bit, -1), i) AS bit FROM b GROUP BY ALL) l JOIN fin USING (test_id) JOIN sp USING (test_id, contact)
    WHERE bit = 1 AND NOT v BETWEEN rl - 1e-9 AND rh + 1e-9 AND NOT v BETWEEN al - 1e-9 AND ah + 1e-9),
gap AS (SELECT e.test_id, e.contact, e.t, round(abs(e.position - arg_min(r.position, r.t)), 4) AS gap
  FROM ed e JOIN ed r ON r.test_id = e.test_id AND r.contact = e.contact AND r.edge = 'release' AND r.t > e.t AND r.position IS NOT NULL
  WHERE e.edge = 'actuate' AND e.position IS NOT NULL GROUP BY e.test_id, e.contact, e.t, e.position),
mt AS (
  SELECT test_id, contact, count(*) FILTER (WHERE edge = 'actuate') AS n_actuate, count(*) FILTER (WHERE edge = 'release') AS n_release,
    round(avg(position) FILTER (WHERE edge = 'actuate'), 4) AS mean_actuation, round(avg(position) FILTER (WHERE edge = 'release'), 4) AS mean_release, round(avg(gap), 4) AS mean_differential,
    CASE WHEN count(*) FILTER (WHERE edge = 'actuate') >= 2 THEN round(max(position) FILTER (WHERE edge = 'actuate') - min(position) FILTER (WHERE edge = 'actuate'), 4) END AS actuation_dispersion,
    CASE WHEN count(*) FILTER (WHERE edge = 'release') >= 2 THEN round(max(position) FILTER (WHERE edge = 'release') - min(position) FILTER (WHERE edge = 'release'), 4) END AS release_dispersion,
    round(max(delay), 4) AS max_delay
  FROM ed LEFT JOIN (SELECT *, 'actuate' AS edge FROM gap) g USING (test_id, contact, t, edge) WHERE position IS NOT NULL GROUP BY test_id, contact),
ck AS (
  SELECT *, value <= high + 1e-9 AS passes FROM (
    SELECT test_id, contact, unnest(['edge_delay', 'actuation_dispersion', 'release_dispersion']) AS metric, unnest([max_delay, actuation_dispersion, release_dispersion]) AS value, 1.0 AS high FROM mt)
  WHERE value IS NOT NULL),
gp AS (
  SELECT test_id, contact, 'contact_unusable' AS code, true AS blocking FROM sp WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.test_id = sp.test_id AND b.contact = sp.contact AND bit IS NOT NULL)
  UNION ALL SELECT test_id, contact, 'edge_outside_position_span', false FROM ed WHERE position IS NULL),
vd AS (
  SELECT test_id, coalesce(codes, '') AS blocking, coalesce(kinds, '') AS events, coalesce(fails, '') AS failed, coalesce(n, 0) AS n_events,
    CASE WHEN codes IS NOT NULL THEN 'no_conclusion' WHEN kinds IS NOT NULL OR fails IS NOT NULL THEN 'exceedances' ELSE 'ok' END AS verdict
  FROM (SELECT DISTINCT test_id FROM sp) LEFT JOIN (SELECT test_id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(*) AS n FROM ev GROUP BY test_id) USING (test_id)
    LEFT JOIN (SELECT test_id, string_agg(DISTINCT contact || ' ' || metric, ',' ORDER BY contact || ' ' || metric) AS fails FROM ck WHERE NOT passes GROUP BY test_id) USING (test_id)
    LEFT JOIN (SELECT test_id, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM gp WHERE blocking GROUP BY test_id) USING (test_id))"""

_EDGES = "test_id, contact, edge, t, round(position, 4) AS position, direction, in_window, round(delay, 4) + 0.0 AS delay"
_EVENTS = "test_id, kind, contact, round(t_start, 6) AS t_start, round(t_end, 6) AS t_end, channel, i_start, i_end"
#: Means are shown to three digits, so that a tie in the fourth doesn't depend on the order of a sum.
_MEANS = ("mean_actuation", "mean_release", "mean_differential")
_METRICS = "* REPLACE (max_delay + 0.0 AS max_delay, " + ", ".join(f"round({m} + 0.00001, 3) AS {m}" for m in _MEANS) + ")"


def edges_of(found):
    return found["edges"].select("test_id", "contact", "edge", "t", F.round("position", 4).alias("position"), "direction", "in_window", (F.round("delay", 4) + 0.0).alias("delay"))


def events_of(found):
    return found["events"].select("test_id", "kind", "contact", F.round("t_start", 6).alias("t_start"), F.round("t_end", 6).alias("t_end"), "channel", "i_start", "i_end")


def metrics_of(found):
    means = {m: F.round(F.col(m) + 0.00001, 3) for m in _MEANS}
    return found["metrics"].withColumns({"max_delay": F.col("max_delay") + 0.0, **means})


@query("switch_intervals", f"WITH {CUSTOMER_SQL}, {ADOPTED_SQL} SELECT test_id, t_start, t_end, n_runs, kind, chatter_until, release_t, active_until FROM ad")
def switch_intervals(spark, sf_dir):
    """Debounced intervals with chatter, release and how long they hold."""
    found = switches.adopted(bits(spark, sf_dir), KEYS, DEBOUNCE_S)
    return found.select("test_id", "t_start", "t_end", "n_runs", "kind", "chatter_until", "release_t", "active_until")


@query("switch_edges", f"WITH {CUSTOMER_SQL}, {EDGE_SQL} SELECT {_EDGES} FROM ed")
def switch_edges(spark, sf_dir):
    """Edges with their positions, directions and delays."""
    return edges_of(switches.analyse(*customer_record(spark, sf_dir)))


@query("switch_events", f"WITH {CUSTOMER_SQL}, {VERDICT_SQL} SELECT {_EVENTS} FROM ev")
def switch_events(spark, sf_dir):
    """What contradicts the travel."""
    return events_of(switches.analyse(*customer_record(spark, sf_dir)))


@query("switch_metrics", f"WITH {CUSTOMER_SQL}, {VERDICT_SQL} SELECT {_METRICS} FROM mt")
def switch_metrics(spark, sf_dir):
    """Switching points, differentials, dispersions and delays."""
    return metrics_of(switches.analyse(*customer_record(spark, sf_dir)))


@query("switch_verdicts", f"WITH {CUSTOMER_SQL}, {VERDICT_SQL} SELECT * FROM vd")
def switch_verdicts(spark, sf_dir):
    """The whole limit-switch analysis, from levels to verdict."""
    return switches.analyse(*customer_record(spark, sf_dir))["verdicts"]


@query("switch_active_at", f"WITH {CUSTOMER_SQL}, {ADOPTED_SQL}, q AS (SELECT c_custkey AS test_id, unnest([6.0, 20.0, 24.7])::DOUBLE AS t FROM customer) SELECT q.test_id, q.t FROM q WHERE EXISTS (SELECT 1 FROM ad WHERE ad.test_id = q.test_id AND kind = 'adopted' AND t_start <= q.t AND q.t < coalesce(active_until, 1e12))")
def switch_active_at(spark, sf_dir):
    """Times at which the contact counts as on."""
    points = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("test_id"), F.explode(F.array(F.lit(6.0), F.lit(20.0), F.lit(24.7))).alias("t"))
    return switches.active_at(points, switch_intervals(spark, sf_dir), KEYS)


@query("contact_edges", f"WITH {EVENT_SQL}, {EDGE_SQL} SELECT {_EDGES} FROM ed")
def contact_edges(spark, sf_dir):
    """Edges of both contacts."""
    return edges_of(switches.analyse(*event_record(spark, sf_dir)))


@query("contact_crossings", f"""WITH {EVENT_SQL}, {EDGE_SQL} SELECT test_id, contact, what, t, i AS idx, towards, t_leave, i_leave FROM cr
UNION ALL SELECT test_id, contact, 'exit', t, i, NULL, NULL, NULL FROM ex""")
def contact_crossings(spark, sf_dir):
    """What the position does at the windows of both contacts."""
    _, position_, specs, _ = event_record(spark, sf_dir)
    return switches.crossings(position_, specs)


@query("contact_events", f"WITH {EVENT_SQL}, {VERDICT_SQL} SELECT {_EVENTS} FROM ev")
def contact_events(spark, sf_dir):
    """All kinds of contradictions of two contacts and the travel."""
    return events_of(switches.analyse(*event_record(spark, sf_dir)))


@query("contact_metrics", f"WITH {EVENT_SQL}, {VERDICT_SQL} SELECT {_METRICS} FROM mt")
def contact_metrics(spark, sf_dir):
    """Metrics of both contacts."""
    return metrics_of(switches.analyse(*event_record(spark, sf_dir)))


@query("contact_checks", f"WITH {EVENT_SQL}, {VERDICT_SQL} SELECT * FROM ck")
def contact_checks(spark, sf_dir):
    """Metrics against their limits."""
    return switches.analyse(*event_record(spark, sf_dir))["checks"]


@query("contact_gaps", f"WITH {EVENT_SQL}, {VERDICT_SQL} SELECT * FROM gp")
def contact_gaps(spark, sf_dir):
    """Missing evidence of both contacts."""
    return switches.analyse(*event_record(spark, sf_dir))["gaps"]


@query("contact_verdicts", f"WITH {EVENT_SQL}, {VERDICT_SQL} SELECT * FROM vd")
def contact_verdicts(spark, sf_dir):
    """The whole analysis of two contacts."""
    return switches.analyse(*event_record(spark, sf_dir))["verdicts"]


@query("contact_references", f"""WITH {EVENT_SQL}, {VERDICT_SQL}, ch AS (SELECT test_id, contact AS channel, i, t FROM b UNION ALL SELECT test_id, 'position', i, t FROM p),
q AS (SELECT DISTINCT test_id, kind, contact, channel, i_start, i_end, unnest([i_start - 1, i_start, i_end, i_end + 1]) AS i FROM ev)
SELECT test_id, kind, contact, channel, i_start, i_end, string_agg(i || '@' || floor(round(t, 6) * 1000 + 0.0001)::BIGINT, ',' ORDER BY i) AS refs FROM (SELECT DISTINCT q.*, t FROM q JOIN ch USING (test_id, channel, i)) GROUP BY ALL""")
def contact_references(spark, sf_dir):
    """The samples at the edges of events and next to them."""
    bit_rows, position_, specs, ignored = event_record(spark, sf_dir)
    samples = bit_rows.select("test_id", F.col("contact").alias("channel"), "idx", "t", "v").unionByName(position_.withColumn("channel", F.lit("position")))
    found = switches.references(switches.analyse(bit_rows, position_, specs, ignored)["events"], samples)
    shown = F.transform("refs", lambda r: F.concat_ws("@", r["idx"].cast("string"), F.floor(r["t"] * 1000 + 0.0001).cast("long").cast("string")))
    return found.withColumn("refs", F.array_join(shown, ","))
