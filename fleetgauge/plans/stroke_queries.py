"""Full-stroke analysis with its default limits over the records of ``stroke_records``."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge.functions import units
from fleetgauge.operators import fullstroke, runs
from fleetgauge.plans import stroke_records as records
from fleetgauge.plans.registry import query
from fleetgauge.plans.stroke_records import GRID_SQL, KEYS, SEGMENT_SQL


def parts(spark, sf_dir):
    """Grid, segments and the grid's points with their segments.

    They are not held: made anew they lie where their test's rows do, while
    tables read back would be shuffled whole.
    """
    grid = records.grid(spark, sf_dir)
    segs = fullstroke.segment(grid, KEYS)
    return grid, segs, fullstroke.in_segments(grid, segs, KEYS)


@query("stroke_segments", f"""WITH {SEGMENT_SQL} SELECT test_id, seg, type, i_start, i_end, t_start, t_end, cmd_start, cmd_end, target,
  CASE WHEN seg = 0 THEN 'start of record' WHEN type = 'dwell' THEN 'command settles at ' || format('{{:.1f}}', cmd_start) || ' %'
    ELSE 'command leaves ' || format('{{:.1f}}', cmd_start) || CASE type WHEN 'opening' THEN ' % upwards' ELSE ' % downwards' END END AS reason FROM segs""")  # fmt: skip
def stroke_segments(spark, sf_dir):
    """Segments of the command with targets and why they begin."""
    return parts(spark, sf_dir)[1].drop("next_t_start", "next_i_end")


@query("moved_boundaries", f"""WITH {SEGMENT_SQL},
m AS (SELECT p_partkey AS test_id, (6 + p_size % 4) * 4 AS pos FROM part WHERE p_size % 9 = 0),
x AS (SELECT s.test_id, greatest(b.i_start + 1, least(pos, s.i_end - 1)) AS i_new FROM m JOIN segs s ON s.test_id = m.test_id AND s.seg = 1 JOIN segs b ON b.test_id = m.test_id AND b.seg = 0)
SELECT s.test_id, seg, type, CASE WHEN seg = 1 AND i_new IS NOT NULL THEN i_new ELSE i_start END AS i_start, CASE WHEN seg = 0 AND i_new IS NOT NULL THEN i_new - 1 ELSE i_end END AS i_end
FROM segs s LEFT JOIN x USING (test_id)""")  # fmt: skip
def moved_boundaries(spark, sf_dir):
    """Segments after manual boundary moves."""
    grid = records.grid(spark, sf_dir)
    return fullstroke.segment(grid, KEYS, records.moves(spark, sf_dir)).select("test_id", "seg", "type", "i_start", "i_end")


TRAVEL_SQL = """tt AS (SELECT s.test_id, s.seg, any_value(s.type) AS type, any_value(s.target) AS target, min(g.t) FILTER (WHERE abs(position - target) <= 2) AS hit_t,
  any_value(s.t_start) AS t0, any_value(coalesce(next_t_start, t_end)) AS t1
  FROM segs s JOIN g ON g.test_id = s.test_id AND i BETWEEN i_start AND coalesce(next_i_end, i_end) WHERE s.type <> 'dwell' GROUP BY s.test_id, s.seg)"""


@query("stroke_travel_time", f"""WITH {SEGMENT_SQL}, {TRAVEL_SQL}
SELECT test_id, seg, type, target, CASE WHEN hit_t IS NOT NULL THEN round(greatest(0.0, hit_t - t1), 3) END AS travel_time, round(hit_t - t0, 3) AS total_response, hit_t IS NOT NULL AS reached FROM tt""")  # fmt: skip
def stroke_travel_time(spark, sf_dir):
    """Time from the command's arrival until the position settles; none if it never does."""
    return fullstroke.travel_time(parts(spark, sf_dir)[2], KEYS)


DEADBAND_SQL = """mo AS (SELECT *, lag(type) OVER (PARTITION BY test_id ORDER BY seg) AS before FROM segs WHERE type <> 'dwell'),
ow AS (SELECT r.*, before, first_value(position) OVER w AS p0, first_value(command) OVER w AS c0 FROM r JOIN mo USING (test_id, seg) WHERE before <> r.type WINDOW w AS (PARTITION BY r.test_id, r.seg ORDER BY i)),
gn AS (SELECT *, max((abs(position - p0) >= 0.5)::INT) OVER (PARTITION BY test_id, seg ORDER BY i ROWS UNBOUNDED PRECEDING) AS gone FROM ow),
db AS (SELECT test_id, seg, any_value(before || '->' || type) AS direction, round(min(t), 3) AS at_time, round(max(abs(command - c0)), 3) AS deadband, round(max(t), 3) AS unresponsive_until FROM gn WHERE gone = 0 GROUP BY test_id, seg)"""


@query("stroke_deadband", f"WITH {SEGMENT_SQL}, {DEADBAND_SQL} SELECT * FROM db")
def stroke_deadband(spark, sf_dir):
    """Dead band of every reversal."""
    _, segs, rows = parts(spark, sf_dir)
    return fullstroke.deadband(rows, segs, KEYS)


HYSTERESIS_SQL = """qs AS (SELECT test_id, type, command, position FROM r WHERE type <> 'dwell' AND abs(position - command) <= 5),
br AS (SELECT test_id, type, command AS x, list(position ORDER BY position) AS ps FROM qs GROUP BY ALL),
bm AS (SELECT test_id, type, x, list_reduce(ps, lambda a, b: (a + b) / 2) AS y FROM br),
sp AS (SELECT test_id, greatest(min(x) FILTER (WHERE type = 'opening'), min(x) FILTER (WHERE type = 'closing')) AS lo, least(max(x) FILTER (WHERE type = 'opening'), max(x) FILTER (WHERE type = 'closing')) AS hi
  FROM bm GROUP BY test_id HAVING count(DISTINCT type) = 2),
pt AS (SELECT test_id, lo, hi, greatest(1, floor(hi - lo)::INT) AS last, unnest(range(greatest(1, floor(hi - lo)::INT) + 1)) AS k FROM sp WHERE hi > lo),
cx AS (SELECT test_id, k, lo + (hi - lo) * k / last AS c, type FROM pt, (VALUES ('opening'), ('closing')) v(type)),
lo_ AS (SELECT cx.*, b.x AS x0, b.y AS y0 FROM cx ASOF JOIN bm b ON b.test_id = cx.test_id AND b.type = cx.type AND b.x <= cx.c),
hi_ AS (SELECT lo_.*, b.x AS x1, b.y AS y1 FROM lo_ ASOF JOIN bm b ON b.test_id = lo_.test_id AND b.type = lo_.type AND b.x >= lo_.c),
vv AS (SELECT test_id, k, any_value(c) AS c, max(CASE WHEN x1 > x0 THEN y0 + (y1 - y0) * (c - x0) / (x1 - x0) ELSE y0 END) - min(CASE WHEN x1 > x0 THEN y0 + (y1 - y0) * (c - x0) / (x1 - x0) ELSE y0 END) AS gap FROM hi_ GROUP BY test_id, k),
hy AS (SELECT test_id, round(max(gap), 3) AS hysteresis, CASE WHEN max(gap) > 0 THEN round(arg_max(c, (gap, -k)), 2) END AS at_command FROM vv GROUP BY test_id)"""


@query("stroke_hysteresis", f"WITH {SEGMENT_SQL}, {HYSTERESIS_SQL} SELECT * FROM hy")
def stroke_hysteresis(spark, sf_dir):
    """Largest gap between the branches among quasi-static points."""
    grid, segs, _ = parts(spark, sf_dir)
    return fullstroke.hysteresis(grid, KEYS, segs=segs)


OVERSHOOT_SQL = """ov AS (SELECT s.test_id, s.seg, any_value(s.type) AS type, any_value(s.target) AS target,
  round(greatest(0.0, CASE any_value(s.type) WHEN 'opening' THEN max(position) - any_value(s.target) ELSE any_value(s.target) - min(position) END), 3) AS overshoot
  FROM segs s JOIN g ON g.test_id = s.test_id AND g.t >= t_start AND g.t <= t_end + 2 WHERE s.type <> 'dwell' GROUP BY s.test_id, s.seg)"""


@query("stroke_overshoot", f"WITH {SEGMENT_SQL}, {OVERSHOOT_SQL} SELECT * FROM ov")
def stroke_overshoot(spark, sf_dir):
    """Overshoot of every motion, two seconds beyond it included."""
    grid, segs, _ = parts(spark, sf_dir)
    return fullstroke.overshoot(grid, segs, KEYS)


STEADY_SQL = """sd AS (SELECT r.test_id, r.seg, round(min(r.t), 3) AS t_start, round(max(r.t), 6) AS t_end, round(avg(abs(position - command)), 3) AS mean_deviation, round(max(abs(position - command)), 3) AS max_deviation
  FROM r JOIN segs s USING (test_id, seg) WHERE r.type = 'dwell' AND r.t >= s.t_end - greatest(1.0, 0.25 * (s.t_end - s.t_start)) GROUP BY r.test_id, r.seg)"""


@query("stroke_steady_state", f"WITH {SEGMENT_SQL}, {STEADY_SQL} SELECT * FROM sd")
def stroke_steady_state(spark, sf_dir):
    """Deviation in the tail of every dwell."""
    return fullstroke.steady_state(parts(spark, sf_dir)[2], KEYS)


@query("stroke_steady_periods", f"""WITH {SEGMENT_SQL}, o AS (SELECT *, abs(position - command) > 2 AS off FROM r WHERE type = 'dwell'),
n AS (SELECT *, CASE WHEN off = lag(off) OVER (PARTITION BY test_id, seg ORDER BY i) THEN 0 ELSE 1 END AS new FROM o),
u AS (SELECT *, sum(new) OVER (PARTITION BY test_id, seg ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT test_id, seg, min(t) AS start_at, max(t) AS end_at, count(*) AS n FROM u WHERE off GROUP BY test_id, seg, run""")  # fmt: skip
def stroke_steady_periods(spark, sf_dir):
    """Stretches of dwells beyond the limit."""
    return fullstroke.steady_periods(parts(spark, sf_dir)[2], KEYS)


STICK_SQL = """, m AS (SELECT test_id, seg, i, t, command AS c, position AS p, max(i) OVER (PARTITION BY test_id, seg) AS last FROM r WHERE type <> 'dwell'),
off AS (SELECT a.test_id, a.seg, a.i, min(b.i) AS far FROM m a JOIN m b ON b.test_id = a.test_id AND b.seg = a.seg AND b.i > a.i AND abs(b.p - a.p) >= 0.3 GROUP BY ALL),
st AS (SELECT m.*, coalesce(far - 1, last) AS j FROM m LEFT JOIN off USING (test_id, seg, i)),
jp AS (SELECT st.test_id, st.seg, st.i, any_value(s.t) - any_value(st.t) AS stuck, abs(any_value(s.c) - any_value(st.c)) AS change, max(abs(k.p - s.p)) AS jump, max(k.i) AS k_end, max(k.t) AS t_end
  FROM st JOIN m s ON s.test_id = st.test_id AND s.seg = st.seg AND s.i = st.j LEFT JOIN m k ON k.test_id = st.test_id AND k.seg = st.seg AND k.i > st.j AND k.t - s.t <= 0.3 GROUP BY ALL),
hop AS (SELECT st.test_id, st.seg, st.i, st.t, st.last, stuck, change, jump, t_end, coalesce(stuck >= 0.5 AND change >= 1 AND jump >= 1, false) AS hit,
  CASE WHEN coalesce(stuck >= 0.5 AND change >= 1 AND jump >= 1, false) THEN k_end ELSE greatest(j, st.i + 1) END AS nxt FROM st JOIN jp USING (test_id, seg, i)),
walk AS (SELECT test_id, seg, min(i) AS i FROM m GROUP BY ALL UNION ALL SELECT w.test_id, w.seg, h.nxt FROM walk w JOIN hop h ON h.test_id = w.test_id AND h.seg = w.seg AND h.i = w.i WHERE h.nxt < h.last)
SELECT h.test_id, h.seg, round(h.t, 3) AS t_start, round(t_end, 3) AS t_end, round(stuck, 3) AS stuck_s, round(change, 3) AS command_change, round(jump, 3) AS jump
FROM walk w JOIN hop h ON h.test_id = w.test_id AND h.seg = w.seg AND h.i = w.i WHERE hit AND h.i < h.last"""


@query("stroke_stick_slip", f"WITH RECURSIVE {SEGMENT_SQL}{STICK_SQL}")
def stroke_stick_slip(spark, sf_dir):
    """Episodes of sticking and jumping."""
    return fullstroke.stick_slip(parts(spark, sf_dir)[2], KEYS)


LOW_SQL = """lf AS (SELECT *, pressure < 300 AS low FROM r WHERE type <> 'dwell'),
ln AS (SELECT *, CASE WHEN low = lag(low) OVER (PARTITION BY test_id, seg ORDER BY i) THEN 0 ELSE 1 END AS new FROM lf),
lr AS (SELECT *, sum(new) OVER (PARTITION BY test_id, seg ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM ln),
lw AS (SELECT test_id, seg, round(min(t), 3) AS t_start, round(max(t), 3) AS t_end, round(min(pressure), 1) AS min_kpa FROM lr WHERE low GROUP BY test_id, seg, run)"""


@query("stroke_low_supply", f"WITH {SEGMENT_SQL}, {LOW_SQL} SELECT * FROM lw")
def stroke_low_supply(spark, sf_dir):
    """Stretches of motions with too little pressure."""
    return fullstroke.low_supply(parts(spark, sf_dir)[2], KEYS)


INCOMPLETE_SQL = """ie AS (SELECT test_id, max(command) AS c1, min(command) AS c0, max(position) AS p1, min(position) AS p0 FROM g GROUP BY test_id),
ic AS (SELECT test_id, 'high' AS "end", round(c1, 2) AS commanded, round(p1, 2) AS reached FROM ie WHERE p1 < c1 - 2 UNION ALL SELECT test_id, 'low', round(c0, 2), round(p0, 2) FROM ie WHERE p0 > c0 + 2)"""


@query("stroke_incomplete", f"WITH {SEGMENT_SQL}, {INCOMPLETE_SQL} SELECT * FROM ic")
def stroke_incomplete(spark, sf_dir):
    """Ends of the stroke that the position misses."""
    return fullstroke.incomplete_travel(records.grid(spark, sf_dir), KEYS)


@query("stroke_missing_types", f"""WITH {SEGMENT_SQL} SELECT test_id, array_to_string(list_filter(['opening', 'closing', 'dwell'], lambda x: NOT list_contains(ts, x)), ',') AS missing
FROM (SELECT test_id, list(DISTINCT type) AS ts FROM segs GROUP BY test_id)""")  # fmt: skip
def stroke_missing_types(spark, sf_dir):
    """Segment types a test lacks."""
    return fullstroke.missing_types(parts(spark, sf_dir)[1], KEYS).withColumn("missing", F.array_join("missing", ","))


METRIC_SQL = """mx AS (SELECT test_id, 'travel_time' AS metric, max(CASE WHEN hit_t IS NOT NULL THEN round(greatest(0.0, hit_t - t1), 3) END) AS value FROM tt GROUP BY test_id
  UNION ALL SELECT test_id, 'deadband', max(deadband) FROM db GROUP BY test_id UNION ALL SELECT test_id, 'hysteresis', hysteresis FROM hy
  UNION ALL SELECT test_id, 'overshoot', max(overshoot) FROM ov GROUP BY test_id UNION ALL SELECT test_id, 'steady_state', max(max_deviation) FROM sd GROUP BY test_id)"""
ALL_SQL = f"{SEGMENT_SQL}, {TRAVEL_SQL}, {DEADBAND_SQL}, {HYSTERESIS_SQL}, {OVERSHOOT_SQL}, {STEADY_SQL}, {METRIC_SQL}"


@query("stroke_metrics", f"WITH {ALL_SQL} SELECT * FROM mx WHERE value IS NOT NULL")
def stroke_metrics(spark, sf_dir):
    """The five metrics of every test."""
    grid, segs, _ = parts(spark, sf_dir)
    return fullstroke.metrics(grid, segs, KEYS)


def gaps(spark, sf_dir):
    """Dropouts of some tests, as long as a part of the first motion."""
    found = records.table(spark, sf_dir, "part").where("p_size % 10 = 1")
    start = F.lit(8.0)
    return found.select(F.col("p_partkey").alias("test_id"), F.lit("position").alias("channel"), F.lit("gap").alias("kind"), start.alias("start_at"), (start + F.col("p_size") / 4).alias("end_at"))


GAPS_SQL = """ga AS (SELECT p_partkey AS test_id, 8.0::DOUBLE AS a, 8 + p_size / 4.0::DOUBLE AS b FROM part WHERE p_size % 10 = 1),
gb AS (SELECT s.test_id, s.seg, sum(least(t_end, b) - greatest(t_start, a)) / any_value(t_end - t_start) AS share FROM segs s JOIN ga ON ga.test_id = s.test_id AND a < t_end AND b > t_start
  WHERE type <> 'dwell' GROUP BY s.test_id, s.seg HAVING share > 0.2)"""


@query("stroke_gap_blocks", f"WITH {SEGMENT_SQL}, {GAPS_SQL} SELECT test_id, seg, round(share, 6) AS share FROM gb")
def stroke_gap_blocks(spark, sf_dir):
    """Motions of which more than a fifth is lost in gaps."""
    found = fullstroke.gap_blocks(parts(spark, sf_dir)[1], gaps(spark, sf_dir), KEYS)
    return found.withColumn("share", F.round("share", 6))


VERDICT_SQL = f"""WITH RECURSIVE {ALL_SQL}, {GAPS_SQL}, {LOW_SQL}, {INCOMPLETE_SQL}, ss AS (SELECT * FROM ({{stick}})),
lim(metric, limit_) AS (VALUES ('travel_time', 10.0), ('deadband', 2.0), ('hysteresis', 3.0), ('overshoot', 5.0), ('steady_state', 2.0)),
iss AS (SELECT test_id, metric AS kind, value, limit_::DOUBLE AS threshold FROM mx JOIN lim USING (metric) WHERE value > limit_
  UNION ALL SELECT test_id, 'stick_slip', jump, NULL FROM ss UNION ALL SELECT test_id, 'reverse_hysteresis', deadband, 2.0 FROM db WHERE deadband > 2
  UNION ALL SELECT test_id, 'low_supply', min_kpa, 300.0 FROM lw UNION ALL SELECT test_id, 'incomplete_travel', NULL, NULL FROM ic UNION ALL SELECT test_id, 'dropout', NULL, NULL FROM ga)"""


def _verdict_sql(tail: str) -> str:
    """The CTEs of the stick-slip walk go before the issues that use them."""
    ctes, _, final = STICK_SQL.partition("\nSELECT h.test_id")
    return VERDICT_SQL.replace(", ss AS (SELECT * FROM ({stick}))", f"{ctes}, ss AS (SELECT h.test_id{final})") + tail


@query("stroke_issues", _verdict_sql(" SELECT * FROM iss"))
def stroke_issues(spark, sf_dir):
    """Metrics over their limits and all events."""
    return fullstroke.analyse(records.grid(spark, sf_dir), gaps(spark, sf_dir), KEYS)["issues"]


@query("stroke_verdicts", _verdict_sql(""", bl AS (SELECT test_id, string_agg('gaps_in_segment_' || seg, ',' ORDER BY seg) AS blocking FROM gb GROUP BY test_id),
ct AS (SELECT test_id, count(*) AS n_issues, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM iss GROUP BY test_id)
SELECT p_partkey AS test_id, coalesce(blocking, '') AS blocking, coalesce(n_issues, 0) AS n_issues, coalesce(kinds, '') AS kinds,
  CASE WHEN blocking IS NOT NULL THEN 'no_conclusion' WHEN p_size % 8 = 2 THEN 'indeterminate' WHEN n_issues > 0 OR p_size % 8 = 3 THEN 'exceedances' ELSE 'ok' END AS verdict
FROM part LEFT JOIN bl ON bl.test_id = p_partkey LEFT JOIN ct ON ct.test_id = p_partkey"""))  # fmt: skip
def stroke_verdicts(spark, sf_dir):
    """The whole analysis from grid to verdict, with an evaluated uncertainty for some tests."""
    part = records.table(spark, sf_dir, "part")
    overall = F.when(F.col("p_size") % 8 == 2, "indeterminate").when(F.col("p_size") % 8 == 3, "fail").when(F.col("p_size") % 8 == 4, "pass")
    found = part.select(F.col("p_partkey").alias("test_id"), overall.alias("overall"))
    return fullstroke.analyse(records.grid(spark, sf_dir), gaps(spark, sf_dir), KEYS, uncertainty=found)["verdicts"]


def samples(spark, sf_dir):
    """The records as samples, some positions without a stretch and some pressures stuck."""
    size = F.col("p_size")
    part = records.dealt(records.table(spark, sf_dir, "part"), "p_partkey", records.POINTS).select(F.col("p_partkey").alias("test_id"), "p_size")
    grid = records.grid(spark, sf_dir).join(part, "test_id")
    each = F.array(*[F.struct(F.lit(n).alias("channel"), F.col(n).alias("v")) for n in ("command", "position", "pressure")])
    rows = grid.select("test_id", "p_size", "i", "t", F.explode(each).alias("x")).select("test_id", "p_size", F.col("i").alias("idx"), "t", "x.channel", "x.v")
    lost = (F.col("channel") == "position") & (size % 10 == 1) & F.col("idx").between(60, 60 + size)
    moved = F.when((F.col("channel") == "pressure") & (size % 3 > 0), F.col("v") + F.col("idx") % 4).otherwise(F.col("v"))
    return rows.where(~lost).select("test_id", "channel", "idx", "t", moved.alias("v"))


@query("stroke_dropouts", f"""WITH {GRID_SQL}, u AS (SELECT test_id, z0.p_size AS z, i, t, unnest(['command', 'position', 'pressure']) AS channel, unnest([command, position, pressure]) AS v FROM g JOIN part z0 ON p_partkey = test_id),
s AS (SELECT test_id, channel, i, t, CASE WHEN channel = 'pressure' AND z % 3 > 0 THEN v + i % 4 ELSE v END AS v FROM u WHERE NOT (channel = 'position' AND z % 10 = 1 AND i BETWEEN 60 AND 60 + z)),
d AS (SELECT *, lag(t) OVER w AS b, t - lag(t) OVER w AS dt, CASE WHEN v = lag(v) OVER w THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY test_id, channel ORDER BY i)),
r AS (SELECT *, sum(new) OVER (PARTITION BY test_id, channel ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM d)
SELECT test_id, channel, 'gap' AS kind, b AS start_at, t AS end_at FROM d WHERE dt > 0.75 UNION ALL SELECT test_id, channel, 'frozen', min(t), max(t) FROM r WHERE channel <> 'command' GROUP BY test_id, channel, run HAVING count(*) >= 5""")  # fmt: skip
def stroke_dropouts(spark, sf_dir):
    """Gaps and frozen stretches of the records' channels."""
    return runs.dropouts(samples(spark, sf_dir), KEYS)


@query("stroke_blocked_contacts", """SELECT l_suppkey AS test_id, count(*) FILTER (WHERE l_discount * 10 > 0.3 AND l_discount * 10 < 0.7) AS n_illegal FROM lineitem GROUP BY ALL HAVING n_illegal > 0""")
def stroke_blocked_contacts(spark, sf_dir):
    """Contacts with levels that are neither on nor off."""
    rows = records.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("test_id"), (F.col("l_discount") * 10).alias("v"))
    return runs.blocked_contacts(rows, KEYS, units.contact_level(F.col("v")))
