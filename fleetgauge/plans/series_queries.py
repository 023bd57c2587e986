"""Queries over the event table read as samples of tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.functions import verdicts
from fleetgauge.operators import interp, intervals, runs, stats
from fleetgauge.plans.registry import SAMPLES_SQL, query, table
from fleetgauge.sources.series import samples_of_events

HOUR = 3600.0
DAY = 24 * HOUR
KEYS = ["test_id", "channel"]


def samples(spark, sf_dir) -> DataFrame:
    return samples_of_events(table(spark, sf_dir, "events"))


def channel(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(F.col("channel") == name)


@query("series_gaps", f"""WITH {SAMPLES_SQL},
d AS (SELECT *, t - lag(t) OVER w AS dt, lag(t) OVER w AS t_before FROM s WINDOW w AS (PARTITION BY test_id, channel ORDER BY t, idx)),
m AS (SELECT test_id, channel, percentile_disc(0.5) WITHIN GROUP (ORDER BY dt DESC) AS med FROM d WHERE dt IS NOT NULL GROUP BY ALL)
SELECT test_id, channel, idx, round(t_before, 6) AS start_at, round(t, 6) AS end_at FROM d JOIN m USING (test_id, channel) WHERE dt > 3 * med""")  # fmt: skip
def series_gaps(spark, sf_dir):
    """Spacings of more than three times the channel's upper median spacing."""
    w = Window.partitionBy(*KEYS).orderBy("t", "idx")
    spaced = samples(spark, sf_dir).withColumn("before", F.lag("t").over(w)).withColumn("dt", F.col("t") - F.col("before"))
    median = spaced.groupBy(*KEYS).agg(stats.upper_median("dt").alias("median"))
    wide = spaced.join(median, KEYS).where(F.col("dt") > 3 * F.col("median"))
    return wide.select(*KEYS, "idx", F.round("before", 6).alias("start_at"), F.round("t", 6).alias("end_at"))


@query("median_trio", f"""WITH {SAMPLES_SQL}
SELECT test_id, channel, percentile_disc(0.5) WITHIN GROUP (ORDER BY v DESC) AS upper_median,
  percentile_disc(0.5) WITHIN GROUP (ORDER BY v) AS lower_median, round(median(v), 6) AS mean_median FROM s GROUP BY ALL""")  # fmt: skip
def median_trio(spark, sf_dir):
    """The three medians the analyses use."""
    return samples(spark, sf_dir).groupBy(*KEYS).agg(
        stats.upper_median("v").alias("upper_median"), stats.lower_median("v").alias("lower_median"), F.round(F.median("v"), 6).alias("mean_median")
    )


@query("coverage_ratio", f"""WITH {SAMPLES_SQL},
d AS (SELECT *, t - lag(t) OVER (PARTITION BY test_id, channel ORDER BY t, idx) AS dt FROM s),
c AS (SELECT test_id, channel, count(*) FILTER (WHERE t >= 86400.0 AND t < 864000.0) AS n,
  percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN dt > 0 THEN dt END) AS med FROM d GROUP BY ALL)
SELECT test_id, channel, n, round(least(1.0, n / greatest(1.0, 777600.0 / med)), 6) AS coverage FROM c""")  # fmt: skip
def coverage_ratio(spark, sf_dir):
    """Share of expected samples between day 1 and day 10 of each channel."""
    found = interp.coverage(samples(spark, sf_dir), KEYS, F.lit(DAY), F.lit(10 * DAY))
    return found.withColumn("coverage", F.round("coverage", 6))


ALIGN_SQL = f"""{SAMPLES_SQL},
w AS (SELECT * FROM s WHERE channel IN ('view', 'click')),
b AS (SELECT test_id FROM w GROUP BY test_id HAVING count(DISTINCT channel) = 2),
d AS (SELECT *, t - lag(t) OVER (PARTITION BY test_id, channel ORDER BY t, idx) AS dt FROM w JOIN b USING (test_id)),
c AS (SELECT test_id, channel, min(t) AS first, max(t) AS last, percentile_disc(0.5) WITHIN GROUP (ORDER BY dt DESC) AS dt FROM d GROUP BY ALL),
sp AS (SELECT test_id, max(first) AS t0, min(last) AS t1, least(greatest(min(coalesce(dt, 1.0)), 3600.0), 86400.0) AS step FROM c GROUP BY test_id HAVING min(last) > max(first)),
g AS (SELECT test_id, i, t0 + i * step AS t FROM (SELECT *, unnest(range(0, floor((t1 - t0) / step)::BIGINT + 1)) AS i FROM sp)),
q AS (SELECT g.*, c.channel FROM g JOIN c USING (test_id)),
p AS (SELECT q.test_id, q.channel, q.i, q.t, arg_max(w.t, (w.t, w.idx)) AS pt, arg_max(w.v, (w.t, w.idx)) AS pv
  FROM q JOIN w ON w.test_id = q.test_id AND w.channel = q.channel AND w.t <= q.t GROUP BY ALL),
n AS (SELECT q.test_id, q.channel, q.i, arg_min(w.t, (w.t, -w.idx)) AS nt, arg_min(w.v, (w.t, -w.idx)) AS nv
  FROM q JOIN w ON w.test_id = q.test_id AND w.channel = q.channel AND w.t >= q.t GROUP BY ALL),
v AS (SELECT q.test_id, q.channel, q.i, q.t,
  CASE WHEN pt IS NULL THEN nv WHEN nt IS NULL THEN pv WHEN nt > pt THEN pv + (nv - pv) * (q.t - pt) / (nt - pt) ELSE pv END AS v
  FROM q LEFT JOIN p USING (test_id, channel, i) LEFT JOIN n USING (test_id, channel, i)),
a AS (SELECT test_id, i, max(t) AS t, max(v) FILTER (WHERE channel = 'view') AS "view", max(v) FILTER (WHERE channel = 'click') AS click FROM v GROUP BY test_id, i)"""


def aligned(spark, sf_dir) -> DataFrame:
    """Views and clicks of each user on a common grid of one hour to one day."""
    return interp.align(samples(spark, sf_dir), ["view", "click"], HOUR, DAY)


@query("resample_linear", f"""WITH {ALIGN_SQL} SELECT test_id, i, round(t, 3) AS t, round("view", 6) AS "view", round(click, 6) AS click FROM a""")
def resample_linear(spark, sf_dir):
    """Two channels on their common grid."""
    return aligned(spark, sf_dir).select("test_id", "i", F.round("t", 3).alias("t"), F.round("view", 6).alias("view"), F.round("click", 6).alias("click"))


@query("step_hold_asof", f"""WITH {SAMPLES_SQL},
x AS (SELECT p.test_id, p.idx, p.t, arg_max(w.idx, (w.t, w.idx)) AS held_idx FROM s p JOIN s w
  ON p.test_id = w.test_id AND w.channel = 'view' AND w.t <= p.t WHERE p.channel = 'purchase' GROUP BY ALL),
f AS (SELECT test_id, max(idx) AS first_idx FROM (SELECT test_id, idx, t, min(t) OVER (PARTITION BY test_id) AS t0 FROM s WHERE channel = 'view') WHERE t = t0 GROUP BY test_id)
SELECT p.test_id, p.idx, coalesce(x.held_idx, f.first_idx) AS held_idx FROM s p LEFT JOIN x USING (test_id, idx) LEFT JOIN f USING (test_id) WHERE p.channel = 'purchase'""")  # fmt: skip
def step_hold_asof(spark, sf_dir):
    """The view in force at each purchase; before the first view, that one."""
    s = samples(spark, sf_dir)
    points = channel(s, "purchase").select("test_id", "t", F.col("idx").alias("asked"))
    views = channel(s, "view").select("test_id", "t", "idx", "v")
    found = interp.step_hold(points, views, ["test_id"], ["idx"])
    return found.select("test_id", F.col("asked").alias("idx"), F.col("held.idx").cast("int").alias("held_idx"))


@query("nearest_sample", f"""WITH {SAMPLES_SQL}
SELECT test_id, idx, near.idx AS near_idx, round(near.t, 6) AS near_t FROM (
  SELECT e.test_id, e.idx, arg_min({{'idx': w.idx, 't': w.t}}, (abs(w.t - e.t), w.t)) AS near
  FROM s e JOIN s w ON e.test_id = w.test_id AND w.channel = 'view' WHERE e.channel = 'error' GROUP BY e.test_id, e.idx)""")  # fmt: skip
def nearest_sample(spark, sf_dir):
    """The view nearest in time to each error."""
    s = samples(spark, sf_dir)
    points = channel(s, "error").select("test_id", "t", F.col("idx").alias("asked"))
    found = interp.nearest(points, channel(s, "view").select("test_id", "t", "idx", "v"), ["test_id"])
    found = found.where("near is not null")
    return found.select("test_id", F.col("asked").alias("idx"), F.col("near.idx").cast("int").alias("near_idx"), F.round("near.t", 6).alias("near_t"))


@query("exclude_index_ranges", f"""WITH {SAMPLES_SQL},
r AS (SELECT DISTINCT test_id, channel, test_id % 4 AS low, test_id % 4 + 2 AS high FROM s)
SELECT test_id, channel, idx, v FROM s WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.test_id = s.test_id AND r.channel = s.channel AND s.idx BETWEEN r.low AND r.high)""")  # fmt: skip
def exclude_index_ranges(spark, sf_dir):
    """Samples outside of the index ranges excluded per channel."""
    s = samples(spark, sf_dir)
    ranges = s.select(*KEYS).distinct().select(*KEYS, (F.col("test_id") % 4).alias("low"), (F.col("test_id") % 4 + 2).alias("high"))
    return intervals.outside(s, ranges, KEYS, "idx").select(*KEYS, "idx", "v")


@query("over_limit_periods", f"""WITH {SAMPLES_SQL},
f AS (SELECT *, coalesce(v > 50, false) AS o FROM s), n AS (SELECT *, CASE WHEN o IS DISTINCT FROM lag(o) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM f WINDOW w AS (PARTITION BY test_id, channel ORDER BY t, idx)),
g AS (SELECT *, sum(new) OVER (PARTITION BY test_id, channel ORDER BY t, idx ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT test_id, channel, round(min(t), 6) AS start_at, round(max(t), 6) AS end_at, count(*) AS n, max(v) AS worst FROM g WHERE o GROUP BY test_id, channel, run""")  # fmt: skip
def over_limit_periods(spark, sf_dir):
    """Contiguous stretches over a limit with their worst value."""
    found = runs.periods_where(samples(spark, sf_dir), KEYS, ["t", "idx"], F.col("v") > 50, "t", F.max("v").alias("worst"))
    return found.withColumn("start_at", F.round("start_at", 6)).withColumn("end_at", F.round("end_at", 6))


@query("longest_stretch", f"""WITH {SAMPLES_SQL},
f AS (SELECT *, coalesce(v BETWEEN 10 AND 90, false) AS o FROM s), n AS (SELECT *, CASE WHEN o IS DISTINCT FROM lag(o) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM f WINDOW w AS (PARTITION BY test_id, channel ORDER BY t, idx)),
g AS (SELECT *, sum(new) OVER (PARTITION BY test_id, channel ORDER BY t, idx ROWS UNBOUNDED PRECEDING) AS run FROM n),
r AS (SELECT test_id, channel, min(t) AS a, max(t) AS b, count(*) AS n FROM g WHERE o GROUP BY test_id, channel, run)
SELECT test_id, channel, round(a, 6) AS start_at, round(b, 6) AS end_at, n FROM (SELECT *, row_number() OVER (PARTITION BY test_id, channel ORDER BY n DESC, a) AS rn FROM r) WHERE rn = 1""")  # fmt: skip
def longest_stretch(spark, sf_dir):
    """Longest stretch inside the mid band, the first of equal ones."""
    found = runs.periods_where(samples(spark, sf_dir), KEYS, ["t", "idx"], F.col("v").between(10, 90), "t")
    best = runs.longest(found, KEYS)
    return best.select(*KEYS, F.round("start_at", 6).alias("start_at"), F.round("end_at", 6).alias("end_at"), "n")


@query("pulse_clusters", f"""WITH {SAMPLES_SQL},
p AS (SELECT test_id, t AS a, t + 60.0 AS b FROM s WHERE channel = 'error'),
n AS (SELECT *, CASE WHEN a - max(b) OVER (PARTITION BY test_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 259200.0 THEN 0 ELSE 1 END AS new FROM p),
c AS (SELECT *, sum(new) OVER (PARTITION BY test_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS cluster FROM n)
SELECT test_id, cluster::BIGINT AS cluster, round(min(a), 6) AS start_at, round(max(b), 6) AS end_at, count(*) AS pulses, count(*) > 1 AS chatter FROM c GROUP BY test_id, cluster""")  # fmt: skip
def pulse_clusters(spark, sf_dir):
    """Errors, each lasting a minute, in clusters with gaps of at most three days."""
    pulses = channel(samples(spark, sf_dir), "error").select("test_id", F.col("t").alias("a"), (F.col("t") + 60.0).alias("b"))
    found = runs.cluster_by_gap(pulses, ["test_id"], "a", "b", 3 * DAY).withColumn("chatter", F.col("pulses") > 1)
    return found.withColumn("start_at", F.round("start_at", 6)).withColumn("end_at", F.round("end_at", 6))


@query("sliding_slope", f"""WITH {SAMPLES_SQL},
c AS (SELECT *, (us - min(us) OVER (PARTITION BY test_id)) / 6e7::DOUBLE AS x FROM s),
w AS (SELECT test_id, event_id, regr_slope(v, x) OVER f AS slope, count(*) OVER f AS n, max(us) OVER f - min(us) OVER f AS span FROM c
  WINDOW f AS (PARTITION BY test_id ORDER BY us RANGE BETWEEN 1209600000000 PRECEDING AND CURRENT ROW))
SELECT test_id, event_id, CASE WHEN n >= 3 AND span >= 0.8 * 1209600000000 THEN round(slope, 6) END AS slope FROM w""")  # fmt: skip
def sliding_slope(spark, sf_dir):
    """Slope of the values over the last fourteen days at each event."""
    found = stats.trailing_slope(samples(spark, sf_dir), ["test_id"], "us", "v", 14 * 86_400_000_000)
    return found.select("test_id", "event_id", F.round("slope", 6).alias("slope"))


@query("ols_slope", f"""WITH {SAMPLES_SQL} SELECT test_id, channel, round(regr_slope(v, t / 86400.0), 6) AS slope FROM s GROUP BY ALL HAVING count(*) > 2""")
def ols_slope(spark, sf_dir):
    """Least-squares slope per day of each channel."""
    found = samples(spark, sf_dir).groupBy(*KEYS).agg(F.regr_slope("v", F.col("t") / DAY).alias("slope"), F.count(F.lit(1)).alias("n"))
    return found.where("n > 2").select(*KEYS, F.round("slope", 6).alias("slope"))


@query("spearman_avg_rank", f"""WITH {ALIGN_SQL},
r AS (SELECT *, rank() OVER (PARTITION BY test_id ORDER BY "view") + (count(*) OVER (PARTITION BY test_id, "view") - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY test_id ORDER BY click) + (count(*) OVER (PARTITION BY test_id, click) - 1) / 2.0 AS ry FROM a)
SELECT test_id, CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN round(corr(rx, ry), 6) END AS rho, count(*) AS n FROM r GROUP BY test_id""")  # fmt: skip
def spearman_avg_rank(spark, sf_dir):
    """Rank correlation of the aligned channels."""
    return stats.spearman(aligned(spark, sf_dir), ["test_id"], "view", "click").withColumn("rho", F.round("rho", 6))


@query("percentile_interval", f"""WITH {SAMPLES_SQL} SELECT test_id, channel, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high,
  CASE WHEN quantile_cont(v, 0.975) < 100 THEN 'pass' WHEN quantile_cont(v, 0.025) > 100 THEN 'fail' ELSE 'indeterminate' END AS conformance FROM s GROUP BY ALL""")  # fmt: skip
def percentile_interval(spark, sf_dir):
    """Central 95 % interval of each channel against a limit."""
    found = samples(spark, sf_dir).groupBy(*KEYS).agg(stats.interval("v", 0.95).alias("x"))
    low, high = F.get("x", F.lit(0)), F.get("x", F.lit(1))
    return found.select(*KEYS, F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), verdicts.conformance(low, high, F.lit(100.0)).alias("conformance"))


@query("interval_difference", f"""WITH {SAMPLES_SQL},
h AS (SELECT test_id, channel, quantile_cont(v, 0.25) FILTER (WHERE t < 1296000.0) AS al, quantile_cont(v, 0.75) FILTER (WHERE t < 1296000.0) AS ah,
  quantile_cont(v, 0.25) FILTER (WHERE t >= 1296000.0) AS bl, quantile_cont(v, 0.75) FILTER (WHERE t >= 1296000.0) AS bh FROM s GROUP BY ALL)
SELECT test_id, channel, round(al - bh, 6) AS low, round(ah - bl, 6) AS high,
  CASE WHEN al - bh > 0 THEN 'improved' WHEN ah - bl < 0 THEN 'degraded' ELSE 'indeterminate' END AS change FROM h WHERE al IS NOT NULL AND bl IS NOT NULL""")  # fmt: skip
def interval_difference(spark, sf_dir):
    """Interval before day 15 less the interval after it."""
    s = samples(spark, sf_dir).withColumn("part", F.when(F.col("t") < 15 * DAY, "pre").otherwise("post"))
    each = s.groupBy(*KEYS, "part").agg(stats.fused_interval("v", 0.5).alias("x"))
    pre = each.where("part = 'pre'").select(*KEYS, F.col("x").alias("a"))
    post = each.where("part = 'post'").select(*KEYS, F.col("x").alias("b"))
    both = pre.join(post, KEYS)
    bounds = [F.get(side, F.lit(k)) for side in ("a", "b") for k in (0, 1)]
    low, high, change = verdicts.difference(*bounds)
    return both.select(*KEYS, stats.signed_round(low, 6).alias("low"), stats.signed_round(high, 6).alias("high"), change.alias("change"))


TREND_SQL = f"""{SAMPLES_SQL},
f AS (SELECT test_id, channel, arg_min(v, (t, idx)) AS first, arg_max(v, (t, idx)) AS last, count(*) AS n FROM s WHERE v IS NOT NULL GROUP BY ALL),
k AS (SELECT *, CASE WHEN n < 2 THEN 'inconclusive' WHEN last - first > 5 AND last - first > 0.1 * abs(first) THEN 'degrading'
  WHEN first - last > 5 AND first - last > 0.1 * abs(first) THEN 'improving' ELSE 'stable' END AS trend FROM f)"""


def trends(spark, sf_dir) -> DataFrame:
    s = samples(spark, sf_dir).where("v is not null")
    at = F.struct("t", "idx")
    found = s.groupBy(*KEYS).agg(F.min_by("v", at).alias("first"), F.max_by("v", at).alias("last"), F.count(F.lit(1)).alias("n"))
    return found.withColumn("trend", verdicts.trend(F.col("first"), F.col("last"), F.col("n"), 1, 0.1, 5.0))


@query("trend_classify", f"WITH {TREND_SQL} SELECT test_id, channel, first, last, n, trend FROM k")
def trend_classify(spark, sf_dir):
    """First against last value of each channel."""
    return trends(spark, sf_dir)


@query("overall_rollup", f"""WITH {TREND_SQL} SELECT test_id, CASE WHEN NOT bool_or(trend <> 'inconclusive') THEN 'inconclusive' WHEN bool_or(trend = 'degrading') THEN 'degrading'
  WHEN bool_and(trend IN ('stable', 'inconclusive')) THEN 'stable' WHEN bool_or(trend = 'improving') THEN 'improving' ELSE 'mixed' END AS overall FROM k GROUP BY test_id""")  # fmt: skip
def overall_rollup(spark, sf_dir):
    """Roll-up of a test's trend classes."""
    return trends(spark, sf_dir).groupBy("test_id").agg(verdicts.overall(F.collect_set("trend")).alias("overall"))


@query("forward_fill", f"""WITH {SAMPLES_SQL}, b AS (SELECT *, CASE WHEN v <= 30 THEN 0 WHEN v >= 70 THEN 1 END AS bit FROM s)
SELECT test_id, channel, idx, coalesce(last_value(bit IGNORE NULLS) OVER (PARTITION BY test_id, channel ORDER BY t, idx ROWS UNBOUNDED PRECEDING), 0)::INT AS bit FROM b""")  # fmt: skip
def forward_fill(spark, sf_dir):
    """Contact bits with illegal levels replaced by the last valid one."""
    bits = samples(spark, sf_dir).withColumn("bit", F.when(F.col("v") <= 30, 0).when(F.col("v") >= 70, 1))
    return runs.forward_fill(bits, KEYS, ["t", "idx"], "bit", F.lit(0)).select(*KEYS, "idx", "bit")


@query("first_exceedance", f"""WITH {SAMPLES_SQL},
w AS (SELECT *, min(v) OVER (PARTITION BY test_id ORDER BY us RANGE BETWEEN CURRENT ROW AND 86400000000 FOLLOWING) AS low,
  sum(v) OVER (PARTITION BY test_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS total FROM s)
SELECT test_id, round(min(t) FILTER (WHERE low > 30), 6) AS rate_at, round(min(t) FILTER (WHERE total > 1000), 6) AS total_at,
  round(least(min(t) FILTER (WHERE low > 30), min(t) FILTER (WHERE total > 1000)), 6) AS first_at FROM w GROUP BY test_id""")  # fmt: skip
def first_exceedance(spark, sf_dir):
    """Earliest of a rate held over the limit for a day and a total over its limit."""
    ahead = Window.partitionBy("test_id").orderBy("us").rangeBetween(0, 86_400_000_000)
    so_far = Window.partitionBy("test_id").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    w = samples(spark, sf_dir).withColumn("low", F.min("v").over(ahead)).withColumn("total", F.sum("v").over(so_far))
    rate, total = F.min(F.when(F.col("low") > 30, F.col("t"))), F.min(F.when(F.col("total") > 1000, F.col("t")))
    found = w.groupBy("test_id").agg(rate.alias("rate_at"), total.alias("total_at"))
    return found.select("test_id", F.round("rate_at", 6).alias("rate_at"), F.round("total_at", 6).alias("total_at"), F.round(F.least("rate_at", "total_at"), 6).alias("first_at"))


@query("edge_entry_pairing", f"""WITH {SAMPLES_SQL},
b AS (SELECT e.test_id, e.idx, max(w.t) FILTER (WHERE w.t <= e.t) AS before, min(w.t) FILTER (WHERE w.t > e.t) AS after, any_value(e.t) AS t
  FROM s e LEFT JOIN s w ON w.test_id = e.test_id AND w.channel = 'signup' WHERE e.channel = 'purchase' GROUP BY ALL)
SELECT test_id, idx, round(t - coalesce(before, after), 6) AS delay FROM b""")  # fmt: skip
def edge_entry_pairing(spark, sf_dir):
    """Signed delay of each purchase to the latest signup before it, else to the earliest after it."""
    s = samples(spark, sf_dir)
    edges = channel(s, "purchase").select("test_id", "t", F.col("idx").alias("asked"))
    entries = channel(s, "signup").select("test_id", "t", "idx", "v")
    found = interp.step_hold(edges, entries, ["test_id"], ["idx"])
    return found.select("test_id", F.col("asked").alias("idx"), F.round(F.col("t") - F.col("held.t"), 6).alias("delay"))


@query("missing_trigger_anti", f"""WITH {SAMPLES_SQL} SELECT test_id, idx, round(t, 6) AS t FROM s e WHERE channel = 'signup' AND NOT EXISTS (
  SELECT 1 FROM s w WHERE w.test_id = e.test_id AND w.channel = 'purchase' AND w.t BETWEEN e.t - 3600.0 AND e.t + 172800.0)""")  # fmt: skip
def missing_trigger_anti(spark, sf_dir):
    """Signups without a purchase from one hour before to two days after."""
    s = samples(spark, sf_dir)
    triggers = channel(s, "purchase").select("test_id", F.col("t").alias("other_at"))
    found = intervals.without_match(channel(s, "signup"), triggers, ["test_id"], "t", F.lit(HOUR), F.lit(2 * DAY))
    return found.select("test_id", "idx", F.round("t", 6).alias("t"))


INTERVAL_SQL = f"""{SAMPLES_SQL},
a AS (SELECT test_id, idx, t AS x0, t + 86400.0 AS x1 FROM s WHERE channel = 'view'), o AS (SELECT test_id, idx, t AS y0, t + 43200.0 AS y1 FROM s WHERE channel = 'error')"""


def day_intervals(spark, sf_dir, name: str, length: float) -> DataFrame:
    return channel(samples(spark, sf_dir), name).select("test_id", "idx", F.col("t").alias("start_at"), (F.col("t") + length).alias("end_at"))


@query("overlap_share", f"""WITH {INTERVAL_SQL},
c AS (SELECT a.test_id, a.idx, sum(least(x1, y1) - greatest(x0, y0)) AS covered FROM a JOIN o ON a.test_id = o.test_id AND y0 < x1 AND y1 > x0 GROUP BY ALL)
SELECT a.test_id, a.idx, round(coalesce(covered, 0) / (x1 - x0), 6) AS share FROM a LEFT JOIN c USING (test_id, idx)""")  # fmt: skip
def overlap_share(spark, sf_dir):
    """Share of the day after each view that error periods cover."""
    found = intervals.overlap_share(day_intervals(spark, sf_dir, "view", DAY), day_intervals(spark, sf_dir, "error", DAY / 2), ["test_id"])
    return found.select("test_id", "idx", F.round("share", 6).alias("share"))


@query("mutual_exclusion", f"""WITH {INTERVAL_SQL} SELECT a.test_id, a.idx, o.idx AS b_idx, round(least(x1, y1) - greatest(x0, y0), 6) AS overlap
FROM a JOIN o ON a.test_id = o.test_id AND y0 < x1 AND y1 > x0 WHERE least(x1, y1) - greatest(x0, y0) > 3600.0""")  # fmt: skip
def mutual_exclusion(spark, sf_dir):
    """View and error periods of a test that overlap by more than an hour."""
    found = intervals.overlaps(day_intervals(spark, sf_dir, "view", DAY), day_intervals(spark, sf_dir, "error", DAY / 2), ["test_id"])
    return found.where(F.col("overlap") > HOUR).select("test_id", "idx", "b_idx", F.round("overlap", 6).alias("overlap"))


@query("steady_tail", f"""WITH {SAMPLES_SQL}, e AS (SELECT *, max(t) OVER (PARTITION BY test_id, channel) AS t1, min(t) OVER (PARTITION BY test_id, channel) AS t0 FROM s)
SELECT test_id, channel, count(*) AS n, round(avg(abs(v - 50)), 6) AS mean_deviation, max(abs(v - 50)) AS max_deviation FROM e WHERE t >= t1 - greatest(86400.0, 0.25 * (t1 - t0)) GROUP BY ALL""")  # fmt: skip
def steady_tail(spark, sf_dir):
    """Deviation from the set point over the last quarter, at least a day."""
    whole = Window.partitionBy(*KEYS)
    s = samples(spark, sf_dir).withColumn("t1", F.max("t").over(whole)).withColumn("t0", F.min("t").over(whole))
    tail = s.where(F.col("t") >= F.col("t1") - F.greatest(F.lit(DAY), 0.25 * (F.col("t1") - F.col("t0"))))
    off = F.abs(F.col("v") - 50)
    return tail.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(off), 6).alias("mean_deviation"), F.max(off).alias("max_deviation"))


@query("overshoot_window", f"""WITH {SAMPLES_SQL} SELECT e.test_id, e.idx, round(greatest(0.0, max(w.v) - any_value(e.v)), 6) AS overshoot FROM s e JOIN s w
  ON w.test_id = e.test_id AND w.channel = 'view' AND w.t >= e.t AND w.t <= e.t + 172800.0 WHERE e.channel = 'click' GROUP BY e.test_id, e.idx""")  # fmt: skip
def overshoot_window(spark, sf_dir):
    """How far views within two days rise over each click's value."""
    s = samples(spark, sf_dir)
    targets = channel(s, "click").select("test_id", "idx", F.col("t").alias("t0"), F.col("v").alias("target"))
    seen = channel(s, "view").select("test_id", "t", "v")
    inside = targets.join(seen, "test_id").where((F.col("t") >= F.col("t0")) & (F.col("t") <= F.col("t0") + 2 * DAY))
    worst = F.greatest(F.lit(0.0), F.max("v") - F.max("target"))
    return inside.groupBy("test_id", "idx").agg(F.round(worst, 6).alias("overshoot"))


@query("incomplete_travel", f"""WITH {ALIGN_SQL} SELECT test_id, round(max(click) - max("view"), 6) AS short_high, round(min("view") - min(click), 6) AS short_low,
  max("view") < max(click) - 2 OR min("view") > min(click) + 2 AS incomplete FROM a GROUP BY test_id""")  # fmt: skip
def incomplete_travel(spark, sf_dir):
    """Whether the position reaches the command's extremes within the band."""
    a = aligned(spark, sf_dir)
    high, low = F.max("click") - F.max("view"), F.min("view") - F.min("click")
    return a.groupBy("test_id").agg(F.round(high, 6).alias("short_high"), F.round(low, 6).alias("short_low"), ((F.max("view") < F.max("click") - 2) | (F.min("view") > F.min("click") + 2)).alias("incomplete"))


@query("deadband_reversal", f"""WITH {ALIGN_SQL},
z AS (SELECT *, first_value("view") OVER w AS v0, first_value(click) OVER w AS c0 FROM a WINDOW w AS (PARTITION BY test_id ORDER BY i)),
m AS (SELECT test_id, min(i) FILTER (WHERE abs("view" - v0) >= 5) AS moved FROM z GROUP BY test_id)
SELECT test_id, round(max(abs(click - c0)), 6) AS deadband FROM z JOIN m USING (test_id) WHERE i < coalesce(moved, 1e18) GROUP BY test_id""")  # fmt: skip
def deadband_reversal(spark, sf_dir):
    """Largest command change before the position first moves by five."""
    w = Window.partitionBy("test_id").orderBy("i")
    z = aligned(spark, sf_dir).withColumn("v0", F.first("view").over(w)).withColumn("c0", F.first("click").over(w))
    moved = F.min(F.when(F.abs(F.col("view") - F.col("v0")) >= 5, F.col("i"))).over(Window.partitionBy("test_id"))
    still = z.withColumn("moved", moved).where(F.col("moved").isNull() | (F.col("i") < F.col("moved")))
    return still.groupBy("test_id").agg(F.round(F.max(F.abs(F.col("click") - F.col("c0"))), 6).alias("deadband"))


@query("t90_hold", f"""WITH {ALIGN_SQL},
h AS (SELECT *, count(*) FILTER (WHERE "view" >= 30) OVER (PARTITION BY test_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS held FROM a)
SELECT test_id, min(i) FILTER (WHERE held = 3) AS first_i FROM h GROUP BY test_id""")  # fmt: skip
def t90_hold(spark, sf_dir):
    """First grid point from which three in a row reach the level."""
    ahead = Window.partitionBy("test_id").orderBy("i").rowsBetween(0, 2)
    held = F.sum((F.col("view") >= 30).cast("int")).over(ahead)
    return aligned(spark, sf_dir).withColumn("held", held).groupBy("test_id").agg(F.min(F.when(F.col("held") == 3, F.col("i"))).alias("first_i"))


@query("rebound_peaks", f"""WITH {ALIGN_SQL}, fl AS (SELECT *, abs("view" - 50) > 20 AS o FROM a),
nn AS (SELECT *, CASE WHEN o IS DISTINCT FROM lag(o) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM fl WINDOW w AS (PARTITION BY test_id ORDER BY i)),
gg AS (SELECT *, sum(new) OVER (PARTITION BY test_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM nn)
SELECT test_id, min(i) AS start_at, max(i) AS end_at, count(*) AS n, round(max(abs("view" - 50)), 6) AS peak FROM gg WHERE o GROUP BY test_id, run""")  # fmt: skip
def rebound_peaks(spark, sf_dir):
    """Stretches outside of the band and how far they go."""
    off = F.abs(F.col("view") - 50)
    return runs.periods_where(aligned(spark, sf_dir), ["test_id"], ["i"], off > 20, "i", F.round(F.max(off), 6).alias("peak"))


@query("residual_rmse_band", f"""WITH {ALIGN_SQL}, k AS (SELECT *, sum("view" * click) OVER w / sum(click * click) OVER w AS k FROM a WINDOW w AS (PARTITION BY test_id))
SELECT test_id, round(any_value(k), 6) AS factor, round(sqrt(avg(pow("view" - k * click, 2))), 6) AS rmse, round(min("view" - k * click), 6) AS low, round(max("view" - k * click), 6) AS high FROM k GROUP BY test_id""")  # fmt: skip
def residual_rmse_band(spark, sf_dir):
    """Fit through the origin, its residual error and band."""
    a = aligned(spark, sf_dir)
    fit = a.groupBy("test_id").agg(stats.through_origin(F.col("click"), F.col("view")).alias("factor"))
    rest = F.col("view") - F.col("factor") * F.col("click")
    both = a.join(fit, "test_id").withColumn("rest", rest)
    return both.groupBy("test_id").agg(F.round(F.max("factor"), 6).alias("factor"), F.round(F.sqrt(F.avg(F.col("rest") * F.col("rest"))), 6).alias("rmse"), F.round(F.min("rest"), 6).alias("low"), F.round(F.max("rest"), 6).alias("high"))


@query("inversions_count", f"""WITH {ALIGN_SQL}, l AS (SELECT *, lag("view") OVER (PARTITION BY test_id ORDER BY click, i) AS before FROM a)
SELECT test_id, count(*) FILTER (WHERE "view" < before) AS inversions, count(*) FILTER (WHERE "view" < before) = 0 AS monotone FROM l GROUP BY test_id""")  # fmt: skip
def inversions_count(spark, sf_dir):
    """How often the response falls as the command rises."""
    before = F.lag("view").over(Window.partitionBy("test_id").orderBy("click", "i"))
    falls = F.count(F.when(F.col("view") < F.col("before"), 1))
    return aligned(spark, sf_dir).withColumn("before", before).groupBy("test_id").agg(falls.alias("inversions"), (falls == 0).alias("monotone"))


@query("phase_chain", f"""WITH {ALIGN_SQL},
p1 AS (SELECT test_id, min(i) AS permit FROM a WHERE click > 20 GROUP BY test_id),
p2 AS (SELECT a.test_id, min(i) AS moved FROM a JOIN p1 USING (test_id) WHERE i >= permit AND "view" > 40 GROUP BY a.test_id),
p3 AS (SELECT a.test_id, min(i) AS returned FROM a JOIN p2 USING (test_id) WHERE i >= moved AND "view" < 20 GROUP BY a.test_id)
SELECT test_id, permit, moved, returned FROM p1 LEFT JOIN p2 USING (test_id) LEFT JOIN p3 USING (test_id)""")  # fmt: skip
def phase_chain(spark, sf_dir):
    """Permit, then movement, then return: each the first point not before the last."""
    whole = Window.partitionBy("test_id")
    a = aligned(spark, sf_dir)
    a = a.withColumn("permit", F.min(F.when(F.col("click") > 20, F.col("i"))).over(whole))
    a = a.withColumn("moved", F.min(F.when((F.col("i") >= F.col("permit")) & (F.col("view") > 40), F.col("i"))).over(whole))
    a = a.withColumn("returned", F.min(F.when((F.col("i") >= F.col("moved")) & (F.col("view") < 20), F.col("i"))).over(whole))
    return a.where("permit is not null").groupBy("test_id").agg(*[F.max(c).alias(c) for c in ("permit", "moved", "returned")])
