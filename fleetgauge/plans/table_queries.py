"""Queries over the relational tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetgauge.functions import physics, units, verdicts
from fleetgauge.operators import calibration, fullstroke, runs, stats, uncertainty, versions
from fleetgauge.plans import stroke_records
from fleetgauge.plans.registry import SAMPLES_A_TASK, query, table
from fleetgauge.plans.series_queries import samples
from fleetgauge.sources.held import hold

RUNS_SQL = """n AS (SELECT *, CASE WHEN {v} IS DISTINCT FROM lag({v}) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM {t} WINDOW w AS (PARTITION BY {k} ORDER BY {o})),
g AS (SELECT *, sum(new) OVER (PARTITION BY {k} ORDER BY {o} ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM n)"""


@query("series_frozen_runs", "WITH " + RUNS_SQL.format(v="l_quantity", t="lineitem", k="l_partkey", o="l_shipdate, l_orderkey, l_linenumber") + """
SELECT l_partkey, run, any_value(l_quantity) AS l_quantity, min(l_shipdate) AS start_at, max(l_shipdate) AS end_at, count(*) AS n FROM g GROUP BY l_partkey, run HAVING count(*) >= 2""")  # fmt: skip
def series_frozen_runs(spark, sf_dir):
    """Runs of exactly equal quantities of a part in shipping order."""
    found = runs.run_lengths(table(spark, sf_dir, "lineitem"), ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber"], "l_quantity", "l_shipdate")
    return found.where("n >= 2")


STATUS_RUNS = "WITH " + RUNS_SQL.format(v="o_orderstatus", t="orders", k="o_custkey", o="o_orderdate, o_orderkey") + """,
r AS (SELECT o_custkey, run, any_value(o_orderstatus) AS o_orderstatus, min(o_orderdate) AS start_at, max(o_orderdate) AS end_at, count(*) AS n FROM g GROUP BY o_custkey, run)"""


def status_runs(spark, sf_dir):
    return runs.run_lengths(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderstatus", "o_orderdate")


@query("run_length_segments", STATUS_RUNS + " SELECT * FROM r")
def run_length_segments(spark, sf_dir):
    """Runs of equal order status of each customer."""
    return status_runs(spark, sf_dir)


@query("short_run_merge", STATUS_RUNS + """,
k AS (SELECT *, CASE WHEN NOT (o_orderstatus = 'P' AND n < 2) THEN o_orderstatus END AS keep FROM r),
f AS (SELECT *, coalesce(last_value(keep IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY run ROWS UNBOUNDED PRECEDING),
  first_value(keep IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY run ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), o_orderstatus) AS status FROM k),
x AS (SELECT *, CASE WHEN status IS DISTINCT FROM lag(status) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS fresh FROM f WINDOW w AS (PARTITION BY o_custkey ORDER BY run)),
y AS (SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY run ROWS UNBOUNDED PRECEDING)::BIGINT AS merged FROM x)
SELECT o_custkey, merged, any_value(status) AS o_orderstatus, min(start_at) AS start_at, max(end_at) AS end_at, sum(n)::BIGINT AS n FROM y GROUP BY o_custkey, merged""")  # fmt: skip
def short_run_merge(spark, sf_dir):
    """Status runs after single pending orders have joined their neighbours."""
    short = (F.col("o_orderstatus") == "P") & (F.col("n") < 2)
    return runs.merge_short(status_runs(spark, sf_dir), ["o_custkey"], "o_orderstatus", short)


PRESSURE_UNITS = ("kPa", " MPa", "bar", "PSI ", "kgf/cm2", "mmHg")


@query("normalise_units", """WITH u AS (SELECT p_partkey, p_retailprice AS v, (['kpa', 'mpa', 'bar', 'psi', 'kgf/cm2', 'mmhg'])[p_size % 6 + 1] AS u, p_size % 3 AS k FROM part)
SELECT p_partkey, round(v * CASE u WHEN 'kpa' THEN 1.0 WHEN 'mpa' THEN 1000.0 WHEN 'bar' THEN 100.0 WHEN 'psi' THEN 6.894757 WHEN 'kgf/cm2' THEN 98.0665 END, 8) AS kpa,
  round(CASE k WHEN 0 THEN v WHEN 1 THEN v - 273.15 ELSE v * (5.0::DOUBLE / 9.0) - 160.0::DOUBLE / 9.0 END, 7) AS celsius,
  round(CASE WHEN k = 0 THEN CASE WHEN v / 100 BETWEEN -10 AND 110 THEN v / 100 END WHEN k = 1 THEN CASE WHEN v / 100 BETWEEN 0 AND 25 THEN (v / 100 - 4) / 16 * 100 END END, 7) AS percent FROM u""")  # fmt: skip
def normalise_units(spark, sf_dir):
    """Prices read as pressures, temperatures and signals of several units."""
    part = table(spark, sf_dir, "part")
    unit = F.get(F.array(*[F.lit(u) for u in PRESSURE_UNITS]), F.col("p_size") % 6)
    degree = F.get(F.array(F.lit("C"), F.lit("K"), F.lit("F")), F.col("p_size") % 3)
    signal = F.get(F.array(F.lit("%"), F.lit("mA"), F.lit("V")), F.col("p_size") % 3)
    v = F.col("p_retailprice")
    percent = units.span_percent(v / 100, signal, F.lit(0.0), F.lit(100.0), F.lit("%"))
    return part.select(
        "p_partkey", F.round(units.by_factor(v, unit, units.PRESSURE_KPA), 8).alias("kpa"),
        F.round(units.temperature_c(v, degree), 7).alias("celsius"), F.round(percent, 7).alias("percent"),
    )


CURVE = [(900.0, 900.5), (1100.0, 1101.0), (1300.0, 1299.0), (1700.0, 1702.5)]


@query("piecewise_correct", """WITH c(x0, y0, x1, y1) AS (VALUES (900.0::DOUBLE, 900.5::DOUBLE, 1100.0::DOUBLE, 1101.0::DOUBLE), (1100.0, 1101.0, 1300.0, 1299.0), (1300.0, 1299.0, 1700.0, 1702.5)),
j AS (SELECT p_partkey, p_retailprice AS v, x0, y0, x1, y1, row_number() OVER (PARTITION BY p_partkey ORDER BY x0) AS rn FROM part JOIN c ON p_retailprice BETWEEN x0 AND x1)
SELECT p.p_partkey, round(y0 + (v - x0) * ((y1 - y0) / (x1 - x0)), 5) AS corrected, corrected IS NULL AS outside FROM part p LEFT JOIN j ON p.p_partkey = j.p_partkey AND rn = 1""")  # fmt: skip
def piecewise_correct(spark, sf_dir):
    """Readings corrected by a certificate's points, none outside of them."""
    value = F.round(physics.piecewise(F.col("p_retailprice"), CURVE), 5)
    return table(spark, sf_dir, "part").select("p_partkey", value.alias("corrected"), value.isNull().alias("outside"))


@query("calib_validity", """WITH o AS (SELECT o_orderkey, o_orderdate AS a, o_orderdate + INTERVAL 30 DAY AS b, TIMESTAMP '1994-01-01' + to_days((o_custkey % 5 * 200)::INT) AS f, TIMESTAMP '1997-01-01' + to_days((o_custkey % 7 * 100)::INT) AS u FROM orders)
SELECT o_orderkey, CASE WHEN a >= f AND b <= u THEN 'ok' WHEN b <= f THEN 'not_yet_valid' WHEN a >= u THEN 'expired' ELSE 'spans_boundary' END AS status FROM o""")  # fmt: skip
def calib_validity(spark, sf_dir):
    """Thirty-day tests against certificates valid for some years."""
    o = table(spark, sf_dir, "orders")
    day = lambda n: F.make_dt_interval(days=n.cast("int"))
    start = F.lit("1994-01-01").cast("timestamp_ntz") + day(F.col("o_custkey") % 5 * 200)
    until = F.lit("1997-01-01").cast("timestamp_ntz") + day(F.col("o_custkey") % 7 * 100)
    return o.select("o_orderkey", verdicts.validity(F.col("o_orderdate"), F.col("o_orderdate") + day(F.lit(30)), start, until).alias("status"))


@query("apply_chain_gates", """WITH c AS (SELECT o_custkey AS test_id, o_orderpriority AS channel, min(o_orderdate) AS a, max(o_orderdate) AS b, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY ALL),
j AS (SELECT c.*, CASE WHEN test_id % 10 <> 0 THEN test_id % 40 END AS version_id, s.s_suppkey, s.s_nationkey FROM c LEFT JOIN supplier s ON test_id % 10 <> 0 AND s.s_suppkey = test_id % 40),
v AS (SELECT *, TIMESTAMP '1993-01-01' + to_days((s_suppkey % 9 * 150)::INT) AS f, TIMESTAMP '1999-01-01' - to_days((s_suppkey % 4 * 400)::INT) AS u FROM j)
SELECT test_id, channel, version_id, CASE WHEN version_id IS NULL THEN 'not_bound' WHEN s_suppkey IS NULL THEN 'version_missing' WHEN s_suppkey % 6 = 0 THEN 'type_mismatch' WHEN s_suppkey % 7 = 0 THEN 'unit_incompatible'
  WHEN s_suppkey % 11 = 0 THEN 'points_nonmonotonic' WHEN a >= f AND b <= u THEN CASE WHEN low < -1e-9 OR high > 400000 + 1e-9 THEN 'range_uncovered' WHEN low < 1000 OR high > 350000 THEN 'points_outside' END
  WHEN b <= f THEN 'not_yet_valid' WHEN a >= u THEN 'expired' ELSE 'spans_boundary' END AS gate, gate IS NULL AS accepted FROM v""")  # fmt: skip
def apply_chain_gates(spark, sf_dir):
    """First failing gate of each customer and priority, with suppliers as certificates."""
    orders = table(spark, sf_dir, "orders")
    channels = orders.groupBy(F.col("o_custkey").alias("test_id"), F.col("o_orderpriority").alias("channel")).agg(
        F.min("o_orderdate").alias("starts"), F.max("o_orderdate").alias("ends"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high")
    )
    channels = channels.withColumn("measurement_type", F.lit("pressure")).withColumn("unit_family", F.lit("kpa"))
    bindings = channels.where("test_id % 10 <> 0").select("test_id", "channel", (F.col("test_id") % 40).alias("version_id"))
    key = F.col("s_suppkey")
    day = lambda n: F.make_dt_interval(days=n.cast("int"))

    def point(x, y):
        return F.struct(F.lit(float(x)).alias("ind"), F.lit(float(y)).alias("ref"))

    points = F.when(key % 11 == 0, F.array(point(1000, 1000), point(900, 1100))).otherwise(F.array(point(1000, 1000), point(350000, 350100)))
    certificates = table(spark, sf_dir, "supplier").select(
        key.alias("version_id"), F.when(key % 6 == 0, "travel").otherwise("pressure").alias("cert_type"), F.when(key % 7 == 0, "mm").otherwise("kpa").alias("cert_family"),
        (F.lit("1993-01-01").cast("timestamp_ntz") + day(key % 9 * 150)).alias("valid_from"), (F.lit("1999-01-01").cast("timestamp_ntz") - day(key % 4 * 400)).alias("valid_until"),
        F.lit(0.0).alias("range_min"), F.lit(400000.0).alias("range_max"), points.alias("points"),
    )
    return calibration.apply_chain(channels, bindings, certificates)


@query("chain_compare_full_outer", """WITH a AS (SELECT s_nationkey AS key, sha256(count(*)::VARCHAR) AS digest, sum(s_acctbal) AS x FROM supplier GROUP BY ALL), b AS (SELECT c_nationkey AS key, sha256((count(*) // 15)::VARCHAR) AS digest, sum(c_acctbal) AS x FROM customer GROUP BY ALL)
SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.digest IS NULL THEN 'post_only' WHEN b.digest IS NULL THEN 'pre_only' WHEN a.digest = b.digest THEN 'same' ELSE 'recalibrated' END AS status, round(b.x - a.x, 2) AS delta FROM a FULL JOIN b ON a.key = b.key""")  # fmt: skip
def chain_compare_full_outer(spark, sf_dir):
    """Suppliers' and customers' figures by nation as two chains."""
    pre = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg(F.sha2(F.count(F.lit(1)).cast("string"), 256).alias("digest"), F.sum("s_acctbal").alias("correction"))
    post = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("key"))
    post = post.agg(F.sha2(F.floor(F.count(F.lit(1)) / 15).cast("string"), 256).alias("digest"), F.sum("c_acctbal").alias("correction"))
    return calibration.compare_chains(pre, post).select("key", "status", F.round("delta", 2).alias("delta"))


@query("characteristic_fraction", """SELECT p_partkey, round(CASE p_size % 3 WHEN 0 THEN least(greatest(p_size * 2.5 / 100, 0.0), 1.0) WHEN 1 THEN pow(50.0, least(greatest(p_size * 2.5 / 100, 0.0), 1.0) - 1) ELSE sqrt(least(greatest(p_size * 2.5 / 100, 0.0), 1.0)) END, 6) AS fraction FROM part""")
def characteristic_fraction(spark, sf_dir):
    """Share of the rated coefficient by size as position."""
    kind = F.get(F.array(F.lit("linear"), F.lit("equal_percentage"), F.lit("quick_opening")), F.col("p_size") % 3)
    value = physics.characteristic(F.col("p_size") * 2.5, kind, F.lit(50.0))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(value, 6).alias("fraction"))


@query("liquid_cv", """SELECT p_partkey, CASE WHEN p_size - 5 > 0 AND p_retailprice / 10 - 92 > 0 THEN round((p_size - 5) / (0.865 * sqrt((p_retailprice / 10 - 92) / 100 / ((900 + p_size) / 999.0))), 6) END AS cv FROM part""")
def liquid_cv(spark, sf_dir):
    """Flow coefficient, none for flows or drops that aren't positive."""
    cv = physics.liquid_cv(F.col("p_size") - 5, F.col("p_retailprice") / 10 - 92, F.lit(900) + F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(cv, 6).alias("cv"))


@query("choked_dp", """SELECT p_partkey, round(0.96 - 0.28 * sqrt(p_size / 22064.0), 6) AS ff, round(0.81 * (p_retailprice - (0.96 - 0.28 * sqrt(p_size / 22064.0)) * p_size), 6) AS choked FROM part""")
def choked_dp(spark, sf_dir):
    """Critical pressure ratio and choked drop."""
    pv, pc = F.col("p_size").cast("double"), F.lit(22064.0)
    choked = physics.choked_drop(F.col("p_retailprice"), pv, pc, F.lit(0.9))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(physics.critical_ratio(pv, pc), 6).alias("ff"), F.round(choked, 6).alias("choked"))


@query("exclusion_codes", """WITH x AS (SELECT l_orderkey, l_linenumber, [CASE WHEN l_quantity <= 3 THEN 'too_short' END, CASE WHEN l_discount >= 0.09 THEN 'drift' END, CASE WHEN l_extendedprice > 80000 THEN 'overrange' END, CASE WHEN l_tax = 0 THEN 'low_dp' END] AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, array_to_string(list_filter(c, lambda v: v IS NOT NULL), ',') AS codes, coalesce(list_filter(c, lambda v: v IS NOT NULL)[1], 'adopted') AS first_code FROM x""")
def exclusion_codes(spark, sf_dir):
    """All reasons to leave a point out, and the one that wins."""
    rules = {"too_short": F.col("l_quantity") <= 3, "drift": F.col("l_discount") >= 0.09, "overrange": F.col("l_extendedprice") > 80000, "low_dp": F.col("l_tax") == 0}
    codes = F.array_compact(F.array(*[F.when(rule, code) for code, rule in rules.items()]))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(codes, ",").alias("codes"), F.coalesce(F.get(codes, F.lit(0)), F.lit("adopted")).alias("first_code"))


@query("isolation_order", """WITH f AS (SELECT o_custkey, o_orderpriority, o_orderdate, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) - 1 AS duplicates FROM orders),
l AS (SELECT *, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS before FROM f WHERE rn = 1)
SELECT o_custkey, o_orderpriority, duplicates, coalesce(o_orderdate > before, true) AS in_order FROM l""")  # fmt: skip
def isolation_order(spark, sf_dir):
    """First occurrence of each action, its repeats, and whether the order is kept."""
    first = Window.partitionBy("o_custkey", "o_orderpriority")
    rows = table(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(first.orderBy("o_orderdate", "o_orderkey")))
    rows = rows.withColumn("duplicates", F.count(F.lit(1)).over(first) - 1).where("rn = 1")
    before = F.lag("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderpriority"))
    return rows.select("o_custkey", "o_orderpriority", "duplicates", F.coalesce(F.col("o_orderdate") > before, F.lit(True)).alias("in_order"))


@query("net_thrust", """SELECT p_partkey, round(CASE WHEN p_size % 3 = 0 THEN p_retailprice * 0.02 * 1000 - p_size * 10 * 0.018 * 1000 WHEN p_size % 3 = 1 THEN p_retailprice * 0.02 * 1000 - p_size * 100 ELSE p_size * 100 - p_retailprice * 0.02 * 1000 END, 3) AS force_n FROM part""")
def net_thrust(spark, sf_dir):
    """Net stem force of three actuator kinds."""
    acting = F.when(F.col("p_size") % 3 == 0, "double").otherwise("single")
    action = F.when(F.col("p_size") % 3 == 1, "fail_close").otherwise("fail_open")
    force = physics.net_thrust(acting, action, F.col("p_retailprice"), F.col("p_size") * 10, F.lit(0.02), F.lit(0.018), F.col("p_size") * 100)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(force, 3).alias("force_n"))


@query("through_origin_fit", """SELECT l_suppkey, round(sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity), 6) AS factor, count(*) AS n FROM lineitem GROUP BY l_suppkey""")
def through_origin_fit(spark, sf_dir):
    """Price per quantity of each supplier, fitted through the origin."""
    fit = stats.through_origin(F.col("l_quantity"), F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(fit, 6).alias("factor"), F.count(F.lit(1)).alias("n"))


@query("latest_version", """WITH v AS (SELECT o_custkey AS test_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, o_orderkey, o_totalprice FROM orders)
SELECT test_id, version, o_orderkey, o_totalprice, version + 1 AS next_version FROM (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY version DESC) AS rn FROM v) WHERE rn = 1""")  # fmt: skip
def latest_version(spark, sf_dir):
    """Each customer's last order as its latest version, and the version to come."""
    version = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("test_id"), version.alias("version"), "o_orderkey", "o_totalprice")
    return versions.latest(rows).join(versions.next_version(rows), "test_id")


@query("first_device_overlap", """WITH e AS (SELECT l_orderkey AS k, 'part ' || l_partkey AS device, epoch(l_shipdate) AS t0, epoch(l_shipdate) + 864000.0 AS t1 FROM lineitem), a AS (SELECT o_orderkey AS k, o_orderpriority AS action, epoch(o_orderdate) + 2592000.0 AS a0, epoch(o_orderdate) + 7776000.0 AS a1 FROM orders)
SELECT a.k, action, arg_min(device, (t0, device)) AS device, count(*) AS n FROM a JOIN e ON a.k = e.k AND t0 < a1 AND t1 > a0 GROUP BY a.k, action""")  # fmt: skip
def first_device_overlap(spark, sf_dir):
    """First shipped part in the second and third month of each order."""
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1e6)
    t0, a = seconds("l_shipdate"), seconds("o_orderdate")
    events = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.concat(F.lit("part "), "l_partkey").alias("device"), t0.alias("t0"), (t0 + 864000.0).alias("t1"))
    actions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("action"), (a + 2592000.0).alias("a0"), (a + 7776000.0).alias("a1"))
    return versions.first_overlapping(events, actions, ["k"])


@query("revision_delta", """WITH y AS (SELECT o_custkey, o_orderpriority, year(o_orderdate) AS y, avg(o_totalprice) AS m FROM orders GROUP BY ALL), e AS (SELECT min(y) AS y0, max(y) AS y1 FROM y),
a AS (SELECT y.* FROM y JOIN e ON y = y0), b AS (SELECT y.* FROM y JOIN e ON y = y1)
SELECT a.o_custkey, a.o_orderpriority, round(b.m - a.m, 4) AS delta, CASE WHEN b.m IS NULL THEN 'missing' WHEN b.m - a.m = 0 THEN 'unchanged' WHEN b.m - a.m < 0 THEN 'improved' ELSE 'degraded' END AS change
FROM a LEFT JOIN b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority""")  # fmt: skip
def revision_delta(spark, sf_dir):
    """Mean order price of the first year against the last, lower being better."""
    keys = ["o_custkey", "o_orderpriority"]
    yearly = table(spark, sf_dir, "orders").groupBy(*keys, F.year("o_orderdate").alias("y")).agg(F.avg("o_totalprice").alias("m"))
    ends = F.broadcast(yearly.agg(F.min("y").alias("y0"), F.max("y").alias("y1")))  # one row
    marked = yearly.join(ends, (F.col("y") == F.col("y0")) | (F.col("y") == F.col("y1")))
    found = versions.deltas(marked.where("y = y0"), marked.where("y = y1"), keys, "m", -1)
    return found.select(*keys, F.round("delta", 4).alias("delta"), "change")


@query("conformance", """SELECT l_suppkey, round(min(l_extendedprice), 2) AS low, round(max(l_extendedprice), 2) AS high, CASE WHEN max(l_extendedprice) < 94000 THEN 'pass' WHEN min(l_extendedprice) > 94000 THEN 'fail' ELSE 'indeterminate' END AS state FROM lineitem GROUP BY l_suppkey""")
def conformance(spark, sf_dir):
    """Price range of each supplier against a limit."""
    low, high = F.min("l_extendedprice"), F.max("l_extendedprice")
    found = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(low.alias("low"), high.alias("high"))
    return found.select("l_suppkey", F.round("low", 2).alias("low"), F.round("high", 2).alias("high"), verdicts.conformance(F.col("low"), F.col("high"), F.lit(94000.0)).alias("state"))


@query("mc_interval")
def mc_interval(spark, sf_dir):
    """Intervals of the stroke metrics of each supplier's record over perturbed trials, with manual boundaries and failed trials."""
    n = 32
    tests = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey"), (F.col("s_nationkey") + 1).alias("p_size"))
    grid = stroke_records.grid_of(tests)
    each = F.array(*[F.struct(F.lit(x).alias("channel"), F.col(x).alias("v")) for x in ("command", "position", "pressure")])
    rows = grid.select("test_id", F.col("i").alias("idx"), "t", F.explode(each).alias("x")).select("test_id", "x.channel", "idx", "t", "x.v")
    parts = [("position", "accuracy", 0.3, "rectangular", False), ("position", "resolution", 0.05, "rectangular", True), ("pressure", "calibration", 2.0, "normal", False)]
    part = F.array(*[F.struct(F.lit(c).alias("channel"), F.lit(k).alias("kind"), F.lit("channel").alias("source"), F.lit(x).alias("scale"), F.lit(d).alias("distribution"), F.lit(p).alias("per_point")) for c, k, x, d, p in parts])
    ids = tests.select(F.col("p_partkey").alias("test_id"), "p_size")
    inputs = ids.select("test_id", F.when((F.col("p_size") % 8 == 0), "invalid").otherwise("used").alias("status"), F.explode(part).alias("x")).select("test_id", "x.*", "status")
    jitter = ids.select("test_id", F.lit("position").alias("channel"), F.lit(0.01).alias("jitter_s"))
    moves = ids.where("p_size % 9 = 0").select("test_id", F.lit(1).alias("seq"), F.lit(1).alias("segment_index"), F.lit("start").alias("boundary"), F.lit(6.0).alias("new_time"))
    # So many that no task has to spill while it sorts the samples of all trials.
    tasks = max(1, -(-tests.count() * stroke_records.POINTS * 3 * n // SAMPLES_A_TASK))
    trials = hold(uncertainty.trial_metrics(uncertainty.perturb_by(rows, inputs, jitter, n, tasks=tasks), dealt=True, moves=moves, trials=n), "trials")
    segs = hold(fullstroke.segment(grid, ["test_id"], moves), "segments")
    central = fullstroke.metrics(grid, segs, ["test_id"])
    due = uncertainty.input_states(inputs, jitter).where("state = 'evaluated'").select("test_id")
    found = hold(uncertainty.evaluate(trials, central, n_trials=n, tests=due), "intervals")
    overall = uncertainty.overall(found, uncertainty.valid_trials(due, trials, n), n)
    supply = uncertainty.supply_conformance(trials).select("test_id", F.lit(uncertainty.SUPPLY).alias("metric"), "n", "low", "high", "status")
    return found.unionByName(supply).join(overall, "test_id")
