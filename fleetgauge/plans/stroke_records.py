"""Full-stroke records made from the part table: one test per part, the part's numbers set its faults.

The command rises from 10 to 90 % at 4 %/s, dwells, falls and dwells, at 4 Hz
for 60 s.  The position follows up to a second late; some parts stick in steps
of 4 %, overshoot, or stop at 80 %; some lose supply pressure while they move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.plans.registry import dealt, sampled, table

KEYS = ["test_id"]
#: Samples of a record.
POINTS = 240


def _command(i: Column) -> Column:
    i = F.least(F.greatest(i, F.lit(0)), F.lit(239))
    return F.when(i < 20, 10).when(i < 100, i - 10).when(i < 140, 90).when(i < 220, 230 - i).otherwise(10).cast("double")


def grid(spark, sf_dir) -> DataFrame:
    """(test_id, i, t, command, position, pressure)."""
    return grid_of(table(spark, sf_dir, "part"))


def grid_of(tests: DataFrame) -> DataFrame:
    """The records of ``tests`` (p_partkey, p_size)."""
    size, key, i = F.col("p_size"), F.col("p_partkey"), F.col("i")
    rows = sampled(tests.select("p_partkey", "p_size"), "p_partkey", POINTS)
    base = _command(i - size % 5)
    base = F.when(size % 4 == 0, F.floor(base / 4) * 4.0).otherwise(base)
    base = F.when(size % 11 == 5, F.least(base, F.lit(80.0))).otherwise(base)
    hump = F.when((size % 7 == 3) & i.between(104, 108), 6.0).otherwise(0.0)
    low = F.when((size % 6 == 1) & i.between(40, 60), 150.0).otherwise(0.0)
    return rows.select(
        key.alias("test_id"), i.cast("long").alias("i"), (i * 0.25).alias("t"), _command(i).alias("command"),
        (base + key % 3 * 0.5 + hump).alias("position"), (F.lit(400.0) + size - low).alias("pressure"),
    )


def moves(spark, sf_dir) -> DataFrame:
    """Manual boundary moves of some tests: the first motion starts later."""
    size = F.col("p_size")
    found = table(spark, sf_dir, "part").where(size % 9 == 0)
    return found.select(F.col("p_partkey").alias("test_id"), F.lit(1).alias("seq"), F.lit(1).alias("segment_index"), F.lit("start").alias("boundary"), (F.lit(6.0) + size % 4).alias("new_time"))


_C = "CASE WHEN {0} < 20 THEN 10 WHEN {0} < 100 THEN {0} - 10 WHEN {0} < 140 THEN 90 WHEN {0} < 220 THEN 230 - {0} ELSE 10 END::DOUBLE"

#: The grid g(test_id, i, t, command, position, pressure), cut into segs and rows r.
GRID_SQL = f"""p AS (SELECT p_partkey, p_size AS z, i, least(greatest(i - z % 5, 0), 239) AS j FROM part, range(240) x(i)),
b AS (SELECT *, {_C.format("i")} AS command, {_C.format("j")} AS f FROM p),
b2 AS (SELECT *, CASE WHEN z % 4 = 0 THEN floor(f / 4) * 4 ELSE f END AS f2 FROM b),
g AS (SELECT p_partkey AS test_id, i, i * 0.25::DOUBLE AS t, command,
  (CASE WHEN z % 11 = 5 THEN least(f2, 80.0) ELSE f2 END + p_partkey % 3 * 0.5 + CASE WHEN z % 7 = 3 AND i BETWEEN 104 AND 108 THEN 6 ELSE 0 END)::DOUBLE AS position,
  (400 + z - CASE WHEN z % 6 = 1 AND i BETWEEN 40 AND 60 THEN 150 ELSE 0 END)::DOUBLE AS pressure FROM b2)"""

SEGMENT_SQL = f"""{GRID_SQL},
d AS (SELECT *, coalesce(lead(command) OVER w - command, 0) * 4 AS slope FROM g WINDOW w AS (PARTITION BY test_id ORDER BY i)),
dd AS (SELECT *, CASE WHEN slope > 0.5 THEN 1 WHEN slope < -0.5 THEN -1 ELSE 0 END AS dir FROM d),
n1 AS (SELECT *, CASE WHEN dir = lag(dir) OVER (PARTITION BY test_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM dd),
n2 AS (SELECT *, sum(new) OVER (PARTITION BY test_id ORDER BY i ROWS UNBOUNDED PRECEDING) - 1 AS seg FROM n1),
segs0 AS (SELECT test_id, seg, CASE any_value(dir) WHEN 1 THEN 'opening' WHEN -1 THEN 'closing' ELSE 'dwell' END AS type, min(i) AS i_start, max(i) AS i_end FROM n2 GROUP BY ALL),
segs1 AS (SELECT s.test_id, seg, type, i_start, i_end, a.t AS t_start, e.t AS t_end, a.command AS cmd_start, e.command AS cmd_end
  FROM segs0 s JOIN g a ON a.test_id = s.test_id AND a.i = i_start JOIN g e ON e.test_id = s.test_id AND e.i = i_end),
segs AS (SELECT *, CASE WHEN type <> 'dwell' THEN coalesce(lead(cmd_start) OVER w, cmd_start) END AS target, lead(t_start) OVER w AS next_t_start, lead(i_end) OVER w AS next_i_end
  FROM segs1 WINDOW w AS (PARTITION BY test_id ORDER BY seg)),
r AS (SELECT g.*, s.seg, s.type, s.target, s.i_end FROM g JOIN segs s ON s.test_id = g.test_id AND g.i BETWEEN s.i_start AND s.i_end)"""
