"""Full-stroke analysis on a common grid: segments, metrics, detections, issues and verdict.

``grid`` has the key columns, i (0, 1, ...), t, command, position and pressure.
All functions work on all tests at once; ``keys`` may have more than the test,
as a Monte-Carlo trial.  A record's rows meet in one task for its windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.operators import anchors, interp, runs, stats, strokes_at_once
from fleetgauge.sources.held import hold

MOTION = ("opening", "closing")
#: Default limits.
LIMITS = {
    "travel_time": 10.0, "deadband": 2.0, "hysteresis": 3.0, "overshoot": 5.0, "steady_state": 2.0,
    "supply_min_kpa": 300.0, "settle_band": 2.0,
}
#: Share of a motion segment's time that gaps may cover.
GAP_SHARE = 0.2


def directions(grid: DataFrame, keys: list[str], slope_min: float = 0.5, window_s: float = 0.4) -> DataFrame:
    """``grid`` with slope and direction (1, -1, 0) of the command over less than ``window_s`` ahead."""
    ahead = Window.partitionBy(*keys).orderBy("__us").rangeBetween(0, round(window_s * 1e6) - 1)
    rows = grid.withColumn("__us", stats.micros(F.col("t")))
    dt = F.last("t").over(ahead) - F.col("t")
    rows = rows.withColumn("slope", F.when(dt > 0, (F.last("command").over(ahead) - F.col("command")) / dt).otherwise(0.0))
    sign = F.when(F.col("slope") > slope_min, 1).when(F.col("slope") < -slope_min, -1).otherwise(0)
    return rows.withColumn("direction", sign).drop("__us")


def cut(grid: DataFrame, keys: list[str], min_dwell_s: float = 1.0, **how: float) -> DataFrame:
    """Segments before manual moves: keys, seg, type, i_start, i_end, and their first and last points (i, t, c); dwells shorter than ``min_dwell_s`` join the motion before."""
    c = F.col
    marked = runs.mark_runs(directions(grid, keys, **how), keys, ["i"], c("direction"))
    point = F.struct("i", "t", F.col("command").alias("c"))
    found = marked.groupBy(*keys, "run").agg(
        F.first("direction").alias("direction"), F.min(point).alias("start_at"), F.max(point).alias("end_at"),
        F.count(F.lit(1)).alias("n"), (F.max("t") - F.min("t")).alias("length"),
    )
    merged = runs.merge_short(found, keys, "direction", (c("direction") == 0) & (c("length") < min_dwell_s))
    kind = F.when(c("direction") == 1, "opening").when(c("direction") == -1, "closing").otherwise("dwell")
    return merged.select(
        *keys, (c("merged") - 1).cast("int").alias("seg"), kind.alias("type"), c("start_at.i").alias("i_start"), c("end_at.i").alias("i_end"),
        F.round("start_at.t", 6).alias("t_start"), F.round("end_at.t", 6).alias("t_end"), F.round("start_at.c", 4).alias("cmd_start"), F.round("end_at.c", 4).alias("cmd_end"),
    )


def move_boundaries(segs: DataFrame, grid: DataFrame, moves: DataFrame, keys: list[str]) -> DataFrame:
    """``segs`` after manual moves (keys, seq, segment_index, boundary start or end, new_time), in the order of seq.

    A boundary goes to the nearest grid point but stays inside its two
    segments; the record's ends and unknown segments stay as they are.
    """
    asked = moves.select(*keys, F.col("new_time").cast("double").alias("t"), "seq", "segment_index", "boundary")
    known = grid.select(*keys, "t", F.col("i").alias("idx"), F.col("t").alias("v"))
    placed = interp.nearest_of_few(asked, known, keys).withColumn("i_new", F.col("near.idx"))
    steps = placed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "segment_index", "boundary", "i_new"))).alias("moves"))
    whole = segs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seg", "type", F.col("i_start").cast("long").alias("i_start"), F.col("i_end").cast("long").alias("i_end")))).alias("all"))

    def step(all_: Column, m: Column) -> Column:
        k = m["segment_index"]
        this, before, after = F.get(all_, k), F.get(all_, k - 1), F.get(all_, k + 1)
        at_start = F.greatest(before["i_start"] + 1, F.least(m["i_new"], this["i_end"] - 1))
        at_end = F.greatest(this["i_start"] + 1, F.least(m["i_new"], after["i_end"] - 1))
        start = (m["boundary"] == "start") & (k > 0) & (k < F.size(all_))
        end = (m["boundary"] == "end") & (k >= 0) & (k < F.size(all_) - 1)

        def placed_at(s: Column, j: Column) -> Column:
            first = F.when(start & (j == k), at_start).when(end & (j == k + 1), at_end + 1).otherwise(s["i_start"])
            last = F.when(start & (j == k - 1), at_start - 1).when(end & (j == k), at_end).otherwise(s["i_end"])
            return F.struct(s["seg"].alias("seg"), s["type"].alias("type"), first.alias("i_start"), last.alias("i_end"))

        return F.transform(all_, placed_at)

    both = whole.join(steps, keys, "left").withColumn("all", F.when(F.col("moves").isNull(), F.col("all")).otherwise(F.aggregate("moves", F.col("all"), step)))
    return both.select(*keys, F.explode("all").alias("s")).select(*keys, "s.*")


def segment(grid: DataFrame, keys: list[str], moves: DataFrame | None = None, **how: float) -> DataFrame:
    """One row per segment: keys, seg, type, i_start, i_end, t_start, t_end, cmd_start, cmd_end, target, next_t_start, next_i_end, reason.

    The target of a motion is the command at the start of the next segment, of
    the last segment that at its own start; next_* are null for the last one.
    """
    segs = cut(grid, keys, **how)
    if moves is not None:
        segs = move_boundaries(segs, grid, moves, keys)
        # A test's boundaries go to its points as one array: no point moves to meet one.
        ends = segs.groupBy(*keys).agg(F.collect_list(F.struct("seg", "type", "i_start", "i_end")).alias("__all"))
        points = grid.select(*keys, "i", F.round("t", 6).alias("t"), F.round("command", 4).alias("c")).join(ends, keys)
        met = F.filter("__all", lambda s: (s["i_start"] == F.col("i")) | (s["i_end"] == F.col("i")))
        points = points.select(*keys, "i", F.struct("t", "c").alias("p"), F.explode(met).alias("s")).select(*keys, "i", "p", "s.*")
        at = lambda name: F.max(F.when(F.col("i") == F.col(name), F.col("p"))).alias(f"at_{name}")
        found = points.groupBy(*keys, "seg", "type", "i_start", "i_end").agg(at("i_start"), at("i_end")).where("at_i_start is not null and at_i_end is not null")
        times = {"t_start": "at_i_start.t", "cmd_start": "at_i_start.c", "t_end": "at_i_end.t", "cmd_end": "at_i_end.c"}
        segs = found.select(*keys, "seg", "type", "i_start", "i_end", *(F.col(x).alias(n) for n, x in times.items()))
    along = Window.partitionBy(*keys).orderBy("seg")
    target = F.when(F.col("type") != "dwell", F.coalesce(F.lead("cmd_start").over(along), F.col("cmd_start")))
    before = F.lag("type").over(along)
    segs = segs.withColumn("target", target).withColumn("next_t_start", F.lead("t_start").over(along)).withColumn("next_i_end", F.lead("i_end").over(along))
    return segs.withColumn("reason", boundary_reason(before, F.col("type"), F.col("cmd_start")))


def boundary_reason(before: Column, kind: Column, command: Column) -> Column:
    """Why a segment starts where it does."""
    at = F.format_number(command, 1)
    text = (
        F.when(before.isNull(), F.lit("start of record"))
        .when(kind == "dwell", F.concat(F.lit("command settles at "), at, F.lit(" %")))
        .when(before == "dwell", F.concat(F.lit("command leaves "), at, F.when(kind == "opening", " % upwards").otherwise(" % downwards")))
        .otherwise(F.concat(F.lit("command turns at "), at, F.lit(" %")))
    )
    return text


def in_segments(grid: DataFrame, segs: DataFrame, keys: list[str]) -> DataFrame:
    """``grid`` with the seg, type and target each point lies in, own and before (that segment and the one before it as structs) and turned, the type of the last motion before it."""
    own = F.struct("seg", "type", "target", "t_start", "t_end", "next_t_start")
    along = Window.partitionBy(*keys).orderBy("seg")
    turned = F.last(F.when(F.col("type") != "dwell", F.col("type")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    known = F.struct(own.alias("own"), F.lag(own).over(along).alias("before"), turned.alias("turned"))
    starts = segs.select(*keys, F.col("i_start").cast(grid.schema["i"].dataType).alias("i"), known.alias("__s"))
    # Starts lie among the points, so one shuffle by test does for both.
    rows = grid.withColumn("__point", F.lit(1)).unionByName(starts.withColumn("__point", F.lit(0)), allowMissingColumns=True)
    so_far = Window.partitionBy(*keys).orderBy("i", "__point").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__s", F.last("__s", ignorenulls=True).over(so_far)).where("__point = 1")
    return rows.select(*grid.columns, "__s.*").select("*", "own.seg", "own.type", "own.target")


def missing_types(segs: DataFrame, keys: list[str]) -> DataFrame:
    """Per test the segment types it lacks of opening, closing and dwell (array)."""
    need = F.array(*[F.lit(x) for x in ("opening", "closing", "dwell")])
    return segs.groupBy(*keys).agg(F.array_except(need, F.collect_set("type")).alias("missing"))


def travel_time(rows: DataFrame, keys: list[str], band: float = LIMITS["settle_band"]) -> DataFrame:
    """Per motion segment how long after the command's arrival the position is first within ``band`` of the target.

    Searched from the segment's start to the end of the next one; null if it
    never gets there (``reached`` false).
    """
    # A point counts for its own segment and for the one before: no join.
    both = rows.select(*keys, "t", "position", F.explode(F.array("own", "before")).alias("s")).where(F.col("s.type").isin(*MOTION))
    first = F.min(F.when(F.abs(F.col("position") - F.col("s.target")) <= band, F.col("t")))
    found = both.groupBy(*keys, F.col("s.seg").alias("seg")).agg(first.alias("at"), F.first("s").alias("s"))
    late = F.when(F.col("at").isNotNull(), F.round(F.greatest(F.lit(0.0), F.col("at") - F.coalesce("s.next_t_start", "s.t_end")), 3))
    return found.select(*keys, "seg", "s.type", "s.target", late.alias("travel_time"), F.round(F.col("at") - F.col("s.t_start"), 3).alias("total_response"), F.col("at").isNotNull().alias("reached"))


def deadband(rows: DataFrame, segs: DataFrame, keys: list[str], moved: float = 0.5) -> DataFrame:
    """Per reversal (a motion after one of the other direction): the command's largest change before the position has moved by ``moved``."""
    # Each point knows the last motion before its own (see :func:`in_segments`): none moves to meet its segment.
    known = rows if "turned" in rows.columns else in_segments(rows, segs, keys)
    own = known.where((F.col("type") != "dwell") & (F.col("turned") != F.col("type")))
    along = Window.partitionBy(*keys, "seg").orderBy("i")
    own = own.withColumn("__p0", F.first("position").over(along)).withColumn("__c0", F.first("command").over(along))
    gone = F.max((F.abs(F.col("position") - F.col("__p0")) >= moved).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    still = own.withColumn("__gone", gone).where("__gone = 0")
    return still.groupBy(*keys, "seg").agg(
        F.first(F.concat_ws("->", "turned", "type")).alias("direction"), F.round(F.min("t"), 3).alias("at_time"),
        F.round(F.max(F.abs(F.col("command") - F.col("__c0"))), 3).alias("deadband"), F.round(F.max("t"), 3).alias("unresponsive_until"),
    )


def hysteresis(rows: DataFrame, keys: list[str], settle_band: float = LIMITS["settle_band"], step: float = 1.0, segs: DataFrame | None = None) -> DataFrame:
    """Per test the largest gap between the branches at one command, and the first command where it is; no row where they don't overlap.

    Branches are the quasi-static points of motions by command.  ``rows`` need
    no segments of their own where ``segs`` are given.
    """
    c = F.col
    if segs is None:
        segs = rows.groupBy(*keys, "seg").agg(F.first("type").alias("type"), F.first("target").alias("target"), F.min("i").alias("i_start"), F.max("i").alias("i_end"), F.max("t").alias("t_end"))
        segs = segs.withColumn("next_i_end", c("i_end")).withColumn("next_t_start", c("t_end"))
    found = strokes_at_once.measures(strokes_at_once.whole(rows, segs, keys), keys, settle_band, step=step).where("hysteresis is not null")
    return found.select(*keys, F.round("hysteresis", 3).alias("hysteresis"), F.round("at_command", 2).alias("at_command"))


def overshoot(grid: DataFrame, segs: DataFrame, keys: list[str], settle_s: float = 2.0) -> DataFrame:
    """Per motion segment how far the position passes the target, up to ``settle_s`` after the segment.

    ``grid`` may be that of :func:`in_segments` already.
    """
    rows = grid if "own" in grid.columns else in_segments(grid, segs, keys)
    # What each point sees ahead, taken over a segment's points, is all up to ``settle_s`` after its last one: no join.
    rows = rows.select(*keys, "seg", "type", "target", "position", stats.micros(F.col("t")).alias("__us"))
    ahead = Window.partitionBy(*keys).orderBy("__us").rangeBetween(0, round(settle_s * 1e6))
    rows = rows.withColumn("__high", F.max("position").over(ahead)).withColumn("__low", F.min("position").over(ahead)).where(F.col("type") != "dwell")
    found = rows.groupBy(*keys, "seg").agg(F.first("type").alias("type"), F.first("target").alias("target"), F.max("__high").alias("high"), F.min("__low").alias("low"))
    past = F.when(F.col("type") == "opening", F.col("high") - F.col("target")).otherwise(F.col("target") - F.col("low"))
    return found.select(*keys, "seg", "type", "target", F.round(F.greatest(F.lit(0.0), past), 3).alias("overshoot"))


def steady_state(rows: DataFrame, keys: list[str], least_s: float = 1.0, share: float = 0.25) -> DataFrame:
    """Per dwell the mean and largest deviation of position from command in its tail (the last quarter, at least ``least_s``)."""
    inside = Window.partitionBy(*keys, "seg")
    dwell = rows.where(F.col("type") == "dwell").withColumn("t1", F.max("t").over(inside)).withColumn("t0", F.min("t").over(inside))
    tail = dwell.where(F.col("t") >= F.col("t1") - F.greatest(F.lit(least_s), share * (F.col("t1") - F.col("t0"))))
    off = F.abs(F.col("position") - F.col("command"))
    return tail.groupBy(*keys, "seg").agg(F.round(F.min("t"), 3).alias("t_start"), F.round(F.max("t"), 6).alias("t_end"), F.round(F.avg(off), 3).alias("mean_deviation"), F.round(F.max(off), 3).alias("max_deviation"))


def steady_periods(rows: DataFrame, keys: list[str], limit: float = LIMITS["steady_state"]) -> DataFrame:
    """Stretches of dwells in which the position is off by more than ``limit``."""
    off = F.abs(F.col("position") - F.col("command")) > limit
    return runs.periods_where(rows.where(F.col("type") == "dwell"), [*keys, "seg"], ["i"], off, "t")


def stick_slip(rows: DataFrame, keys: list[str], still: float = 0.3, excursion: float = 1.0, jump: float = 1.0, least_s: float = 0.5, jump_s: float = 0.3) -> DataFrame:
    """Episodes of motion segments in which the position sticks while the command moves, then jumps.

    From an anchor on the position stays within ``still`` of it; if that lasts
    ``least_s`` while the command changes by ``excursion`` from end to end, and
    within ``jump_s`` the position gets ``jump`` away from where it stuck, it is
    an episode.  The next anchor is the end of the jump's window, else the last
    still point.  A window puts on each point how far the position gets within
    ``jump_s``; a fold over each segment follows the anchors.
    """
    c = F.col
    moving = rows.where(c("type").isin(*MOTION)).select(*keys, "seg", "i", "t", "command", "position")
    moving = moving.withColumn("__us", stats.micros(c("t")))
    along = Window.partitionBy(*keys, "seg").orderBy("__us")

    def until(us: int) -> Column:
        frame = along.rangeBetween(0, us)
        far = F.greatest(F.max("position").over(frame) - c("position"), c("position") - F.min("position").over(frame))
        return F.struct(F.max(F.struct("i", "t")).over(frame).alias("end"), far.alias("far"))

    # Whole microseconds can't tell whether a point at the window's very end belongs to it, the times themselves can.
    us = round(jump_s * 1e6)
    soon = moving.withColumn("__a", until(us + 1)).withColumn("__b", until(max(us - 1, 0)))
    soon = soon.withColumn("__x", F.when(c("__a.end.t") - c("t") <= jump_s, c("__a")).otherwise(c("__b")))
    soon = soon.select(*keys, "seg", "i", "t", "command", "position", "__x.end", "__x.far")

    def hit(a: Column, s: Column) -> Column:
        return (s["t"] - a["t"] >= least_s) & (F.abs(s["command"] - a["command"]) >= excursion) & (s["far"] >= jump)

    found = anchors.held(soon, [*keys, "seg"], "position", still, hit, ["command", "far", "end"], lambda s: s["end"]["i"])
    figures = {"t_start": c("anchor.t"), "t_end": c("last.end.t"), "stuck_s": c("last.t") - c("anchor.t"), "command_change": F.abs(c("last.command") - c("anchor.command")), "jump": c("last.far")}
    return found.select(*keys, c("seg").cast("int").alias("seg"), *(F.round(x, 3).alias(n) for n, x in figures.items()))


def low_supply(rows: DataFrame, keys: list[str], least_kpa: float = LIMITS["supply_min_kpa"]) -> DataFrame:
    """Stretches of motion segments with too little pressure, and the least of it."""
    moving = rows.where(F.col("type").isin(*MOTION))
    found = runs.periods_where(moving, [*keys, "seg"], ["i"], F.col("pressure") < least_kpa, "t", F.round(F.min("pressure"), 1).alias("min_kpa"))
    return found.select(*keys, "seg", F.round("start_at", 3).alias("t_start"), F.round("end_at", 3).alias("t_end"), "min_kpa")


def incomplete_travel(grid: DataFrame, keys: list[str], band: float = LIMITS["settle_band"]) -> DataFrame:
    """Ends of the command's range (high, low) that the position misses by more than ``band``."""
    ends = grid.groupBy(*keys).agg(F.max("command").alias("c1"), F.min("command").alias("c0"), F.max("position").alias("p1"), F.min("position").alias("p0"))
    high = F.when(F.col("p1") < F.col("c1") - band, F.struct(F.lit("high").alias("end"), F.round("c1", 2).alias("commanded"), F.round("p1", 2).alias("reached")))
    low = F.when(F.col("p0") > F.col("c0") + band, F.struct(F.lit("low").alias("end"), F.round("c0", 2).alias("commanded"), F.round("p0", 2).alias("reached")))
    return ends.select(*keys, F.explode(F.array_compact(F.array(high, low))).alias("x")).select(*keys, "x.*")


def metrics(grid: DataFrame, segs: DataFrame, keys: list[str], band: float = LIMITS["settle_band"]) -> DataFrame:
    """The five metrics in long form: keys, metric, value; one without value has no row.

    Each is the largest of its test, of :func:`travel_time`, :func:`deadband`,
    :func:`overshoot` and :func:`steady_state` over all segments.
    """
    found = strokes_at_once.measures(strokes_at_once.whole(grid, segs, keys), keys, band)
    listed = F.array(*[F.struct(F.lit(m).alias("metric"), F.round(m, 3).alias("value")) for m in strokes_at_once.METRICS])
    return found.select(*keys, F.explode(listed).alias("x")).select(*keys, "x.*").where("value is not null")


def gap_blocks(segs: DataFrame, gaps: DataFrame, keys: list[str], share: float = GAP_SHARE) -> DataFrame:
    """Motion segments of which gaps (keys, start_at, end_at) cover more than ``share``: keys, seg, share."""
    c = F.col
    motion = segs.where((c("type") != "dwell") & (c("t_end") > c("t_start"))).select(*keys, "seg", "t_start", "t_end")
    # A test's gaps go to its segments as one array: segments are made once, and none moves to meet a gap.
    known = gaps.where("end_at > start_at").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start_at", "end_at"))).alias("__gaps"))
    lost = lambda g: F.greatest(F.lit(0.0), F.least(g["end_at"], c("t_end")) - F.greatest(g["start_at"], c("t_start")))
    covered = F.aggregate("__gaps", F.lit(0.0), lambda sum_, g: sum_ + lost(g))
    found = motion.join(known, keys, "left").withColumn("share", F.coalesce(covered, F.lit(0.0)) / (c("t_end") - c("t_start")))
    return found.where(c("share") > share).select(*keys, "seg", "share")


def issues(found: DataFrame, events: DataFrame, keys: list[str], limits: dict[str, float] = LIMITS) -> DataFrame:
    """Metrics over their limits and all events, as keys, kind, value, threshold.

    ``events`` has keys, kind, value, threshold already.
    """
    table = F.create_map(*[F.lit(x) for name in ("travel_time", "deadband", "hysteresis", "overshoot", "steady_state") for x in (name, limits[name])])
    over = found.withColumn("threshold", F.element_at(table, F.col("metric"))).where(F.col("value") > F.col("threshold"))
    return over.select(*keys, F.col("metric").alias("kind"), "value", "threshold").unionByName(events.select(*keys, "kind", "value", "threshold"))


def reverse_hysteresis(turns: DataFrame, limit: float = LIMITS["deadband"]) -> DataFrame:
    """Reversals whose dead band is over the limit."""
    return turns.where(F.col("deadband") > limit)


def merged_verdict(verdict: Column, uncertainty: Column) -> Column:
    """The verdict with the overall conformance of the uncertainty (null: not evaluated); missing evidence stays first."""
    return (
        F.when((verdict == "no_conclusion") | uncertainty.isNull(), verdict)
        .when(uncertainty == "indeterminate", "indeterminate")
        .when((uncertainty == "fail") & (verdict == "ok"), "exceedances")
        .otherwise(verdict)
    )


def uncertainty_input(override: Column, previous: Column, submitted: Column, none: Column) -> Column:
    """Which input an analysis evaluates: the override (an empty one, ``none``, means none), the last evaluated one, the submission's."""
    return F.when(override.isNotNull(), F.when(~none, override)).otherwise(F.coalesce(previous, submitted))


def analyse(
    grid: DataFrame, gaps: DataFrame, keys: list[str], blocks: DataFrame | None = None, moves: DataFrame | None = None,
    uncertainty: DataFrame | None = None, limits: dict[str, float] = LIMITS,
) -> dict[str, DataFrame]:
    """The whole analysis as tables: segments, metrics, stick_slip, low_supply, incomplete, issues, verdicts.

    ``gaps`` (keys, channel, kind, start_at, end_at) are the record's dropouts,
    ``blocks`` (keys, code) what calibration and units already object to, and
    ``uncertainty`` (keys, overall) an evaluated conformance.  The tables that
    several results read are held, so each is planned and made once.
    """
    band = limits["settle_band"]
    segs = hold(segment(grid, keys, moves), "segments")
    rows = hold(in_segments(grid, segs, keys), "rows")
    turns = deadband(rows, segs, keys)
    sticks, low, short = stick_slip(rows, keys), low_supply(rows, keys, limits["supply_min_kpa"]), incomplete_travel(rows, keys, band)
    null = F.lit(None).cast("double")

    def event(found: DataFrame, kind: Column | str, value: Column, threshold: Column) -> DataFrame:
        return found.select(*keys, (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), value.alias("value"), threshold.alias("threshold"))

    events = event(sticks, "stick_slip", F.col("jump"), null)
    events = events.unionByName(event(reverse_hysteresis(turns, limits["deadband"]), "reverse_hysteresis", F.col("deadband"), F.lit(limits["deadband"])))
    events = events.unionByName(event(low, "low_supply", F.col("min_kpa"), F.lit(limits["supply_min_kpa"])))
    events = events.unionByName(event(short, "incomplete_travel", null, null)).unionByName(event(gaps, "dropout", null, null))
    found = hold(metrics(rows, segs, keys, band), "metrics")
    listed = hold(issues(found, events, keys, limits), "issues")

    missing = missing_types(segs, keys).select(*keys, F.explode("missing").alias("x")).select(*keys, F.concat(F.lit("missing_"), "x").alias("code"))
    blocking = missing.unionByName(gap_blocks(segs, gaps, keys, GAP_SHARE).select(*keys, F.concat(F.lit("gaps_in_segment_"), "seg").alias("code")))
    if blocks is not None:
        blocking = blocking.unionByName(blocks.select(*keys, "code"))
    codes = blocking.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("blocking"))
    counts = listed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_issues"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    tests = segs.select(*keys).distinct()
    both = tests.join(codes, keys, "left").join(counts, keys, "left")
    central = F.when(F.col("blocking").isNotNull(), "no_conclusion").when(F.col("n_issues") > 0, "exceedances").otherwise("ok")
    both = both.withColumn("verdict", central)
    if uncertainty is not None:
        both = both.join(uncertainty, keys, "left").withColumn("verdict", merged_verdict(F.col("verdict"), F.col("overall"))).drop("overall")
    verdicts = both.select(*keys, F.coalesce("blocking", F.lit("")).alias("blocking"), F.coalesce("n_issues", F.lit(0)).alias("n_issues"), F.coalesce("kinds", F.lit("")).alias("kinds"), "verdict")
    return {"segments": segs, "metrics": found, "stick_slip": sticks, "low_supply": low, "incomplete": short, "issues": listed, "verdicts": verdicts}
