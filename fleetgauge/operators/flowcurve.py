"""Liquid flow curve: steady plateaus, their statistics, exclusions, the fitted characteristic and suspects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.functions import physics
from fleetgauge.operators import interp, runs, stats
from fleetgauge.sources.held import hold

#: Default limits.
LIMITS = {
    "min_dp_kpa": 20.0, "slope_pct_s": 0.5, "min_duration_s": 3.0, "merge_gap_s": 1.5, "merge_position_pct": 2.0,
    "drift_pct": 1.5, "flow_cv_pct": 5.0, "residual_pct": 15.0, "blockage": 0.85, "erosion": 1.15, "reversed_ratio": 0.6, "rho": 0.9,
}
MIN_POINTS = 3
#: Reasons to leave a plateau out, in the order they are listed.
CODES = (
    "plateau_too_short", "manual_disabled", "plateau_drift", "nonpositive_flow", "flow_overrange", "insufficient_differential_pressure",
    "pressure_physical", "property_out_of_range", "property_missing", "flashing", "cavitation",
)


def window_velocity(keys: list[str], value: str, step_s: float, window_s: float = 1.0) -> Column:
    """Change of ``value`` per second over the points at most max(half the window, one step) away on either side.

    For grids with the even step ``step_s``, so that the window is one of fixed rows.
    """
    reach = int(max(window_s / 2, step_s) / step_s + 1e-9)
    frame = Window.partitionBy(*keys).orderBy("i").rowsBetween(-reach, reach)
    dt = F.last("t").over(frame) - F.first("t").over(frame)
    return F.when(dt > 0, (F.last(value).over(frame) - F.first(value).over(frame)) / dt).otherwise(0.0)


def steady_runs(grid: DataFrame, keys: list[str], velocity: Column, limits: dict[str, float] = LIMITS) -> DataFrame:
    """Steady stretches of at least the minimum duration: keys, i_start, i_end, start_at, end_at."""
    rows = grid.withColumn("__v", velocity)
    found = runs.periods_where(rows, keys, ["i"], F.abs("__v") <= limits["slope_pct_s"], "t", F.min("i").alias("i_start"), F.max("i").alias("i_end"))
    return found.where(F.col("end_at") - F.col("start_at") >= limits["min_duration_s"]).drop("n")


def joined(stretches: list[tuple[int, int]], t: list[float], v: list[float], gap_s: float, near: float) -> list[tuple[int, int]]:
    """Neighbouring stretches become one while they lie within ``gap_s`` and their upper medians within ``near``.

    Going from left to right, a stretch is compared with the one before again
    whenever either has grown.  The definition of :func:`merged`, of one record.
    """

    def middle(a: int, b: int) -> float:
        inside = sorted(v[a : b + 1])
        return inside[len(inside) // 2]

    done: list[tuple[int, int]] = []
    for nxt in stretches:
        done.append(nxt)
        while len(done) > 1 and t[done[-1][0]] - t[done[-2][1]] <= gap_s and abs(middle(*done[-2]) - middle(*done[-1])) <= near:
            last = done.pop()
            done[-1] = (done[-1][0], last[1])
    return done


def merged(stretches: Column, t: Column, v: Column, gap_s: float, near: float) -> Column:
    """:func:`joined` as a column.

    ``stretches`` is an array of first and last places (a, b) in the arrays
    ``t`` and ``v``, from left to right; given back are (a, b, m) with the
    median.
    """

    def found(a: Column, b: Column) -> Column:
        inside = F.array_sort(F.slice(v, a + 1, b - a + 1))
        return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), F.get(inside, F.floor(F.size(inside) / 2).cast("int")).cast("double").alias("m"))

    def once(done: Column) -> Column:
        n = F.size(done)
        last, before = F.get(done, n - 1), F.get(done, n - 2)
        close = (n > 1) & (F.get(t, last["a"]) - F.get(t, before["b"]) <= gap_s) & (F.abs(before["m"] - last["m"]) <= near)
        return F.when(close, F.concat(F.slice(done, 1, F.greatest(n - 2, F.lit(0))), F.array(found(before["a"], last["b"])))).otherwise(done)

    def take(done: Column, nxt: Column) -> Column:
        # As many comparisons as there are stretches before: each but the last one joins two.
        return F.aggregate(done, F.concat(done, F.array(found(nxt["a"], nxt["b"]))), lambda s, _: once(s))

    return F.aggregate(stretches, F.array().cast("array<struct<a:int,b:int,m:double>>"), take)


def plateaus(grid: DataFrame, keys: list[str], velocity: Column, limits: dict[str, float] = LIMITS) -> DataFrame:
    """Plateaus of the position: keys, plateau, i_start, i_end, t_start, t_end, position, direction.

    Merging depends on the medians of what is merged already, so it is a fold
    over the array of one test's stretches, with the test's points beside it.
    """
    c = F.col
    flagged = grid.select(*keys, "i", "t", "position", velocity.alias("__v")).withColumn("__still", F.coalesce(F.abs("__v") <= limits["slope_pct_s"], F.lit(False)))
    marked = runs.mark_runs(flagged, keys, ["i"], c("__still"))
    points = F.array_sort(F.collect_list(F.struct("i", "t", "position")))
    each = marked.groupBy(*keys, "run").agg(F.first("__still").alias("still"), points.alias("points"))
    whole = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("run", "still", "points"))).alias("runs"))
    whole = whole.withColumn("p", F.flatten("runs.points")).withColumn("first", F.get("p", F.lit(0))["i"])

    def ends(r: Column) -> Column:
        a, b = F.get(r["points"], F.lit(0)), F.get(r["points"], F.size(r["points"]) - 1)
        long = r["still"] & (b["t"] - a["t"] >= limits["min_duration_s"])
        return F.when(long, F.struct((a["i"] - c("first")).cast("int").alias("a"), (b["i"] - c("first")).cast("int").alias("b")))

    whole = whole.select(*keys, "p", c("p.t").alias("t"), c("p.position").alias("v"), F.array_compact(F.transform("runs", ends)).alias("stretches"))
    found = whole.withColumn("found", merged(c("stretches"), c("t"), c("v"), limits["merge_gap_s"], limits["merge_position_pct"]))
    found = found.select(*keys, "p", F.posexplode("found").alias("plateau", "x"))
    a, b = F.get("p", c("x.a")), F.get("p", c("x.b"))
    found = found.select(*keys, "plateau", a["i"].cast("long").alias("i_start"), b["i"].cast("long").alias("i_end"), F.round(a["t"], 6).alias("t_start"), F.round(b["t"], 6).alias("t_end"), F.round("x.m", 4).alias("position"))
    return directed(found, keys)


def directed(found: DataFrame, keys: list[str]) -> DataFrame:
    """``found`` with whether the positions rise to the next plateau (from the one before, at the last)."""
    along = Window.partitionBy(*keys).orderBy("plateau")
    after, before = F.lead("position").over(along), F.lag("position").over(along)
    rises = F.coalesce(after >= F.col("position"), F.col("position") >= before, F.lit(True))
    return found.withColumn("direction", F.when(rises, "ascending").otherwise("descending"))


def inside(grid: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Grid points that lie in a stretch (keys, i_start, i_end, ...; apart from each other), with its columns.

    Starts lie among the points, so one shuffle by test does for both and no
    stretch is written out point by point.
    """
    starts = found.select(*keys, F.col("i_start").cast(grid.schema["i"].dataType).alias("i"), F.struct(*[n for n in found.columns if n not in keys]).alias("__s"))
    rows = grid.withColumn("__point", F.lit(1)).unionByName(starts.withColumn("__point", F.lit(0)), allowMissingColumns=True)
    so_far = Window.partitionBy(*keys).orderBy("i", "__point").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__s", F.last("__s", ignorenulls=True).over(so_far)).where("__point = 1 and i <= __s.i_end")
    return rows.select(*grid.columns, "__s.*")


def described(found: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """Stretches (keys, plateau, i_start, i_end) with their times, position and direction."""
    points = inside(grid.select(*keys, "i", "t", "position"), found.select(*keys, "plateau", "i_start", "i_end"), keys)
    found = points.groupBy(*keys, "plateau", "i_start", "i_end").agg(F.round(F.min("t"), 6).alias("t_start"), F.round(F.max("t"), 6).alias("t_end"), F.round(stats.upper_median("position"), 4).alias("position"))
    return directed(found, keys)


def move_plateaus(found: DataFrame, grid: DataFrame, moves: DataFrame, keys: list[str]) -> DataFrame:
    """``found`` after one manual move per boundary (keys, plateau, boundary, new_time); a move that would pass a neighbour is not applied."""
    along = Window.partitionBy(*keys).orderBy("plateau")
    known = grid.select(*keys, "t", F.col("i").alias("idx"), F.col("t").alias("v"))
    asked = moves.select(*keys, F.col("new_time").cast("double").alias("t"), "plateau", "boundary")
    placed = interp.nearest(asked, known, keys).groupBy(*keys, "plateau")
    placed = placed.agg(F.max(F.when(F.col("boundary") == "start", F.col("near.idx"))).alias("new_start"), F.max(F.when(F.col("boundary") == "end", F.col("near.idx"))).alias("new_end"))
    rows = found.withColumn("__low", F.lag("i_end").over(along)).withColumn("__high", F.lead("i_start").over(along)).join(placed, [*keys, "plateau"], "left")
    start = F.when((F.col("new_start") < F.col("i_end")) & F.coalesce(F.col("new_start") > F.col("__low"), F.lit(True)), F.col("new_start"))
    rows = rows.withColumn("i_start", F.coalesce(start, F.col("i_start")))
    end = F.when((F.col("new_end") > F.col("i_start")) & F.coalesce(F.col("new_end") < F.col("__high"), F.lit(True)), F.col("new_end"))
    return rows.withColumn("i_end", F.coalesce(end, F.col("i_end"))).drop("__low", "__high", "new_start", "new_end")


def statistics(grid: DataFrame, found: DataFrame, keys: list[str], settle_s: float = 0.5) -> DataFrame:
    """Per plateau: medians, spread of the position, and the flow's variation from ``settle_s`` after the start on."""
    points = inside(grid, found.select(*keys, "plateau", "i_start", "i_end", "t_start", "t_end", "direction"), keys)
    late = (F.col("t") >= F.col("t_start") + settle_s) | (F.col("i") == F.col("i_end"))

    def middle(name: str, digits: int) -> Column:
        return F.round(F.median(F.when(late, F.col(name))), digits)

    flow = F.when(late, F.col("flow"))
    variation = F.when(F.abs(F.avg(flow)) > 1e-12, F.round(F.stddev_pop(flow) / F.abs(F.avg(flow)) * 100, 3))
    return points.groupBy(*keys, "plateau").agg(
        F.first("t_start").alias("t_start"), F.first("t_end").alias("t_end"), F.first("direction").alias("direction"), F.count(F.lit(1)).alias("n_points"),
        F.round(F.median("position"), 4).alias("position"), F.round(F.max("position") - F.min("position"), 4).alias("peak_to_peak"),
        middle("flow", 6).alias("flow"), variation.alias("flow_cv"), middle("p1", 3).alias("p1"), middle("p2", 3).alias("p2"), middle("temperature", 3).alias("temperature"),
    )


def conversion_code(flow: Column, p1: Column, p2: Column, temperature: Column, atm: Column, density: Column, pv: Column, pc: Column, recovery: Column, ref_c: Column, band_c: Column) -> Column:
    """Why a point can't be converted, the first of all reasons; null if it can."""
    p1_abs, p2_abs, dp = p1 + atm, p2 + atm, p1 - p2
    choked = (p1_abs > 0) & (p2_abs > 0) & (dp > 0) & (dp > physics.choked_drop(p1_abs, pv, pc, recovery))
    return F.coalesce(
        F.when(flow <= 0, "nonpositive_flow"),
        F.when(dp <= 0, "insufficient_differential_pressure"),
        F.when((p1_abs <= 0) | (p2_abs <= 0), "pressure_physical"),
        F.when(F.abs(temperature - ref_c) > band_c, "property_out_of_range"),
        F.when(density.isNull() | pv.isNull() | pc.isNull(), "property_missing"),
        F.when(choked, F.when(p2_abs < pv, "flashing").otherwise("cavitation")),
    )


def convert(found: DataFrame, valves: DataFrame, keys: list[str], disabled: DataFrame | None = None, limits: dict[str, float] = LIMITS) -> DataFrame:
    """Plateaus with all their exclusion codes, adopted, and cv where adopted.

    ``valves`` has per test atm, density, pv, pc, recovery, ref_c, band_c,
    full_scale, kind, rated_cv, ratio.
    """
    rows = found.join(valves, keys)
    off = F.lit(False)
    if disabled is not None:
        rows = rows.join(disabled.select(*keys, "plateau", F.lit(True).alias("__off")), [*keys, "plateau"], "left")
        off = F.coalesce("__off", F.lit(False))
    c = F.col
    code = conversion_code(c("flow"), c("p1"), c("p2"), c("temperature"), c("atm"), c("density"), c("pv"), c("pc"), c("recovery"), c("ref_c"), c("band_c"))
    dp = F.round(c("p1") - c("p2"), 3)
    low = (dp > 0) & (dp < limits["min_dp_kpa"]) & ~F.coalesce(code.isin("flashing", "cavitation"), F.lit(False))
    codes = F.array_compact(F.array(
        F.when((c("n_points") < 3) | (c("t_end") - c("t_start") < limits["min_duration_s"]), "plateau_too_short"),
        F.when(off, "manual_disabled"),
        F.when((c("peak_to_peak") > limits["drift_pct"]) | F.coalesce(c("flow_cv") > limits["flow_cv_pct"], F.lit(False)), "plateau_drift"),
        F.when(c("flow") <= 0, "nonpositive_flow").when(c("flow") >= c("full_scale"), "flow_overrange"),
        code,
        F.when(low, "insufficient_differential_pressure"),
    ))
    rows = rows.withColumn("codes", codes).withColumn("adopted", F.size("codes") == 0)
    cv = F.round(physics.liquid_cv(c("flow"), c("p1") - c("p2"), c("density")), 4)
    return rows.withColumn("cv", F.when(c("adopted"), cv)).drop("__off")


def fit(points: DataFrame, keys: list[str], limits: dict[str, float] = LIMITS) -> DataFrame:
    """Per test with at least ``MIN_POINTS`` adopted points the curve's figures, suspects and checks."""
    c = F.col
    rows = points.where("adopted").withColumn("f", physics.characteristic(c("position"), c("kind"), c("ratio"))).withColumn("g", physics.characteristic(100 - c("position"), c("kind"), c("ratio")))
    fits = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_adopted"),
        (F.sum(c("cv") * c("f")) / F.sum(c("rated_cv") * c("f") * c("f"))).alias("k"), (F.sum(c("cv") * c("g")) / F.sum(c("rated_cv") * c("g") * c("g"))).alias("k_mirrored"),
    ).where(c("n_adopted") >= MIN_POINTS)
    rho = stats.spearman(rows.select(*keys, "position", "cv"), keys, "position", "cv").select(*keys, "rho")
    before = F.lag("cv").over(Window.partitionBy(*keys).orderBy("position", "plateau"))
    rows = rows.withColumn("falls", c("cv") + 1e-9 < before).join(fits, keys)
    fitted = c("k") * c("rated_cv") * c("f")
    rest, mirrored = c("cv") - fitted, c("cv") - c("k_mirrored") * c("rated_cv") * c("g")
    percent = rest / F.greatest(fitted, F.lit(1e-9)) * 100
    curve = rows.groupBy(*keys).agg(
        F.first("n_adopted").alias("n_adopted"), F.first("k").alias("k"), F.first("rated_cv").alias("rated_cv"),
        F.sqrt(F.avg(rest * rest)).alias("rmse"), F.sqrt(F.avg(mirrored * mirrored)).alias("rmse_mirrored"),
        F.round(F.min(percent), 2).alias("residual_low"), F.round(F.max(percent), 2).alias("residual_high"),
        F.count_if("falls").alias("inversions"), F.round(F.max("cv") / F.min("cv"), 2).alias("turndown"),
    ).join(rho, keys)
    curve = curve.withColumn("rmse_pct", F.round(c("rmse") / F.greatest(c("rated_cv") * c("k"), F.lit(1e-9)) * 100, 2))
    curve = curve.withColumn("capacity_factor", F.round("k", 4)).withColumn("rmse", F.round("rmse", 4)).withColumn("rmse_mirrored", F.round("rmse_mirrored", 4))
    curve = curve.withColumn("monotonic", F.coalesce((c("rho") >= limits["rho"]) & (c("inversions") == 0), F.lit(False))).withColumn("rho", F.round("rho", 3))
    curve = curve.withColumn("suspects", suspects(limits))
    shaped = c("rmse_pct") <= limits["residual_pct"]
    passes = (c("residual_low") >= -limits["residual_pct"]) & (c("residual_high") <= limits["residual_pct"]) & c("monotonic")
    passes = passes & (~shaped | c("capacity_factor").between(limits["blockage"], limits["erosion"]))
    return curve.withColumn("checks_pass", passes).drop("k", "rated_cv")


def suspects(limits: dict[str, float] = LIMITS) -> Column:
    """Array of suspected faults of a fitted curve; capacity only counts where the shape fits."""
    c = F.col
    shaped = c("rmse_pct") <= limits["residual_pct"]
    turned = ((c("rmse") > 0) & (c("rmse_mirrored") < limits["reversed_ratio"] * c("rmse"))) | F.coalesce(c("rho") <= -limits["rho"], F.lit(False))
    return F.array_compact(F.array(
        F.when(shaped & (c("capacity_factor") < limits["blockage"]), "blockage"),
        F.when(shaped & (c("capacity_factor") > limits["erosion"]), "erosion"),
        F.when(turned, "reversed_installation"),
    ))


def analyse(
    grid: DataFrame, valves: DataFrame, keys: list[str], velocity: Column, disabled: DataFrame | None = None,
    blocks: DataFrame | None = None, limits: dict[str, float] = LIMITS, moves: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Plateaus, points, curves and verdicts of all tests; ``blocks`` (keys, code) are gaps found before, ``moves`` those of :func:`move_plateaus`."""
    # Not held: made anew they lie where their test's points do, read back they would have all points shuffled to them.
    found = plateaus(grid, keys, velocity, limits)
    if moves is not None:
        moved = move_plateaus(found, grid, moves, keys)
        found = hold(described(moved.select(*keys, "plateau", "i_start", "i_end"), grid, keys), "moved")
    points = hold(convert(statistics(grid, found, keys), valves, keys, disabled, limits), "points")
    curves = hold(fit(points, keys, limits), "curves")
    missing = points.groupBy(*keys).agg(F.count_if(F.array_contains("codes", "property_missing")).alias("n_missing"))
    both = valves.select(*keys).join(missing, keys, "left").join(curves.select(*keys, "suspects", "checks_pass"), keys, "left")
    code = F.when(F.col("n_missing").isNull(), "no_plateau").when(F.col("checks_pass").isNull(), "insufficient_adopted_points").when(F.col("n_missing") > 0, "property_missing")
    if blocks is not None:
        both = both.join(blocks.groupBy(*keys).agg(F.collect_set("code").alias("__codes")), keys, "left")
        every = F.array_union(F.coalesce("__codes", F.array().cast("array<string>")), F.array_compact(F.array(code)))
        code = F.when(F.size(every) > 0, F.array_join(F.array_sort(every), ","))
    verdict = F.when(code.isNotNull(), "no_conclusion").when((F.size("suspects") > 0) | ~F.col("checks_pass"), "suspect").otherwise("matches_nameplate")
    verdicts = both.select(*keys, code.alias("blocking"), F.coalesce(F.array_join("suspects", ","), F.lit("")).alias("suspects"), verdict.alias("verdict"))
    return {"plateaus": found, "points": points, "curves": curves, "verdicts": verdicts}
