"""From submitted records to result tables: exclusions, certificates, units, alignment, analysis.

Records are those of ``sources.records``; ``adjustments`` are all decisions
about them so far: test_id, seq, type (exclusion, boundary_move, trip_move,
ignore_glitch, disable_point), channel, low, high (index range of an exclusion),
segment_index, boundary, new_time, t_start, t_end, reason.  A full stroke's
boundary is start or end of the segment, a flow curve's of the plateau of that
index; a seat leak's is isolation, hold or end; a stem thrust's names stroke,
phase and end, as in ``opening running start``.  All tests at once; tests with
limits of their own are analysed in groups of equal limits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions import physics, units
from fleetgauge.operators import calibration, curves, exclusions, failsafe, flowcurve, fullstroke, interp, runs, seatleak, switches, thrust, uncertainty
from fleetgauge.sources.held import hold
from fleetgauge.sources.records import CHANNELS, OPTIONAL, samples_of, times

KEYS = ["test_id"]
ADJUSTMENTS = (
    "test_id long, seq int, type string, channel string, low long, high long, segment_index int, boundary string, new_time double, t_start double, t_end double, reason string"
)
#: Measurement types of the channels that are subject to calibration.
KINDS = {
    "command": "command", "position": "position", "pressure": "pressure", "supply_pressure": "pressure", "upstream_pressure": "pressure", "downstream_pressure": "pressure",
    "chamber_a_pressure": "pressure", "chamber_b_pressure": "pressure", "downstream_temp": "temperature", "temperature": "temperature",
}
#: What a kind's flow meters measure.
FLOWS = {"seatleak": "flow_gas", "flowcurve": "flow_liquid"}
#: Names of the limits in a record, and in the analyses.
LIMIT_NAMES = {
    "fullstroke": {
        "travel_time_s_max": "travel_time", "deadband_pct_max": "deadband", "hysteresis_pct_max": "hysteresis", "overshoot_pct_max": "overshoot", "steady_state_pct_max": "steady_state",
        "supply_pressure_min_kpa": "supply_min_kpa", "settle_band_pct": "settle_band",
    },
    "failsafe": {
        "response_delay_s_max": "delay_s", "t90_s_max": "t90_s", "settle_band_pct": "band", "settle_dwell_s": "dwell_s", "rebound_pct_max": "rebound", "stall_min_s": "stall_s", "stall_move_pct": "stall_move",
        "pressure_residual_kpa_max": "residual_kpa", "pressure_decay_pct_min": "decay_pct", "command_loss_pct": "loss_pct", "fip_drift_pct_max": "drift", "baseline_min_s": "baseline_s",
        "baseline_coverage_min": "coverage", "chatter_merge_s": "merge_s", "pre_trip_margin_s": "margin_s",
    },
    "limitswitch": {"edge_delay_s_max": "delay_s", "dispersion_pct_max": "dispersion", "end_dwell_s": "end_dwell_s", "move_slope_pct_s": "speed"},
    "seatleak": {
        "leak_rate_max_nl_min": "rate", "cumulative_leak_max_nl": "cumulative", "min_differential_kpa": "min_dp_kpa", "closed_band_pct": "closed_band", "position_drift_pct_max": "drift",
        "stabilization_min_s": "stabilise_s", "hold_min_s": "hold_s", "temp_coverage_min": "coverage", "temp_slope_max_c_min": "slope_c_min", "slope_window_s": "slope_window_s",
        "rate_exceed_dwell_s": "dwell_s", "flow_deviation_pct_max": "deviation_pct",
    },
    "stemthrust": {
        "breakaway_open_max_n": "breakaway_open", "breakaway_close_max_n": "breakaway_close", "running_friction_max_n": "running", "friction_band_max_n": "band", "friction_band_total_max_n": "band_total",
        "unseat_open_max_n": "unseat", "seating_min_n": "seating_min", "seating_max_n": "seating_max", "supply_pressure_min_kpa": "supply_kpa", "closed_band_pct": "closed_band", "move_detect_pct": "move",
        "move_sustained_s": "move_s", "run_margin_pct": "run_margin", "velocity_min_pct_s": "velocity", "spring_coverage_margin_pct": "spring_margin",
    },
    "flowcurve": {
        "min_differential_kpa": "min_dp_kpa", "plateau_slope_pct_s": "slope_pct_s", "plateau_min_duration_s": "min_duration_s", "plateau_merge_gap_s": "merge_gap_s",
        "plateau_merge_position_pct": "merge_position_pct", "plateau_drift_pct_max": "drift_pct", "plateau_flow_cv_pct_max": "flow_cv_pct", "residual_warn_pct": "residual_pct",
        "blockage_scale_max": "blockage", "erosion_scale_min": "erosion", "reversed_match_ratio": "reversed_ratio", "monotonic_rho_min": "rho",
    },
}
#: Different sets of limits that one call analyses at most; more is an error, not a cut.
MOST_LIMITS = 64


def of_type(adjustments: DataFrame | None, kind: str) -> DataFrame | None:
    return None if adjustments is None else adjustments.where(F.col("type") == kind)


def prepare(records: DataFrame, kind: str, certificates: DataFrame, adjustments: DataFrame | None = None, contacts: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """samples (test_id, channel, idx, t, v in base units, unit), raw (before units), chain, excluded, blocks (test_id, code).

    Excluded points go first, then each bound channel is corrected by its
    certificate, then units become one.  ``contacts`` are no measurements and
    pass as they are.  A test without bindings goes by its one validity date.
    """
    c = F.col
    channels = [*CHANNELS[kind], *OPTIONAL.get(kind, [])]
    points = samples_of(records, channels)
    excluded = points.limit(0).withColumn("reason", F.lit(None).cast("string"))
    cuts = of_type(adjustments, "exclusion")
    if cuts is not None:
        kept, excluded = exclusions.apply_ranges(points, cuts.select("test_id", "channel", "seq", "low", "high", "reason"), ["test_id", "channel"])
        points = kept.drop("idx").withColumnRenamed("new_idx", "idx")
    points = hold(points.select("test_id", "channel", "unit", "idx", "t", "v"), "points")
    when = times(records)
    bound = records.select("test_id", F.explode("calibration_bindings").alias("channel", "version_id")).where("version_id is not null")
    chained = bound.select("test_id").distinct()
    ranges = records.select("test_id", "range_low", "range_high")
    kinds = KINDS | ({"flow": FLOWS[kind]} if kind in FLOWS else {})
    used = {x: kinds[x] for x in channels if x in kinds}
    mine = points.join(chained, "test_id", "left_semi").where(c("channel").isin(*used))
    fixed, chain = calibration.calibrate(mine, when, bound, certificates, ranges, used)
    chain = hold(chain, "chain")
    rest = points.join(chained, "test_id", "left_anti").unionByName(points.join(chained, "test_id", "left_semi").where(~c("channel").isin(*used)))
    raw = hold(fixed.select(*points.columns).unionByName(rest), "corrected")
    blocks = chain.where("not accepted").select("test_id", F.concat_ws(" ", F.lit("calibration"), "channel", "gate").alias("code"))
    blocks = blocks.unionByName(calibration.legacy_block(when.join(chained, "test_id", "left_anti")))

    table = F.create_map(*[F.lit(x) for pair in used.items() for x in pair])
    rows = raw.join(records.select("test_id", "range_low", "range_high", "range_unit"), "test_id").withColumn("type", F.try_element_at(table, c("channel")))
    value = units.normalised(c("type"), c("v"), c("unit"), c("range_low"), c("range_high"), c("range_unit"))
    ends = rows.where("type is not null").groupBy("test_id", "channel", "type", "unit", "range_low", "range_high", "range_unit").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    conflict = units.conflict(c("type"), c("unit"), c("range_unit"), c("low"), c("high"), c("range_high") - c("range_low"))
    clashes = ends.select("test_id", F.concat_ws(" ", F.lit("unit"), "channel", conflict).alias("code"), conflict.alias("problem")).where("problem is not null").drop("problem")
    base = F.when(c("channel").isin(*contacts) | c("type").isNull(), c("v")).otherwise(value)
    samples = rows.select("test_id", "channel", "idx", "t", base.alias("v"), "unit").where("v is not null")
    return {"samples": hold(samples, "samples"), "raw": raw, "chain": chain, "excluded": excluded, "blocks": hold(blocks.unionByName(clashes), "blocks")}


def by_limits(records: DataFrame, kind: str, defaults: dict[str, float], run: Callable[[DataFrame, dict[str, float]], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """``run`` for every set of limits that records have, its tables joined together; a record's limits are the defaults but for what it says itself."""
    names = LIMIT_NAMES[kind]
    known = F.array_sort(F.transform(F.map_entries(F.map_filter(F.coalesce("thresholds", F.create_map().cast("map<string,double>")), lambda k, v: k.isin(*names) & v.isNotNull())), lambda e: e))
    rows = records.withColumn("__own", F.to_json(known))
    sets = sorted(r[0] for r in rows.select("__own").distinct().limit(MOST_LIMITS + 1).collect()) or ["[]"]
    if len(sets) > MOST_LIMITS:
        raise ValueError(f"records have more than {MOST_LIMITS} different sets of limits; analyse them in parts")
    tables: dict[str, DataFrame] = {}
    for own in sets:
        said = records.sparkSession.createDataFrame([(own,)], "x string").select(F.from_json("x", "array<struct<key:string,value:double>>").alias("x")).first()["x"]
        limits = defaults | {names[e["key"]]: e["value"] for e in said}
        for name, df in run(rows.where(F.col("__own") == own).drop("__own"), limits).items():
            tables[name] = df if name not in tables else tables[name].unionByName(df)
    return tables


def by_step(grid: DataFrame, run: Callable[[DataFrame, float], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """``run`` for the tests of every step that grids have, its tables joined together: steps are those of the records' instruments."""
    c = F.col
    step = F.when(F.max("i") > F.min("i"), F.round((F.max("t") - F.min("t")) / (F.max("i") - F.min("i")), 6)).otherwise(1.0)
    steps = hold(grid.groupBy("test_id").agg(step.alias("step")), "steps")
    spacings = sorted(r[0] for r in steps.select("step").distinct().limit(MOST_LIMITS + 1).collect()) or [1.0]
    if len(spacings) > MOST_LIMITS:
        raise ValueError(f"records have more than {MOST_LIMITS} different grid steps; analyse them in parts")
    tables: dict[str, DataFrame] = {}
    for spacing in spacings:
        for name, df in run(grid.join(steps.where(c("step") == spacing), "test_id", "left_semi"), spacing).items():
            tables[name] = df if name not in tables else tables[name].unionByName(df)
    return tables


def _moves(adjustments: DataFrame | None, *columns: Column | str) -> DataFrame | None:
    moves = of_type(adjustments, "boundary_move")
    return None if moves is None else moves.select("test_id", "seq", "new_time", *columns)


def with_all(verdicts: DataFrame, records: DataFrame, blocks: DataFrame, code: str) -> DataFrame:
    """``verdicts`` (with blocking and verdict) and rows of the tests that couldn't be analysed at all: their blocks and ``code``."""
    lost = records.select("test_id").join(verdicts, "test_id", "left_anti").join(blocks.groupBy("test_id").agg(F.collect_set("code").alias("codes")), "test_id", "left")
    codes = F.array_sort(F.array_union(F.coalesce("codes", F.array().cast("array<string>")), F.array(F.lit(code))))
    lost = lost.select("test_id", F.array_join(codes, ",").alias("blocking"), F.lit("no_conclusion").alias("verdict"))
    return verdicts.unionByName(lost, allowMissingColumns=True)


def _components(records: DataFrame) -> DataFrame:
    """Declared uncertainty components of full-stroke records, those of the whole record's calibration included."""
    c = F.col
    each = records.select("test_id", F.explode("uncertainty.channels").alias("channel", "u"))
    listed = F.array(*[F.struct(F.lit(k).alias("kind"), c(f"u.{k}.value").alias("value"), c(f"u.{k}.unit").alias("unit"), c(f"u.{k}.distribution").alias("distribution")) for k in ("resolution", "accuracy", "zero_drift", "calibration")])
    own = each.select("test_id", "channel", F.explode(listed).alias("x")).select("test_id", "channel", "x.*", F.lit("channel").alias("source")).where("value is not null")
    whole = records.where("uncertainty.calibration.value is not null").select("test_id", c("uncertainty.calibration").alias("x"))
    to = F.coalesce("x.applies_to", F.array(*map(F.lit, CHANNELS["fullstroke"])))
    whole = whole.select("test_id", F.explode(to).alias("channel"), F.lit("calibration").alias("kind"), c("x.value").alias("value"), c("x.unit").alias("unit"), c("x.distribution").alias("distribution"), F.lit("record").alias("source"))
    return own.unionByName(whole)


def _range_problems(records: DataFrame, samples: DataFrame) -> DataFrame:
    """(test_id, problem) of records whose declared calibration range doesn't cover the readings."""
    c = F.col
    asked = records.where("uncertainty.calibration.value is not null").select("test_id", "range_low", "range_high", c("uncertainty.calibration").alias("x"))
    asked = asked.select("*", F.explode(F.coalesce("x.applies_to", F.array(*map(F.lit, CHANNELS["fullstroke"])))).alias("channel"))
    seen = samples.groupBy("test_id", "channel").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    unit = F.coalesce("x.range_unit", "x.unit")
    low, high = uncertainty.calibration_range(c("x.range_min"), c("x.range_max"), unit, c("channel"), c("range_low"), c("range_high") - c("range_low"))
    return asked.join(seen, ["test_id", "channel"]).select("test_id", uncertainty.range_problem(c("lo"), c("hi"), low, high).alias("problem")).where("problem is not null")


def full_stroke(records: DataFrame, certificates: DataFrame, adjustments: DataFrame | None = None, trials: int | None = None) -> dict[str, DataFrame]:
    """Full-stroke results of ``records`` (those of the kind, with its fields): chain, excluded, gaps, segments, metrics, issues, uncertainty, verdicts.

    With ``trials`` the declared and the certificates' uncertainties are
    evaluated by so many trials; invalid inputs leave the central verdict.
    """
    made = prepare(records, "fullstroke", certificates, adjustments)
    moves = of_type(adjustments, "boundary_move")
    moves = None if moves is None else moves.select("test_id", "seq", "segment_index", "boundary", "new_time")
    grid = hold(interp.align(made["samples"], CHANNELS["fullstroke"]), "grid")
    gaps = hold(runs.dropouts(made["samples"], KEYS), "gaps")
    c = F.col

    def run(some: DataFrame, limits: dict[str, float]) -> dict[str, DataFrame]:
        mine = some.select("test_id")
        only = lambda df: df.join(mine, "test_id", "left_semi")
        own_grid, own_gaps, own_blocks = only(grid), only(gaps), only(made["blocks"])
        results: dict[str, DataFrame] = {}
        sure = None
        if trials:
            frozen = calibration.chain_components(only(made["chain"]), certificates, calibration.present_channels(only(made["raw"]), KINDS), some.select("test_id", "range_low", "range_high"))
            spans = some.select("test_id", (c("range_high") - c("range_low")).alias("span"))
            inputs = hold(uncertainty.build_inputs(_components(some), frozen, spans), "inputs")
            jitter = some.select("test_id", F.explode("uncertainty.channels").alias("channel", "u")).select("test_id", "channel", c("u.time_jitter_s").alias("jitter_s")).where("jitter_s > 0")
            problems = _range_problems(some, only(made["samples"]))
            due = uncertainty.input_states(inputs, jitter, problems).where("state = 'evaluated'").select("test_id")
            drawn = hold(uncertainty.trial_metrics(uncertainty.perturb_by(only(made["samples"]), inputs, jitter, trials, problems=problems), limits["settle_band"], moves, trials), "trials")
            segs = hold(fullstroke.segment(own_grid, KEYS, moves), "segments")
            central = fullstroke.metrics(own_grid, segs, KEYS, limits["settle_band"])
            evaluated = hold(uncertainty.evaluate(drawn, central, limits, trials, tests=due), "evaluated")
            sure = hold(uncertainty.overall(evaluated, uncertainty.valid_trials(due, drawn, trials), trials), "overall")
            supply = uncertainty.supply_conformance(drawn, limits["supply_min_kpa"]).withColumn("metric", F.lit(uncertainty.SUPPLY))
            results["uncertainty"] = evaluated.unionByName(supply)
        found = fullstroke.analyse(own_grid, own_gaps, KEYS, own_blocks, moves, sure, limits)
        extra = {
            "indeterminate": "uncertainty_indeterminate",
            "fail": "uncertainty_exceedance",
        }
        issues = found["issues"]
        if sure is not None:
            # A failing interval is news only where the central values are within their limits.
            told = found["verdicts"].join(sure, "test_id").where((c("verdict") != "no_conclusion") & ((c("overall") == "indeterminate") | ((c("overall") == "fail") & (c("n_issues") == 0))))
            kind = F.when(c("overall") == "indeterminate", extra["indeterminate"]).otherwise(extra["fail"])
            null = F.lit(None).cast("double")
            issues = issues.unionByName(told.select("test_id", kind.alias("kind"), null.alias("value"), null.alias("threshold")))
        verdicts = with_all(found["verdicts"], some, own_blocks, "no_overlap")
        return results | {"segments": found["segments"], "metrics": found["metrics"], "issues": issues, "verdicts": verdicts}

    results = by_limits(records, "fullstroke", fullstroke.LIMITS, run)
    return {"chain": made["chain"], "excluded": made["excluded"], "gaps": gaps} | results


def limit_switch(records: DataFrame, certificates: DataFrame, adjustments: DataFrame | None = None) -> dict[str, DataFrame]:
    """Limit-switch results: chain, intervals, edges, events, references, metrics, checks, missing, verdicts."""
    c = F.col
    made = prepare(records, "limitswitch", certificates, None, ("open", "closed"))
    samples = made["samples"]

    def spec(contact: str, end: str) -> DataFrame:
        of = c(f"switch.{contact}")
        lap = F.when(F.coalesce("switch.mutual_exclusion.enabled", F.lit(True)), F.coalesce("switch.mutual_exclusion.max_overlap_s", F.lit(0.0)))
        ends = {"act_low": of["actuate_window_pct"][0], "act_high": of["actuate_window_pct"][1], "rel_low": of["release_window_pct"][0], "rel_high": of["release_window_pct"][1]}
        return records.select(
            "test_id", F.lit(contact).alias("contact"), F.lit(end).alias("end"), *(v.alias(n) for n, v in ends.items()),
            c("switch.debounce_s").alias("debounce_s"), lap.alias("max_overlap_s"), F.lower(of["polarity"]).alias("polarity"),
        )

    specs = spec("open", "high").unionByName(spec("closed", "low"))
    contacts = samples.where("channel in ('open', 'closed')").withColumnRenamed("channel", "contact").join(specs.select("test_id", "contact", "polarity"), ["test_id", "contact"])
    level = units.contact_level(c("v"))
    bits = hold(contacts.select("test_id", "contact", "idx", "t", "v", units.polarity(level, c("polarity")).alias("bit")), "bits")
    position = samples.where("channel = 'position'").select("test_id", "idx", "t", "v")
    ignored = of_type(adjustments, "ignore_glitch")
    ignored = None if ignored is None else ignored.select("test_id", c("channel").alias("contact"), "t_start", "t_end")
    all_samples = bits.select("test_id", c("contact").alias("channel"), "idx", "t", "v").unionByName(position.withColumn("channel", F.lit("position")))

    def run(some: DataFrame, limits: dict[str, float]) -> dict[str, DataFrame]:
        only = lambda df: df.join(some.select("test_id"), "test_id", "left_semi")
        found = switches.analyse(only(bits), only(position), only(specs).drop("polarity"), ignored, only(made["blocks"]), limits)
        found["references"] = switches.references(found["events"], only(all_samples))
        return {("missing" if n == "gaps" else n): df for n, df in found.items()}

    return {"chain": made["chain"]} | by_limits(records, "limitswitch", switches.LIMITS, run)


def fail_safe(records: DataFrame, certificates: DataFrame, adjustments: DataFrame | None = None) -> dict[str, DataFrame]:
    """Fail-safe results: chain, trips, losses, verdicts (with all metrics).

    The trip is the first cluster of pulses, or a manual one close to a rising
    edge; what is missing before the trip and in the observed window blocks.
    """
    c = F.col
    made = prepare(records, "failsafe", certificates, of_type(adjustments, "exclusion"), ("trip",))
    samples = made["samples"]
    bits = hold(samples.where("channel = 'trip'").select("test_id", "idx", "t", units.contact_level(c("v")).alias("bit")), "trip-bits")
    grid = hold(interp.align(samples, ["command", "position", "pressure"]), "grid")
    steps = interp.grid_of(samples.where("channel <> 'trip'"), KEYS, 0.02, 1.0).groupBy("test_id").agg(F.first("step").alias("step"))

    def run(some: DataFrame, limits: dict[str, float]) -> dict[str, DataFrame]:
        only = lambda df: df.join(some.select("test_id"), "test_id", "left_semi")
        found = failsafe.locate_trip(only(bits), KEYS, limits["merge_s"])
        blocks = only(made["blocks"])
        manual = of_type(adjustments, "trip_move")
        if manual is not None:
            asked = only(manual).groupBy("test_id").agg(F.max_by("new_time", "seq").alias("trip_time"))
            spacing = only(bits).groupBy("test_id").agg(((F.max("t") - F.min("t")) / F.greatest(F.count(F.lit(1)) - 1, F.lit(1))).alias("dt"))
            judged = hold(failsafe.manual_trip(failsafe.rising_edges(only(bits), KEYS), asked.join(spacing, "test_id"), KEYS, c("dt")), "manual-trips")
            blocks = blocks.unionByName(judged.where("not bracketed").select("test_id", F.lit("manual_trip_not_bracketed").alias("code")))
            moved = judged.select("test_id", c("trip_time").alias("__manual"))
            found = found.join(moved, "test_id", "left").withColumn("trip_time", F.coalesce("__manual", "trip_time")).drop("__manual")
        facts = some.select("test_id", c("fail_mode").alias("mode"), F.coalesce("acting", F.lit("spring_return")).alias("acting"))
        trips = hold(found.join(facts, "test_id"), "trips")
        parts = samples.join(trips.select("test_id", "trip_time"), "test_id")
        before = interp.coverage(parts.where("channel = 'position'"), KEYS, c("trip_time") - limits["baseline_s"], c("trip_time"))
        blocks = blocks.unionByName(before.where(c("coverage") < limits["coverage"]).select("test_id", F.lit("baseline_coverage").alias("code")))
        gaps = runs.dropouts(only(samples).where("channel = 'position'"), KEYS, unchecked=("command", "position"))
        lost = hold(failsafe.position_loss(gaps.select("test_id", "start_at", "end_at"), trips, KEYS, limits), "losses")
        blocks = hold(blocks.unionByName(lost.where("lost").select("test_id", F.lit("position_lost").alias("code"))), "blocks")
        # Grids of one step are analysed together: steps are those of the records' instruments.
        results = []
        spacings = sorted(r[0] for r in only(steps).select(F.round("step", 6)).distinct().limit(MOST_LIMITS + 1).collect()) or [1.0]
        if len(spacings) > MOST_LIMITS:
            raise ValueError(f"records have more than {MOST_LIMITS} different grid steps; analyse them in parts")
        for step in spacings:
            of_step = only(steps).where(F.round("step", 6) == step).select("test_id")
            results.append(failsafe.analyse(only(grid).join(of_step, "test_id", "left_semi"), trips.join(of_step, "test_id", "left_semi"), KEYS, step, blocks, limits))
        verdicts = results[0] if results else None
        for part in results[1:]:
            verdicts = verdicts.unionByName(part)
        return {"trips": trips, "losses": lost, "verdicts": with_all(verdicts.withColumnRenamed("gaps", "blocking"), some, blocks, "no_trip")}

    return {"chain": made["chain"]} | by_limits(records, "failsafe", failsafe.LIMITS, run)


def seat_leak(records: DataFrame, certificates: DataFrame, adjustments: DataFrame | None = None) -> dict[str, DataFrame]:
    """Seat-leak results: chain, excluded, gaps, segments, balance, gates, exceedances, periods, checks, verdicts.

    A record without a positive closed volume or without blank baseline, and one
    whose channels end before the volume was closed, can't be judged.
    """
    c = F.col
    made = prepare(records, "seatleak", certificates, adjustments)
    samples = made["samples"]
    names = {"upstream_pressure": "p_up", "downstream_pressure": "p_down", "downstream_temp": "temp"}
    grid = hold(interp.align(samples, CHANNELS["seatleak"]).withColumnsRenamed(names), "grid")
    gaps = hold(runs.dropouts(samples.where(c("channel").isin("position", *names)), KEYS), "gaps")
    actions = records.select("test_id", F.posexplode("isolation").alias("idx", "x")).select("test_id", "idx", "x.t", "x.action")
    points = F.filter("blank_baseline.points", lambda p: p["temp_c"].isNotNull() & p["pressure_kpa"].isNotNull() & p["recovery_rate_kpa_min"].isNotNull())
    blank = F.transform(points, lambda p: F.struct(p["temp_c"].alias("temp_c"), p["pressure_kpa"].alias("pressure_kpa"), p["recovery_rate_kpa_min"].alias("rate")))
    volume = c("closed_volume.downstream_volume_m3")
    defaults = {"z": ("gas.compressibility_z", 1.0), "ref_c": ("gas.reference_temp_c", 15.0), "ref_kpa": ("gas.reference_pressure_kpa", 101.325), "temp_margin": ("blank_baseline.temp_margin_c", 2.0), "pressure_margin": ("blank_baseline.pressure_margin_kpa", 20.0)}
    sign = F.when(c("flow_direction") == "downstream_to_upstream", -1).otherwise(1)
    tests = records.select("test_id", F.when(volume > 0, volume).alias("volume_m3"), *(F.coalesce(c(x), F.lit(v)).alias(n) for n, (x, v) in defaults.items()), sign.alias("sign"), blank.alias("blank"))
    no_volume = tests.where("volume_m3 is null").select("test_id", F.lit("closed_volume_missing").alias("code"))
    no_blank = tests.where(F.coalesce(F.size("blank"), F.lit(0)) <= 0).select("test_id", F.lit("blank_baseline_missing").alias("code"))
    closed = actions.where("action = 'downstream_isolated'").groupBy("test_id").agg(F.min("t").alias("t_closed"))
    ends = tests.select("test_id").join(grid.groupBy("test_id").agg(F.max("t").alias("t_last")), "test_id", "left").join(closed, "test_id", "left")
    short = ends.where("t_last is null or t_last <= t_closed").select("test_id", F.lit("no_overlap").alias("code"))
    blocks = hold(made["blocks"].unionByName(no_volume).unionByName(no_blank).unionByName(short), "blocks")
    moves = _moves(adjustments, "boundary")

    def run(some: DataFrame, limits: dict[str, float]) -> dict[str, DataFrame]:
        only = lambda df: df.join(some.select("test_id"), "test_id", "left_semi")
        of = lambda channel: only(samples).where(c("channel") == channel).select("test_id", "idx", "t", "v")
        own_moves = None if moves is None else only(moves)
        found = seatleak.analyse(only(grid), only(actions), only(tests), None, KEYS, None, own_moves, limits, only(blocks), of("downstream_temp"), of("flow"))
        return found | {"verdicts": found["verdicts"].withColumnRenamed("gaps", "blocking")}

    return {"chain": made["chain"], "excluded": made["excluded"], "gaps": gaps} | by_limits(records, "seatleak", seatleak.LIMITS, run)


def _thrust_facts(records: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, blocks): actuators with areas in m2 and springs in N, and what they and the record's pressure channels lack."""
    c = F.col
    double = F.coalesce(c("acting"), F.lit("single_acting")) == "double_acting"
    unit = lambda area: F.coalesce(units.unit_key(c(f"{area}.unit")), F.lit("cm2"))
    strange = lambda area: c(f"{area}.value").isNotNull() & ~unit(area).isin(*units.AREA_M2)
    area = lambda x: F.when(~strange(x), c(f"{x}.value"))
    spring = F.transform("spring.points", lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), units.by_factor(F.get(p, F.lit(1)), F.coalesce("spring.force_unit", F.lit("n")), units.FORCE_N).alias("y")))
    there = raw.where("v is not null").groupBy("test_id").agg(F.collect_set("channel").alias("there"))
    rows = records.select(
        "test_id", F.when(double, "double").otherwise("single").alias("acting"), area("area_a").alias("area_a"), unit("area_a").alias("area_a_unit"), area("area_b").alias("area_b"), unit("area_b").alias("area_b_unit"),
        F.coalesce("spring.action", F.lit("fail_close")).alias("action"), F.when(~double, spring).alias("spring"), (strange("area_a") | strange("area_b")).alias("strange"),
    ).join(there, "test_id", "left")
    rows = thrust.actuator(rows)
    has = lambda channel: F.coalesce(F.array_contains("there", channel), F.lit(False))
    lacks = ~has("chamber_a_pressure") | ~has("supply_pressure") | ((c("acting") == "double") & ~has("chamber_b_pressure"))
    codes = F.array_compact(F.array(
        F.when(c("strange"), "unit area"), F.when(~c("strange") & ~F.coalesce(c("area_a_m2") > 0, F.lit(False)), "area_missing"),
        F.when(lacks, "pressure_channel_missing"), F.when((c("acting") == "single") & c("spring").isNull(), "spring_curve_missing"),
    ))
    facts = hold(rows.withColumn("codes", codes), "actuators")
    return facts, facts.select("test_id", F.explode("codes").alias("code"))


def stem_thrust(records: DataFrame, certificates: DataFrame, adjustments: DataFrame | None = None) -> dict[str, DataFrame]:
    """Stem-thrust results: chain, excluded, gaps, strokes, phases, metrics, checks, issues, verdicts.

    The force is that of the chambers and, of single-acting actuators, of the
    spring, which must cover the travel.
    """
    c = F.col
    made = prepare(records, "stemthrust", certificates, adjustments)
    samples = made["samples"]
    facts, lacking = _thrust_facts(records, made["raw"])
    need, other = [*CHANNELS["stemthrust"], "chamber_a_pressure"], "chamber_b_pressure"
    both = samples.where(c("channel") == other).select("test_id").distinct()
    one = interp.align(samples.join(both, "test_id", "left_anti"), need).withColumn(other, F.lit(None).cast("double"))
    wide = one.unionByName(interp.align(samples.join(both, "test_id", "left_semi"), [*need, other])).join(facts.drop("codes", "there"), "test_id")
    of_spring = curves.clamped(c("position"), F.when(F.size("spring") > 0, c("spring")))
    force = physics.net_thrust(c("acting"), c("action"), c("chamber_a_pressure"), c(other), c("area_a_m2"), c("area_b_m2"), of_spring)
    grid = hold(wide.select("test_id", "i", "t", "command", "position", force.alias("force"), c("supply_pressure").alias("supply")), "grid")
    gaps = hold(runs.dropouts(samples, KEYS), "gaps")
    travel = grid.groupBy("test_id").agg(F.min("position").alias("low"), F.max("position").alias("high"))
    springs = hold(facts.where("acting = 'single' and spring is not null").join(travel, "test_id"), "springs")
    part = lambda k: F.get(F.split("boundary", " "), F.lit(k))
    moves = _moves(adjustments, part(0).alias("type"), part(1).alias("phase"), part(2).alias("boundary"), "reason")

    def run(some: DataFrame, limits: dict[str, float]) -> dict[str, DataFrame]:
        only = lambda df: df.join(some.select("test_id"), "test_id", "left_semi")
        unfit = only(springs).select("test_id", curves.spring_problem(c("spring"), c("action"), c("low"), c("high"), limits["spring_margin"]).alias("code")).where("code is not null")
        blocks = hold(only(made["blocks"]).unionByName(only(lacking)).unionByName(unfit), "blocks")
        own_moves = None if moves is None else only(moves)
        found = by_step(only(grid), lambda part_, step: thrust.analyse(part_, KEYS, step, blocks, limits, own_moves))
        return found | {"verdicts": with_all(found["verdicts"].withColumnRenamed("gaps", "blocking"), some, blocks, "no_overlap")}

    return {"chain": made["chain"], "excluded": made["excluded"], "gaps": gaps} | by_limits(records, "stemthrust", thrust.LIMITS, run)


def flow_curve(records: DataFrame, certificates: DataFrame, adjustments: DataFrame | None = None) -> dict[str, DataFrame]:
    """Flow-curve results: chain, excluded, gaps, plateaus, points, curves, verdicts.

    A liquid without density or vapour pressure, and a valve without rated
    coefficient or known characteristic, can't be judged.  A meter of an unknown
    unit is taken to give its full scale in m3/h.
    """
    c = F.col
    made = prepare(records, "flowcurve", certificates, adjustments)
    samples = made["samples"]
    names = {"upstream_pressure": "p1", "downstream_pressure": "p2"}
    grid = hold(interp.align(samples, CHANNELS["flowcurve"]).withColumnsRenamed(names), "grid")
    gaps = hold(runs.dropouts(samples, KEYS), "gaps")
    full_scale = F.coalesce(units.by_factor(c("meter.full_scale"), c("meter.unit"), units.LIQUID_M3H), "meter.full_scale")
    shape = F.when(c("valve.characteristic") == "quick_open", "quick_opening").otherwise(c("valve.characteristic"))
    valves = records.select(
        "test_id", F.coalesce("atmospheric_pressure_kpa", F.lit(101.325)).alias("atm"), c("fluid.density_kg_m3").alias("density"), c("fluid.vapor_pressure_kpa").alias("pv"), F.coalesce("fluid.critical_pressure_kpa", F.lit(22120.0)).alias("pc"),
        F.coalesce("valve.liquid_recovery_factor_fl", F.lit(0.9)).alias("recovery"), c("fluid.density_ref_temp_c").alias("ref_c"), F.try_element_at("thresholds", F.lit("temp_applicability_band_c")).alias("band_c"),
        full_scale.alias("full_scale"), shape.alias("kind"), F.when(c("valve.rated_cv") > 0, c("valve.rated_cv")).alias("rated_cv"), F.coalesce("valve.equal_percentage_r", F.lit(50.0)).alias("ratio"),
    )
    valves = hold(valves, "valves")
    lacking = valves.where("density is null or pv is null").select("test_id", F.lit("property_missing").alias("code"))
    unknown = valves.where("rated_cv is null or kind is null or kind not in ('linear', 'equal_percentage', 'quick_opening')").select("test_id", F.lit("valve_unknown").alias("code"))
    blocks = hold(made["blocks"].unionByName(lacking).unionByName(unknown), "blocks")
    moves = _moves(adjustments, c("segment_index").alias("plateau"), "boundary")
    if moves is not None:
        moves = moves.groupBy("test_id", "plateau", "boundary").agg(F.max_by("new_time", "seq").alias("new_time"))
    off = of_type(adjustments, "disable_point")
    off = None if off is None else off.select("test_id", c("segment_index").alias("plateau")).distinct()

    def run(some: DataFrame, limits: dict[str, float]) -> dict[str, DataFrame]:
        only = lambda df: df.join(some.select("test_id"), "test_id", "left_semi")
        own_blocks, own_off, own_moves = only(blocks), None if off is None else only(off), None if moves is None else only(moves)

        def analysed(part: DataFrame, step: float) -> dict[str, DataFrame]:
            mine = only(valves).join(part.select("test_id").distinct(), "test_id", "left_semi")
            return flowcurve.analyse(part, mine, KEYS, flowcurve.window_velocity(KEYS, "position", step), own_off, own_blocks, limits, own_moves)

        found = by_step(only(grid), analysed)
        return found | {"verdicts": with_all(found["verdicts"], some, own_blocks, "no_overlap")}

    return {"chain": made["chain"], "excluded": made["excluded"], "gaps": gaps} | by_limits(records, "flowcurve", flowcurve.LIMITS, run)
