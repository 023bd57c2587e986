"""Limit switches: debounced intervals, edges at positions, events, metrics, checks and verdict.

``bits``: test_id, contact (open or closed), idx, t, bit (1 is on, 0 off, null
neither level).  ``position``: test_id, idx, t, v in %.  ``specs`` has one row
per test and contact: test_id, contact, end (high or low: the end of travel
that it stands for), act_low, act_high, rel_low, rel_high (windows in %),
debounce_s, max_overlap_s (null: both may be on at once).  A contact of a spec
without legal samples can't be judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.operators import interp, intervals, runs
from fleetgauge.sources.held import hold

#: Default limits.
LIMITS = {"delay_s": 1.0, "dispersion": 1.0, "end_dwell_s": 1.0, "speed": 0.5}
#: Tolerance of comparisons, half width of the stretch that tells the direction at an edge.
EPS, HALF_S = 1e-9, 0.6
KEYS = ["test_id", "contact"]
FOREVER = float("inf")
#: Objections that leave no conclusion.
BLOCKING = ("contact_unusable",)


def adopted(bits: DataFrame, keys: list[str], debounce_s: float | Column) -> DataFrame:
    """Clusters of active runs that lie at most ``debounce_s`` (a number or a column of ``bits``) apart.

    kind: glitch (one run, shorter than that), else adopted; chatter_until is
    set for several runs and is the start of the first long one, else the end.
    release_t is the next sample if that is a legal 0; active_until the next
    legal sample, null at the end of the record.  i_start, i_end, i_release are
    the samples' idx; from_start says that the record begins with it.
    """
    c = F.col
    wait = F.lit(debounce_s) if isinstance(debounce_s, float) else debounce_s
    along = Window.partitionBy(*keys).orderBy("t", "idx")
    later = Window.partitionBy(*keys).orderBy(c("t").desc(), c("idx").desc()).rowsBetween(Window.unboundedPreceding, -1)
    legal = F.last(F.when(c("bit").isNotNull(), c("t")), ignorenulls=True).over(later)
    rows = bits.withColumn("__wait", wait).withColumn("next_bit", F.lead("bit").over(along)).withColumn("next_t", F.lead("t").over(along)).withColumn("next_i", F.lead("idx").over(along))
    rows = rows.withColumn("legal_t", legal).withColumn("__first", F.lag("t").over(along).isNull())
    order = F.struct("t", "idx")
    end = F.max_by(F.struct("next_bit", "next_t", "next_i", "legal_t", "idx"), order)
    begin = F.min_by(F.struct(c("idx").alias("idx"), c("__first").alias("first")), order)
    found = runs.periods_where(rows, keys, ["t", "idx"], c("bit") == 1, "t", end.alias("x"), begin.alias("y"), F.first("__wait").alias("wait"))
    in_order = Window.partitionBy(*keys).orderBy("start_at")
    apart = F.coalesce(c("start_at") - F.lag("end_at").over(in_order) > c("wait") + EPS, F.lit(True)).cast("int")
    found = found.withColumn("__new", apart).withColumn("cluster", F.sum("__new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    long = c("end_at") - c("start_at") >= c("wait") - EPS
    merged = found.groupBy(*keys, "cluster").agg(
        F.min("start_at").alias("t_start"), F.max("end_at").alias("t_end"), F.count(F.lit(1)).alias("n_runs"), F.first("wait").alias("wait"),
        F.min(F.when(long, F.struct("start_at", "y.idx"))).alias("steady"), F.max_by("x", "start_at").alias("x"), F.min_by("y", "start_at").alias("y"),
    )
    glitch = (c("n_runs") == 1) & (c("t_end") - c("t_start") < c("wait") - EPS)
    release = c("x.next_bit") == 0
    several = c("n_runs") > 1
    return merged.select(
        *keys, "t_start", "t_end", "n_runs", F.when(glitch, "glitch").otherwise("adopted").alias("kind"), F.when(several, F.coalesce("steady.start_at", "t_end")).alias("chatter_until"),
        F.when(release, c("x.next_t")).alias("release_t"), F.coalesce(F.when(release, c("x.next_t")), c("x.legal_t")).alias("active_until"), c("y.idx").alias("i_start"), c("x.idx").alias("i_end"),
        F.when(release, c("x.next_i")).alias("i_release"), F.when(several, F.coalesce("steady.idx", "x.idx")).alias("i_chatter"), c("y.first").alias("from_start"),
    )


def ignore(found: DataFrame, ignored: DataFrame) -> DataFrame:
    """``found`` as rows of one kind each (adopted, glitch, chatter), without those that touch an ignored stretch (test_id, contact, t_start, t_end).

    An adopted interval reaches to active_until, or its end where that isn't known.
    """
    c = F.col
    whole = F.struct(c("kind").alias("kind"), c("t_start").alias("start_at"), F.when(c("kind") == "adopted", F.coalesce("active_until", "t_end")).otherwise(c("t_end")).alias("end_at"))
    bounce = F.when(c("chatter_until").isNotNull(), F.struct(F.lit("chatter").alias("kind"), c("t_start").alias("start_at"), c("chatter_until").alias("end_at")))
    rows = found.withColumn("__x", F.explode(F.array_compact(F.array(whole, bounce)))).drop("kind").select("*", "__x.*").drop("__x")
    ranges = ignored.select(*KEYS, (c("t_start") - EPS).alias("low"), (c("t_end") + EPS).alias("high"))
    return intervals.untouched(rows, ranges, KEYS, c("start_at"), c("end_at"))


def crossings(position: DataFrame, specs: DataFrame) -> DataFrame:
    """What the position does at the windows: test_id, contact, what, t, idx, towards, t_leave, i_leave.

    what: actuate and release (entries into the window of that name; towards
    tells whether the position comes from the right side, null at the start of
    the record; t_leave and i_leave are the last sample before it leaves again)
    and exit (out of the release window on the side away from the end).  All
    windows of a test go through one sort of its record.
    """
    c = F.col
    along = Window.partitionBy("test_id").orderBy("t", "idx")
    rows = position.select("test_id", "idx", "t", "v", F.lag("v").over(along).alias("was"), F.lead("v").over(along).alias("next"))
    listed = specs.groupBy("test_id").agg(F.collect_list(F.struct("contact", "end", "act_low", "act_high", "rel_low", "rel_high")).alias("__s"))

    def within(v: Column, low: Column, high: Column) -> Column:
        return (v >= low - EPS) & (v <= high + EPS)

    def marks(s: Column) -> Column:
        found = []
        for what, low, high, upwards in (("actuate", s["act_low"], s["act_high"], s["end"] == "high"), ("release", s["rel_low"], s["rel_high"], s["end"] == "low")):
            inside = within(c("v"), low, high)
            enters = inside & ~F.coalesce(within(c("was"), low, high), F.lit(False))
            leaves = inside & ~F.coalesce(within(c("next"), low, high), F.lit(False))
            towards = F.when(upwards, c("v") >= c("was") - EPS).otherwise(c("v") <= c("was") + EPS)
            found += [F.when(enters, F.struct(s["contact"].alias("contact"), F.lit(what).alias("what"), F.lit(0).alias("side"), towards.alias("towards")))]
            found += [F.when(leaves, F.struct(s["contact"].alias("contact"), F.lit(what).alias("what"), F.lit(1).alias("side"), F.lit(None).cast("boolean").alias("towards")))]
        down = (c("was") >= s["rel_low"] - EPS) & (c("v") < s["rel_low"] - EPS)
        up = (c("was") <= s["rel_high"] + EPS) & (c("v") > s["rel_high"] + EPS)
        gone = F.when(s["end"] == "high", down).otherwise(up)
        found.append(F.when(gone, F.struct(s["contact"].alias("contact"), F.lit("exit").alias("what"), F.lit(0).alias("side"), F.lit(None).cast("boolean").alias("towards"))))
        return F.array_compact(F.array(*found))

    rows = rows.join(listed, "test_id").select("test_id", "idx", "t", F.explode(F.flatten(F.transform("__s", marks))).alias("x")).select("test_id", "idx", "t", "x.*")
    # From here on there are only crossings: an entry is followed by the end of its stay.
    of = Window.partitionBy(*KEYS, "what").orderBy("t", "idx", "side")
    rows = rows.withColumn("t_leave", F.lead("t").over(of)).withColumn("i_leave", F.lead("idx").over(of)).where("side = 0")
    stay = c("what") != "exit"
    return rows.select(*KEYS, "what", "t", "idx", "towards", F.when(stay, c("t_leave")).alias("t_leave"), F.when(stay, c("i_leave")).alias("i_leave"))


def direction(points: DataFrame, position: DataFrame, speed: float = LIMITS["speed"]) -> DataFrame:
    """``points`` (test_id, t, ...) with position (interpolated, null outside of the record), slope and direction (1, -1, 0).

    The slope is that of all samples within ``HALF_S``; of fewer than two, that
    between the nearest ones before and after, null where one is missing.
    """
    c = F.col
    placed = interp._around(points, position, ["test_id"], ["v"])
    span = c("n.t") - c("p.t")
    both = c("p").isNotNull() & c("n").isNotNull()
    placed = placed.withColumn("position", F.when(both, F.when(span > 0, c("p.v") + (c("n.v") - c("p.v")) * (c("t") - c("p.t")) / span).otherwise(c("p.v"))))
    placed = placed.withColumn("__rough", F.when(both, F.when(span > 0, (c("n.v") - c("p.v")) / span).otherwise(0.0))).drop("p", "n")
    spans = points.select("test_id", c("t").alias("__t"), (c("t") - HALF_S).alias("low"), (c("t") + HALF_S).alias("high")).distinct()
    met = intervals.points_within(position.select("test_id", c("t").alias("at"), "v"), spans, ["test_id"], "at", "low", "high")
    fitted = met.groupBy("test_id", c("__t").alias("t")).agg(F.count(F.lit(1)).alias("__n"), F.regr_slope("v", "at").alias("__fit"))
    placed = placed.join(fitted, ["test_id", "t"], "left")
    slope = F.when(c("__n") >= 2, F.coalesce("__fit", F.lit(0.0))).otherwise(c("__rough"))
    sign = F.when(c("slope") > speed, 1).when(c("slope") < -speed, -1).when(c("slope").isNotNull(), 0)
    return placed.withColumn("slope", slope).withColumn("direction", sign).drop("__rough", "__fit", "__n")


def edges(intervals_: DataFrame, position: DataFrame, crossed: DataFrame, specs: DataFrame, speed: float = LIMITS["speed"]) -> DataFrame:
    """Actuate and release edges of adopted intervals: test_id, contact, edge, t, idx, position, direction, in_window, delay, expected.

    The delay counts from the latest entry into the edge's own window that
    comes from the right side, or (negative) until the first one after the edge;
    an interval that is on from the record's start has no actuate edge.
    """
    c = F.col
    on = F.when(~c("from_start"), F.struct(F.lit("actuate").alias("edge"), c("t_start").alias("t"), c("i_start").alias("idx")))
    off = F.when(c("release_t").isNotNull(), F.struct(F.lit("release").alias("edge"), c("release_t").alias("t"), c("i_release").alias("idx")))
    listed = intervals_.where("kind = 'adopted'").select(*KEYS, F.explode(F.array_compact(F.array(on, off))).alias("x")).select(*KEYS, "x.*")
    placed = direction(listed, position, speed)
    entries = crossed.where("what <> 'exit' and towards").select(*KEYS, c("what").alias("edge"), "t", "idx", F.lit(0).alias("v"))
    asked = placed.select(*KEYS, "edge", (c("t") + EPS).alias("t"), c("t").alias("at"), "idx", "position", "direction")
    around = interp._around(asked, entries, [*KEYS, "edge"], ["v"])
    rows = around.withColumn("delay", F.round(c("at") - F.coalesce("p.t", "n.t"), 6)).drop("p", "n", "t").withColumnRenamed("at", "t")
    rows = rows.join(specs.select(*KEYS, "end", "act_low", "act_high", "rel_low", "rel_high"), KEYS)
    first = c("edge") == "actuate"
    low, high = F.when(first, c("act_low")).otherwise(c("rel_low")), F.when(first, c("act_high")).otherwise(c("rel_high"))
    inside = (c("position") >= low - EPS) & (c("position") <= high + EPS)
    expected = F.when(first == (c("end") == "high"), 1).otherwise(-1)
    return rows.select(*KEYS, "edge", "t", "idx", "position", "direction", inside.alias("in_window"), "delay", expected.alias("expected"))


def together(intervals_: DataFrame, record_end: DataFrame) -> DataFrame:
    """Pairs of adopted intervals of both contacts with a common stretch: test_id, t_start, t_end, overlap and the idx of both.

    Intervals of one contact are disjoint, so in the order of their starts each
    pair shows where its later one begins while the other contact's latest is
    still on.  Open ends last forever; t_end is then that of the record.
    """
    c = F.col
    spans = intervals_.where("kind = 'adopted'").select(*KEYS, "t_start", F.coalesce("active_until", F.lit(FOREVER)).alias("until"), "i_start", "i_end")
    so_far = Window.partitionBy("test_id").orderBy("t_start", "contact").rowsBetween(Window.unboundedPreceding, -1)
    span = F.struct("until", "i_start", "i_end")
    latest = {name: F.last(F.when(c("contact") == name, span), ignorenulls=True).over(so_far) for name in ("open", "closed")}
    rows = spans.withColumn("__o", F.when(c("contact") == "open", latest["closed"]).otherwise(latest["open"]))
    until = F.least("until", "__o.until")
    rows = rows.where(c("__o").isNotNull() & (until > c("t_start"))).join(record_end, "test_id")
    return rows.select("test_id", "t_start", F.when(until < FOREVER, until).otherwise(c("record_end")).alias("t_end"), (until - c("t_start")).alias("overlap"), "i_start", "i_end")


def active_at(points: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """``points`` (keys, t) that lie in an adopted interval, from its start to before active_until (open-ended: to any time)."""
    spans = found.where("kind = 'adopted'").select(*keys, F.col("t_start").alias("low"), F.coalesce("active_until", F.lit(FOREVER)).alias("high"))
    known = spans.select(*keys, F.col("low").alias("t"), F.lit(0).alias("idx"), F.col("high").alias("v"))
    around = interp._around(points, known, keys, ["v"])
    return around.where(F.col("p").isNotNull() & (F.col("t") < F.col("p.v"))).drop("p", "n")


def states(points: DataFrame, bits: DataFrame) -> DataFrame:
    """``points`` (test_id, contact, t, ...) with the contact's bit at the last sample up to each, before the first one that of it."""
    held = interp.step_hold(points, bits.withColumn("v", F.col("bit").cast("double")), KEYS, ["v"])
    return held.withColumn("bit", F.col("held.v")).drop("held")


def metrics(edge_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per contact: numbers of edges, means and dispersions of their positions, mean differential to the next release, largest delay.

    ``edge_rows`` have edge, t, position and delay; those without position don't count.
    """
    c = F.col
    rows = edge_rows.where("position is not null")
    later = Window.partitionBy(*keys).orderBy(c("t").desc(), c("edge")).rowsBetween(Window.unboundedPreceding, -1)
    following = F.last(F.when(c("edge") == "release", c("position")), ignorenulls=True).over(later)
    rows = rows.withColumn("gap", F.when(c("edge") == "actuate", F.round(F.abs(c("position") - following), 4)))
    on, off = F.when(c("edge") == "actuate", c("position")), F.when(c("edge") == "release", c("position"))
    spread = lambda x: F.when(F.count(x) >= 2, F.round(F.max(x) - F.min(x), 4))
    return rows.groupBy(*keys).agg(
        F.count(on).alias("n_actuate"), F.count(off).alias("n_release"), F.round(F.avg(on), 4).alias("mean_actuation"), F.round(F.avg(off), 4).alias("mean_release"),
        F.round(F.avg("gap"), 4).alias("mean_differential"), spread(on).alias("actuation_dispersion"), spread(off).alias("release_dispersion"), F.round(F.max("delay"), 4).alias("max_delay"),
    )


def checks(figures: DataFrame, limits: dict[str, float] = LIMITS) -> DataFrame:
    """Metrics against their limits: test_id, contact, metric, value, high, passes; one without value isn't checked."""
    table = {"edge_delay": ("max_delay", limits["delay_s"]), "actuation_dispersion": ("actuation_dispersion", limits["dispersion"]), "release_dispersion": ("release_dispersion", limits["dispersion"])}
    listed = [F.struct(F.lit(m).alias("metric"), F.col(v).alias("value"), F.lit(high).alias("high")) for m, (v, high) in table.items()]
    rows = figures.select(*KEYS, F.explode(F.array(*listed)).alias("x")).select(*KEYS, "x.*").where("value is not null")
    return rows.withColumn("passes", F.col("value") <= F.col("high") + EPS)


def mapped(bits: DataFrame, swaps: DataFrame, polarity: Column) -> DataFrame:
    """``bits`` with the contact that its channel really is (swaps: test_id, contact, really) and its polarity's sense."""
    rows = bits.join(swaps, ["test_id", "contact"], "left").withColumn("contact", F.coalesce("really", "contact")).drop("really")
    return rows.withColumn("bit", F.when(polarity == "nc", 1 - F.col("bit")).otherwise(F.col("bit")))


def events(
    bits: DataFrame, position: DataFrame, specs: DataFrame, intervals_: DataFrame, edge_rows: DataFrame, crossed: DataFrame, limits: dict[str, float] = LIMITS
) -> DataFrame:
    """All that contradicts the travel: test_id, kind, contact, t_start, t_end, channel, i_start, i_end.

    channel and the indices name the samples that show it: those of the contact, or of the position.
    """
    c = F.col

    def event(rows: DataFrame, kind: str, a: str | Column, b: str | Column, i: str | Column, j: str | Column, channel: Column | None = None, contact: Column | None = None) -> DataFrame:
        a, b, i, j = (F.col(x) if isinstance(x, str) else x for x in (a, b, i, j))
        who = c("contact") if contact is None else contact
        return rows.select("test_id", F.lit(kind).alias("kind"), who.alias("contact"), a.alias("t_start"), b.alias("t_end"), (who if channel is None else channel).alias("channel"), i.cast("long").alias("i_start"), j.cast("long").alias("i_end"))

    wait = specs.select(*KEYS, "debounce_s", "end", "act_low", "act_high", "rel_low", "rel_high", "max_overlap_s")
    illegal = runs.periods_where(bits, KEYS, ["t", "idx"], c("bit").isNull(), "t", F.min("idx").alias("i0"), F.max("idx").alias("i1"))
    found = event(illegal, "illegal_state", "start_at", "end_at", "i0", "i1")
    # A lone glitch bounces as much as a cluster does.
    bounces = intervals_.where("kind in ('chatter', 'glitch')").withColumn("i1", F.when(c("kind") == "chatter", c("i_chatter")).otherwise(c("i_end")))
    found = found.unionByName(event(bounces, "chatter", "start_at", "end_at", "i_start", "i1"))

    known = edge_rows.where("position is not null")
    found = found.unionByName(event(known.where("not in_window"), "position_out_of_window", "t", "t", "idx", "idx"))
    found = found.unionByName(event(known.where("direction = -expected"), "order_reversal", "t", "t", "idx", "idx"))
    other = F.when(c("contact") == "open", "closed").otherwise("open")
    acts = known.where("edge = 'actuate'").select("test_id", c("contact").alias("mine"), other.alias("contact"), (c("t") + EPS).alias("t"), c("t").alias("at"), "idx")
    crossed_over = active_at(acts, intervals_, KEYS).where("at is not null")
    found = found.unionByName(event(crossed_over, "order_reversal", "at", "at", "idx", "idx", c("mine"), c("mine")))

    ends = bits.groupBy("test_id").agg(F.max("t").alias("record_end"))
    excluded = specs.groupBy("test_id").agg(F.max("max_overlap_s").alias("max_overlap_s")).where("max_overlap_s is not null")
    both = together(intervals_, ends).join(excluded, "test_id").where(c("overlap") > c("max_overlap_s") + EPS)
    found = found.unionByName(event(both, "both_active", "t_start", "t_end", "i_start", "i_end", F.lit("both"), F.lit("both")))

    stays = crossed.where((c("what") == "actuate") & (c("t_leave") - c("t") >= limits["end_dwell_s"]))
    asleep = states(stays, bits).where("bit is null or bit <> 1").join(wait, KEYS)
    acted = edge_rows.where("edge = 'actuate'").select(*KEYS, c("t").alias("other_at"))
    late = F.lit(limits["delay_s"] + EPS)
    silent = intervals.without_match(asleep, acted, KEYS, "t", c("debounce_s") + EPS, late)
    found = found.unionByName(event(silent, "no_trigger_at_end", "t", "t_leave", "idx", "i_leave", F.lit("position")))

    awake = states(crossed.where("what = 'exit'"), bits).where("bit = 1").join(wait, KEYS)
    freed = edge_rows.where("edge = 'release'").select(*KEYS, c("t").alias("other_at"))
    stuck = intervals.without_match(awake, freed, KEYS, "t", c("debounce_s") + EPS, late)
    found = found.unionByName(event(stuck, "missed_transition", "t", "t", F.greatest(F.lit(0), c("idx") - 1), "idx", F.lit("position")))
    order = F.struct("t", "idx")
    last = position.groupBy("test_id").agg(F.max("t").alias("t"), F.max_by("v", order).alias("v"), F.max_by("idx", order).alias("idx"))
    on = bits.groupBy(*KEYS).agg(F.max_by(F.struct("bit"), order).alias("x")).where("x.bit = 1").join(last, "test_id").join(wait, KEYS)

    def beyond(low: str, high: str) -> Column:
        return ~((c("v") >= c(low) - EPS) & (c("v") <= c(high) + EPS))

    held = on.where(beyond("rel_low", "rel_high") & beyond("act_low", "act_high"))
    return found.unionByName(event(held, "missed_transition", "t", "t", F.greatest(F.lit(0), c("idx") - 1), "idx", F.lit("position")))


def gaps(bits: DataFrame, specs: DataFrame, edge_rows: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Missing evidence: test_id, contact, code, blocking.  ``blocks`` (test_id, code) was found before."""
    legal = bits.where("bit is not null").select(*KEYS).distinct()
    found = specs.select(*KEYS).join(legal, KEYS, "left_anti").select(*KEYS, F.lit("contact_unusable").alias("code"), F.lit(True).alias("blocking"))
    lost = edge_rows.where("position is null").select(*KEYS, F.lit("edge_outside_position_span").alias("code"), F.lit(False).alias("blocking"))
    found = found.unionByName(lost)
    if blocks is not None:
        found = found.unionByName(blocks.select("test_id", F.lit(None).cast("string").alias("contact"), "code", F.lit(True).alias("blocking")))
    return found


def analyse(
    bits: DataFrame, position: DataFrame, specs: DataFrame, ignored: DataFrame | None = None, blocks: DataFrame | None = None, limits: dict[str, float] = LIMITS
) -> dict[str, DataFrame]:
    """Intervals, edges, events, metrics, checks, gaps and one verdict per test; ``ignored`` are stretches that a person has set aside."""
    c = F.col
    timed = bits.join(specs.select(*KEYS, "debounce_s"), KEYS)
    none = bits.sparkSession.createDataFrame([], "test_id long, contact string, t_start double, t_end double")
    kept = hold(ignore(adopted(timed, KEYS, c("debounce_s")), none if ignored is None else ignored), "intervals")
    crossed = hold(crossings(position, specs), "crossings")
    placed = hold(edges(kept, position, crossed, specs, limits["speed"]), "edges")
    listed = hold(events(bits, position, specs, kept, placed, crossed, limits), "events")
    figures = metrics(placed, KEYS)
    checked = checks(figures, limits)
    missing = gaps(bits, specs, placed, blocks)
    kinds = lambda x: F.array_join(F.array_sort(F.collect_set(x)), ",")
    both = specs.select("test_id").distinct().join(listed.groupBy("test_id").agg(kinds("kind").alias("events"), F.count(F.lit(1)).alias("n_events")), "test_id", "left")
    both = both.join(checked.where("not passes").groupBy("test_id").agg(kinds(F.concat_ws(" ", "contact", "metric")).alias("failed")), "test_id", "left")
    both = both.join(missing.groupBy("test_id").agg(kinds(F.when(c("blocking"), c("code"))).alias("blocking")), "test_id", "left")
    blocked = F.coalesce(c("blocking") != "", F.lit(False))
    verdict = F.when(blocked, "no_conclusion").when(c("events").isNotNull() | c("failed").isNotNull(), "exceedances").otherwise("ok")
    verdicts = both.select("test_id", *(F.coalesce(x, F.lit("")).alias(x) for x in ("blocking", "events", "failed")), F.coalesce("n_events", F.lit(0)).alias("n_events"), verdict.alias("verdict"))
    return {"intervals": kept, "edges": placed, "events": listed, "metrics": figures, "checks": checked, "gaps": missing, "verdicts": verdicts}


def references(found: DataFrame, samples: DataFrame) -> DataFrame:
    """(test_id, kind, contact, channel, i_start, i_end, refs): the samples at the edges of events and next to them.

    ``samples`` (test_id, channel, idx, t, v) of all channels; refs are the
    existing ones of i_start - 1, i_start, i_end, i_end + 1, each once.  Events
    meet samples by index, not by their time.
    """
    keys = ["test_id", "kind", "contact", "channel", "i_start", "i_end"]
    wanted = F.array_distinct(F.array(*[F.col(x) + d for x, d in (("i_start", -1), ("i_start", 0), ("i_end", 0), ("i_end", 1))]))
    asked = found.select(*keys).distinct().withColumn("idx", F.explode(wanted))
    points = samples.select("test_id", "channel", F.col("idx").cast("long").alias("idx"), "t", "v")
    met = asked.join(points, ["test_id", "channel", "idx"])
    return met.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", F.round("t", 6).alias("t"), "v"))).alias("refs"))
