"""Certificates: gates, correction and comparison of chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgauge.functions import units
from fleetgauge.functions.verdicts import validity

#: First failing gate wins.
GATES = (
    "not_bound", "version_missing", "type_mismatch", "unit_incompatible", "points_nonmonotonic",
    "not_yet_valid", "expired", "spans_boundary", "range_uncovered", "points_outside",
)


def increasing(points: Column) -> Column:
    """Whether an array of (ind, ref) has at least two points and rises in both."""
    later = F.sequence(F.lit(1), F.greatest(F.size(points) - 1, F.lit(1)))
    rises = F.forall(later, lambda i: (F.get(points, i)["ind"] > F.get(points, i - 1)["ind"]) & (F.get(points, i)["ref"] > F.get(points, i - 1)["ref"]))
    return (F.size(points) >= 2) & F.coalesce(rises, F.lit(False))


def segment_at(value: Column, points: Column) -> Column:
    """Index of the first segment of a certificate's points that holds ``value``; null outside of them."""
    last = F.size(points) - 1
    below = F.filter(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))), lambda i: (F.get(points, i)["ind"] <= value) & (F.get(points, i + 1)["ind"] >= value))
    return F.get(below, F.lit(0))


def between(value: Column, points: Column, at: Column) -> Column:
    """``value`` by the line of segment ``at``."""
    a, b = F.get(points, at), F.get(points, at + 1)
    return a["ref"] + (value - a["ind"]) * (b["ref"] - a["ref"]) / (b["ind"] - a["ind"])


def corrected(value: Column, points: Column) -> Column:
    """Piecewise-linear correction by a certificate's points; null outside of them."""
    return between(value, points, segment_at(value, points))


def apply_chain(channels: DataFrame, bindings: DataFrame, certificates: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """One row per test channel with the certificate that applies or the first gate that fails.

    ``channels``: test_id, channel, measurement_type, starts, ends, low, high
    (readings) and unit.  ``bindings``: test_id, channel, version_id.
    ``certificates``: version_id, cert_type, cert_unit, valid_from,
    valid_until, range_min, range_max, points.  Readings are put into the
    certificate's unit before they are held against its range and points;
    ``ranges`` (test_id, range_low, range_high) serve travel units.  Readings
    that are in the certificate's unit already come with unit_family and
    cert_family instead of the units, and without ``ranges``.
    """
    c = F.col
    rows = channels.join(bindings, ["test_id", "channel"], "left").join(certificates.withColumn("__known", F.lit(True)), "version_id", "left")
    state = validity(c("starts"), c("ends"), c("valid_from"), c("valid_until"))
    slack = 1e-9
    if ranges is None:
        a, b, strange = c("low"), c("high"), c("cert_family") != c("unit_family")
    else:
        rows = rows.join(ranges, "test_id", "left")
        a, b = (units.convert(c(x), c("unit"), c("cert_unit"), c("measurement_type"), c("range_low"), c("range_high")) for x in ("low", "high"))
        strange = a.isNull() | b.isNull()
    # A travel range that falls turns the readings' ends round.
    rows = rows.withColumn("__low", F.least(a, b)).withColumn("__high", F.greatest(a, b)).withColumn("__strange", strange)
    covered = (c("__low") >= c("range_min") - slack) & (c("__high") <= c("range_max") + slack)
    inside = (c("__low") >= F.get("points", F.lit(0))["ind"]) & (c("__high") <= F.element_at("points", -1)["ind"])
    failed = {
        "not_bound": F.col("version_id").isNull(),
        "version_missing": F.col("__known").isNull(),
        "type_mismatch": F.col("cert_type") != F.col("measurement_type"),
        "unit_incompatible": F.col("__strange"),
        "points_nonmonotonic": ~increasing(F.col("points")),
        "not_yet_valid": state == "not_yet_valid",
        "expired": state == "expired",
        "spans_boundary": state == "spans_boundary",
        "range_uncovered": F.coalesce(~covered, F.lit(False)),
        "points_outside": ~inside,
    }
    gate = F.coalesce(*[F.when(failed[g], g) for g in GATES])
    return rows.select("test_id", "channel", "version_id", gate.alias("gate"), gate.isNull().alias("accepted"))


def compare_chains(pre: DataFrame, post: DataFrame) -> DataFrame:
    """Full outer join of two sides' chains (channel keys in ``key``, digest, correction)."""
    a = pre.select("key", F.col("digest").alias("pre_digest"), F.col("correction").alias("pre_correction"))
    b = post.select("key", F.col("digest").alias("post_digest"), F.col("correction").alias("post_correction"))
    both = a.join(b, "key", "full_outer")
    status = F.when(F.col("pre_digest").isNull(), "post_only").when(F.col("post_digest").isNull(), "pre_only")
    status = status.when(F.col("pre_digest") == F.col("post_digest"), "same").otherwise("recalibrated")
    return both.withColumn("status", status).withColumn("delta", F.col("post_correction") - F.col("pre_correction"))


def test_interval(samples: DataFrame, tests: DataFrame) -> DataFrame:
    """(test_id, starts, ends, max_t): from the recorded start, else the submission, to the latest sample of any channel."""
    last = samples.groupBy("test_id").agg(F.max("t").alias("max_t"))
    starts = F.coalesce("started_at", "submitted_at")
    rows = tests.join(last, "test_id").withColumn("starts", starts)
    ends = F.timestamp_micros(F.unix_micros(F.col("starts").cast("timestamp")) + F.round(F.col("max_t") * 1e6).cast("long"))
    return rows.select("test_id", F.col("starts").cast("timestamp").alias("starts"), ends.alias("ends"), "max_t")


def present_channels(samples: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(test_id, channel, measurement_type, unit, low, high) of the channels that have points and are subject to calibration."""
    table = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    rows = samples.where(F.col("channel").isin(*kinds))
    # Strings are grouped by, not aggregated, so that the samples are hashed instead of sorted.
    each = rows.groupBy("test_id", "channel", "unit").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    each = each.groupBy("test_id", "channel").agg(F.first("unit").alias("unit"), F.min("low").alias("low"), F.max("high").alias("high"))
    return each.select("test_id", "channel", F.element_at(table, F.col("channel")).alias("measurement_type"), "unit", "low", "high")


def channel_units(samples: DataFrame) -> DataFrame:
    """(test_id, channel, unit): a unit of each channel's samples."""
    each = samples.groupBy("test_id", "channel", "unit").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("test_id", "channel").agg(F.first("unit").alias("unit"))


def version_problems(certificates: DataFrame) -> DataFrame:
    """``certificates`` with the problems (array of codes) that forbid registering them.

    Columns: valid_from, valid_until, measurement_type, unit, range_min,
    range_max, points, standard_uncertainty.
    """
    c = F.col
    known = increasing(c("points"))
    first, last = F.get("points", F.lit(0))["ind"], F.element_at("points", -1)["ind"]
    ranged = c("range_min").isNotNull() & c("range_max").isNotNull()
    problems = F.array_compact(F.array(
        F.when(c("valid_from").isNull() | c("valid_until").isNull(), "interval_unparsable").when(c("valid_from") >= c("valid_until"), "interval_empty"),
        F.when(~units.same_family(c("measurement_type"), c("unit")), "unit_incompatible"),
        F.when(ranged & (c("range_max") <= c("range_min")), "range_empty"),
        F.when(~known, "points_nonmonotonic").when(ranged & ((first < c("range_min") - 1e-9) | (last > c("range_max") + 1e-9)), "points_outside_range"),
        F.when(c("standard_uncertainty") <= 0, "uncertainty_nonpositive"),
    ))
    return certificates.withColumn("problems", problems)


def frozen(certificates: DataFrame) -> DataFrame:
    """(version_id, certificate): each certificate's row as one struct, to be stored with a result."""
    return certificates.select("version_id", F.struct(*[F.col(c) for c in certificates.columns]).alias("certificate"))


def correct_samples(samples: DataFrame, chain: DataFrame, certificates: DataFrame, ranges: DataFrame) -> DataFrame:
    """``samples`` (test_id, channel, idx, t, v, unit) of accepted channels corrected, others as they are, with ``shift``.

    A reading goes into the certificate's unit, through its points and back;
    ``ranges`` (test_id, range_low, range_high) serve travel units.  A reading
    of an accepted channel that can't be corrected is an error.
    """
    c = F.col
    certs = certificates.select("version_id", "points", c("unit").alias("cert_unit"), "measurement_type")
    # Certificates, ranges and conversions go to the few channels first, and all channels of a test to its samples by the test alone.
    used = chain.where("accepted").select("test_id", "channel", "version_id").join(certs, "version_id", "left").join(ranges, "test_id", "left")
    one = F.struct("version_id", "points", "cert_unit", "measurement_type", "range_low", "range_high")
    used = used.groupBy("test_id").agg(F.map_from_entries(F.collect_list(F.struct("channel", one))).alias("__used"))
    named = samples.groupBy("test_id", "channel", "unit").agg(F.count(F.lit(1)).alias("n")).join(used, "test_id")
    named = named.withColumn("__one", F.try_element_at("__used", c("channel"))).where("__one is not null").select("test_id", "channel", "unit", "__one.*")
    ends = c("measurement_type"), c("range_low"), c("range_high")
    named = named.withColumn("there", units.conversion(c("unit"), c("cert_unit"), *ends)).withColumn("back", units.conversion(c("cert_unit"), c("unit"), *ends))
    how = F.struct(F.struct("channel", "unit"), F.struct("version_id", "points", "there", "back"))
    named = named.groupBy("test_id").agg(F.map_from_entries(F.collect_list(how)).alias("__how"))
    rows = samples.join(named, "test_id", "left").withColumn("__one", F.try_element_at("__how", F.struct("channel", "unit")))
    rows = rows.select(*samples.columns, "__one.*")
    # Columns of their own, so that each is computed once a sample.
    rows = rows.withColumn("__there", units.converted(c("v"), c("there"))).withColumn("__at", segment_at(c("__there"), c("points")))
    rows = rows.withColumn("__back", units.converted(between(c("__there"), c("points"), c("__at")), c("back")))
    back = c("__back")
    lost = F.raise_error(F.format_string("test %s, channel %s: an accepted certificate leaves a reading uncorrected", c("test_id").cast("string"), c("channel"))).cast("double")
    fixed = F.when(c("version_id").isNull() | c("v").isNull(), c("v")).when(back.isNull(), lost).otherwise(back)
    rows = rows.withColumn("raw", c("v")).withColumn("v", fixed).withColumn("shift", c("v") - c("raw"))
    return rows.select("test_id", "channel", "idx", "t", "v", "unit", "raw", "shift", "version_id")


def calibrate(samples: DataFrame, tests: DataFrame, bindings: DataFrame, certificates: DataFrame, ranges: DataFrame, kinds: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """The whole chain: (samples as of :func:`correct_samples`, gates as of :func:`apply_chain`).

    ``tests``: test_id, started_at, submitted_at; ``kinds`` names the
    measurement type of each channel that is subject to calibration.
    """
    span = test_interval(samples, tests).select("test_id", "starts", "ends")
    channels = present_channels(samples, kinds).join(span, "test_id")
    known = certificates.withColumnRenamed("measurement_type", "cert_type").withColumnRenamed("unit", "cert_unit")
    wanted = known.select("version_id", "cert_type", "cert_unit", "valid_from", "valid_until", "range_min", "range_max", "points")
    chain = apply_chain(channels, bindings, wanted, ranges)
    return correct_samples(samples, chain, certificates, ranges), chain


def correction_stats(corrected_rows: DataFrame, kept: int = 8) -> DataFrame:
    """Per corrected channel the mean and largest shift, the corrected range, and up to ``kept`` evenly spaced shifts."""
    c = F.col
    n = F.count(F.lit(1)).over(_of_channel())
    stride = F.greatest(F.lit(1), F.ceil(n / kept))
    rows = corrected_rows.where("version_id is not null").withColumn("__k", F.row_number().over(_of_channel().orderBy("idx")) - 1).withColumn("__s", stride)
    some = F.array_sort(F.collect_list(F.when(c("__k") % c("__s") == 0, F.struct("idx", "shift"))))
    found = rows.groupBy("test_id", "channel", "version_id").agg(
        F.round(F.avg("shift"), 6).alias("mean_shift"), F.round(F.max(F.abs("shift")), 6).alias("max_shift"), F.round(F.min("v"), 6).alias("low"), F.round(F.max("v"), 6).alias("high"), some.alias("x")
    )
    return found.withColumn("shifts", F.transform("x", lambda s: F.round(s["shift"], 6))).drop("x")


def _of_channel():
    return Window.partitionBy("test_id", "channel")


def chain_components(chain: DataFrame, certificates: DataFrame, channels: DataFrame, ranges: DataFrame) -> DataFrame:
    """(test_id, channel, value, unit): the certificates' standard uncertainties in the channels' units."""
    c = F.col
    rows = chain.where("accepted").select("test_id", "channel", "version_id").join(certificates.select("version_id", c("unit").alias("cert_unit"), "measurement_type", "standard_uncertainty"), "version_id")
    rows = rows.join(channels.select("test_id", "channel", "unit"), ["test_id", "channel"]).join(ranges, "test_id", "left")
    value = units.convert_spread(c("standard_uncertainty"), c("cert_unit"), c("unit"), c("measurement_type"), c("range_low"), c("range_high"))
    return rows.select("test_id", "channel", value.alias("value"), "unit").where("value is not null")


def legacy_block(tests: DataFrame) -> DataFrame:
    """(test_id, code) of tests without bindings whose one validity date is missing or before the test."""
    c = F.col
    code = F.when(c("calibration_valid_until").isNull(), "calibration_missing").when(c("calibration_valid_until") < F.coalesce("started_at", "submitted_at"), "calibration_expired")
    return tests.select("test_id", code.alias("code")).where("code is not null")


def resolve_bindings(override: Column, previous: Column, submitted: Column) -> Column:
    """The map channel -> version that an analysis uses: the override (an empty one: none), the last version's, the submission's; null means the single date holds."""
    mine = F.when(F.size(override) > 0, F.map_filter(override, lambda _, v: v.isNotNull()))
    return F.when(override.isNotNull(), mine).when(previous.isNotNull(), previous).otherwise(F.map_filter(submitted, lambda _, v: v.isNotNull()))


def bindings_of(raw: Column) -> Column:
    """A list of (channel, calibration_version_id) as a map; of repeated channels the last one holds."""
    last = F.filter(raw, lambda x, i: ~F.exists(F.slice(raw, i + 2, F.greatest(F.size(raw), F.lit(1))), lambda y: y["channel"] == x["channel"]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["channel"], x["calibration_version_id"])))


def rebind_record(author: Column, bindings: Column) -> Column:
    """Audit entry of a rebinding."""
    return F.struct(F.lit("calibration_rebind").alias("type"), author.alias("author"), bindings.alias("bindings"))
