"""Submitted test records of all kinds: one payload column, projected by kind, and the records that can't be read.

A record's payload is a VARIANT, so each kind's own fields (actuator, spring,
gas, isolation steps, fluid, switch, specification) come with it and are taken
out only where an analysis asks for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SERIES = "map<string,struct<unit:string,points:array<array<double>>>>"
_COMPONENT = "struct<kind:string,value:double,unit:string,distribution:string>"
_CHANNEL = f"struct<resolution:{_COMPONENT},accuracy:{_COMPONENT},zero_drift:{_COMPONENT},calibration:{_COMPONENT},time_jitter_s:double>"
_QUANTITY = "struct<value:double,unit:string>"
_CURVE = "array<array<double>>"
_CHAMBER = f"struct<min_volume:{_QUANTITY},max_volume:{_QUANTITY}>"
_ACTUATOR = (
    f"struct<actuator_type:string,fail_mode:string,air_chambers:array<string>,chamber_a:{_CHAMBER},chamber_b:{_CHAMBER},area_a:{_QUANTITY},area_b:{_QUANTITY},spring:struct<force_unit:string,points:{_CURVE}>,"
    f"load:{_QUANTITY},friction:{_QUANTITY},port_conductance:{_QUANTITY},initial_position_pct:double,initial_chamber_pressure:{_QUANTITY}>"
)

#: Fields of every kind: name, (path, type).
COMMON = {
    "test_id": ("$.test_id", "bigint"), "kind": ("$.kind", "string"), "valve_tag": ("$.valve_tag", "string"), "phase": ("$.phase", "string"),
    "test_started_at": ("$.test_started_at", "string"), "submitted_at": ("$.submitted_at", "string"), "calibration_valid_until": ("$.calibration_valid_until", "string"),
    "range_low": ("$.range.min", "double"), "range_high": ("$.range.max", "double"), "range_unit": ("$.range.unit", "string"),
    "calibration_bindings": ("$.calibration_bindings", "map<string,bigint>"), "thresholds": ("$.thresholds", "map<string,double>"),
    "load": ("$.conditions.load", "string"), "medium": ("$.conditions.medium", "string"), "series": ("$.series", SERIES),
}
#: What a record has where it doesn't say.
DEFAULTS = {"range_low": 0.0, "range_high": 100.0, "range_unit": "%", "phase": "standalone"}
#: Fields of one kind.
FIELDS = {
    "fullstroke": {
        "uncertainty": ("$.uncertainty", f"struct<channels:map<string,{_CHANNEL}>,calibration:struct<value:double,unit:string,distribution:string,applies_to:array<string>,range_min:double,range_max:double,range_unit:string>,n_samples:int,seed:bigint,interval_prob:double>"),
    },
    "failsafe": {"fail_mode": ("$.fail_mode", "string"), "observation_window_s": ("$.observation_window_s", "double"), "acting": ("$.conditions.actuator_type", "string")},
    "seatleak": {
        "flow_direction": ("$.flow_direction", "string"), "gas": ("$.gas", "struct<name:string,molar_mass_g_mol:double,compressibility_z:double,reference_temp_c:double,reference_pressure_kpa:double>"),
        "closed_volume": ("$.closed_volume", "struct<downstream_volume_m3:double,uncertainty_pct:double>"), "isolation": ("$.isolation", "array<struct<t:double,action:string,note:string>>"),
        "blank_baseline": ("$.blank_baseline", "struct<points:array<struct<temp_c:double,pressure_kpa:double,recovery_rate_kpa_min:double>>,temp_margin_c:double,pressure_margin_kpa:double>"),
    },
    "stemthrust": {
        "acting": ("$.actuator.actuator_type", "string"), "area_a": ("$.actuator.area_a", _QUANTITY), "area_b": ("$.actuator.area_b", _QUANTITY), "stem_direction": ("$.actuator.stem_direction", "string"),
        "spring": ("$.actuator.spring", f"struct<version:string,action:string,force_unit:string,points:{_CURVE}>"),
    },
    "flowcurve": {
        "fluid": ("$.fluid", "struct<name:string,density_kg_m3:double,vapor_pressure_kpa:double,critical_pressure_kpa:double,density_ref_temp_c:double>"),
        "valve": ("$.valve", "struct<rated_cv:double,size_dn_mm:double,trim:string,characteristic:string,liquid_recovery_factor_fl:double,equal_percentage_r:double>"),
        "meter": ("$.meter", "struct<full_scale:double,unit:string>"), "atmospheric_pressure_kpa": ("$.atmospheric_pressure_kpa", "double"), "flow_direction": ("$.flow_direction", "string"),
    },
    "limitswitch": {
        "switch": ("$.switch", "struct<open:struct<polarity:string,actuate_window_pct:array<double>,release_window_pct:array<double>>,closed:struct<polarity:string,actuate_window_pct:array<double>,release_window_pct:array<double>>,debounce_s:double,mutual_exclusion:struct<enabled:boolean,max_overlap_s:double>>"),
    },
    "partialstroke": {
        "trim": ("$.trim", "string"), "spec": ("$.spec", "struct<start_pct:double,direction:string,target_travel_pct:double,max_disturbance_pct:double,time_limit_s:double>"),
        "pv_measurement_type": ("$.pv_measurement_type", "string"),
    },
    "airsupply": {
        "actuator": ("$.actuator", _ACTUATOR), "supply": ("$.supply", f"struct<header_pressure:{_QUANTITY}>"), "tank": ("$.tank", f"struct<volume:{_QUANTITY},initial_pressure:{_QUANTITY}>"),
        "pipe_segments": ("$.pipe_segments", "array<struct<name:string,length_m:double,inner_diameter_mm:double,friction_factor:double,minor_loss_k:double>>"),
        "regulator": ("$.regulator", f"struct<set_pressure:{_QUANTITY},dp_unit:string,flow_unit:string,flow_curve:{_CURVE}>"),
        "events": ("$.events", f"array<struct<device:string,t_start_s:double,t_end_s:double,flow:{_QUANTITY}>>"),
        "actions": ("$.actions", f"array<struct<name:string,kind:string,direction:string,t_start_s:double,travel_time_s_max:double,required_supply_pressure_min:{_QUANTITY},safe_band_pct:double>>"),
    },
}
#: Channels that a record of a kind must have.
CHANNELS = {
    "fullstroke": ["command", "position", "pressure"], "failsafe": ["trip", "command", "position", "pressure"],
    "seatleak": ["command", "position", "upstream_pressure", "downstream_pressure", "downstream_temp"], "stemthrust": ["command", "position", "supply_pressure"],
    "flowcurve": ["position", "flow", "upstream_pressure", "downstream_pressure", "temperature"], "limitswitch": ["position", "open", "closed"],
    "partialstroke": ["permit", "abort", "command", "position", "pressure", "pv"], "airsupply": [],
}
#: Channels that a record of a kind may have besides.
OPTIONAL = {"seatleak": ["flow"], "stemthrust": ["chamber_a_pressure", "chamber_b_pressure"]}


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(source, text) of JSON files with one record each."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))


def parse(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejected) of (source, text).

    ``records``: the common fields, source and payload (VARIANT).  ``rejected``:
    source, text and reason (not_json, no_object, unknown_kind, no_channel X,
    bad_points X); a bad record doesn't hold up the others.  A record without
    id gets one from its valve, phase, start and source.
    """
    c = F.col
    rows = texts.select("source", "text", F.try_parse_json("text").alias("payload"))
    rows = rows.select("source", "text", "payload", *(F.try_variant_get("payload", path, kind).alias(n) for n, (path, kind) in COMMON.items()))
    rows = rows.withColumns({n: F.coalesce(c(n), F.lit(v)) for n, v in DEFAULTS.items()})
    need = F.create_map(*[x for k, channels in CHANNELS.items() for x in (F.lit(k), F.array(*map(F.lit, channels)).cast("array<string>"))])
    asked = F.try_element_at(need, c("kind"))
    lacking = F.filter(asked, lambda x: F.coalesce(F.size(F.try_element_at("series", x)["points"]), F.lit(0)) <= 0)
    may = F.create_map(*[x for k in CHANNELS for x in (F.lit(k), F.array(*map(F.lit, OPTIONAL.get(k, []))).cast("array<string>"))])
    broken = F.filter(F.concat(asked, F.try_element_at(may, c("kind"))), lambda x: F.exists(F.try_element_at("series", x)["points"], lambda p: F.coalesce((F.size(p) != 2) | F.get(p, 0).isNull() | F.get(p, 1).isNull(), F.lit(True))))
    reason = (
        F.when(c("payload").isNull(), "not_json")
        .when(~F.startswith(F.schema_of_variant("payload"), F.lit("OBJECT")), "no_object")
        .when(asked.isNull(), "unknown_kind")
        .when(F.size(lacking) > 0, F.concat(F.lit("no_channel "), F.array_join(lacking, ",")))
        .when(F.size(broken) > 0, F.concat(F.lit("bad_points "), F.array_join(broken, ",")))
    )
    rows = rows.withColumn("reason", reason)
    made = F.xxhash64("valve_tag", "phase", "test_started_at", "source")
    good = rows.where("reason is null").withColumn("test_id", F.coalesce("test_id", made)).drop("reason", "text")
    return good, rows.where("reason is not null").select("source", "text", "reason")


def of_kind(records: DataFrame, kind: str) -> DataFrame:
    """The records of one kind with its own fields."""
    rows = records.where(F.col("kind") == kind)
    return rows.select("*", *(F.try_variant_get("payload", path, type_).alias(n) for n, (path, type_) in FIELDS[kind].items())).drop("payload")


def samples_of(records: DataFrame, channels: list[str] | None = None) -> DataFrame:
    """Long samples (test_id, channel, unit, idx, t, v) of all or the named channels."""
    rows = records.select("test_id", F.explode("series").alias("channel", "s"))
    if channels is not None:
        rows = rows.where(F.col("channel").isin(channels))
    rows = rows.select("test_id", "channel", "s.unit", F.posexplode("s.points").alias("idx", "p"))
    return rows.select("test_id", "channel", "unit", "idx", F.get("p", F.lit(0)).alias("t"), F.get("p", F.lit(1)).alias("v"))


def times(records: DataFrame) -> DataFrame:
    """(test_id, started_at, submitted_at, calibration_valid_until) as timestamps; unreadable ones are null."""

    def at(name: str) -> Column:
        return F.try_to_timestamp(name).alias(name.replace("test_", ""))

    return records.select("test_id", at("test_started_at"), at("submitted_at"), at("calibration_valid_until"))
