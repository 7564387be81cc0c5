"""Observations against the declarations: fields typed, converted, checked and cut to what may be stored, in one join.

A declaration is a few fields, so that a signal's specification is one row and an observation's fields stay in its row:
nothing is exploded and only the small table of specifications is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from .ingest import instant


def specifications(dims: DataFrame) -> DataFrame:
    """A row per signal: fields as a map of name to (type, unit, low, high, nullable, privacy, enum), and the required ones."""
    spec = F.struct("type", "unit", "low", "high", "nullable", "privacy", "enum")
    return dims.groupBy("signal").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", spec.alias("spec"))))).alias("spec"), F.array_sort(F.collect_set(F.when(~F.col("nullable"), F.col("field")))).alias("required")
    )


def _typed(raw: Column, spec: Column, unit: Column) -> Column:
    """(canonical text, problem) of one field; a null value has neither."""
    number = raw.try_cast("double")
    kind, target = spec["type"], spec["unit"]
    finite = ~(F.isnan(number) | (F.abs(number) == float("inf")))
    converted = F.when(unit.isNull() | unit.eqNullSafe(target), number).otherwise(scalars.convert(number, unit, target))
    numeric = kind.isin("integer", "number")
    problem = (
        F.when(raw.isNull(), None).when(numeric & number.isNull(), "not_a_number").when(numeric & ~finite, "not_finite").when(unit.isNotNull() & (~numeric | target.isNull() | converted.isNull()), "invalid_units")
        .when((kind == "integer") & (converted != F.floor(converted)), "not_whole").when((kind == "boolean") & ~F.lower(raw).isin("true", "false"), "not_boolean")
        .when((kind == "enum") & ~F.array_contains(spec["enum"], raw), "not_a_member").when((kind == "timestamp") & instant(raw).isNull(), "not_a_time")
        .when(numeric & F.coalesce((converted < spec["low"]) | (converted > spec["high"]), F.lit(False)), "out_of_range")
    )
    text = F.when(kind == "integer", converted.cast("long").cast("string")).when(numeric, converted.cast("string")).when(kind == "boolean", F.lower(raw)).otherwise(raw)
    return F.struct(F.when(problem.isNull(), text).alias("text"), problem.alias("problem"))


def normalised(observations: DataFrame, dims: DataFrame) -> DataFrame:
    """observations (signal, availability, values map<string,string>, units map<string,string>) with `stored` (canonical values
    as text), source_units and source_values of converted fields, and `problems`.

    Unknown signals are refused. Undeclared and restricted fields are dropped, the latter without a trace. Fields are
    checked by type, members and range after conversion; an observed one must have all required fields.
    """
    rows = observations.join(specifications(dims), "signal", "left")
    values, units = F.coalesce("values", F.create_map().cast("map<string,string>")), F.coalesce("units", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(values, lambda k, v: F.coalesce(F.try_element_at(F.col("spec"), k)["privacy"] != "restricted", F.lit(False)))
    rows = rows.withColumns({"_kept": kept, "_units": units})
    rows = rows.withColumn("_typed", F.transform_values("_kept", lambda k, v: _typed(v, F.try_element_at(F.col("spec"), k), F.try_element_at(F.col("_units"), k))))
    entries = F.map_entries("_typed")
    bad = F.transform(F.filter(entries, lambda e: e["value"]["problem"].isNotNull()), lambda e: F.concat(e["value"]["problem"], F.lit(":"), e["key"]))
    undeclared_unit = F.transform(F.filter(F.map_keys("_units"), lambda k: ~F.map_contains_key("spec", k)), lambda k: F.concat(F.lit("invalid_units:"), k))
    given = F.map_keys(F.map_filter("_kept", lambda k, v: v.isNotNull()))
    missing = F.transform(F.when(F.col("availability") == "observed", F.array_except("required", given)).otherwise(F.array().cast("array<string>")), lambda k: F.concat(F.lit("missing:"), k))
    problems = F.when(F.col("spec").isNull(), F.array(F.lit("unknown_signal"))).otherwise(F.array_sort(F.concat(bad, undeclared_unit, missing)))
    stored = F.transform_values(F.map_filter("_typed", lambda k, v: v["text"].isNotNull()), lambda k, v: v["text"])
    changed = F.map_filter("_units", lambda k, v: F.coalesce(F.map_contains_key("_kept", k) & (v != F.try_element_at(F.col("spec"), k)["unit"]), F.lit(False)))
    source = F.map_filter("_kept", lambda k, v: F.map_contains_key(changed, k))
    return rows.withColumns({"problems": problems, "stored": stored, "source_units": changed, "source_values": source}).drop("spec", "required", "_kept", "_units", "_typed")


def known_zones(rows: DataFrame, zones: DataFrame, supplied: str = "timezone", fallback: str = "host_zone") -> DataFrame:
    """rows with zone, zone_source (declared, host, missing) and zone_problem: a supplied zone that isn't known is refused, never replaced."""
    known = zones.select(F.col("zone").alias("_z"))
    got = rows.join(known, F.col(supplied) == F.col("_z"), "left")
    bad = F.col(supplied).isNotNull() & F.col("_z").isNull()
    zone = F.when(F.col(supplied).isNotNull(), F.col("_z")).otherwise(F.col(fallback))
    source = F.when(F.col(supplied).isNotNull(), "declared").when(F.col(fallback).isNotNull(), "host").otherwise("missing")
    return got.withColumns({"zone": zone, "zone_source": source, "zone_problem": F.when(bad, "unknown_zone")}).drop("_z")


def with_ids(rows: DataFrame, id_for) -> DataFrame:
    """rows with observation_id from a host's generator, a column expression of the row."""
    return rows.withColumn("observation_id", id_for)


def semantic_digest(values: Column) -> Column:
    """A digest of a map's canonical JSON, marked with the version of its form."""
    return F.concat(F.lit("v2:"), F.sha2(scalars.canonical_json(values), 256))
