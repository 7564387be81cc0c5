"""Reports to facts: parsing, checks, units, clock, scope, batch limits and identities, as columns of one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars

REPORT_SCHEMA = (
    "schema_version int, report_id string, producer string, producer_instance_id string, reported_at string, observations array<struct<signal:string,signal_schema_version:int,"
    "occurred_at:string,availability:string,state:string,value:string,source_event_id:string,sample_id:string,timezone:string,source_revision:string,reason:string,unit:string>>"
)
FUTURE_SECONDS, WARN_SECONDS, MOST_OBSERVATIONS, MOST_BYTES = 86_400, 600, 200, 262_144
REASONS = ("permission_denied", "not_supported", "source_error")
_OFFSET = r"(Z|[+-][0-9]{2}:?[0-9]{2})$"


def parse_reports(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """JSON payloads to one row per observation with its place in the report; a bad payload is a row with problems.

    Reports of another schema version, without an id or producer, or beyond the batch limits are refused as a whole.
    """
    r = raw.withColumn("report", F.from_json(payload, REPORT_SCHEMA))
    n = F.coalesce(F.size("report.observations"), F.lit(0))
    refused = (
        F.when(F.col("report").isNull() | F.col("report.schema_version").isNull(), "malformed").when(F.col("report.schema_version") != 1, "unsupported_version")
        .when(F.col("report.report_id").isNull() | F.col("report.producer").isNull(), "missing_field").when(n > MOST_OBSERVATIONS, "too_many_observations")
        .when(F.octet_length(payload) > MOST_BYTES, "payload_too_large")
    )
    r = r.withColumn("refused", refused)
    kept = r.drop(payload)
    rows = kept.select("*", F.posexplode_outer("report.observations").alias("index", "o"))
    return rows.select(
        *(c for c in kept.columns if c not in ("report",)), F.col("report.report_id").alias("report_id"), F.col("report.producer").alias("producer"), "index",
        F.col("o.signal").alias("signal"), F.col("o.occurred_at").alias("occurred_raw"), F.coalesce("o.availability", "o.state").alias("availability"), F.col("o.value").alias("value_raw"),
        F.coalesce("o.source_event_id", "o.sample_id").alias("source_event_id"), F.col("o.timezone").alias("timezone"), F.col("o.source_revision").alias("revision"), F.col("o.unit").alias("unit"), F.col("o.reason").alias("reason"),
    )


def instant(text: Column) -> Column:
    """An instant from ISO text with an offset; null for naive or broken text."""
    t = F.regexp_replace(F.trim(text), " ", "T")
    return F.when(t.rlike(_OFFSET), F.coalesce(F.try_to_timestamp(t), F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mmXXX")), F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ssXX"))))


def problems(rows: DataFrame, received_at: Column, low: Column, high: Column, unit: Column, allowed: Column | None = None) -> DataFrame:
    """rows with canonical value and the array of problem codes (empty: accepted) and warnings.

    value is a number column, occurred_at an instant, signal unknown if unit is null; allowed is an array of signals
    (null: all), low and high bound the value, unit is the canonical one.
    """
    canonical = scalars.convert(F.col("value"), F.coalesce("unit", unit), unit)
    skew = F.timestamp_diff("SECOND", received_at, F.col("occurred_at"))
    bad = F.isnan("value") | (F.abs("value") == float("inf"))
    checks = {
        "unknown_signal": unit.isNull(),
        "not_authorized": F.lit(False) if allowed is None else (allowed.isNotNull() & ~F.array_contains(allowed, F.col("signal"))),
        "invalid_time": F.col("occurred_at").isNull(),
        "clock_skew": skew > FUTURE_SECONDS,
        "invalid_units": (F.col("availability") == "observed") & unit.isNotNull() & F.col("value").isNotNull() & canonical.isNull(),
        "not_finite": bad,
        "out_of_range": (F.col("availability") == "observed") & ~bad & ((canonical < low) | (canonical > high)),
        "missing_value": (F.col("availability") == "observed") & F.col("value").isNull(),
        "unknown_availability": ~F.coalesce(F.col("availability").isin("observed", "no_data", "unavailable"), F.lit(False)),
    }
    codes = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items())))
    warn = F.when(F.abs(skew) > WARN_SECONDS, F.array(F.lit("clock_drift"))).otherwise(F.array().cast("array<string>"))
    return rows.withColumns({"canonical": canonical, "problems": codes, "warnings": warn})


def resolve_zone(supplied: Column, fallback: Column, known: DataFrame | None = None) -> tuple[Column, Column]:
    """(zone, where it came from): the supplied one, else the fallback, else missing."""
    zone = F.coalesce(supplied, fallback)
    return zone, F.when(supplied.isNotNull(), "declared").when(fallback.isNotNull(), "host").otherwise("missing")


def identities(rows: DataFrame, strategy: Column) -> DataFrame:
    """fact_key by identity strategy, content and delivery digests."""
    fact = (
        F.when(strategy == "source_event_id", scalars.digest(F.col("subject"), F.col("source"), F.col("signal"), F.col("source_event_id")))
        .when(strategy == "singleton", scalars.digest(F.col("subject"), F.col("source"), F.col("signal")))
        .otherwise(scalars.digest(F.col("subject"), F.col("source"), F.col("signal"), F.col("occurred_at")))
    )
    content = scalars.digest(F.coalesce(F.col("availability"), F.lit("")), F.coalesce(F.col("canonical").cast("string"), F.lit("")))
    rows = rows.withColumns({"fact_key": fact, "content_digest": content})
    return rows.withColumn("delivery_key", scalars.digest(F.col("fact_key"), F.coalesce(F.col("revision").cast("string"), F.lit("")), F.col("content_digest")))


def claim_reports(reports: DataFrame, digest: str = "payload_digest", arrival: str = "received_at") -> DataFrame:
    """accepted for the first report of an identity, duplicate for the same content again, conflict for other content."""
    w = Window.partitionBy("subject", "producer", "report_id").orderBy(arrival, digest)
    first = F.first(digest).over(w)
    return reports.withColumn("claim", F.when(F.row_number().over(w) == 1, "accepted").when(F.col(digest) == first, "duplicate").otherwise("conflict"))


def finalised(claims: DataFrame, receipts: DataFrame) -> DataFrame:
    """Claims with the receipt of the same identity and digest; `refused` marks receipts of another digest, which don't count."""
    keys = ["subject", "producer", "report_id"]
    rows = claims.join(receipts.select(*keys, F.col("payload_digest").alias("_d"), F.col("status").alias("_s")), keys, "left")
    same = F.col("_d") == F.col("payload_digest")
    return rows.withColumns({"status": F.when(same, F.col("_s")), "refused": F.col("_d").isNotNull() & ~same}).drop("_d", "_s")


def merge_rejections(rejected: DataFrame) -> DataFrame:
    """One row per (report, index): the first code in order of codes, problems without repeats."""
    return rejected.groupBy("report_id", "index").agg(F.min("code").alias("code"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("problems")))).alias("problems"))


# What a producer should do, by the batch's error code, then by its items' codes, in this order.
RECOVERY_BY_ERROR = (
    ("legacy_report_semantics_unverifiable", "migrate_original_envelope_or_use_new_report_id"),
    ("fact_revision_details_incomplete", "restore_fact_evidence_and_use_new_report_id"),
    ("fact_conflict", "resolve_fact_conflict_and_use_new_report_id"),
)
RECOVERY_BY_CODE = (
    ("fact_revision_details_incomplete", "restore_fact_evidence_and_use_new_report_id"),
    ("fact_conflict", "resolve_fact_conflict_and_use_new_report_id"),
    ("stale_fact_revision", "use_higher_fact_revision_and_new_report_id"),
    ("validation_failed", "correct_rejected_observations_and_use_new_report_id"),
)


def recovery_action(status: Column, error_code: Column, codes: Column) -> Column:
    """What a producer should do next; null if nothing."""
    rungs = [(error_code == code, action) for code, action in RECOVERY_BY_ERROR]
    rungs += [(F.array_contains(codes, F.lit(code)), action) for code, action in RECOVERY_BY_CODE]
    rungs += [(status.isin("rejected", "conflict"), "correct_payload_and_use_new_report_id")]
    return F.coalesce(*(F.when(holds, F.lit(action)) for holds, action in rungs))


def device_snapshot(snapshots: DataFrame, mapping: DataFrame) -> DataFrame:
    """Device snapshots (client_ts seconds as text, items array<struct<key, data, message>>) to observations by a mapping (key, signal, field, name, scale)."""
    rows = snapshots.select("report_id", F.timestamp_seconds(F.col("client_ts").cast("double")).alias("occurred_at"), F.explode("items").alias("i"))
    rows = rows.select("report_id", "occurred_at", F.col("i.key").alias("key"), F.col("i.data").alias("data"))
    rows = rows.join(F.broadcast(mapping), "key")  # the mapping is a fixed table of the adapter, some dozens of rows
    state = scalars.availability(F.col("data"))
    number = F.expr("try_cast(from_json(data, 'map<string,string>')[field] AS double)")
    value = F.when(state == "observed", number * F.col("scale"))
    return rows.select("report_id", "occurred_at", "signal", "name", state.alias("availability"), value.alias("value"))
