"""What readers may see: fields of an agent's signals, permissions, wake facts, routes of reported fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

# How hosts write that something is off, denied or allowed.
OFF = ("0", "false", "off", "disabled", "switch_off", "switch-off", "no")
DENIED = ("denied", "not_permitted", "not-permitted", "not_allowed", "not-allowed", "not_authorized", "not-authorized", "unauthorized", "restricted", "permission_denied")
# Signals whose changes wake no one, wake triggers with what they say, hints that are passed on.
NOT_WAKE_WORTHY = ("motion_state", "battery", "now_playing", "time", "place_label")
TRIGGERS = {
    "unlock_after_absence": "returned_after_absence", "arrived_at_anchor": "anchor_changed", "photo_added": "new_photo", "scene_change": None,
    "broadcast_opened": "screen_share_started", "broadcast_closed": "screen_share_ended",
}
PHOTO = {"photo_id": 160, "scene": 200, "time_of_day": 80}
HINTS = ("place_label", "motion_state", "now_playing", "locale", "broadcast_state", "broadcast_active")


def refusal(value: Column) -> Column:
    """Why a permission value forbids reading: switch_off, not_permitted, or null if it allows (as unknown text and null do)."""
    v = F.lower(F.trim(value.cast("string")))
    return F.when(v.isin(*OFF), "switch_off").when(v.isin(*DENIED), "not_permitted")


def refused(states: Column, keys: Sequence[str]) -> Column:
    """The first refusal among the keys (in order) of a map of permission values; null: readable."""
    return F.coalesce(*(refusal(F.try_element_at(states, F.lit(k))) for k in keys))


def projected(snapshot: Column, pull: Column, signal: str, fields: Sequence[str]) -> list[Column]:
    """One agent signal's fields from maps: cheap signals from the snapshot, all others from the pulled one."""
    source = snapshot if signal in ("now", "app") else pull
    return [F.try_element_at(source, F.lit(f)).alias(f) for f in fields]


def significant(signal: Column, previous: Column, current: Column) -> Column:
    """Whether a change is worth a wake: another value, of a signal that isn't vetoed."""
    return ~previous.eqNullSafe(current) & ~signal.isin(*NOT_WAKE_WORTHY)


def arrival(observed: Column, seen: Column) -> Column:
    return F.when(observed < seen, "stale").when(observed == seen, "same_ts").otherwise("newer")


def wake_facts(items: DataFrame) -> DataFrame:
    """Wake items (trigger, wake_id, source, change_digest, origin_refs, presence_hints) cut to the closed field set; others go.

    presence_hints is a map of texts, or of variants, which keep their kinds: truth values, finite numbers and texts are
    passed on, anything else isn't. A photo's photo_id, scene and time_of_day, where items have them, go with a new photo only.
    """
    cut = lambda c, most: F.nullif(F.left(F.coalesce(c.cast("string"), F.lit("")), F.lit(most)), F.lit(""))
    rows = items.where(F.col("trigger").isin(*TRIGGERS))
    refs = F.transform(F.slice(F.coalesce("origin_refs", F.array().cast("array<string>")), 1, 10), lambda r: F.left(r, F.lit(200)))
    if isinstance(items.schema["presence_hints"].dataType.valueType, VariantType):

        def passed(v):
            kind = F.schema_of_variant(v)
            finite = kind.isin("BIGINT", "BOOLEAN") | kind.startswith("DECIMAL") | (kind.isin("DOUBLE", "FLOAT") & (F.abs(F.try_variant_get(v, "$", "double")) < float("inf")))
            return F.when(kind == "STRING", F.to_variant_object(F.array(F.left(F.try_variant_get(v, "$", "string"), F.lit(200))))).when(finite, F.to_variant_object(F.array(v)))

        # texts are cut inside a list of one, as only lists and objects are made into variants
        hints = F.transform_values(F.map_filter("presence_hints", lambda k, v: k.isin(*HINTS)), lambda _, v: F.try_variant_get(passed(v), "$[0]", "variant"))
        hints = F.map_filter(hints, lambda _, v: v.isNotNull())
    else:
        hints = F.map_filter(F.transform_values("presence_hints", lambda k, v: F.left(v, F.lit(200))), lambda k, v: k.isin(*HINTS) & v.isNotNull())
    photo = {c: F.when(F.col("trigger") == "photo_added", cut(F.col(c), most)).alias(c) for c, most in PHOTO.items() if c in items.columns}
    says = F.create_map(*(F.lit(x) for t, s in TRIGGERS.items() if s for x in (t, s)))
    return rows.select(
        *(c for c in items.columns if c not in ("trigger", "wake_id", "source", "change_digest", "origin_refs", "presence_hints", *PHOTO)), "trigger", F.try_element_at(says, F.col("trigger")).alias("says"),
        cut(F.col("wake_id"), 160).alias("wake_id"), cut(F.col("source"), 120).alias("source"), cut(F.col("change_digest"), 2000).alias("change_digest"), refs.alias("origin_refs"), hints.alias("presence_hints"), *photo.values(),
    )


def routes(reported: DataFrame, splits: DataFrame, dims: DataFrame) -> DataFrame:
    """Where reported fields (report_key, field, capability, ttl_seconds) are stored: where a split says, else the signal of the
    report itself if it declares the field, else nowhere; never guessed by name. The shortest ttl of a route holds."""
    own = dims.select(F.col("signal").alias("report_key"), "field", F.col("signal").alias("own"))
    rows = reported.join(splits, ["report_key", "field"], "left").join(own, ["report_key", "field"], "left")
    at = F.coalesce("split_signal", "own")
    return rows.groupBy("report_key", "field", at.alias("storage_signal")).agg(F.min("ttl_seconds").alias("ttl_seconds")).withColumn("split_off", F.coalesce(F.col("storage_signal") != F.col("report_key"), F.lit(False)))


def classified(value: Column, reported_zero: Column, available: Column) -> Column:
    """One of four states: what isn't available is never believed, and only the source says that a zero is one."""
    return F.when(~available, "unavailable").when(value.isNull(), "no_observation").when(reported_zero, "observed_zero").otherwise("observed")
