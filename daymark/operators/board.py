"""What a reader is shown of a subject: a board with one entry a domain, and a glance of flags without any number.

Documents are variants, the latest of each signal or a snapshot; histories are days. A board puts facts beside each other
and ranks nothing; its hints (a new artist, a long stay) are facts as well.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What makes a domain of a signal's document available, and what makes a document invalid.
LONG_STAY, TOP_ARTISTS, RECENT_APPS, OVERDUE, SCENES = 240.0, 3, 5, 5, 5
EXPIRED = ("expired", "stale", "is_expired", "is_stale")
GLANCE = {
    "location": ("location", {"text": ("place_label", "wifi_label", "country", "locality", "wifi_anchor_id")}),
    "now": ("media", {"text": ("now_playing.title", "now_playing.artist", "now_playing.album", "now_playing.playback_state")}),
    "app": ("app", {"text": ("app_name", "app_category", "app_state")}),
    "steps": ("health", {"number": ("step_count",)}),
    "sleep": ("health", {"number": ("asleep_minutes", "core_minutes", "deep_minutes", "rem_minutes")}),
    "workout": ("health", {"number": ("duration_min", "count_today"), "text": ("workout_type",)}),
    "vitals": ("health", {"number": ("resting_heart_rate", "step_count", "current_heart_rate", "hrv_sdnn_ms", "respiratory_rate", "oxygen_saturation_pct", "vo2_max")}),
    "activity": ("health", {"number": ("active_energy_kcal", "exercise_minutes", "stand_minutes", "mindful_minutes")}),
    "body": ("health", {"number": ("weight_kg", "bmi", "body_fat_pct", "height_cm")}),
    "metabolic": ("health", {"number": ("blood_glucose_mmol_l", "blood_pressure_systolic", "blood_pressure_diastolic")}),
    "cycle": ("health", {"text": ("flow_level",), "flag": ("is_active_period",)}),
    "weather": ("weather", {"number": ("temperature", "apparent_temperature", "humidity", "precipitation_chance", "uv_index"), "text": ("condition",), "flag": ("is_daylight",), "alerts": ("alerts",)}),
    "mood": ("mood", {"number": ("valence", "label_count"), "text": ("valence_classification", "kind"), "flag": ("recorded_today",)}),
    "reminders": ("reminders", {"number": ("overdue_count", "due_today_count"), "text": ("next_reminder",), "flag": ("reminders_truncated",), "reminders": ("reminders",)}),
    "calendar": ("calendar", {"event": ("calendar_next_event",), "events": ("calendar_events",)}),
}
CHANGES = {"location": ("location_signal",), "media": ("playback",), "health": ("health_vitals", "health_sleep", "health_workout", "health_activity", "health_body", "health_metabolic", "health_cycle"), "weather": ("weather",)}


def _at(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, f"$.{path}", "variant")


def is_number(v: Column) -> Column:
    """A number that is finite; truth values are none."""
    kind = F.schema_of_variant(v)
    return F.coalesce((kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")) & (F.abs(F.try_variant_get(v, "$", "double")) < float("inf")), F.lit(False))


def is_text(v: Column) -> Column:
    """A string with something in it."""
    return F.coalesce((F.schema_of_variant(v) == "STRING") & (F.trim(F.try_variant_get(v, "$", "string")) != ""), F.lit(False))


def is_flag(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "BOOLEAN", F.lit(False))


def _any(tests: list[Column]) -> Column:
    return reduce(or_, tests, F.lit(False))


def is_event(v: Column) -> Column:
    return _any([is_text(_at(v, p)) for p in ("title", "start_time")] + [is_number(_at(v, p)) for p in ("starts_in_min", "minutes_until_start")])


def is_reminder(v: Column) -> Column:
    return _any([is_text(_at(v, p)) for p in ("title", "due_time", "due_date")] + [is_flag(_at(v, "overdue"))])


def is_alert(v: Column) -> Column:
    return _any([is_text(_at(v, p)) for p in ("title", "summary", "headline", "description", "severity")])


def holds_any(v: Column, test) -> Column:
    """Whether a variant is a list of which any member passes."""
    return F.coalesce(F.exists(F.try_variant_get(v, "$", "array<variant>"), test), F.lit(False))


_TESTS = {
    "number": is_number, "text": is_text, "flag": is_flag, "event": is_event,
    "alerts": lambda v: holds_any(v, is_alert), "reminders": lambda v: holds_any(v, is_reminder), "events": lambda v: holds_any(v, is_event),
}


def glance(latest: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """subject, glance (JSON of flags by domain, keys sorted, domains without anything left out) and its fingerprint.

    latest: subject, signal, doc (variant), the latest document of each signal. Disabled, outdated and expired documents
    are as none. changed: subject, signal of notable changes. Every subject with a document has a row.
    """
    doc = F.col("doc")
    flag = lambda p, to: F.coalesce((F.schema_of_variant(_at(doc, p)) == "BOOLEAN") & (F.try_variant_get(doc, f"$.{p}", "boolean") == to), F.lit(False))
    invalid = flag("disabled", True) | flag("fresh", False) | _any([flag(m, True) for m in EXPIRED])
    there, domain = F.lit(False), F.lit(None).cast("string")
    for signal, (name, wanted) in GLANCE.items():
        mine = F.col("signal") == signal
        there = F.when(mine, _any([_TESTS[kind](_at(doc, p)) for kind, paths in wanted.items() for p in paths])).otherwise(there)
        domain = F.when(mine, name).otherwise(domain)
    count = lambda p: is_number(_at(doc, p)) & (F.try_variant_get(doc, f"$.{p}", "double") > 0)
    coming = is_event(_at(doc, "calendar_next_event")) | holds_any(_at(doc, "calendar_events"), is_event)
    rows = latest.select("subject", domain.alias("domain"), (there & ~invalid).alias("there"), *(F.coalesce(c & ~invalid, F.lit(False)).alias(n) for n, c in {"recorded": flag("recorded_today", True), "due": count("due_today_count"), "overdue": count("overdue_count"), "coming": coming}.items()))
    has = lambda d, c="there": F.coalesce(F.bool_or(F.when(F.col("domain") == d, F.col(c))), F.lit(False))
    got = rows.groupBy("subject").agg(*(has(d).alias(d) for d in dict.fromkeys(n for n, _ in GLANCE.values())), has("mood", "recorded").alias("recorded"), has("reminders", "due").alias("due"), has("reminders", "overdue").alias("overdue"), has("calendar", "coming").alias("coming"))
    none = F.array().cast("array<string>")
    if changed is not None:
        got = got.join(changed.groupBy("subject").agg(F.collect_set("signal").alias("changed")), "subject", "left")
        moved = F.coalesce("changed", none)
    else:
        moved = none
    change = lambda d: F.arrays_overlap(moved, F.array(*map(F.lit, CHANGES[d])))
    yes = F.lit(True).alias("available")
    entry = lambda d, **more: F.when(F.col(d), F.struct(yes, *(c.alias(n) for n, c in more.items()))).alias(d)
    parts = {
        "app": entry("app", recent_activity=F.lit(True)), "calendar": entry("calendar", has_upcoming=F.col("coming")), "health": entry("health", notable_change=change("health")), "location": entry("location", notable_change=change("location")),
        "media": F.when(F.col("media"), F.struct(F.lit(True).alias("active"), yes, change("media").alias("notable_change"))).alias("media"), "mood": entry("mood", recorded=F.col("recorded")),
        "reminders": entry("reminders", has_due=F.col("due"), has_overdue=F.col("overdue")), "weather": entry("weather", notable_change=change("weather")),
    }
    got = got.select("subject", F.to_json(F.struct(*(parts[d] for d in sorted(parts)))).alias("glance"))
    return got.withColumn("fingerprint", F.sha2("glance", 256))


def _texts(doc: Column, path: str) -> Column:
    return F.nullif(F.try_variant_get(doc, f"$.{path}", "string"), F.lit(""))


def _numbers(doc: Column, path: str) -> Column:
    return F.when(is_number(_at(doc, path)), F.try_variant_get(doc, f"$.{path}", "double"))


def _distinct(values: Column, most: int) -> Column:
    """The first `most` distinct texts of an array, in its order; nulls and empty ones are none."""
    return F.slice(F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != ""))), 1, most)


def recent_apps(snapshot: Column) -> Column:
    """Apps of a snapshot's list by time, latest first (without a time last), each once."""
    items = F.try_variant_get(snapshot, "$.recent_apps", "array<variant>")
    timed = F.transform(F.filter(items, lambda x: F.schema_of_variant(x).startswith("OBJECT")), lambda x, i: F.struct((-F.coalesce(_numbers(x, "ts"), F.lit(0.0))).alias("late"), i.alias("at"), _texts(x, "app").alias("app")))
    return F.transform(F.array_sort(timed), lambda x: x["app"])


def first_seen(days: DataFrame, values: Column, keys: tuple[str, ...] = ("subject",)) -> DataFrame:
    """keys, value, first_day: an index of what days hold, by the first day that does."""
    return days.select(*keys, "local_date", F.explode(values).alias("value")).groupBy(*keys, "value").agg(F.min("local_date").alias("first_day"))


def latest_day(days: DataFrame, keys: tuple[str, ...] = ("subject",)) -> DataFrame:
    """The row of each key's last day."""
    rest = [c for c in days.columns if c not in keys]
    return days.groupBy(*keys).agg(F.max_by(F.struct(*rest), "local_date").alias("x")).select(*keys, "x.*")


def board(snapshots: DataFrame, listening: DataFrame, places: DataFrame, notable: DataFrame, photos: DataFrame) -> DataFrame:
    """A row per subject of snapshots, a struct per domain.

    snapshots: subject, snapshot and pull (variants); listening: days (by_artist map, total_minutes, distinct_titles);
    places: days (minutes map, visited); notable: trends.notable_readings(); photos: subject, taken_at, photo_id, scene.
    """
    day = latest_day(listening).select("subject", F.col("local_date").alias("m_day"), "by_artist", "total_minutes", "distinct_titles")
    here = latest_day(places).select("subject", "minutes", "visited")
    rows = snapshots.join(day, "subject", "left").join(here, "subject", "left")
    rows = rows.withColumns({"artist": _texts(F.col("snapshot"), "now_playing.artist"), "place": _texts(F.col("snapshot"), "place_label")})
    index = first_seen(listening, F.map_keys("by_artist")).withColumnRenamed("value", "artist")
    rows = rows.join(index, ["subject", "artist"], "left")
    fresh = F.when(F.col("artist").isNotNull() & (F.col("first_day").isNull() | (F.col("first_day") >= F.col("m_day"))), "new_artist")
    ranked = F.array_sort(F.transform(F.map_entries("by_artist"), lambda e: F.struct((-e["value"]).alias("m"), e["key"].alias("a"))))
    changes = notable.groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("place", "signal", "field", "direction"))).alias("notable"))
    # a subject's photos are counted in full; of scenes only the latest sight of each is kept
    scenes = photos.where("scene <> ''").groupBy("subject", "scene").agg(F.max(F.struct("taken_at", "photo_id")).alias("seen"))
    order = F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("seen")))
    scenes = scenes.withColumn("n", order).where(F.col("n") <= SCENES).groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("n", "scene"))).alias("scenes"))
    counts = photos.groupBy("subject").agg(F.count("*").alias("recent_count"))
    rows = rows.join(changes, "subject", "left").join(scenes, "subject", "left").join(counts, "subject", "left")
    snap, pull = F.col("snapshot"), F.col("pull")
    title = _texts(snap, "now_playing.title")
    stay = F.when(F.col("place").isNotNull(), F.try_element_at(F.col("minutes"), F.col("place")))
    apps = recent_apps(snap)
    due = F.filter(F.try_variant_get(pull, "$.reminders", "array<variant>"), lambda r: F.coalesce(F.try_variant_get(r, "$.overdue", "boolean"), F.lit(False)) & _texts(r, "title").isNotNull())
    mood = _at(pull, "valence").isNotNull() | _at(pull, "valence_classification").isNotNull() | F.coalesce(F.try_variant_get(pull, "$.recorded_today", "boolean"), F.lit(False))
    none = F.array().cast("array<string>")
    return rows.select(
        "subject",
        F.struct(F.col("place").alias("now"), stay.alias("minutes_today"), F.coalesce("visited", none).alias("visited_today"), F.when(stay >= LONG_STAY, "long_dwell").alias("novelty")).alias("location"),
        F.struct(F.when(title.isNotNull() | F.col("artist").isNotNull(), F.struct(title.alias("title"), "artist")).alias("now"), F.coalesce(F.transform(F.slice(ranked, 1, TOP_ARTISTS), lambda x: x["a"]), none).alias("top_artists_today"), F.col("total_minutes").alias("minutes_today"),
                 F.when(F.col("distinct_titles").isNotNull(), F.size("distinct_titles")).alias("distinct_today"), fresh.alias("novelty")).alias("media"),
        F.struct(F.try_element_at(apps, F.lit(1)).alias("now"), F.coalesce(_distinct(apps, RECENT_APPS), none).alias("recent")).alias("app"),
        F.coalesce(F.transform("notable", lambda x: F.concat_ws(".", x["signal"], x["field"], x["direction"])), none).alias("health"),
        F.struct(F.when(_at(pull, "condition").isNull() & _at(pull, "temperature").isNull(), "none").alias("status"), _texts(pull, "condition").alias("condition"), _numbers(pull, "temperature").alias("temperature")).alias("weather"),
        F.struct(F.when(~mood, "none").alias("status"), _numbers(pull, "valence").alias("valence"), _texts(pull, "valence_classification").alias("classification")).alias("mood"),
        F.struct(_numbers(pull, "due_today_count").alias("due_today"), _numbers(pull, "overdue_count").alias("overdue_count"), F.coalesce(F.slice(F.transform(due, lambda r: _texts(r, "title")), 1, OVERDUE), none).alias("overdue"), _texts(pull, "next_reminder").alias("next")).alias("reminders"),
        F.struct(F.to_json(_at(snap, "calendar_next_event")).alias("next")).alias("calendar"),
        F.struct(F.coalesce("recent_count", F.lit(0)).alias("recent_count"), F.coalesce(F.transform("scenes", lambda x: x["scene"]), none).alias("scenes")).alias("photos"),
        F.struct(_texts(snap, "broadcast_state").alias("state")).alias("screen"),
    )
