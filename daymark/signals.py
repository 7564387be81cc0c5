"""The built-in declarations: device, place, media, mood and health signals, as a host may use or replace them."""

from __future__ import annotations

from .schema import Field, Signal

# Keys, types, units, ranges, members, strategies and days of the built-in signals.
SIGNALS = (
    Signal("battery", (
        Field("level_ratio", "number", "ratio", low=0.0, high=1.0, nullable=False, comparison="threshold_crossing", visibility="always", privacy="public"),
        Field("is_charging", "boolean", nullable=False, comparison="state_change", visibility="always", privacy="public"),
        Field("is_low_power_mode_enabled", "boolean", comparison="state_change", visibility="always", privacy="public"),
    ), storage="current_only", identity="singleton", ttl_seconds=600, detail_days=0),
    Signal("presence_recovery", (
        Field("recovered_at", "timestamp", nullable=False, comparison="occurrence", visibility="always", wakes=True),
        Field("absence_seconds", "number", "seconds", low=0.0, comparison="threshold_crossing", visibility="always"),
        Field("absence_quality", "enum", enum=("measured", "estimated"), nullable=False, visibility="always", privacy="public"),
        Field("evidence", "enum", enum=("app_entered_foreground", "app_became_active", "protected_data_became_available", "unknown"), nullable=False, visibility="always", privacy="public"),
    ), storage="current_only", identity="source_event_id", ttl_seconds=0, detail_days=0),
    Signal("steps", (
        Field("step_count", "integer", "count", low=0, nullable=False, aggregation="daily_total", trend="fluctuating", comparison="threshold_crossing", privacy="sensitive", wakes=True),
        Field("counter_epoch_id", "string", visibility="never", privacy="public"),
    ), identity="source_event_id", attribution="source_local_date", ttl_seconds=3600),
    Signal("location_city", (
        Field("locality", "string", aggregation="duration_by_state", comparison="exact", visibility="always", wakes=True),
        Field("country_code", "string", comparison="exact", visibility="always", wakes=True),
        Field("region", "string", comparison="exact", visibility="always"),
        Field("accuracy_m", "number", "m", low=0),
        Field("placemark_source", "string"),
        Field("coordinate", "object", visibility="never", privacy="restricted"),
    ), ttl_seconds=900),
    Signal("focus_state", (
        Field("is_active", "boolean", nullable=False, aggregation="duration_by_state", comparison="state_change", visibility="always"),
    ), ttl_seconds=900, detail_days=365, aggregate_days=-1),
    Signal("time_context", (
        Field("time_zone_id", "string", nullable=False, aggregation="event_list", comparison="exact", visibility="always", wakes=True),
        Field("utc_offset_seconds", "integer", "seconds", visibility="always"),
        Field("locale", "string", visibility="always"),
    ), ttl_seconds=0),
    Signal("broadcast", (
        Field("is_active", "boolean", nullable=False, aggregation="duration_by_state", comparison="state_change", visibility="always", wakes=True),
        Field("broadcast_state", "enum", enum=("idle", "broadcasting", "paused"), comparison="state_change", visibility="always", wakes=True),
    ), storage="current_short_timeline", ttl_seconds=300, detail_days=7),
    Signal("screen_change", (
        Field("changed", "boolean", nullable=False, comparison="occurrence", visibility="always", wakes=True),
    ), storage="current_only", identity="singleton", ttl_seconds=60, detail_days=0),
    Signal("audio_route", (
        Field("output_type", "enum", enum=("builtin", "headphones", "car_audio", "bluetooth_a2dp", "bluetooth_hfp", "bluetooth_le", "other"), nullable=False, aggregation="duration_by_state", comparison="state_change", visibility="always", wakes=True),
        Field("is_bluetooth", "boolean", comparison="state_change", visibility="always"),
        Field("device_label", "string"),
    ), storage="current_short_timeline", ttl_seconds=600, detail_days=7),
    Signal("weather", (
        Field("condition", "string", comparison="exact", visibility="always", privacy="public"),
        Field("temperature_c", "number", "celsius", low=-90.0, high=60.0, aggregation="numeric_dist", trend="fluctuating", comparison="numeric_delta", visibility="always", privacy="public"),
        Field("apparent_temperature_c", "number", "celsius", low=-90.0, high=70.0, visibility="always", privacy="public"),
        Field("humidity_ratio", "number", "ratio", low=0.0, high=1.0, visibility="always", privacy="public"),
        Field("precipitation_probability", "number", "ratio", low=0.0, high=1.0, visibility="always", privacy="public"),
        Field("uv_index", "number", "index", low=0.0, high=20.0, visibility="always", privacy="public"),
        Field("is_daylight", "boolean", comparison="state_change", visibility="always", privacy="public"),
        Field("alerts", "array", comparison="exact", visibility="always", privacy="public", wakes=True),
        Field("valid_at", "timestamp", visibility="always", privacy="public"),
        Field("location_scope", "string", visibility="always"),
    ), storage="current_short_timeline", ttl_seconds=1800, detail_days=7),
    Signal("proximity_anchor", (
        Field("anchor_id", "string", nullable=False, comparison="exact", visibility="always", wakes=True),
        Field("anchor_type", "enum", enum=("wifi", "bluetooth"), nullable=False, comparison="exact", visibility="always"),
        Field("label", "string", visibility="always"),
        Field("is_connected", "boolean", nullable=False, aggregation="duration_by_state", comparison="state_change", visibility="always", wakes=True),
        Field("raw_identifier", "string", visibility="never", privacy="restricted"),
    ), storage="current_short_timeline", ttl_seconds=900, detail_days=7, dimensions=("anchor_id",)),
    Signal("place_zone", (
        Field("is_inside_known_zone", "boolean", nullable=False, aggregation="duration_by_state", comparison="state_change", visibility="always", wakes=True),
        Field("zone_label", "string", comparison="state_change", visibility="always", wakes=True),
    ), storage="current_short_timeline", ttl_seconds=900, detail_days=7),
    Signal("motion_state", (
        Field("state", "enum", enum=("stationary", "walking", "running", "cycling", "automotive", "unknown"), nullable=False, aggregation="duration_by_state", comparison="state_change", visibility="always"),
        Field("confidence", "number", "ratio", low=0.0, high=1.0, visibility="always", privacy="public"),
    ), ttl_seconds=900, detail_days=365, aggregate_days=-1),
    Signal("photo_library_added", (
        Field("count", "integer", "count", low=1, high=1, nullable=False, aggregation="occurrence_count", trend="fluctuating", comparison="occurrence", wakes=True),
        Field("added_at", "timestamp", nullable=False),
    ), identity="source_event_id", ttl_seconds=0, detail_days=7, aggregate_days=-1),
    Signal("music_playback", (
        Field("track_key", "string", comparison="exact", privacy="sensitive", wakes=True),
        Field("title", "string", privacy="sensitive"),
        Field("artist", "string", privacy="sensitive"),
        Field("album", "string", privacy="sensitive"),
        Field("playback_state", "enum", enum=("playing", "paused", "stopped"), nullable=False, aggregation="duration_by_state", comparison="state_change", privacy="sensitive", wakes=True),
        Field("position_seconds", "number", "s", low=0, privacy="sensitive"),
        Field("edge_quality", "enum", enum=("measured", "estimated"), nullable=False, visibility="always", privacy="sensitive"),
        Field("media_type", "enum", enum=("music", "podcast", "audio_book", "audio_itunes_u", "audio", "movie", "tv_show", "music_video", "video_podcast", "video_itunes_u", "home_video", "video", "unknown"), privacy="sensitive"),
        Field("duration_seconds", "number", "seconds", low=0, privacy="sensitive"),
    ), ttl_seconds=600, detail_days=365, aggregate_days=-1),
    Signal("app_usage", (
        Field("app_id", "string", nullable=False, comparison="exact", privacy="sensitive", wakes=True),
        Field("app_name", "string", privacy="sensitive"),
        Field("category", "string", privacy="sensitive"),
        Field("action", "enum", enum=("open", "close"), nullable=False, comparison="exact", privacy="sensitive"),
        Field("open_count", "integer", "count", low=0, aggregation="occurrence_count", trend="fluctuating", privacy="sensitive"),
    ), identity="source_event_id", ttl_seconds=900, aggregate_days=-1),
    Signal("health_sleep", (
        Field("stage", "enum", enum=("awake", "core", "deep", "rem", "asleep", "unknown"), nullable=False, comparison="state_change", privacy="sensitive"),
        Field("duration_minutes", "number", "minutes", low=0.0, high=1440.0, aggregation="duration_sum_by_state", trend="fluctuating", comparison="threshold_crossing", privacy="sensitive", wakes=True),
        Field("start_at", "timestamp", privacy="sensitive"),
        Field("end_at", "timestamp", privacy="sensitive"),
    ), identity="source_event_id", attribution="episode_end", ttl_seconds=86400, dimensions=("stage",)),
    Signal("health_workout", (
        Field("workout_type", "string", nullable=False, aggregation="event_list", comparison="occurrence", privacy="sensitive", wakes=True),
        Field("duration_minutes", "number", "minutes", low=0.0, high=1440.0, aggregation="daily_sum", trend="fluctuating", privacy="sensitive"),
        Field("active_energy_kcal", "number", "kcal", accepts=("kj",), low=0.0, high=20000.0, aggregation="daily_sum", trend="fluctuating", privacy="sensitive"),
        Field("distance_m", "number", "m", accepts=("km", "mi"), low=0.0, high=500000.0, aggregation="daily_sum", trend="fluctuating", privacy="sensitive"),
        Field("start_at", "timestamp", privacy="sensitive"),
        Field("end_at", "timestamp", privacy="sensitive"),
    ), identity="source_event_id", attribution="episode_end", ttl_seconds=86400),
    Signal("health_activity", (
        Field("active_energy_kcal", "number", "kcal", accepts=("kj",), low=0.0, high=20000.0, aggregation="daily_total", trend="fluctuating", comparison="threshold_crossing", privacy="sensitive", wakes=True),
        Field("exercise_minutes", "number", "minutes", low=0.0, high=1440.0, aggregation="daily_total", trend="fluctuating", comparison="threshold_crossing", privacy="sensitive", wakes=True),
        Field("stand_minutes", "number", "minutes", low=0.0, high=1440.0, aggregation="daily_total", trend="fluctuating", privacy="sensitive"),
        Field("mindful_minutes", "number", "minutes", low=0.0, high=1440.0, aggregation="daily_total", trend="fluctuating", privacy="sensitive"),
        Field("counter_epoch_id", "string", visibility="never", privacy="public"),
    ), identity="source_event_id", attribution="source_local_date", ttl_seconds=3600),
    Signal("health_cycle", (
        Field("is_active_period", "boolean", aggregation="main_of_day", comparison="state_change", privacy="sensitive", wakes=True),
        Field("flow_level", "enum", enum=("none", "light", "medium", "heavy", "unspecified"), comparison="state_change", privacy="sensitive"),
        Field("start_at", "timestamp", privacy="sensitive"),
        Field("end_at", "timestamp", privacy="sensitive"),
    ), identity="source_event_id", ttl_seconds=86400),
    Signal("health_mood", (
        Field("valence", "number", "scale_minus1_to_1", low=-1.0, high=1.0, aggregation="numeric_dist", trend="fluctuating", comparison="numeric_delta", privacy="sensitive", wakes=True),
        Field("valence_classification", "string", privacy="sensitive"),
        Field("kind", "string", privacy="sensitive"),
        Field("labels", "array", privacy="sensitive"),
        Field("recorded_at", "timestamp", privacy="sensitive"),
    ), identity="source_event_id", ttl_seconds=86400),
    Signal("health_weight", (
        Field("weight_kg", "number", "kg", accepts=("lb", "g"), low=2.0, high=500.0, aggregation="main_of_day", trend="drifting", comparison="numeric_delta", privacy="sensitive", wakes=True, max_relative_jump=0.2),
    ), identity="source_event_id", ttl_seconds=86400),
    Signal("health_bmi", (
        Field("bmi", "number", "kg_m2", low=5.0, high=100.0, aggregation="main_of_day", trend="drifting", privacy="sensitive", max_relative_jump=0.2),
    ), identity="source_event_id", ttl_seconds=86400),
    Signal("health_body_fat", (
        Field("body_fat_ratio", "number", "ratio", low=0.01, high=0.75, aggregation="main_of_day", trend="drifting", privacy="sensitive", max_relative_jump=0.3),
    ), identity="source_event_id", ttl_seconds=86400),
    Signal("health_height", (
        Field("height_cm", "number", "cm", accepts=("in", "m", "ft"), low=30.0, high=280.0, privacy="sensitive", max_relative_jump=0.1),
    ), storage="current_only", identity="source_event_id", ttl_seconds=86400, detail_days=0),
    Signal("health_resting_hr", (
        Field("resting_heart_rate", "number", "bpm", low=20.0, high=200.0, aggregation="numeric_dist", trend="fluctuating", comparison="numeric_delta", privacy="sensitive", wakes=True, max_relative_jump=0.5),
    ), identity="source_event_id", ttl_seconds=3600),
    Signal("health_hrv", (
        Field("hrv_sdnn_ms", "number", "ms", low=0.0, high=500.0, aggregation="numeric_dist", trend="fluctuating", privacy="sensitive"),
    ), identity="source_event_id", ttl_seconds=3600),
    Signal("health_respiratory", (
        Field("respiratory_rate", "number", "breaths_per_minute", low=4.0, high=60.0, aggregation="numeric_dist", trend="fluctuating", privacy="sensitive"),
    ), identity="source_event_id", ttl_seconds=3600),
    Signal("health_oxygen", (
        Field("oxygen_saturation_pct", "number", "percent", low=50.0, high=100.0, aggregation="numeric_dist", trend="fluctuating", privacy="sensitive"),
    ), identity="source_event_id", ttl_seconds=3600),
    Signal("health_vo2max", (
        Field("vo2_max", "number", "ml_kg_min", low=5.0, high=100.0, aggregation="main_of_day", trend="drifting", privacy="sensitive"),
    ), identity="source_event_id", ttl_seconds=3600),
    Signal("health_current_hr", (
        Field("current_heart_rate", "number", "bpm", low=20.0, high=250.0, privacy="sensitive"),
    ), storage="current_only", identity="source_event_id", ttl_seconds=3600, detail_days=0),
    Signal("health_glucose", (
        Field("blood_glucose_mmol_l", "number", "mmol_l", accepts=("mg_dl",), low=0.5, high=40.0, aggregation="numeric_dist", trend="fluctuating", comparison="threshold_crossing", privacy="sensitive", wakes=True),
    ), identity="source_event_id", ttl_seconds=86400),
    Signal("health_blood_pressure", (
        Field("blood_pressure_systolic_mmhg", "number", "mmhg", low=50.0, high=260.0, aggregation="numeric_dist", trend="fluctuating", comparison="threshold_crossing", privacy="sensitive", wakes=True, max_relative_jump=0.6),
        Field("blood_pressure_diastolic_mmhg", "number", "mmhg", low=30.0, high=180.0, aggregation="numeric_dist", trend="fluctuating", privacy="sensitive", max_relative_jump=0.6),
    ), identity="source_event_id", ttl_seconds=86400),
)
BY_KEY = {s.key: s for s in SIGNALS}
