"""Signals and fields declared by the host: closed vocabularies, validation, and the dimension tables of plans."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The closed vocabularies of declarations.
FIELD_TYPES = ("integer", "number", "boolean", "string", "enum", "timestamp", "array", "object")
PRIVACY = ("public", "personal", "sensitive", "restricted")
STORAGE = ("current_only", "current_timeline_aggregate", "current_short_timeline", "source_mirror")
STRATEGIES = ("none", "numeric_dist", "daily_total", "daily_sum", "occurrence_count", "main_of_day", "duration_by_state", "duration_sum_by_state", "event_list")
IDENTITIES = ("source_event_id", "deterministic_digest", "singleton")
ATTRIBUTION = ("instant", "episode_end", "split_at_midnight", "source_local_date")
TRENDS = ("none", "fluctuating", "drifting", "cyclical")
COMPARISONS = ("none", "exact", "numeric_delta", "threshold_crossing", "state_change", "occurrence")
VISIBILITY = ("always", "on_demand", "never")
PERMANENT = -1
_NUMERIC = {"numeric_dist", "daily_total", "daily_sum", "occurrence_count"}
_SPARK = {"integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "array": T.ArrayType(T.VariantType()), "object": T.VariantType()}


@dataclass(frozen=True)
class Field:
    key: str
    type: str = "number"
    unit: str | None = None
    accepts: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    enum: tuple[str, ...] = ()
    nullable: bool = True
    aggregation: str = "none"
    trend: str = "none"
    visibility: str = "on_demand"
    privacy: str = "personal"
    max_relative_jump: float | None = None
    comparison: str = "none"
    wakes: bool = False


@dataclass(frozen=True)
class Signal:
    key: str
    fields: tuple[Field, ...] = field(default_factory=tuple)
    storage: str = "current_timeline_aggregate"
    identity: str = "deterministic_digest"
    attribution: str = "instant"
    ttl_seconds: int | None = None
    detail_days: int = PERMANENT
    aggregate_days: int | None = None  # None: as long as details
    dimensions: tuple[str, ...] = ()

    def struct(self) -> T.StructType:
        """The type of a stored value: restricted fields are never stored."""
        return T.StructType([T.StructField(f.key, _SPARK.get(f.type, T.StringType()), f.nullable) for f in self.fields if f.privacy != "restricted"])


def validate(signals: Iterable[Signal]) -> list[str]:
    """All problems of a declaration, in order; none: it may be used."""
    out, seen = [], set()
    for s in signals:
        if s.key in seen:
            out.append(f"{s.key}: declared twice")
        seen.add(s.key)
        for what, value, known in (("storage", s.storage, STORAGE), ("identity", s.identity, IDENTITIES), ("attribution", s.attribution, ATTRIBUTION)):
            if value not in known:
                out.append(f"{s.key}: unknown {what} {value}")
        keys = [f.key for f in s.fields]
        out += [f"{s.key}.{k}: declared twice" for k in sorted({k for k in keys if keys.count(k) > 1})]
        out += [f"{s.key}: dimension {d} is no field" for d in s.dimensions if d not in keys]
        if s.storage == "current_only" and s.detail_days not in (0, PERMANENT):
            out.append(f"{s.key}: keeps details, but stores the current value only")
        for f in s.fields:
            at = f"{s.key}.{f.key}"
            for what, value, known in (("type", f.type, FIELD_TYPES), ("aggregation", f.aggregation, STRATEGIES), ("trend", f.trend, TRENDS), ("comparison", f.comparison, COMPARISONS), ("visibility", f.visibility, VISIBILITY), ("privacy", f.privacy, PRIVACY)):
                if value not in known:
                    out.append(f"{at}: unknown {what} {value}")
            if (f.type == "enum") != bool(f.enum):
                out.append(f"{at}: an enum has members, and nothing else does")
            if f.aggregation in _NUMERIC and f.type not in ("integer", "number"):
                out.append(f"{at}: {f.aggregation} needs numbers")
            if f.trend != "none" and f.aggregation == "none":
                out.append(f"{at}: a trend needs an aggregation")
            if f.aggregation == "duration_sum_by_state" and not s.dimensions:
                out.append(f"{at}: duration_sum_by_state needs a dimension")
            if f.low is not None and f.high is not None and f.low > f.high:
                out.append(f"{at}: empty range")
            if f.accepts and f.unit is None:
                out.append(f"{at}: accepts units, but has none")
            if f.privacy == "restricted" and f.visibility != "never":
                out.append(f"{at}: restricted fields are never visible")
    return out


def _real(x: float | None) -> float | None:
    return None if x is None else float(x)


def dimensions(spark: SparkSession, signals: Iterable[Signal]) -> DataFrame:
    """A row per field: what plans join to. As large as the declarations are, some hundreds of rows."""
    rows = [
        (s.key, f.key, f.type, f.unit, _real(f.low), _real(f.high), f.nullable, f.aggregation, f.trend, f.visibility, f.privacy, f.max_relative_jump, s.storage, s.identity, s.attribution, s.ttl_seconds,
         s.detail_days, s.detail_days if s.aggregate_days is None else s.aggregate_days, list(f.enum), s.dimensions[0] if s.dimensions else None)
        for s in signals for f in s.fields
    ]
    return spark.createDataFrame(
        rows,
        "signal string, field string, type string, unit string, low double, high double, nullable boolean, aggregation string, trend string, visibility string, privacy string, max_relative_jump double,"
        "storage string, identity string, attribution string, ttl_seconds int, detail_days int, aggregate_days int, enum array<string>, state_field string",
    )


def visible(signal: Signal, on_demand: bool = True) -> list[str]:
    return [f.key for f in signal.fields if f.visibility == "always" or (on_demand and f.visibility == "on_demand")]


# What a storage mode writes.
OBJECTS = {
    "current_only": ("current",),
    "current_short_timeline": ("current", "observations"),
    "current_timeline_aggregate": ("current", "observations", "daily"),
    "source_mirror": ("mirror", "sync_state"),
}


def mapping(signals: Iterable[Signal]) -> list[tuple[str, str, str, int, int]]:
    """For each signal: its storage mode, what that writes, and days of details and aggregates."""
    return [(s.key, s.storage, ", ".join(OBJECTS[s.storage]), s.detail_days, s.detail_days if s.aggregate_days is None else s.aggregate_days) for s in signals]
