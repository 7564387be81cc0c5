"""Trends over daily series: fluctuating, drifting, cyclical, and the most notable changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAYS_PER_MONTH = 30.4375


def nearest_rank(values: Column, p: float) -> Column:
    """The value at place round(p * (n - 1)) of a sorted array, halves to even."""
    return F.element_at(values, (F.bround(F.lit(p) * (F.size(values) - 1)) + 1).cast("int"))


def median(values: Column) -> Column:
    """The median of a sorted array, interpolated; null if empty."""
    n = F.size(values)
    mid = F.floor(n / 2).cast("int")
    return F.when(n == 0, F.lit(None)).when(n % 2 == 1, F.get(values, mid)).otherwise((F.get(values, mid - 1) + F.get(values, mid)) / 2)


def fluctuating(series: DataFrame, keys: Sequence[str], day: str = "local_date", value: str = "value") -> DataFrame:
    """Baseline of all days but the last (of the only day if there is one) and the last day's distance from it.

    A key's series is one row a day, so that its array stays as small as the days it covers.
    """
    rows = series.where(F.col(value).isNotNull()).groupBy(*keys).agg(_points(day, value).alias("pts"))
    rows = rows.withColumn("base", _baseline(F.col("pts")))
    return rows.select(*keys, F.size("pts").cast("long").alias("n_days"), *(c.alias(n) for n, c in _fluctuation(F.col("pts"), F.col("base")).items()))


def _points(day: str, value: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(F.col(day).alias("d"), F.col(value).alias("v"))))


def _baseline(pts: Column) -> Column:
    """The sorted values of all days but the last; of the only day if there is one."""
    values = F.transform(pts, lambda x: x["v"])
    return F.array_sort(F.when(F.size(pts) > 1, F.slice(values, 1, F.greatest(F.size(pts) - 1, F.lit(1)))).otherwise(values))


def _fluctuation(pts: Column, base: Column) -> dict[str, Column]:
    current = F.try_element_at(pts, F.lit(-1))["v"]
    delta = current - median(base)
    return {
        "current": current, "baseline_median": median(base), "p25": nearest_rank(base, 0.25), "p75": nearest_rank(base, 0.75), "baseline_n": F.size(base).cast("long"), "delta": delta,
        "direction": F.when(delta > 0, "up").when(delta < 0, "down").otherwise("flat"),
    }


def drifting(series: DataFrame, keys: Sequence[str], day: str = "local_date", value: str = "value") -> DataFrame:
    """First and last point, change a month over all and over the last third (two points at least, if there are four)."""
    rows = series.where(F.col(value).isNotNull()).groupBy(*keys).agg(_points(day, value).alias("pts")).where(F.size("pts") >= 2)
    return rows.select(*keys, F.size("pts").cast("long").alias("n_points"), *(c.alias(n) for n, c in _drift(F.col("pts")).items()))


def _drift(pts: Column) -> dict[str, Column]:
    def rate(a, b):
        days = F.date_diff(b["d"], a["d"])
        return F.when(days > 0, (b["v"] - a["v"]) / days * DAYS_PER_MONTH)

    n = F.size(pts)
    first, last = F.get(pts, F.lit(0)), F.try_element_at(pts, F.lit(-1))
    recent = F.get(pts, n - F.greatest(F.lit(2), F.floor(n / 3).cast("int")))
    per_month, late = rate(first, last), F.when(n >= 4, rate(recent, last))
    steeper = (per_month * late > 0) & (F.abs(late) > F.abs(per_month))
    return {
        "first_value": first["v"], "last_value": last["v"], "total_delta": last["v"] - first["v"], "per_month": per_month, "recent_per_month": late, "accelerating": F.coalesce(steeper, F.lit(False)),
    }


def cyclical(dates: DataFrame, keys: Sequence[str], today: Column, day: str = "local_date") -> DataFrame:
    """Typical gap between distinct dates (median, halves to even), days since the last, and days overdue."""
    days = dates.select(*keys, day).distinct()
    gap = F.date_diff(F.col(day), F.lag(day).over(Window.partitionBy(*keys).orderBy(day)))
    rows = days.withColumn("gap", gap).groupBy(*keys).agg(F.bround(F.median("gap")).cast("long").alias("typical"), F.count("gap").alias("n_gaps"), F.max(day).alias("last_date"))
    since = F.date_diff(today, F.col("last_date"))
    return rows.withColumn("days_since", since.cast("long")).withColumn("overdue", F.greatest(F.lit(0), since - F.col("typical")).cast("long"))


def _cycle(days: Column, today: Column) -> dict[str, Column]:
    """The same from a sorted array of distinct days."""
    gaps = F.array_sort(F.zip_with(F.slice(days, 2, F.size(days)), F.slice(days, 1, F.greatest(F.size(days) - 1, F.lit(0))), lambda b, a: F.date_diff(b, a)))
    typical = F.bround(median(gaps)).cast("long")
    since = F.date_diff(today, F.try_element_at(days, F.lit(-1))).cast("long")
    return {"typical": typical, "days_since": since, "overdue": F.greatest(F.lit(0), since - typical).cast("long")}


def notable(trend: DataFrame, subject: Sequence[str], most: int = 8) -> DataFrame:
    """The `most` largest relative changes of a subject among series with a baseline of two days at least."""
    rows = trend.where("baseline_n >= 2").withColumn("magnitude", F.abs("delta") / F.greatest(F.abs("baseline_median"), F.lit(1.0)))
    place = F.row_number().over(Window.partitionBy(*subject).orderBy(F.desc("magnitude"), "signal"))
    return rows.where("magnitude > 0").withColumn("place", place).where(F.col("place") <= most)


def streaks(days: DataFrame, keys: Sequence[str], passing: Column, day: str = "local_date", longest: int | None = None) -> DataFrame:
    """Length of the run of passing days that ends with each passing day, `longest` at most if given."""
    rows = days.where(passing).select(*keys, day).distinct()
    w = Window.partitionBy(*keys).orderBy(day)
    rows = rows.withColumn("island", F.date_sub(F.col(day), F.row_number().over(w)))
    length = F.row_number().over(Window.partitionBy(*keys, "island").orderBy(day))
    return rows.withColumn("length", (length if longest is None else F.least(length, F.lit(longest))).cast("long")).drop("island")


def streak_through(days: DataFrame, keys: Sequence[str], passing: Column, through: Column, day: str = "local_date", longest: int = 90) -> DataFrame:
    """Length of the run of passing days that ends with `through`; 0 where that day is missing or fails."""
    runs = streaks(days.where(F.col(day) <= through), keys, passing, day, longest).where(F.col(day) == through)
    return days.select(*keys).distinct().join(runs.select(*keys, "length"), list(keys), "left").withColumn("length", F.coalesce("length", F.lit(0)))


def rounded(value: Column, digits: int = 3) -> Column:
    """Halves to even, as the readers' own rounding has it."""
    return F.bround(value, digits)


def with_coverage(rows: DataFrame, dims: DataFrame, start: Column, end: Column) -> DataFrame:
    """The trend of each (subject, signal, field) over start..end by its declared model, with coverage and unit.

    rows: a daily view (subject, signal, field, local_date, value, completeness); dims: declarations (signal, field, unit,
    trend, visibility). Incomplete days are counted and not read; missing days are counted and never zero. `reason` says why
    there is no reading: unknown, hidden, empty, or no model.
    """
    keys = ["subject", "signal", "field"]
    complete = F.col("completeness") == "complete"
    span = F.date_diff(end, start) + 1
    # one aggregation: a series is as long as its days, and models are expressions over it
    covered = rows.where(F.col("local_date").between(start, end)).groupBy(*keys).agg(
        F.count_if(complete).alias("days_with_data"), F.count_if(~complete).alias("days_incomplete"), F.array_sort(F.collect_list(F.when(complete, F.struct(F.col("local_date").alias("d"), F.col("value").alias("v"))))).alias("all"),
    )
    covered = covered.withColumn("days_missing", F.greatest(F.lit(0), span - F.col("days_with_data") - F.col("days_incomplete")).cast("long"))
    known = covered.join(F.broadcast(dims.select("signal", "field", "unit", "trend", "visibility")), ["signal", "field"], "left")
    reason = (
        F.when(F.col("trend").isNull(), "not_declared").when(F.col("visibility") == "never", "not_visible").when(F.col("days_with_data") == 0, "no_data").when(F.col("trend") == "none", "no_model")
    )
    known = known.withColumns({"reason": reason, "model": F.when(reason.isNull() | (reason == "no_data"), F.col("trend")).otherwise("none"), "pts": F.filter("all", lambda p: p["v"].isNotNull())})
    known = known.withColumn("base", _baseline(F.col("pts")))
    read = lambda model, least: F.col("reason").isNull() & (F.col("model") == model) & (F.size("pts") >= least)
    flat, drift = _fluctuation(F.col("pts"), F.col("base")), _drift(F.col("pts"))
    cycle = _cycle(F.array_distinct(F.transform("all", lambda p: p["d"])), end)
    flat["delta"], drift["total_delta"], drift["per_month"] = rounded(flat["delta"]), rounded(drift["total_delta"]), rounded(drift["per_month"])
    del drift["recent_per_month"]
    shown = [F.when(read("fluctuating", 1), c).alias(n) for n, c in flat.items()] + [F.when(read("drifting", 2), c).alias(n) for n, c in drift.items()]
    shown += [F.when(F.col("reason").isNull() & (F.col("model") == "cyclical"), c).alias(n) for n, c in cycle.items()]
    return known.select(*keys, "model", "reason", "unit", "days_with_data", "days_missing", "days_incomplete", *shown)


def latched(days: DataFrame, keys: Sequence[str], abnormal: Column, least: int, day: str = "local_date") -> DataFrame:
    """Each observed day in order with the streak that ends there and what a trigger with a latch does.

    streak_reached (fires) when a run of abnormal days gets long enough, already_firing till a day without a streak, which
    is recovered; else streak_too_short. A missing calendar day ends a run, but doesn't open the latch.
    """
    runs = streaks(days, keys, abnormal, day).select(*keys, day, "length")
    rows = days.select(*keys, day).distinct().join(runs, [*keys, day], "left").withColumn("length", F.coalesce("length", F.lit(0)))
    earlier = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    closed, opened = F.max(F.when(F.col("length") >= least, F.col(day))).over(earlier), F.max(F.when(F.col("length") == 0, F.col(day))).over(earlier)
    held = F.coalesce(closed.isNotNull() & (opened.isNull() | (closed > opened)), F.lit(False))
    reason = F.when(held & (F.col("length") == 0), "recovered").when(held, "already_firing").when(F.col("length") < least, "streak_too_short").otherwise("streak_reached")
    return rows.withColumn("reason", reason).withColumn("fires", F.col("reason") == "streak_reached")


def notable_readings(trend: DataFrame, reports: DataFrame, ttl: DataFrame, now: Column, most: int = 8, subject: Sequence[str] = ("subject",)) -> DataFrame:
    """The largest relative changes of a subject, saying whether the last value is current or only the last known.

    trend: fluctuating() by (subject, signal, field); reports: last report (subject, signal, field, reported_at); ttl: (signal,
    ttl_seconds). Without a report in time, `current` is null and `last_known` stands with `as_of`.
    """
    rows = trend.where("baseline_n >= 2").withColumn("magnitude", rounded(F.abs(rounded(F.col("delta"))) / F.greatest(F.abs("baseline_median"), F.lit(1.0)), 6))
    place = F.row_number().over(Window.partitionBy(*subject).orderBy(F.desc("magnitude"), "signal", "field"))
    top = rows.withColumn("place", place).where(F.col("place") <= most)
    seen = top.join(reports, [*subject, "signal", "field"], "left").join(ttl, "signal", "left")
    fresh = F.coalesce(F.timestamp_diff("SECOND", F.col("reported_at"), now) <= F.col("ttl_seconds"), F.lit(False))
    return seen.select(
        *subject, "signal", "field", "place", "magnitude", "direction", F.when(fresh, F.col("current")).alias("current"), F.when(~fresh, F.col("current")).alias("last_known"), F.when(~fresh, F.col("reported_at")).alias("as_of")
    )
