"""Local days: of instants, episodes and split durations, with days of 23 and 25 hours where clocks change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def local_day(at: Column, zone: Column) -> Column:
    """The date at `at` (UTC) in a zone; a null zone is UTC."""
    return F.to_date(F.from_utc_timestamp(at.cast("timestamp"), F.coalesce(zone, F.lit("UTC"))))


def episode_day(start: Column, end: Column, zone: Column) -> Column:
    """An episode belongs to the local day of its end; null if it ends before it starts."""
    return F.when(end >= start, local_day(end, zone))


def split_at_midnight(rows: DataFrame, start: str, end: str, zone: str) -> DataFrame:
    """A row per local day that start..end touches, with its minutes, unrounded; none for an empty or reversed span."""
    rows = rows.where(F.col(end) > F.col(start))
    span = F.sequence(local_day(F.col(start), F.col(zone)), local_day(F.col(end), F.col(zone)), F.expr("INTERVAL 1 DAY"))
    rows = rows.withColumn("local_day", F.explode(span))
    midnight = lambda day: F.to_utc_timestamp(day.cast("timestamp"), F.coalesce(F.col(zone), F.lit("UTC"))).cast("timestamp_ntz")
    a, b = F.greatest(F.col(start), midnight(F.col("local_day"))), F.least(F.col(end), midnight(F.date_add("local_day", 1)))
    return rows.where(b > a).withColumn("minutes", F.timestamp_diff("MICROSECOND", a, b) / 60_000_000)


def effective_day(strategy: Column, at: Column, start: Column, end: Column, source_date: Column, zone: Column) -> tuple[Column, Column]:
    """(day, problem) by attribution strategy; what lacks its input falls back to the instant's day and says so.

    A reversed episode has no day.
    """
    instant, given = local_day(at, zone), lenient_day(source_date, whole=True)
    span = strategy.isin("episode_end", "split_at_midnight")
    lacking = start.isNull() | end.isNull()
    day = F.when((strategy == "source_local_date") & given.isNotNull(), given).when(span & ~lacking, episode_day(start, end, zone)).otherwise(instant)
    problem = (
        F.when((strategy == "source_local_date") & source_date.isNull(), "no_local_date").when((strategy == "source_local_date") & given.isNull(), "bad_local_date")
        .when(span & lacking, "no_span").when(span & (end < start), "reversed_span")
    )
    return day, problem


def lenient_day(text: Column, whole: bool = False) -> Column:
    """The date in the first ten characters (or in all, with whole) of ISO text; null for anything else."""
    t = text if whole else F.left(text, F.lit(10))
    return F.when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_timestamp(t, F.lit("yyyy-MM-dd")).cast("date"))


def as_of(at: Column, zone: Column) -> Column:
    """A time as a reader is shown it: in their zone, else in UTC and saying so."""
    shown = lambda z: F.date_format(F.from_utc_timestamp(at.cast("timestamp"), z), "yyyy-MM-dd HH:mm")
    return F.when(zone.isNotNull(), shown(zone)).otherwise(F.concat(shown(F.lit("UTC")), F.lit(" UTC")))
