"""Daily aggregates: each fold over (subject, signal, local day) as a grouped aggregation or an ordered window.

Input is facts with observed values; the order of a day is (occurred_at, observation_id). Everything is a partial
aggregation where the fold is associative; ordered folds share one sort of the day's window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = ("subject", "signal", "local_date")
ORDER = ("occurred_at", "observation_id")


def numeric_dist(facts: DataFrame, value: str = "value", keys: Sequence[str] = DAY) -> DataFrame:
    """min, max, sum and count of the numeric values; nulls are no values."""
    v = F.col(value)
    return facts.where(v.isNotNull()).groupBy(*keys).agg(F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.sum(v).alias("sum_value"), F.count(v).alias("n"))


def cumulative_latest(facts: DataFrame, value: str = "value", keys: Sequence[str] = DAY) -> DataFrame:
    """A counter's total: the value at the latest time, the largest of ties."""
    return facts.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max(F.struct("occurred_at", value)).alias("x")).select(*keys, F.col(f"x.{value}").alias("total"))


def cumulative_epochs(facts: DataFrame, epoch: str, value: str = "value", keys: Sequence[str] = DAY) -> DataFrame:
    """A counter that restarts when its epoch changes: the value at the latest time and the number of restarts.

    A null epoch never restarts it. In time order the newer value replaces the older one in or across epochs.
    """
    w = Window.partitionBy(*keys).orderBy(*ORDER)
    before = F.last(epoch, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    restart = (F.col(epoch).isNotNull() & before.isNotNull() & (F.col(epoch) != before)).cast("long")
    rows = facts.where(F.col(value).isNotNull()).withColumn("restart", restart)
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*ORDER)).alias("total"), F.sum("restart").alias("restarts"))


def daily_sum(facts: DataFrame, value: str = "value", keys: Sequence[str] = DAY) -> DataFrame:
    return facts.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.sum(value).alias("total"), F.count(value).alias("n"))


def occurrences(facts: DataFrame, keys: Sequence[str] = DAY, weight: Column | None = None) -> DataFrame:
    """Number of occurrences; each counts its weight, 1 as a rule."""
    return facts.groupBy(*keys).agg(F.sum(weight if weight is not None else F.lit(1)).cast("double").alias("total"))


def main_of_day(facts: DataFrame, value: str = "value", keys: Sequence[str] = DAY) -> DataFrame:
    """The last non-null value in order, and the time of the last observation of the day."""
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*ORDER)))
    return facts.groupBy(*keys).agg(last.alias("main_value"), F.max("occurred_at").alias("at"))


def state_dwell(facts: DataFrame, state: str, keys: Sequence[str] = DAY) -> DataFrame:
    """Minutes in each state: from an observation to the next of the day, credited to the state that held before it.

    A null state keeps the state before it; what follows a day's last observation isn't credited.
    """
    w = Window.partitionBy(*keys).orderBy(*ORDER)
    held = F.last(state, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = facts.withColumns({"held": held, "until": F.lead("occurred_at").over(w)})
    rows = rows.where("held IS NOT NULL AND until IS NOT NULL")
    micros = F.timestamp_diff("MICROSECOND", F.col("occurred_at"), F.col("until"))
    return rows.groupBy(*keys, F.col("held").alias("state")).agg((F.sum(micros) / 60_000_000).alias("minutes"))


def visited(facts: DataFrame, place: str, keys: Sequence[str] = DAY) -> DataFrame:
    """Sorted distinct places of the day."""
    return facts.where(F.col(place) != "").groupBy(*keys).agg(F.array_sort(F.collect_set(place)).alias("visited"))


def duration_sum_by_state(facts: DataFrame, state: str, minutes: str, keys: Sequence[str] = DAY) -> DataFrame:
    """Minutes added up by state, with the day's total beside each."""
    by = facts.where(F.col(minutes).isNotNull() & F.col(state).isNotNull()).groupBy(*keys, state).agg(F.sum(minutes).alias("minutes"))
    return by.withColumn("total", F.sum("minutes").over(Window.partitionBy(*keys)))


def event_list(facts: DataFrame, identity: Sequence[str], keys: Sequence[str] = DAY) -> DataFrame:
    """The day's events, the first of each identity only, with their place in the day."""
    first = facts.withColumn("copy", F.row_number().over(Window.partitionBy(*keys, *identity).orderBy(*ORDER))).where("copy = 1").drop("copy")
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*ORDER)))


def tally(facts: DataFrame, track: str, playing: Column, most: int = 30, keys: Sequence[str] = ("subject", "local_date")) -> DataFrame:
    """Minutes credited to the track that was playing before each observation; the `most` largest of a day."""
    w = Window.partitionBy(*keys).orderBy(*ORDER)
    rows = facts.withColumns({"was": F.lag(track).over(w), "on": F.lag(playing).over(w), "since": F.lag("occurred_at").over(w)})
    micros = F.timestamp_diff("MICROSECOND", F.col("since"), F.col("occurred_at"))
    by = rows.where("on AND was IS NOT NULL").groupBy(*keys, F.col("was").alias("track")).agg((F.sum(micros) / 60_000_000).alias("minutes"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("minutes"), "track"))
    return by.withColumn("place", rank).where(F.col("place") <= most)


def listening(facts: DataFrame, track: str, artist: str, playing: Column, most: int = 30, titles: int = 200, keys: Sequence[str] = ("subject", "local_date")) -> DataFrame:
    """A day's music digest: minutes in all, the largest by artist and by track (maps), and the first titles by name.

    The time between two observations goes to what played at the first.
    """
    w = Window.partitionBy(*keys).orderBy(*ORDER)
    rows = facts.withColumns({"_until": F.lead("occurred_at").over(w), "_on": playing})
    micros = F.timestamp_diff("MICROSECOND", F.col("occurred_at"), F.col("_until"))
    spans = rows.where("_on AND _until IS NOT NULL").withColumn("_us", micros)

    def largest(name):
        by = spans.where(F.col(name).isNotNull()).groupBy(*keys, name).agg(F.sum("_us").alias("us"))
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("us"), name))
        top = by.withColumn("place", place).where(F.col("place") <= most)
        return top.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, F.round(F.col("us") / 60_000_000, 2))))).alias(f"by_{name}"))

    total = spans.groupBy(*keys).agg(F.round(F.sum("_us") / 60_000_000, 2).alias("total_minutes"))
    heard = rows.where(F.col("_on") & F.col(track).isNotNull()).select(*keys, track).distinct()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(track))
    first = heard.withColumn("place", place).where(F.col("place") <= titles).groupBy(*keys).agg(F.array_sort(F.collect_list(track)).alias("distinct_titles"))
    out = facts.select(*keys).distinct()
    for part in (total, largest(artist), largest(track), first):
        out = out.join(part, list(keys), "left")
    return out


def listed_events(facts: DataFrame, items: str, keys: Sequence[str] = DAY) -> DataFrame:
    """The day's events out of lists (array<struct<id, title, start_time>>), the first of each identity, in order of arrival.

    An event without an id is the same as another of its title and time; one without any of these is none.
    """
    rows = facts.select(*keys, *ORDER, F.posexplode(items).alias("at", "e"))
    text = lambda c: F.coalesce(F.col(f"e.{c}").cast("string"), F.lit(""))
    key = F.when(text("id") != "", text("id")).otherwise(F.concat_ws("|", text("title"), text("start_time")))
    rows = rows.withColumn("event_key", key).where("event_key <> '' AND event_key <> '|'")
    first = rows.groupBy(*keys, "event_key").agg(F.min_by("e", F.struct(*ORDER, "at")).alias("e"), F.min(F.struct(*ORDER, "at")).alias("first"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("first"))).select(*keys, "event_key", "e.*", "place")


def subjective(facts: DataFrame, value: str = "value", keys: Sequence[str] = DAY) -> DataFrame:
    """The day's entries in order: one array of (at, value)."""
    rows = facts.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("occurred_at", "observation_id", value))).alias("x"))
    return rows.select(*keys, F.transform("x", lambda e: F.struct(e["occurred_at"].alias("at"), e[value].alias("value"))).alias("entries"))


def representative(strategy: Column, total: Column, total_sum: Column, n: Column, value: Column) -> Column:
    """A day's one number: mean of a distribution, total of a counter or sum, else the value."""
    return F.when(strategy == "numeric_dist", F.when(n > 0, total_sum / n)).when(strategy.isin("daily_total", "daily_sum", "occurrence_count"), total).otherwise(value)


def rebuild(facts: DataFrame, retractions: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """The facts that a rebuild folds: not retracted, observed, and of the affected days if given."""
    fact = ["subject", "signal", "source", "source_event_id"]
    rows = facts.join(retractions.select(*fact).distinct(), fact, "left_anti").where("availability = 'observed'")
    return rows if days is None else rows.join(days.distinct(), ["subject", "signal", "local_date"], "left_semi")
