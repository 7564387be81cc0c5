"""Mirrors of outside collections: upserts, tombstones, full snapshots, and recurring events."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import store


def upsert(mirror: DataFrame, batch: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The latest version of every item of mirror and batch."""
    cols = [c for c in mirror.columns if c not in keys]
    both = mirror.unionByName(batch)
    return both.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col(version)).alias("x")).select(*keys, "x.*")


def without_tombstones(mirror: DataFrame, tombstones: DataFrame, keys: Sequence[str]) -> DataFrame:
    return mirror.join(tombstones.select(*keys).distinct(), list(keys), "left_anti")


def full_snapshot(mirror: DataFrame, seen: DataFrame, keys: Sequence[str], covered: Column) -> DataFrame:
    """The mirror after a complete sync: what the sync covers and didn't see goes; the rest stays."""
    marks = seen.select(*keys).distinct().withColumn("seen", F.lit(True))
    return mirror.join(marks, list(keys), "left").where(F.coalesce(F.col("seen"), F.lit(False)) | ~F.coalesce(covered, F.lit(False))).drop("seen")


def _monday(d: Column) -> Column:
    return F.date_sub(d, F.weekday(d))


def instances_until(day: Column) -> Column:
    """How many instances a series (start, freq, interval, byweekday) has from its start to `day`, without making them.

    Days and weeks are counted by division, and so are months if all have the day; the months of the 29th to 31st are
    looked at one by one.
    """
    start, every, freq = F.col("start"), F.greatest(F.col("interval"), F.lit(1)), F.col("freq")
    by_day = F.floor(F.date_diff(day, start) / every) + 1
    weekdays = F.coalesce(F.array_distinct("byweekday"), F.array(F.weekday(start)))
    weeks = F.floor(F.date_diff(day, _monday(start)) / 7)
    upto = lambda last: F.size(F.filter(weekdays, lambda w: w <= last))
    by_week = F.ceil(weeks / every) * F.size(weekdays) + F.when(weeks % every == 0, upto(F.weekday(day))).otherwise(0) - upto(F.weekday(start) - 1)
    dom = F.dayofmonth(start)
    months = (F.year(day) - F.year(start)) * 12 + F.month(day) - F.month(start) - (dom > F.dayofmonth(day)).cast("int")
    steps = F.when(months >= 0, F.sequence(F.lit(0), months, every)).otherwise(F.array().cast("array<int>"))
    by_month = F.when(dom <= 28, F.floor(months / every) + 1).otherwise(F.size(F.filter(steps, lambda m: F.dayofmonth(F.add_months(start, m)) == dom)))
    n = F.when(freq == "daily", by_day).when(freq == "weekly", by_week).when(freq == "monthly", by_month)
    return F.when(day < start, F.lit(0)).otherwise(F.greatest(n, F.lit(0))).cast("long")


def _in_window(window_start: Column, window_end: Column, most: int) -> tuple[Column, Column]:
    """(number of instances before the window, number in it), by count, until and `most`."""
    last = F.least(window_end, F.coalesce("until", window_end))
    limit = F.coalesce(F.col("count").cast("long"), F.lit(2**62))
    before = F.least(instances_until(F.date_sub(window_start, 1)), limit)
    return before, F.least(F.greatest(F.least(instances_until(last), limit) - before, F.lit(0)), F.lit(most)).cast("long")


def expand(series: DataFrame, window_start: Column, window_end: Column, most: int = 200) -> DataFrame:
    """Dates of recurring items in a window: freq daily, weekly (weekdays 0 = Monday, by ISO week from the start's week) or monthly.

    series: start (date), freq, interval, byweekday array<int> (null: the start's), until, count (nulls: none). A month
    without the day is skipped. count numbers instances from the start on, and those before the window are counted
    without being made; `most` instances of the window are given. With a column start_text (an ISO time with offset)
    occurs_at is each instance's text: the date moves, time of day and offset stay.
    """
    last = F.least(window_end, F.coalesce("until", window_end))
    start, every = F.col("start"), F.greatest(F.col("interval"), F.lit(1))
    first = F.greatest(start, window_start)
    days = F.when(last >= first, F.sequence(first, last, F.expr("INTERVAL 1 DAY")))
    weekdays = F.coalesce(F.col("byweekday"), F.array(F.weekday(start)))

    def fits(d):
        daily = F.date_diff(d, start) % every == 0
        weekly = F.array_contains(weekdays, F.weekday(d)) & ((F.date_diff(_monday(d), _monday(start)) / 7).cast("int") % every == 0)
        months = (F.year(d) - F.year(start)) * 12 + F.month(d) - F.month(start)
        monthly = (F.dayofmonth(d) == F.dayofmonth(start)) & (months % every == 0)
        return F.when(F.col("freq") == "daily", daily).when(F.col("freq") == "weekly", weekly).otherwise(monthly)

    _, n = _in_window(window_start, window_end, most)
    shown = series.select("*", F.explode(F.slice(F.filter(days, fits), F.lit(1), n.cast("int"))).alias("occurs_on"))
    return _timed(shown)


def _timed(rows: DataFrame) -> DataFrame:
    if "start_text" not in rows.columns:
        return rows
    return rows.withColumn("occurs_at", F.concat(F.col("occurs_on").cast("string"), F.expr("substring(start_text, 11)")))


# What a recurrence may be, and keys of rules that aren't expanded.
FREQUENCIES, REFUSED = ("daily", "weekly", "monthly"), ("bysetpos", "exdate", "byyearday", "byweekno")
_RULE = "freq string, interval int, byweekday array<int>, until string, count int, " + ", ".join(f"{k} string" for k in REFUSED)


def parse_recurrence(rows: DataFrame, rule: str) -> DataFrame:
    """rows with freq, interval, byweekday, until and count from a rule's JSON, and `problem` where it is refused: nothing is guessed."""
    got = rows.withColumn("_r", F.from_json(rule, _RULE))
    every = F.coalesce("_r.interval", F.lit(1))
    freq = F.lower("_r.freq")
    problem = F.when(F.col("_r").isNull(), "malformed")
    for key in REFUSED:
        problem = problem.when(F.col(f"_r.{key}").isNotNull(), key)
    problem = problem.when(~F.coalesce(freq.isin(*FREQUENCIES), F.lit(False)), "freq").when(every < 1, "interval")
    until = F.try_to_timestamp(F.left(F.col("_r.until"), F.lit(10)), F.lit("yyyy-MM-dd")).cast("date")
    ok = problem.isNull()
    keep = {"freq": freq, "interval": every, "byweekday": F.when(F.size("_r.byweekday") > 0, F.col("_r.byweekday")), "until": until, "count": F.col("_r.count")}
    return got.withColumns({k: F.when(ok, v) for k, v in keep.items()} | {"problem": problem}).drop("_r")


@dataclass(frozen=True)
class Sync:
    """One round of a source: full rounds need the days that they cover; an error code says that the round failed."""

    subject: object
    source: str
    sync_id: str
    snapshot: str = "incremental"
    covers: tuple[str, str] | None = None
    cursor: str | None = None
    error: str | None = None

    def __post_init__(self):
        if self.snapshot not in ("full", "incremental"):
            raise ValueError(f"unknown snapshot kind {self.snapshot!r}")
        if self.snapshot == "full" and self.error is None and self.covers is None:
            raise ValueError("a full round must say which days it covers")
        if self.covers and self.covers[0] > self.covers[1]:
            raise ValueError("the covered range is empty")


def synced(mirror: DataFrame, items: DataFrame, tombstones: DataFrame, sync: Sync, keys: Sequence[str], starts: str = "start_at") -> DataFrame:
    """The mirror after a round. mirror: keys, columns, subject, source, last_seen_sync_id; items: the same without these three, which the round stamps.

    A failed round changes nothing. Tombstones always delete. A full round also deletes what it covers and didn't see,
    of its own source; items of unknown start are never covered. Of an item that a round gives twice the greatest row,
    column by column, is taken, so that a round that is run again gives the same mirror.
    """
    if sync.error is not None:
        return mirror
    stamp = {"subject": F.lit(sync.subject), "source": F.lit(sync.source), "last_seen_sync_id": F.lit(sync.sync_id)}
    rest = [c for c in items.columns if c not in keys]
    once = items.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("x")).select(*keys, "x.*") if rest else items.distinct()
    fresh = once.withColumns(stamp).select(mirror.columns)
    own = (F.col("subject") == F.lit(sync.subject)) & (F.col("source") == sync.source)
    mine, others = mirror.where(own), mirror.where(~F.coalesce(own, F.lit(False)))
    merged = mine.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh)
    merged = without_tombstones(merged, tombstones, keys)
    if sync.snapshot == "full":
        low, high = (F.lit(d).cast("date") for d in sync.covers)
        covered = F.coalesce(F.to_date(starts).between(low, high), F.lit(False))
        merged = merged.where(~covered | (F.col("last_seen_sync_id") == sync.sync_id))
    return others.unionByName(merged)


def sync_state(state: DataFrame, sync: Sync, now: Column) -> DataFrame:
    """The state table (subject, source, cursor, last_attempt, last_success, error) after a round: a failed one keeps cursor and last success."""
    failed = sync.error is not None
    new = state.sparkSession.range(1).select(F.lit(sync.subject).alias("subject"), F.lit(sync.source).alias("source"), F.lit(sync.cursor).cast("string").alias("_cursor"), F.lit(sync.error).cast("string").alias("_error"))
    rows = state.join(new, ["subject", "source"], "full")
    hit = (F.col("subject") == F.lit(sync.subject)) & (F.col("source") == sync.source)
    kept = F.col("cursor") if failed else F.coalesce("_cursor", "cursor")
    return rows.select(
        "subject", "source", F.when(hit, kept).otherwise(F.col("cursor")).alias("cursor"), F.when(hit, now).otherwise(F.col("last_attempt")).alias("last_attempt"),
        F.when(hit & F.lit(not failed), now).otherwise(F.col("last_success")).alias("last_success"), F.when(hit, F.col("_error")).otherwise(F.col("error")).alias("error"),
    )


def calendar(mirror: DataFrame, start: Column, end: Column, starts: str = "start_at", key: str = "source_event_id") -> DataFrame:
    """Calendar items that start in start..end or at an unknown time, those last."""
    return mirror.where(F.col(starts).isNull() | F.col(starts).between(start, end)).orderBy(F.col(starts).asc_nulls_last(), key)


def reminders(mirror: DataFrame, completed: bool = False, due: str = "due_at", key: str = "source_reminder_id") -> DataFrame:
    """Open reminders (all, with completed) by the time that they are due, those without one last."""
    rows = mirror if completed else mirror.where(~F.coalesce("is_completed", F.lit(False)))
    return rows.orderBy(F.col(due).asc_nulls_last(), key)


def expanded_page(series: DataFrame, order: Sequence[str], window_start: Column, window_end: Column, size: int, after: tuple[int, int] = (0, 0), most: int = 200) -> DataFrame:
    """A page of occurrences behind a cursor of two places: (series in order, occurrence in it), from 0; rows carry base and inner.

    Series (see expand()) may have none as freq, which makes them occur once, whatever the window, and a `problem`, with
    which they are shown as they are: occurs_on is null and expanded false. A page starts inside a series just as well as
    between two.

    Series are dealt into ranges of `order` (columns that tell every two series apart) and only counted there: how many
    there are and how many occurrences they have. The sums over ranges, one row each, say which ranges the page lies in;
    only their series are numbered, each range by itself, and only those that the page shows are expanded.
    """
    problem = F.col("problem") if "problem" in series.columns else F.lit(None).cast("string")
    single = F.col("freq").isNull() | problem.isNotNull()
    _, n = _in_window(window_start, window_end, most)
    counted = series.withColumns({"_n": F.when(single, F.lit(1)).otherwise(n).cast("long"), "_single": single})
    ranges = store.kept(counted.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sums = sorted(ranges.groupBy("_part").agg(F.count("*").alias("series"), F.sum("_n").alias("n")).collect())  # a row a range
    wanted, base, room = [], 0, size + after[1]
    for part, many, found in sums:
        if base + many > after[0] and room > 0:
            wanted.append((part, base))
            # of the first range it isn't known how much lies before the cursor
            room -= found if base >= after[0] else 0
        base += many
    spark = series.sparkSession
    offsets = F.broadcast(spark.createDataFrame(wanted, "_part int, _base long"))  # as many rows as ranges
    rows = ranges.join(offsets, "_part")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    rows = rows.withColumn("base", (F.col("_base") + place - 1).cast("int")).where((F.col("base") >= after[0]) & (F.col("_n") > 0))
    shown = rows.orderBy("base").limit(size + 1)  # each of these has an occurrence, and the first may be used up
    many = expand(shown.where("NOT _single"), window_start, window_end, most).withColumn("expanded", F.lit(True))
    one = shown.where("_single").withColumn("occurs_on", F.when(problem.isNull(), F.col("start")))
    both = many.unionByName(_timed(one).withColumn("expanded", F.lit(False)))
    both = both.withColumn("inner", F.row_number().over(Window.partitionBy("base").orderBy("occurs_on")) - 1)
    behind = (F.col("base") > after[0]) | ((F.col("base") == after[0]) & (F.col("inner") >= after[1]))
    return both.where(behind).drop("_n", "_single", "_part", "_base").orderBy("base", "inner").limit(size)
