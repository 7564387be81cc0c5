"""Retention, exports, paging and generations of aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERMANENT = -1
PAGE, MOST_PAGE = 50, 500


def cutoffs(signals: DataFrame, now: Column) -> DataFrame:
    """signals (signal, detail_days, aggregate_days) with the first day that stays; null: everything does."""
    cut = lambda c: F.when(F.col(c) != PERMANENT, F.date_sub(F.to_date(now), F.col(c)))
    return signals.withColumns({"detail_before": cut("detail_days"), "aggregate_before": cut("aggregate_days")})


def expired(rows: DataFrame, plan: DataFrame, day: str, before: str) -> DataFrame:
    """Rows that a retention run deletes. The plan has a row per signal."""
    return rows.join(plan.select("signal", before), "signal").where(F.col(before).isNotNull() & (F.col(day) < F.col(before)))


def page_size(size: int | None) -> int:
    return min(MOST_PAGE, max(1, size)) if size else PAGE


def page(rows: DataFrame, order: Sequence, size: int | None = None, after: Column | None = None) -> DataFrame:
    """A page behind a key (a filter on the order's columns), not behind an offset: its cost doesn't grow with its number."""
    return (rows if after is None else rows.where(after)).orderBy(*order).limit(page_size(size))


def page_with_more(rows: DataFrame, order: Sequence, size: int | None = None, after: Column | None = None) -> DataFrame:
    """A page, and in `more` whether another row follows: one row more is read, and no other."""
    n = page_size(size)
    got = (rows if after is None else rows.where(after)).orderBy(*order).limit(n + 1)
    place = F.row_number().over(Window.orderBy(*order))
    got = got.withColumns({"place": place, "more": F.count("*").over(Window.partitionBy()) > n})  # n + 1 rows at most
    return got.where(F.col("place") <= n)


def drained(tables: dict[str, DataFrame], order: Sequence, cap: int | None = None) -> tuple[dict[str, DataFrame], DataFrame | None]:
    """Every collection to its end, or its first `cap` rows; and with a cap, a row (collection, truncated) for each."""
    if cap is None:
        return dict(tables), None
    kept = {name: df.orderBy(*order).limit(cap) for name, df in tables.items()}
    marks = [df.limit(cap + 1).agg((F.count("*") > cap).alias("truncated")).select(F.lit(name).alias("collection"), "truncated") for name, df in sorted(tables.items())]
    return kept, reduce(DataFrame.unionByName, marks)


def lookup(dims: DataFrame) -> DataFrame:
    """Per signal: whether it keeps a history, days of details and aggregates, and whether either is kept for ever."""
    rows = dims.select("signal", "storage", "detail_days", "aggregate_days").distinct()
    history = ~F.col("storage").isin("current_only", "source_mirror")
    return rows.withColumns({"stores_history": history, "details_forever": history & (F.col("detail_days") == PERMANENT), "aggregates_forever": history & (F.col("aggregate_days") == PERMANENT)})


def coverage_gaps(days: DataFrame, keys: Sequence[str], start: Column, end: Column, day: str = "local_date") -> DataFrame:
    """Days of start..end without a row, one row each."""
    held = days.where(F.col(day).between(start, end)).groupBy(*keys).agg(F.collect_set(day).alias("held"))
    return held.select(*keys, F.explode(F.array_except(F.sequence(start, end, F.expr("INTERVAL 1 DAY")), "held")).alias("missing_date"))


def activatable(generations: DataFrame) -> DataFrame:
    """Generations (start, end, accounted, incomplete, active_start, active_end, status) that may become active."""
    required = F.sequence(F.col("start"), F.col("end"), F.expr("INTERVAL 1 DAY"))
    whole = (F.size(F.array_except(required, "accounted")) == 0) & (F.size("incomplete") == 0)
    wide = F.col("active_start").isNull() | ((F.col("start") <= F.col("active_start")) & (F.col("end") >= F.col("active_end")))
    return generations.withColumn("may_activate", (F.col("status") == "complete") & whole & wide)


def export_subject(tables: dict[str, DataFrame], subject) -> dict[str, DataFrame]:
    """Each collection's rows of a subject."""
    return {name: df.where(F.col("subject") == subject) for name, df in tables.items()}


def purge_subject(tables: dict[str, DataFrame], subject) -> dict[str, DataFrame]:
    """Each collection without a subject's rows."""
    return {name: df.where(~F.col("subject").eqNullSafe(F.lit(subject))) for name, df in tables.items()}
