"""Generations of daily aggregates: whole rebuilds side by side, of which readers see the active one.

A generation is a row (subject, signal, kind, generation_id, aggregation_version, start, end, accounted array<date>,
incomplete array<date>, reasons array<string>, status, created_at). Day sets are as long as the days that a generation
covers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCOPE = ("subject", "signal", "kind")
IDENTITY = (*SCOPE, "generation_id")
_FIXED = ("aggregation_version", "start", "end")
# The moves between states.
MOVES = {
    "building": ("building", "complete", "failed", "incomplete"),
    "complete": ("complete", "active", "failed"),
    "active": ("active", "complete"),
    "incomplete": ("incomplete", "failed"),
    "failed": ("failed",),
}


def days(start: Column, end: Column) -> Column:
    return F.sequence(start, end, F.expr("INTERVAL 1 DAY"))


def legal(now: Column, to: Column) -> Column:
    """Whether the states have this move; an unknown state has none."""
    out = F.lit(False)
    for state, targets in MOVES.items():
        out = F.when(now == state, to.isin(*targets)).otherwise(out)
    return out


def offered(known: DataFrame, new: DataFrame) -> DataFrame:
    """new with what becomes of it: inserted, known (the same again) or conflict (the same id for another range or version)."""
    held = known.select(*IDENTITY, F.struct(*_FIXED).alias("held"))
    decision = F.when(F.col("held").isNull(), "inserted").when(F.col("held") == F.struct(*_FIXED), "known").otherwise("conflict")
    return new.join(held, list(IDENTITY), "left").withColumn("decision", decision).drop("held")


def moved(generations: DataFrame, changes: DataFrame) -> DataFrame:
    """Generations after changes (identity, to); `refused` marks illegal ones, which change nothing."""
    rows = generations.join(changes.select(*IDENTITY, "to"), list(IDENTITY), "left")
    ok = legal(F.col("status"), F.col("to"))
    return rows.withColumns({"refused": F.col("to").isNotNull() & ~ok, "status": F.when(F.col("to").isNotNull() & ok, F.col("to")).otherwise(F.col("status"))}).drop("to")


def audit(generations: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Generations whose range overlaps start..end, in order of creation."""
    rows = generations if start is None else generations.where(F.col("end") >= start)
    return (rows if end is None else rows.where(F.col("start") <= end)).orderBy(F.col("created_at").asc_nulls_first(), "generation_id")


def active(generations: DataFrame) -> DataFrame:
    return generations.where("status = 'active'")


def candidates(generations: DataFrame, rows: DataFrame) -> DataFrame:
    """Complete generations with may_activate: all days accounted, none incomplete, a complete row for every day and no
    other, and a range not narrower than the active generation's of the same scope.

    rows: aggregates (identity, aggregation_version, local_date, completeness).
    """
    held = rows.groupBy(*IDENTITY).agg(
        F.count_distinct("local_date").alias("held_days"), F.min("local_date").alias("first_day"), F.max("local_date").alias("last_day"),
        F.bool_and(F.col("completeness") == "complete").alias("all_complete"), F.min("aggregation_version").alias("v1"), F.max("aggregation_version").alias("v2"),
    )
    now = active(generations).select(*SCOPE, F.col("start").alias("active_start"), F.col("end").alias("active_end"))
    got = generations.where("status = 'complete'").join(held, list(IDENTITY), "left").join(now, list(SCOPE), "left")
    required = days(F.col("start"), F.col("end"))
    accounted = (F.size(F.array_except(required, "accounted")) == 0) & (F.size(F.array_except("accounted", required)) == 0)
    covered = (F.col("held_days") == F.size(required)) & (F.col("first_day") == F.col("start")) & (F.col("last_day") == F.col("end")) & F.col("all_complete")
    version = (F.col("v1") == F.col("aggregation_version")) & (F.col("v2") == F.col("aggregation_version"))
    wide = F.col("active_start").isNull() | ((F.col("start") <= F.col("active_start")) & (F.col("end") >= F.col("active_end")))
    may = F.coalesce(accounted & (F.size("incomplete") == 0) & covered & version & wide, F.lit(False))
    return got.withColumn("may_activate", may).select(*generations.columns, "may_activate")


def activated(generations: DataFrame, chosen: DataFrame) -> DataFrame:
    """Generations after a cut-over: the chosen (identity, one a scope) is active, the one before it complete again."""
    scope = chosen.select(*SCOPE, F.col("generation_id").alias("chosen_id"))
    rows = generations.join(scope, list(SCOPE), "left")
    status = F.when(F.col("generation_id") == F.col("chosen_id"), "active").when(F.col("chosen_id").isNotNull() & (F.col("status") == "active"), "complete").otherwise(F.col("status"))
    return rows.withColumn("status", status).select(*generations.columns)


def marked_incomplete(generations: DataFrame, marks: DataFrame) -> DataFrame:
    """Active generations with days (subject, signal, kind, local_date, reason) added to their incomplete ones; their range grows to hold them."""
    new = marks.groupBy(*SCOPE).agg(F.collect_set("local_date").alias("new_days"), F.collect_set("reason").alias("new_reasons"))
    rows = generations.join(new, list(SCOPE), "left")
    hit = (F.col("status") == "active") & F.col("new_days").isNotNull()
    return rows.withColumns({
        "start": F.when(hit, F.least("start", F.array_min("new_days"))).otherwise(F.col("start")), "end": F.when(hit, F.greatest("end", F.array_max("new_days"))).otherwise(F.col("end")),
        "incomplete": F.when(hit, F.array_sort(F.array_union("incomplete", "new_days"))).otherwise(F.col("incomplete")),
        "reasons": F.when(hit, F.array_sort(F.array_union("reasons", "new_reasons"))).otherwise(F.col("reasons")),
    }).select(*generations.columns)


def accounted(generations: DataFrame, ranges: DataFrame) -> DataFrame:
    """Active generations with a range (subject, signal, kind, from_day, to_day) more of accounted days; a range that ends before it begins is refused."""
    new = ranges.where("to_day >= from_day").select(*SCOPE, "from_day", "to_day")
    rows = generations.join(new, list(SCOPE), "left")
    hit = (F.col("status") == "active") & F.col("from_day").isNotNull()
    return rows.withColumns({
        "accounted": F.when(hit, F.array_sort(F.array_union("accounted", days(F.col("from_day"), F.col("to_day"))))).otherwise(F.col("accounted")),
        "start": F.when(hit, F.least("start", "from_day")).otherwise(F.col("start")), "end": F.when(hit, F.greatest("end", "to_day")).otherwise(F.col("end")),
    }).select(*generations.columns)


def daily(rows: DataFrame, generations: DataFrame, start: Column, end: Column, keep: Sequence[str] = ("value",)) -> DataFrame:
    """Days of the active generation in start..end, never filled with zeros.

    rows: aggregates (identity, local_date, completeness, observations, recomputed and the columns `keep`). A day that the
    generation lists as incomplete is shown without a row too (has_data false); a recomputed day without observations isn't.
    """
    now = active(generations)
    held = rows.where(F.col("local_date").between(start, end)).join(now.select(*IDENTITY), list(IDENTITY))
    gaps = now.select(*IDENTITY, F.explode("incomplete").alias("local_date"), "reasons").where(F.col("local_date").between(start, end))
    both = held.withColumn("held", F.lit(True)).join(gaps.withColumn("gap", F.lit(True)), [*IDENTITY, "local_date"], "full")
    empty = F.coalesce(F.col("recomputed") & (F.col("observations") == 0), F.lit(False)) & F.col("gap").isNull()
    completeness = F.when(F.col("gap").isNotNull() | F.col("held").isNull(), "incomplete").otherwise(F.col("completeness"))
    return both.where(~empty).select(*IDENTITY, "local_date", *keep, completeness.alias("completeness"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"), F.coalesce("held", F.lit(False)).alias("has_data"))


def rebuilt(rows: DataFrame, scopes: DataFrame, kept_from: Column) -> DataFrame:
    """Scopes (identity, aggregation_version, start, end) as generations built from day rows: days before kept_from, whose details may be gone, are incomplete."""
    held = rows.join(scopes.select(*IDENTITY, "start", "end"), list(IDENTITY)).where("local_date BETWEEN start AND end").groupBy(*IDENTITY).agg(F.collect_set("local_date").alias("held_days"))
    required = days(F.col("start"), F.col("end"))
    gone = F.filter(required, lambda d: (d < kept_from) & ~F.array_contains(F.coalesce("held_days", F.array().cast("array<date>")), d))
    got = scopes.join(held, list(IDENTITY), "left").withColumn("incomplete", gone)
    return got.withColumns({
        "accounted": F.array_except(required, "incomplete"), "status": F.when(F.size("incomplete") == 0, "complete").otherwise("incomplete"),
        "reasons": F.when(F.size("incomplete") > 0, F.array(F.lit("detail_expired"))).otherwise(F.array().cast("array<string>")),
    }).drop("held_days")
