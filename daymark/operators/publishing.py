"""Changes of several tables at once: merges of aggregates with versions, retention that keeps coverage true, corrections.

Each is a plan over the tables as they are, and a publication that rewrites only the parts of tables that it touches
and lets readers see all of it at one moment (store.Store).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import Change, Snapshot, Store
from . import corrections, generations, refold, retention
from .current import current
from .daily import DAY

KEY = (*generations.IDENTITY, "aggregation_version", "local_date")


def _no_days() -> Column:
    return F.array().cast("array<date>")


def _no_texts() -> Column:
    return F.array().cast("array<string>")


def _once(batch: DataFrame, order: str) -> DataFrame:
    """The last write of each key of a batch, with the number of its writes."""
    named = batch.withColumn("generation_id", F.coalesce("generation_id", F.concat(F.lit("legacy-v"), F.col("aggregation_version").cast("string"))))
    rest = [c for c in named.columns if c not in KEY]
    got = named.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.col(order)).alias("x"), F.count("*").alias("writes"))
    return got.select(*KEY, "x.*", "writes")


def merged_generations(held: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    """Generations after a batch of aggregates was written.

    The active one's range grows to the batch's days; days in between that it has no account of are incomplete. A
    generation that isn't known begins with its first row: as the active one, if its scope has none and the row is
    complete, and then with all of the batch's days; otherwise with that row's day alone.
    """
    rows = _once(batch, order)
    sums = rows.groupBy(*generations.IDENTITY).agg(
        F.min_by(F.struct("aggregation_version", "local_date", "completeness", "reasons", order), F.struct(order, "local_date")).alias("first"),
        F.array_sort(F.collect_set("local_date")).alias("days"), F.min("aggregation_version").alias("v1"), F.max("aggregation_version").alias("v2"),
    )
    active = generations.active(held).select(*generations.SCOPE).distinct().withColumn("has_active", F.lit(True))
    both = held.withColumn("known", F.lit(True)).join(sums, list(generations.IDENTITY), "full").join(active, list(generations.SCOPE), "left")
    # of several new generations of a scope without an active one, the first written becomes active
    new = F.col("known").isNull()
    fine = F.col("first.completeness") == "complete"
    first = sums.join(active, list(generations.SCOPE), "left_anti").join(held.select(*generations.IDENTITY), list(generations.IDENTITY), "left_anti").where("first.completeness = 'complete'")
    first = first.groupBy(*generations.SCOPE).agg(F.min_by("generation_id", F.struct(F.col(f"first.{order}"), F.col("generation_id"))).alias("chosen"))
    both = both.join(first, list(generations.SCOPE), "left")
    starts = new & F.col("has_active").isNull() & fine & (F.col("generation_id") == F.col("chosen"))
    status = F.when(~new, F.col("status")).when(starts, "active").when(fine, "complete").otherwise("incomplete")
    grows = F.coalesce((status == "active") & F.col("days").isNotNull() & (new | ((F.col("v1") == F.col("aggregation_version")) & (F.col("v2") == F.col("aggregation_version")))), F.lit(False))
    day1 = F.array(F.col("first.local_date"))
    accounted = F.when(grows, F.array_sort(F.array_union(F.coalesce("accounted", _no_days()), "days"))).when(new, day1).otherwise(F.col("accounted"))
    both = both.withColumns({"status": status, "_grows": grows, "accounted": accounted})
    both = both.withColumns({
        "start": F.when(F.col("_grows"), F.least("start", F.array_min("days"))).when(new, F.col("first.local_date")).otherwise(F.col("start")),
        "end": F.when(F.col("_grows"), F.greatest("end", F.array_max("days"))).when(new, F.col("first.local_date")).otherwise(F.col("end")),
    })
    gaps = F.when(F.col("_grows"), F.array_except(generations.days(F.col("start"), F.col("end")), "accounted")).otherwise(_no_days())
    both = both.withColumn("_gaps", gaps)
    bad = F.coalesce("incomplete", F.when(new & ~fine, day1).otherwise(_no_days()))
    reasons = F.coalesce("reasons", F.when(new, F.coalesce("first.reasons", _no_texts())).otherwise(_no_texts()))
    both = both.withColumns({
        "incomplete": F.array_sort(F.array_union(bad, "_gaps")), "reasons": F.array_sort(F.when(F.size("_gaps") > 0, F.array_union(reasons, F.array(F.lit("unaccounted_bootstrap_gap")))).otherwise(reasons)),
        "aggregation_version": F.coalesce("aggregation_version", "first.aggregation_version"),
    })
    return both.select(*(c for c in held.columns))


def merged(held: DataFrame, after: DataFrame, batch: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(aggregates, refused): the rows held and a batch's under their generations `after` it (merged_generations()).

    A row that was there goes one version up with each write, a new one begins at 0; what isn't written stays. Rows of
    another version than their generation's are refused. A day that its generation lists as incomplete is so, whatever
    the row says. held: KEY, completeness, reasons, version and any more columns; batch: the same without version.
    """
    rows = _once(batch, order)
    own = after.select(*generations.IDENTITY, F.col("aggregation_version").alias("_v"), F.col("incomplete").alias("_gaps"), F.col("reasons").alias("_why"))
    bound = rows.join(own, list(generations.IDENTITY))
    refused = bound.where(F.col("_v") != F.col("aggregation_version")).select(*KEY)
    listed = F.array_contains("_gaps", F.col("local_date"))
    why = F.when(listed, F.array_union(F.coalesce("reasons", _no_texts()), "_why")).otherwise(F.coalesce("reasons", _no_texts()))
    good = bound.where(F.col("_v") == F.col("aggregation_version")).withColumns({"completeness": F.when(listed, "incomplete").otherwise(F.col("completeness")), "reasons": F.array_sort(why)})
    before = held.select(*KEY, F.col("version").alias("_was"))
    good = good.join(before, list(KEY), "left").withColumn("version", F.coalesce(F.col("_was") + F.col("writes"), F.col("writes") - 1)).select(held.columns)
    return held.join(good.select(*KEY), list(KEY), "left_anti").unionByName(good), refused


def reconciled(held: DataFrame, gens: DataFrame, cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aggregates, generations) after days before `before` (cut: signal, before; null: all stay) were deleted.

    Active generations give up the days that went; one whose days are all gone is no longer active, and one that has
    lost its incomplete days is complete again and has no more reasons.
    """
    limits = cut.select("signal", F.col("before").alias("_before"))
    stays = F.col("_before").isNull() | (F.col("local_date") >= F.col("_before"))
    left = held.join(limits, "signal", "left").where(stays).select(held.columns)
    rows = gens.join(limits, "signal", "left")
    hit = F.coalesce((F.col("status") == "active") & F.col("_before").isNotNull(), F.lit(False))
    keep = lambda c: F.when(hit, F.filter(c, lambda d: d >= F.col("_before"))).otherwise(F.col(c))
    rows = rows.withColumns({"accounted": keep("accounted"), "incomplete": keep("incomplete")})
    whole = F.array_union("accounted", "incomplete")
    return left, rows.withColumns({
        "status": F.when(hit & (F.size(whole) == 0), "complete").otherwise(F.col("status")), "start": F.when(hit & (F.size(whole) > 0), F.array_min(whole)).otherwise(F.col("start")),
        "reasons": F.when(hit & (F.size("incomplete") == 0), _no_texts()).otherwise(F.col("reasons")),
    }).select(gens.columns)


def backfilled(identities: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("subject", "signal", "source", "digest")) -> DataFrame:
    """Identities with what new rows of the same keys tell about them, and `conflict` where these contradict it.

    One whose fact isn't known takes the new row as it is. Of one whose fact is known only a missing dimension and, if it
    has no content digest either, a missing day are filled in. Columns: fact_key, dimension_key, local_date, content_digest.
    """
    parts = ("fact_key", "dimension_key", "local_date", "content_digest")
    told = new.select(*keys, *(F.col(c).alias(f"_{c}") for c in parts), F.lit(True).alias("_told"))
    rows = identities.join(told, list(keys), "left")
    blank = F.col("fact_key").isNull() & F.col("_told")
    dated = F.col("content_digest").isNull() & F.col("local_date").isNull()
    filled = {
        "fact_key": F.when(blank, F.col("_fact_key")).otherwise(F.col("fact_key")), "content_digest": F.when(blank, F.col("_content_digest")).otherwise(F.col("content_digest")),
        "dimension_key": F.when(blank, F.col("_dimension_key")).otherwise(F.coalesce("dimension_key", "_dimension_key")), "local_date": F.when(blank, F.col("_local_date")).when(dated, F.col("_local_date")).otherwise(F.col("local_date")),
    }
    same = lambda c: filled[c].eqNullSafe(F.col(f"_{c}"))
    conflict = F.coalesce(F.col("_told") & ~(same("fact_key") & same("dimension_key") & same("local_date") & same("content_digest")), F.lit(False))
    out = {c: F.when(conflict, F.col(c)).otherwise(v) for c, v in filled.items()}
    return rows.select(*keys, *(out[c].alias(c) for c in parts), conflict.alias("conflict"))


# publications


def _days_of(rows: DataFrame, column: str = "local_date") -> list:
    """Distinct days: as many as days are touched."""
    return sorted(r[0] for r in rows.select(column).distinct().collect() if r[0] is not None)


def publish_merge(store: Store, change_id: str, batch: DataFrame, order: str) -> Snapshot:
    """Write a batch of aggregates (table aggregates, by local_date) and their generations, all or nothing."""
    if store.applied(change_id):
        return store.snapshot()
    at = store.snapshot()
    days = _days_of(batch)
    gens = store.table("generations", at)
    after = merged_generations(gens, batch, order)
    rows, _ = merged(store.table("aggregates", at, days), after, batch, order)
    return store.publish(change_id, {"aggregates": Change(rows, "local_date", days), "generations": Change(after)}, at)


def publish_retention(store: Store, change_id: str, plan: DataFrame, now: Column) -> Snapshot:
    """Delete days that the plan (signal, detail_days, aggregate_days) lets go, of facts and aggregates, and reconcile generations."""
    if store.applied(change_id):
        return store.snapshot()
    at = store.snapshot()
    cut = retention.cutoffs(plan, now)
    last = {c: cut.agg(F.max(c)).first()[0] for c in ("detail_before", "aggregate_before")}
    old = lambda name, c: [p for p in at.tables[name]["folders"] if last[c] is not None and p < str(last[c])]
    facts, days = old("facts", "detail_before"), old("aggregates", "aggregate_before")
    stays = store.table("facts", at, facts)
    kept = stays.join(cut.select("signal", "detail_before"), "signal", "left").where(F.col("detail_before").isNull() | (F.col("local_date") >= F.col("detail_before"))).select(stays.columns)
    rows, gens = reconciled(store.table("aggregates", at, days), store.table("generations", at), cut.select("signal", F.col("aggregate_before").alias("before")))
    return store.publish(change_id, {"facts": Change(kept, "local_date", facts), "aggregates": Change(rows, "local_date", days), "generations": Change(gens)}, at)


def publish_retractions(store: Store, change_id: str, new: DataFrame, dims: DataFrame) -> Snapshot:
    """Retract facts: note them, choose current values again, fold the days again that they touch, and scrub events, as one change.

    Tables: facts (by local_date), retractions, current (subject, signal, dimension and the current row, whole), documents
    (refold.documents(), by local_date), events (by local_date; fact_dependencies, state, started, value). Only touched
    days of documents and events are rewritten. Retractions that signals don't support are refused (see
    corrections.refuse_unsupported()) and change nothing. Run again, it does nothing more.
    """
    if store.applied(change_id):
        return store.snapshot()
    at = store.snapshot()
    facts, held = store.table("facts", at), store.table("retractions", at)
    asked = corrections.refuse_unsupported(new, dims).where("NOT refused").select(new.columns)
    told = corrections.noted(held, asked)
    fresh = asked.join(held.select(*corrections.FACT), list(corrections.FACT), "left_anti")
    touched = corrections.affected_days(facts, fresh)
    days = _days_of(touched)
    scope = touched.select("subject", "signal").distinct()
    # a fact's revisions may lie on other days than the one that counts: all days of what is touched are read
    left = facts.join(scope, ["subject", "signal"], "left_semi")
    anew = refold.documents(left, dims, told).join(touched, list(DAY), "left_semi")
    documents = store.table("documents", at, days).join(touched, list(DAY), "left_anti").unionByName(anew)
    now = store.table("current", at)
    dimension = ["subject", "signal", "dimension"]
    good = refold.details(left, dims, told)
    again = current(good, dimension).select(*dimension, "observation_id", "occurred_at", "fields", F.lit("observed").alias("availability"))
    mine = now.join(scope, ["subject", "signal"], "left_semi").select(*dimension)
    chosen = mine.join(again, dimension, "left").withColumn("availability", F.coalesce("availability", F.lit("no_data"))).select(now.columns)
    values = now.join(scope, ["subject", "signal"], "left_anti").unionByName(chosen)
    events = store.table("events", at)
    marked = corrections.dependents(events, fresh)
    hit = _days_of(marked.where("gone"))
    parts = corrections.dependents(store.table("events", at, hit), fresh)
    scrubbed = corrections.scrubbed(parts, F.col("gone")).select(events.columns)
    return store.publish(change_id, {
        "retractions": Change(told), "documents": Change(documents, "local_date", days), "current": Change(values), "events": Change(scrubbed, "local_date", hit),
    }, at)
