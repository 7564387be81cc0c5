"""Corrections: retractions, first deliveries, revision decisions, conflicts and what they touch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from .current import canonical_revisions, compare_revisions, current
from .rules import folded

#: What a fact is: a source's id says nothing about another source's.
FACT = ("subject", "signal", "source", "source_event_id")


def without_retracted(facts: DataFrame, retractions: DataFrame, keys: Sequence[str] = FACT) -> DataFrame:
    """Facts that aren't retracted; a fact without a source id never is."""
    return facts.join(retractions.select(*keys).distinct(), list(keys), "left_anti")


def timeline(facts: DataFrame, retractions: DataFrame, keys: Sequence[str] = FACT) -> DataFrame:
    """All facts; retracted ones blanked: unavailable, without a value."""
    marks = retractions.select(*keys).distinct().withColumn("retracted", F.lit(True))
    rows = facts.join(marks, list(keys), "left").withColumn("retracted", F.coalesce("retracted", F.lit(False)))
    return rows.withColumns({"availability": F.when(F.col("retracted"), "unavailable").otherwise(F.col("availability")), "value": F.when(~F.col("retracted"), F.col("value"))})


def first_deliveries(facts: DataFrame, identity: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """The first delivery of every identity, by arrival."""
    cols = [c for c in facts.columns if c not in identity]
    return facts.groupBy(*identity).agg(F.min_by(F.struct(*cols), F.struct(*arrival)).alias("x")).select(*identity, "x.*")


def new_facts(batch: DataFrame, known: DataFrame, identity: Sequence[str], arrival: Sequence[str] = ("observation_id",)) -> DataFrame:
    """A batch without what is known, each identity once: its first by arrival."""
    fresh = batch.join(known.select(*identity).distinct(), list(identity), "left_anti")
    return first_deliveries(fresh, identity, arrival).select(batch.columns)


def decide(facts: DataFrame, revision: str, digest: str, keys: Sequence[str] = FACT, arrival: Sequence[str] = ("received_at", "observation_id")) -> DataFrame:
    """Each arrival against the greatest revision before it: accept, duplicate, conflict or stale."""
    before = Window.partitionBy(*keys).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    top = F.max(revision).over(before)
    held = F.max_by(digest, revision).over(before)
    decision = (
        F.when(F.count("*").over(before) == 0, "accept").when(F.col(revision) > top, "accept").when(F.col(revision) < top, "stale")
        .when(F.col(digest) == held, "duplicate").otherwise("conflict")
    )
    return facts.withColumn("decision", decision)


def ambiguous_facts(batch: DataFrame, revision: str, digest: str, keys: Sequence[str] = FACT) -> DataFrame:
    """Facts that one batch gives at the same revision with different content."""
    return batch.groupBy(*keys, revision).agg(F.countDistinct(digest).alias("contents")).where("contents > 1").select(*keys).distinct()


def jump_conflicts(facts: DataFrame, most: float, keys: Sequence[str] = ("subject", "signal")) -> DataFrame:
    """Observations that differ from the one before them by more than `most` of it."""
    w = Window.partitionBy(*keys).orderBy("occurred_at", "observation_id")
    rows = facts.withColumn("previous", F.lag("value").over(w))
    return rows.withColumn("jump", scalars.relative_jump(F.col("value"), F.col("previous"))).where(F.col("jump") > most)


def jump_conflicts_sequential(facts: DataFrame, most: float, keys: Sequence[str] = ("subject", "signal")) -> DataFrame:
    """The same, but a refused observation is no predecessor: an ordered fold whose state is the value that holds."""

    def refuse(held, value):
        bad = held is not None and held != 0 and abs(value - held) / abs(held) > most
        return (held if bad else value), bad

    rows = facts.where("value IS NOT NULL").select(*keys, "occurred_at", "observation_id", "value")
    return folded(rows, keys, ("occurred_at", "observation_id"), F.col("value"), refuse).select(*keys, "observation_id")


def affected_days(facts: DataFrame, retractions: DataFrame, keys: Sequence[str] = FACT) -> DataFrame:
    return facts.join(retractions.select(*keys).distinct(), list(keys), "left_semi").select("subject", "signal", "local_date").distinct()


def invalidate_events(events: DataFrame, retractions: DataFrame) -> DataFrame:
    """Events (with `started`: whether dispatch has begun) of retracted facts: values blanked, undelivered ones invalidated.

    Whether a begun dispatch arrived can't be known, so such an event is unknown and keeps its token, lease and
    reservation for the receipt; an invalidated one gives them up. Of the columns token, lease_until and reservation
    those that events have are kept so.
    """
    marks = retractions.select(*FACT).distinct().withColumn("gone", F.lit(True))
    rows = events.join(marks, list(FACT), "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    return scrubbed(rows, F.col("gone"))


def scrubbed(events: DataFrame, gone: Column) -> DataFrame:
    """Events of which those that are gone lose their value, and what a dispatch that hasn't begun holds."""
    waits = gone & F.col("state").isin("pending", "claimed")
    begun = F.coalesce("started", F.lit(False))
    state = F.when(waits & begun, "unknown").when(waits, "invalidated").otherwise(F.col("state"))
    held = {"token": ~gone | (state == "unknown"), "lease_until": ~gone | (state == "unknown"), "reservation": ~gone | state.isin("unknown", "delivered")}
    out = {c: F.when(keep, F.col(c)) for c, keep in held.items() if c in events.columns}
    return events.withColumns(out | {"state": state, "value": F.when(~gone, F.col("value"))})


def blocked(facts: DataFrame, pending: DataFrame, revision: Column) -> DataFrame:
    """Facts with a pending conflict of their fact, unless of a strictly higher revision."""
    top = pending.groupBy(*FACT).agg(F.max("revision").alias("held_revision"))
    return facts.join(top, list(FACT)).where(revision <= F.col("held_revision"))


def reselected(facts: DataFrame, retractions: DataFrame, keys: Sequence[str] = ("subject", "signal")) -> DataFrame:
    """The current row of every key that has facts, chosen again: canonical, observed, not retracted; no_data where none is left."""
    left = canonical_revisions(without_retracted(facts, retractions), FACT).where("availability = 'observed'")
    got = current(left, keys).select(*keys, "observation_id", "occurred_at", "value", F.lit("observed").alias("availability"))
    return facts.select(*keys).distinct().join(got, list(keys), "left").withColumn("availability", F.coalesce("availability", F.lit("no_data")))


def dependents(events: DataFrame, retractions: DataFrame, depends: str = "fact_dependencies") -> DataFrame:
    """events with gone: whether any of their dependencies (array<struct<signal, source, source_event_id>>) is a retracted fact of the subject.

    An event that recorded none, or says that they aren't all (`dependencies_complete` false, where it has that column),
    can't be shown to be independent: it is gone as soon as any fact of its subject and signal is retracted.
    """
    refs = events.select("event_id", "subject", F.explode(depends).alias("d")).select("event_id", "subject", "d.signal", "d.source", "d.source_event_id")
    hit = refs.join(retractions.select(*FACT).distinct(), list(FACT), "left_semi").select("event_id").distinct().withColumn("_named", F.lit(True))
    touched = retractions.select("subject", "signal").distinct().withColumn("_touched", F.lit(True))
    vague = F.coalesce(F.size(depends), F.lit(0)) <= 0
    if "dependencies_complete" in events.columns:
        vague = vague | ~F.coalesce("dependencies_complete", F.lit(False))
    rows = events.join(hit, "event_id", "left").join(touched, ["subject", "signal"], "left")
    gone = F.coalesce("_named", F.lit(False)) | (vague & F.coalesce("_touched", F.lit(False)))
    return rows.withColumn("gone", gone).select(*events.columns, "gone")


def replayed(facts: DataFrame, retractions: DataFrame, definition, evaluate) -> DataFrame:
    """What a rule's hits become when retractions are applied: kept, withdrawn, or added. Nothing is delivered.

    evaluate(facts, definition) gives hits with observation_id. Only scopes that a retraction touches are evaluated again:
    the subject, and of daily rules the day.
    """
    scope = ["subject", "local_date"] if definition.scope == "local_day" else ["subject"]
    touched = facts.join(retractions.select(*FACT).distinct(), list(FACT), "left_semi").where(F.col("signal") == definition.signal).select(*scope).distinct()
    rows = facts.join(touched, scope, "left_semi")
    before = evaluate(rows, definition).select(*scope, "observation_id").withColumn("was", F.lit(True))
    after = evaluate(without_retracted(rows, retractions), definition).select(*scope, "observation_id").withColumn("still", F.lit(True))
    both = before.join(after, [*scope, "observation_id"], "full")
    return both.select(*scope, "observation_id", F.when(F.col("was") & F.col("still"), "kept").when(F.col("was"), "withdrawn").otherwise("added").alias("change"))


def refuse_unsupported(retractions: DataFrame, dims: DataFrame) -> DataFrame:
    """Retractions with refused: only signals identified by their source's id can be retracted, and only with such an id."""
    kinds = dims.select("signal", F.col("identity").alias("_identity")).distinct()
    rows = retractions.join(kinds, "signal", "left")
    return rows.withColumn("refused", ~F.coalesce((F.col("_identity") == "source_event_id") & F.col("source_event_id").isNotNull(), F.lit(False))).drop("_identity")


def noted(retractions: DataFrame, new: DataFrame) -> DataFrame:
    """The retraction table with new ones; the same fact of the same source is retracted once."""
    keys = list(FACT)
    return retractions.unionByName(new.dropDuplicates(keys).join(retractions.select(*keys), keys, "left_anti"))


def recorded(conflicts: DataFrame, new: DataFrame) -> DataFrame:
    """The conflict table with new records; one that is there stays as it is."""
    fresh = new.dropDuplicates(["subject", "conflict_id"]).join(conflicts.select("subject", "conflict_id"), ["subject", "conflict_id"], "left_anti")
    return conflicts.unionByName(fresh)


def resolved(conflicts: DataFrame, answers: DataFrame) -> DataFrame:
    """Conflicts after answers (subject, conflict_id, revision): resolved by a strictly higher revision than the candidate's only."""
    rows = conflicts.join(answers.select("subject", "conflict_id", F.col("revision").alias("answer")), ["subject", "conflict_id"], "left")
    wins = (F.col("status") == "pending") & (compare_revisions(F.col("answer"), F.col("candidate_revision")) == 1)
    wins = F.coalesce(wins, F.lit(False))
    return rows.withColumns({"status": F.when(wins, "resolved").otherwise(F.col("status")), "resolution_revision": F.when(wins, F.col("answer"))}).drop("answer")


def proven(details: DataFrame, identities: DataFrame) -> DataFrame:
    """identities (fact_key, revision, content_digest) with whether a detail row still proves them: the same key, revision and content."""
    keys = ["fact_key", "revision", "content_digest"]
    renamed = details.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    on = (F.col("fact_key") == F.col("_fact_key")) & F.col("revision").eqNullSafe(F.col("_revision")) & (F.col("content_digest") == F.col("_content_digest"))
    return identities.join(renamed, on, "left").withColumn("proven", F.col("_fact_key").isNotNull()).drop(*(f"_{k}" for k in keys))
