"""Daily aggregates folded anew from details: every (signal, field) by its declared strategy, in one plan.

Facts are taken in their canonical revisions, without retracted and unobserved ones. Fields become rows, joined to the
declarations, which are sent to every task, as a signal may hold most of the facts; one sort within a field's day serves the folds that need order, a first aggregation folds each bucket of a
day (a state, an event, or the whole) and a second one makes the day's document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import generations
from .corrections import FACT, without_retracted
from .current import canonical_revisions
from .daily import DAY
from .ruleset import number

PERMANENT = -1
#: The parts of a day's document; those that a strategy doesn't have are null.
DOCUMENT = ("min_value", "max_value", "sum_value", "n", "total", "main_value", "minutes", "events")


def _declared(dims: DataFrame) -> DataFrame:
    """Signals with their identity: a row each."""
    return F.broadcast(dims.select("signal", "identity").distinct())


def details(facts: DataFrame, dims: DataFrame, retractions: DataFrame | None = None) -> DataFrame:
    """The facts that count: of signals that their source identifies the canonical revision of each fact, none retracted, observed ones only.

    A higher revision may lie on another day than the one it corrects, so revisions are settled before days are looked at.
    """
    rows = facts.join(_declared(dims), "signal").withColumn("_id", F.col("source_event_id"))
    # a signal that isn't identified by its source has no revisions of one fact
    rows = rows.withColumn("source_event_id", F.when(F.col("identity") == "source_event_id", F.col("source_event_id")))
    rows = canonical_revisions(rows, FACT).withColumn("source_event_id", F.col("_id")).drop("_id", "identity")
    rows = rows if retractions is None else without_retracted(rows, retractions)
    return rows.where("availability = 'observed'")


def _state_label(text: Column) -> Column:
    """A state's label: a string, the `state` of an object, or focused and unfocused for true and false."""
    return F.when(text == "true", "focused").when(text == "false", "unfocused").when(text.startswith("{"), F.get_json_object(text, "$.state")).when(text.startswith('"'), F.get_json_object(text, "$")).otherwise(text)


def _events(text: Column) -> Column:
    """The objects of a list (JSON text) with their identity: an id, else title and times; such without any of these are none."""
    items = F.from_json(text, "array<map<string,string>>")
    first = lambda e, *names: F.coalesce(*(F.nullif(e[n], F.lit("")) for n in names))
    name = lambda e: F.concat_ws("|", *(F.coalesce(e[n], F.lit("")) for n in ("title", "next_event_time", "start_time", "due_time")))
    keyed = F.transform(items, lambda e: F.struct(F.coalesce(first(e, "id", "event_id", "identifier"), F.nullif(name(e), F.lit("|||"))).alias("key"), F.to_json(e).alias("event")))
    return F.filter(keyed, lambda e: e["key"].isNotNull())


def documents(facts: DataFrame, dims: DataFrame, retractions: DataFrame | None = None) -> DataFrame:
    """A row per subject, signal, day and aggregated field: strategy and DOCUMENT.

    facts: subject, signal, source, source_event_id, observation_id, occurred_at, local_date, availability, revision, and
    fields (map of scalar texts, ruleset.payload_fields()). dims: signal, field, aggregation, identity, and state_field,
    the field with the state that a duration belongs to. Times and revisions of a counter are settled already, so its
    total is the last value in time; sums are rounded to 3 places and minutes to 2.
    """
    fields = dims.where("aggregation <> 'none'").select("signal", "field", F.col("aggregation").alias("strategy"), "state_field")
    rows = details(facts, dims, retractions).join(F.broadcast(fields), "signal").where(F.map_contains_key("fields", F.col("field")))
    value = F.element_at("fields", F.col("field"))
    rows = rows.select(*DAY, "field", "strategy", "occurred_at", "observation_id", value.alias("text"), number(value).alias("x"), F.when(F.col("state_field").isNotNull(), F.element_at("fields", F.col("state_field"))).alias("state"))
    order = Window.partitionBy(*DAY, "field").orderBy("occurred_at", "observation_id")
    label = F.last(_state_label(F.col("text")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"until": F.lead("occurred_at").over(order), "held": label})
    s = F.col("strategy")
    micros = F.timestamp_diff("MICROSECOND", F.col("occurred_at"), F.col("until"))
    dwells, sums = s == "duration_by_state", s == "duration_sum_by_state"
    listed = F.when(s == "event_list", _events(F.col("text")))
    rows = rows.select("*", F.posexplode_outer(listed).alias("place", "e"))
    rows = rows.withColumns({
        "bucket": F.when(dwells, F.col("held")).when(sums, _state_label(F.col("state"))).when(s == "event_list", F.col("e.key")), "micros": F.when(dwells, micros),
    })
    at = F.struct("occurred_at", "observation_id", "place")
    held = rows.groupBy(*DAY, "field", "strategy", "bucket").agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("x").alias("sum"), F.count("x").alias("n"), F.max(F.when(F.col("x").isNotNull(), F.struct("occurred_at", "x"))).alias("newest"),
        F.max(F.when(F.col("text").isNotNull(), F.struct("occurred_at", "observation_id", "text"))).alias("main"), F.sum("micros").alias("micros"), F.min_by("e.event", at).alias("event"), F.min(at).alias("since"),
    )
    credit = F.when(dwells, F.col("micros") / 60_000_000).when(sums, F.col("sum"))
    minutes = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("bucket").isNotNull() & credit.isNotNull(), F.struct("bucket", F.round(credit, 2))))))
    events = F.transform(F.array_sort(F.collect_list(F.when(F.col("event").isNotNull(), F.struct("since", "bucket", "event")))), lambda e: e["event"])
    whole = held.groupBy(*DAY, "field", "strategy").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("sum").alias("sum"), F.sum("n").alias("n"), F.max("newest").alias("newest"), F.max("main").alias("main"), minutes.alias("minutes"), events.alias("events"),
    )
    dist = s == "numeric_dist"
    spent = F.aggregate(F.map_values("minutes"), F.lit(0.0), lambda a, b: a + b)
    total = F.when(s == "daily_total", F.col("newest.x")).when(s == "daily_sum", F.round("sum", 3)).when(s == "occurrence_count", F.col("sum")).when(sums, F.round(spent, 2))
    return whole.select(
        *DAY, "field", "strategy", F.when(dist, F.col("lo")).alias("min_value"), F.when(dist, F.col("hi")).alias("max_value"), F.when(dist, F.col("sum")).alias("sum_value"),
        F.when(s.isin("numeric_dist", "daily_sum"), F.col("n")).alias("n"), total.alias("total"), F.when(s == "main_of_day", F.col("main.text")).alias("main_value"),
        F.when(dwells | sums, F.col("minutes")).alias("minutes"), F.when(s == "event_list", F.col("events")).alias("events"),
    )


def representative(docs: DataFrame) -> DataFrame:
    """A field's one number a day, rounded to 3 places: the mean of a distribution, a total, or the last value if it is a number."""
    s = F.col("strategy")
    value = F.when(s == "numeric_dist", F.when(F.col("n") > 0, F.col("sum_value") / F.col("n"))).when(s == "main_of_day", number(F.col("main_value"))).otherwise(F.col("total"))
    return docs.select(*DAY, "field", F.bround(value, 3).alias("value"))


def coverage(facts: DataFrame, dims: DataFrame, retractions: DataFrame | None = None) -> DataFrame:
    """Facts that each day's documents are made of, and the zone of its first."""
    rows = details(facts, dims, retractions)
    zone = F.min_by("zone", F.struct("occurred_at", "observation_id")) if "zone" in facts.columns else F.lit(None).cast("string")
    return rows.groupBy(*DAY).agg(F.count("*").alias("observations"), zone.alias("zone"))


def generation(facts: DataFrame, dims: DataFrame, scopes: DataFrame, today: Column, retractions: DataFrame | None = None, allow_incomplete: bool = False) -> tuple[DataFrame, DataFrame]:
    """(days, generations) built for scopes (subject, signal, kind, generation_id, aggregation_version, start, end) from details.

    days: a row per day of a scope with its observations (0 where it has none) and `fields`, an array of documents. Days
    whose details may have expired (dims: detail_days, storage) have no row; with allow_incomplete they have one, marked.
    A generation with such days is incomplete, all others are complete and may be activated.
    """
    kept = dims.select("signal", "detail_days", "storage").distinct()
    ranges = scopes.join(F.broadcast(kept), "signal", "left").withColumn("local_date", F.explode(generations.days(F.col("start"), F.col("end"))))
    stores = F.coalesce(F.col("storage").isin("current_timeline_aggregate", "current_short_timeline"), F.lit(False))
    expired = ~stores | ((F.col("detail_days") != PERMANENT) & (F.col("local_date") < F.date_sub(today, F.col("detail_days"))))
    ranges = ranges.withColumn("expired", expired)
    docs = documents(facts, dims, retractions).groupBy(*DAY).agg(F.array_sort(F.collect_list(F.struct("field", "strategy", *DOCUMENT[:-2], F.map_entries("minutes").alias("minutes"), "events"))).alias("fields"))
    wanted = ranges if allow_incomplete else ranges.where("NOT expired")
    days = wanted.join(coverage(facts, dims, retractions), list(DAY), "left").join(docs, list(DAY), "left")
    days = days.select(
        *generations.IDENTITY, "aggregation_version", "local_date", F.coalesce("observations", F.lit(0)).alias("observations"), "zone", F.lit(True).alias("recomputed"),
        F.when(F.col("expired"), "incomplete").otherwise("complete").alias("completeness"), "fields",
    )
    held = ranges.groupBy(*generations.IDENTITY, "aggregation_version", "start", "end").agg(
        F.array_sort(F.collect_list(F.when(F.lit(allow_incomplete) | ~F.col("expired"), F.col("local_date")))).alias("accounted"), F.array_sort(F.collect_list(F.when(F.col("expired"), F.col("local_date")))).alias("incomplete"),
    )
    gaps = F.size("incomplete") > 0
    built = held.withColumns({"status": F.when(gaps, "incomplete").otherwise("complete"), "reasons": F.when(gaps, F.array(F.lit("detail_retention_expired"))).otherwise(F.array().cast("array<string>"))})
    return days, built
