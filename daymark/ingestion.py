"""Reports taken in from end to end: parsed, checked, identified, decided, appended, folded, evaluated, and published as one change."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import scalars
from .operators import attribution, current, decisions, ingest, nested, outbox, refold, ruleset
from .operators.corrections import FACT
from .operators.daily import DAY
from .store import Change, Snapshot, Store, kept

FACTS = (
    "subject bigint, signal string, source string, source_event_id string, observation_id string, occurred_at timestamp_ntz, received_at timestamp_ntz, local_date date, zone string, availability string,"
    "revision string, fields map<string,string>, dimension string, content string, report_id string, index int"
)
RECEIPTS = "subject bigint, source string, report_id string, accepted bigint, duplicates bigint, problems array<struct<index:int,code:string,problems:array<string>>>"
CURRENT = "subject bigint, signal string, dimension string, observation_id string, occurred_at timestamp_ntz, fields map<string,string>, availability string"
#: Problems of one observation name what becomes of it.
INVALID, CONFLICT, STALE = "validation_failed", "fact_conflict", "stale_fact_revision"


def observations(reports: DataFrame, dims: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """A row per observation of reports (subject, received_at, payload) as a fact (FACTS), with `problems`; refused reports are one row.

    dims: schema.dimensions(). An observation needs a declared signal, an aware time not more than a day ahead, and a known
    availability; an observed one a valid payload of finite numbers (see nested.ingested()). Its local day is that of its
    own zone (UTC without one); zones (zone) are those that are known, others are a problem.
    """
    rows = ingest.parse_reports(reports).withColumnRenamed("producer", "source")
    rows = rows.withColumn("_key", F.concat_ws(":", "subject", "source", "report_id", F.col("index").cast("string")))
    at = ingest.instant(F.col("occurred_raw")).cast("timestamp_ntz")
    signals = dims.groupBy("signal").agg(F.max("identity").alias("_identity"), F.max("state_field").alias("_dimension"))
    rows = rows.withColumn("occurred_at", at).join(signals, "signal", "left")
    if zones is not None:
        rows = rows.join(zones.select(F.col("zone").alias("timezone"), F.lit(True).alias("_zone")).distinct(), "timezone", "left")
    strange = F.col("timezone").isNotNull() & F.col("_zone").isNull() if zones is not None else F.lit(False)
    observed = F.col("availability") == "observed"
    checked = nested.ingested(rows.where(observed).select("_key", "signal", "value_raw"), dims, "value_raw").select("_key", F.col("problems").alias("_payload"), F.col("value").alias("_value"), F.col("digest").alias("_digest"))
    rows = rows.join(checked, "_key", "left")
    ahead = F.timestamp_diff("SECOND", F.col("received_at"), F.col("occurred_at")) > ingest.FUTURE_SECONDS
    say = lambda bad, text: F.when(F.coalesce(bad, F.lit(False)), F.lit(text))
    own = F.array_compact(F.array(
        say(F.col("_identity").isNull(), "signal: not declared"), say(F.col("occurred_at").isNull(), "occurred_at: no instant with an offset"), say(ahead, "occurred_at: in the future"),
        say(~F.coalesce(F.col("availability").isin("observed", "no_data", "unavailable"), F.lit(False)), "availability: unknown"), say(strange, "timezone: unknown"),
        say(F.col("reason").isNotNull() & ~F.col("reason").isin(*ingest.REASONS), "reason: unknown"), say(F.col("source_event_id").isNotNull() & (F.trim("source_event_id") == ""), "source_event_id: empty"),
    ))
    payload = F.when(F.col("_identity").isNotNull(), F.coalesce("_payload", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    problems = F.when(F.col("refused").isNotNull(), F.array(F.concat(F.lit("report: "), "refused"))).otherwise(F.concat(own, payload))
    fields = F.coalesce(ruleset.payload_fields(F.col("_value")), F.create_map().cast("map<string,string>"))
    zone = F.when(~strange, F.col("timezone"))
    rows = rows.withColumns({"problems": problems, "fields": fields, "zone": zone, "content": F.coalesce("_digest", scalars.digest(F.lit("v2"), F.coalesce("signal", F.lit("")), F.coalesce("availability", F.lit(""))))})
    rows = rows.withColumns({
        "local_date": attribution.local_day(F.col("occurred_at"), F.col("zone")), "source_event_id": F.trim("source_event_id"),
        "dimension": current.dimension_key(F.col("signal"), F.when(F.col("_dimension").isNotNull(), F.element_at("fields", F.col("_dimension")))),
    })
    ident = F.when(F.col("_identity") == "singleton", F.lit("one")).when(F.col("source_event_id").isNotNull(), F.col("source_event_id")).otherwise(F.col("occurred_at").cast("string"))
    delivery = scalars.digest(F.col("subject"), F.col("source"), F.col("signal"), F.coalesce(ident, F.lit("")), F.coalesce("revision", F.lit("")), F.col("content"))
    rows = rows.withColumn("observation_id", F.concat(F.lit("obs_"), F.left(delivery, F.lit(32))))
    names = [part.strip().split(" ")[0] for part in ("subject, signal, source, source_event_id, observation_id, occurred_at, received_at, local_date, zone, availability, revision, fields, dimension, content, report_id, index").split(",")]
    return rows.select(*names, "problems")


def decided(new: DataFrame, held: DataFrame) -> DataFrame:
    """Valid observations with `decision` (accept, duplicate, conflict, stale) against the facts held and those before them in the batch.

    The same delivery again is a duplicate. What a source identifies is decided by its revisions; anything else is
    accepted once.
    """
    order = ("received_at", "report_id", "index")
    known = held.select("observation_id").distinct().withColumn("_known", F.lit(True))
    rows = new.join(known, "observation_id", "left")
    first = rows.groupBy("observation_id").agg(F.min(F.struct(*order)).alias("_first"))
    rows = rows.join(first, "observation_id").withColumn("_again", F.col("_known").isNotNull() | (F.struct(*order) != F.col("_first"))).drop("_first", "_known")
    fresh = rows.where("NOT _again").drop("_again")
    named = fresh.where("source_event_id IS NOT NULL").withColumn("_fresh", F.lit(True))
    before = held.join(named.select(*FACT).distinct(), list(FACT), "left_semi").withColumn("_fresh", F.lit(False))
    both = named.select(*before.columns).unionByName(before)
    told = decisions.fact_decisions(both, "revision", "content", FACT, ("_fresh", *order)).where("_fresh").select("observation_id", "decision")
    rows = rows.join(told, "observation_id", "left")
    return rows.withColumn("decision", F.when(F.col("_again"), "duplicate").otherwise(F.coalesce("decision", F.lit("accept")))).drop("_again")


def receipts(bad: DataFrame, rows: DataFrame) -> DataFrame:
    """A row per report (RECEIPTS): how many observations were accepted or known, and what is wrong with which others."""
    code = F.when(F.col("decision") == "conflict", CONFLICT).when(F.col("decision") == "stale", STALE)
    keys = ["subject", "source", "report_id"]
    wrong = bad.select(*keys, "index", F.lit(INVALID).alias("code"), "problems").unionByName(rows.where(code.isNotNull()).select(*keys, "index", code.alias("code"), F.array(F.col("decision")).alias("problems")))
    counts = rows.groupBy(*keys).agg(F.count_if(F.col("decision") == "accept").alias("accepted"), F.count_if(F.col("decision") == "duplicate").alias("duplicates"))
    listed = wrong.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("index", "code", "problems"))).alias("problems"))  # a report has 200 observations at most
    kinds = "array<struct<index:int,code:string,problems:array<string>>>"
    # reports that can't be told apart (no id) keep their problems together
    on = [counts[k].eqNullSafe(listed[k]) for k in keys]
    both = counts.join(listed, on, "full").select(*(F.coalesce(counts[k], listed[k]).alias(k) for k in keys), "accepted", "duplicates", "problems")
    return both.select(*keys, F.coalesce("accepted", F.lit(0)).alias("accepted"), F.coalesce("duplicates", F.lit(0)).alias("duplicates"), F.coalesce("problems", F.array()).cast(kinds).alias("problems"))


@dataclass
class Ingestion:
    """Taking reports into a store with the declarations `dims` and stored definitions (ruleset.parsed())."""

    store: Store
    dims: DataFrame
    definitions: DataFrame | None = None
    zones: DataFrame | None = None

    def _table(self, name: str, at: Snapshot, ddl: str, parts=None) -> DataFrame:
        return self.store.table(name, at, parts) if name in at.tables else self.store.spark.createDataFrame([], ddl)

    def run(self, change_id: str, reports: DataFrame, now: Column) -> Snapshot:
        """Take reports in. Readers see facts, documents, current values, events and receipts of it together, or nothing.

        Only the days that new facts lie on are written again. Run again with its id, it does nothing.
        """
        if self.store.applied(change_id):
            return self.store.snapshot()
        at = self.store.snapshot()
        facts, told = self._table("facts", at, FACTS), self._table("receipts", at, RECEIPTS)
        got = kept(observations(reports, self.dims, self.zones))
        rows = kept(decided(got.where("size(problems) = 0").drop("problems"), facts))
        new = rows.where("decision = 'accept'").drop("decision").select(facts.columns)
        touched = new.select("subject", "signal").distinct()
        days = sorted(r[0] for r in new.select("local_date").distinct().collect())  # the days of a batch
        mine = facts.join(touched, ["subject", "signal"], "left_semi").unionByName(new)
        parts = self._table("facts", at, FACTS, days).unionByName(new)
        hit = new.select(*DAY).distinct()
        if any(r.identity == "source_event_id" for r in self.dims.select("identity").distinct().collect()):  # a revision may take its fact from another day
            moved = facts.join(new.where("revision IS NOT NULL").select(*FACT).distinct(), list(FACT), "left_semi").select(*DAY)
            hit = hit.unionByName(moved).distinct()
        folded = sorted(r[0] for r in hit.select("local_date").distinct().collect())
        anew = refold.documents(mine, self.dims).join(hit, list(DAY), "left_semi")
        held = self.store.table("documents", at, folded) if "documents" in at.tables else anew.limit(0)
        documents = held.join(hit, list(DAY), "left_anti").unionByName(anew)
        good = refold.details(mine, self.dims)
        latest = current.current(good, ["subject", "signal", "dimension"]).select("subject", "signal", "dimension", "observation_id", "occurred_at", "fields", "availability")
        values = self._table("current", at, CURRENT).join(touched, ["subject", "signal"], "left_anti").unionByName(latest)
        changes = {
            "facts": Change(parts, "local_date", days), "documents": Change(documents, "local_date", folded), "current": Change(values),
            "receipts": Change(told.unionByName(receipts(got.where("size(problems) > 0"), rows))),
        }
        if self.definitions is not None:
            done = ruleset.evaluate(good, self.definitions, F.date_sub(F.to_date(now), 1), now, kept)
            events = done.events().withColumns({"state": F.col("delivery_state"), "detected_at": now})
            box = self.store.table("outbox", at) if "outbox" in at.tables else events.limit(0)
            changes["outbox"] = Change(outbox.enqueue(box, events))
        return self.store.publish(change_id, changes, at)
