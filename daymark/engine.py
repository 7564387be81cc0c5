"""The facade: one object over a table of facts (and, where given, retractions, daily aggregates, mirrors and events)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ingestion, store
from .operators import corrections, current, daily, generations, mirrors, refold, retention, rules, ruleset, trends


class Engine:
    """facts: subject, signal, occurred_at, observation_id, value, local_date, availability, source_event_id, ...

    tables may hold aggregates and generations (see operators.generations), calendar, reminders, conflicts, definitions and
    dims (the declarations, schema.dimensions()). Every method is a plan over the tables; nothing is read before a result
    is asked for.
    """

    def __init__(self, facts: DataFrame, retractions: DataFrame | None = None, events: DataFrame | None = None, tables: Mapping[str, DataFrame] | None = None):
        self.all_facts, self.retractions, self.events, self.store = facts, retractions, events, None
        self.facts = facts if retractions is None else corrections.without_retracted(facts, retractions)
        self.tables = dict(tables or {}) | {"facts": facts} | ({"events": events} if events is not None else {})

    @classmethod
    def over(cls, store: store.Store, dims: DataFrame, at: store.Snapshot | None = None) -> Engine:
        """The facade over a snapshot (the newest) of a store that reports are taken into (ingestion.Ingestion)."""
        at = at or store.snapshot()
        tables = {name: store.table(name, at) for name in at.tables}
        facts = tables.pop("facts", None)
        if facts is None:
            facts = store.spark.createDataFrame([], ingestion.FACTS)
        engine = cls(facts, tables.pop("retractions", None), tables.get("outbox"), tables | {"dims": dims})
        engine.store = store
        return engine

    def ingest(self, change_id: str, reports: DataFrame, now: Column, definitions: DataFrame | None = None, zones: DataFrame | None = None) -> Engine:
        """Take reports (subject, received_at, payload) in as one change of the store, and the facade over what it has become."""
        if self.store is None:
            raise ValueError("reports are taken into a store: use Engine.over()")
        ingestion.Ingestion(self.store, self._table("dims"), definitions, zones).run(change_id, reports, now)
        return Engine.over(self.store, self._table("dims"))

    def _of(self, rows: DataFrame, subject, signals=None) -> DataFrame:
        rows = rows.where(F.col("subject") == F.lit(subject))
        return rows if signals is None else rows.where(F.col("signal").isin(*signals))

    def get_current(self, subject, now: Column, ttl_seconds: Column, signals=None) -> DataFrame:
        return current.with_freshness(current.current(self._of(self.facts, subject, signals)), now, ttl_seconds)

    def get_last_known(self, subject, signals=None) -> DataFrame:
        return current.current(self._of(self.facts, subject, signals).where("value IS NOT NULL"))

    def list_timeline(self, subject, signal: str, size: int | None = None, after: Column | None = None) -> DataFrame:
        rows = self._of(self.all_facts, subject, [signal])
        if self.retractions is not None:
            rows = corrections.timeline(rows, self.retractions)
        return retention.page(rows, ("occurred_at", "observation_id"), size, after)

    def _table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise ValueError(f"this engine has no table {name}")
        return self.tables[name]

    def get_daily(self, subject, signal: str, start: Column, end: Column) -> DataFrame:
        """Days of the active generation, incomplete ones marked; folded from the facts where no generations are kept."""
        if "generations" in self.tables:
            return generations.daily(self._of(self._table("aggregates"), subject, [signal]), self._of(self._table("generations"), subject, [signal]), start, end)
        folded = daily.numeric_dist(self._of(self.facts, subject, [signal]).where(F.col("local_date").between(start, end)))
        mean = F.when(F.col("n") > 0, trends.rounded(F.col("sum_value") / F.col("n")))
        return folded.select(*daily.DAY, mean.alias("value"), F.lit("complete").alias("completeness"), F.lit(True).alias("has_data"))

    def get_documents(self, subject, signal: str, start: Column, end: Column) -> DataFrame:
        """A day's document of every aggregated field, folded from details by the declarations; see refold.documents()."""
        rows = self._of(self.all_facts, subject, [signal])
        return refold.documents(rows, self._table("dims"), self.retractions).where(F.col("local_date").between(start, end))

    def get_trend(self, subject, signal: str, field: str, start: Column, end: Column) -> DataFrame:
        """The trend of one field by its declared model, with days that have data, lack it, or are incomplete; see trends.with_coverage().

        Facts with `fields` give each field its own series; days that the active generation lists as incomplete aren't
        read. Facts of one value a signal have that one series, which is the declared field's.
        """
        if "fields" in self.all_facts.columns:
            rows = refold.representative(self.get_documents(subject, signal, start, end)).where(F.col("field") == field)
            complete = F.lit("complete")
            if "generations" in self.tables:
                gaps = generations.active(self._of(self._table("generations"), subject, [signal])).select("subject", "signal", F.explode("incomplete").alias("local_date")).distinct().withColumn("gap", F.lit(True))
                rows, complete = rows.join(gaps, ["subject", "signal", "local_date"], "left"), F.when(F.col("gap"), "incomplete").otherwise("complete")
            return trends.with_coverage(rows.withColumn("completeness", complete), self._table("dims"), start, end)
        return trends.with_coverage(self.get_daily(subject, signal, start, end).withColumn("field", F.lit(field)), self._table("dims"), start, end)

    def recompute(self, scopes: DataFrame, today: Column, allow_incomplete: bool = False) -> tuple[DataFrame, DataFrame]:
        """(days, generations) built anew from details for scopes; days whose details may be gone make a generation incomplete."""
        return refold.generation(self.all_facts, self._table("dims"), scopes, today, self.retractions, allow_incomplete)

    def evaluate_stored(self, definitions: DataFrame, through: Column, now: Column) -> ruleset.Evaluation:
        """Stored definitions (ruleset.parsed()) over all facts in one pass: events with stable ids, and states."""
        return ruleset.evaluate(self.facts, definitions, through, now, store.kept)

    def apply_retractions(self, retractions: DataFrame) -> dict[str, DataFrame]:
        """What follows from retractions: facts left, current rows chosen again, days to rebuild, events and whether they hang on one."""
        out = {"facts": corrections.without_retracted(self.facts, retractions), "current": corrections.reselected(self.facts, retractions), "days": corrections.affected_days(self.facts, retractions)}
        if self.events is not None and "fact_dependencies" in self.events.columns:
            out["events"] = corrections.dependents(self.events, retractions)
        return out

    def replay(self, retractions: DataFrame, definition: rules.Definition) -> DataFrame:
        return corrections.replayed(self.facts, retractions, definition, rules.hits)

    def sync_mirror(self, collection: str, items: DataFrame, tombstones: DataFrame, sync: mirrors.Sync, keys) -> DataFrame:
        return mirrors.synced(self._table(collection), items, tombstones, sync, keys)

    def list_calendar(self, subject, start: Column, end: Column, size: int | None = None, after: tuple[int, int] = (0, 0)) -> DataFrame:
        """A page of calendar items that start in start..end, or at an unknown time (last). A table with a column
        `recurrence` (a rule as JSON) has its series expanded in the window, behind a cursor of series and occurrence."""
        rows = self._of(self._table("calendar"), subject)
        if "recurrence" not in rows.columns:
            return mirrors.calendar(rows, start, end)
        rule = mirrors.parse_recurrence(rows, "recurrence").withColumn("problem", F.when(F.col("recurrence").isNotNull(), F.col("problem")))
        series = rule.withColumns({"start": F.to_date("start_at"), "freq": F.when(F.col("recurrence").isNotNull(), F.col("freq"))})
        inside = F.col("freq").isNotNull() | F.col("start_at").isNull() | F.col("start_at").between(start, end)
        return mirrors.expanded_page(series.where(inside), ("start_at", "source_event_id"), F.to_date(start), F.to_date(end), retention.page_size(size), after)

    def list_reminders(self, subject, completed: bool = False) -> DataFrame:
        return mirrors.reminders(self._of(self._table("reminders"), subject), completed)

    def list_definitions(self, subject=None) -> DataFrame:
        """Definitions of everyone and of the subject, disabled ones too."""
        rows = self._table("definitions")
        return rows.where(F.col("subject").isNull() | (F.lit(subject).isNotNull() & (F.col("subject") == F.lit(subject)))).orderBy("definition_id", "version")

    def evaluate_daily(self, definitions: DataFrame, through: Column) -> DataFrame:
        """Scheduled streaks over the daily table (see rules.scheduled_streaks())."""
        return rules.scheduled_streaks(self._table("aggregates"), definitions, through)

    def evaluate(self, definition: rules.Definition, **more) -> DataFrame:
        """Rule hits with deterministic event ids."""
        hit = rules.hits(self.facts, definition, **more)
        scope = F.col("local_date") if definition.scope == "local_day" else F.lit("forever")
        return hit.withColumn("event_id", rules.event_id(F.col("subject"), F.lit(definition.id), F.lit(definition.version), scope, F.col("observation_id")))

    def evaluate_absence(self, now: Column, seconds: float) -> DataFrame:
        return rules.absent(self.facts, now, seconds)

    def list_events(self, subject, size: int | None = None) -> DataFrame:
        if self.events is None:
            raise ValueError("this engine has no events")
        return retention.page(self._of(self.events, subject), (F.desc("occurred_at"), F.desc("event_id")), size)

    def list_conflicts(self, subject, status: str | None = None, size: int | None = None) -> DataFrame:
        rows = self._of(self._table("conflicts"), subject)
        return retention.page(rows if status is None else rows.where(F.col("status") == status), ("created_at", "conflict_id"), size)

    def find_jumps(self, most_jump: float) -> DataFrame:
        return corrections.jump_conflicts(self.facts, most_jump)

    def run_retention(self, plan: DataFrame, now: Column, dry_run: bool = True) -> DataFrame:
        """Rows that go (dry run), or the facts that stay."""
        plan = retention.cutoffs(plan, now)
        gone = retention.expired(self.all_facts.withColumn("_day", F.to_date("occurred_at")), plan, "_day", "detail_before").drop("_day", "detail_before")
        return gone if dry_run else self.all_facts.join(gone.select("observation_id"), "observation_id", "left_anti")

    def export_subject(self, subject, order=("occurred_at",), cap: int | None = None) -> tuple[dict[str, DataFrame], DataFrame | None]:
        """Every collection of the subject, to its end or to `cap` rows by `order`, and which of them the cap cut."""
        return retention.drained(retention.export_subject(self.tables, subject), order, cap)

    def purge_subject(self, subject) -> dict[str, DataFrame]:
        return retention.purge_subject(self.tables, subject)
