"""Many stored definitions at once: parsed and checked as rows, and evaluated together in one pass over the facts.

Definitions that look at the same signal, field, scope and precondition share a *view* of the facts: the value before
is the same for all of them. A pass reads the facts once, gives each its views, sorts each view's facts of a subject,
scope and day once, and asks every definition of the view there; what leaves the sort are the facts at which some
definition may fire and one row for each day. The days then pass their last value on to the next, in a second sort of
these few rows only, so no subject's facts ever meet in one task. Lifecycles, states, streaks and absences are small
aggregations of what the pass has left.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import rules

# Conditions that look at observations, those that a clock drives, and the parts of a lifecycle.
OBSERVED = ("changed", "equals", "enters", "leaves", "threshold_crossing", "delta", "occurrence")
CLOCKED = ("streak", "absence")
SCOPES, FIRES, REARMS = ("local_day", "forever"), ("once", "every"), ("next_scope", "cooldown", "never")

FACT_COLUMNS = ("subject", "signal", "source", "source_event_id", "observation_id", "occurred_at", "local_date", "fields")
_DEFINITION = (
    "definition_id", "version", "condition", "event_type", "operator", "wanted", "fire", "rearm", "cooldown_seconds", "dedupe_key", "periods", "wake_enabled", "unit", "aggregation",
)


def scalar_text(value: Column) -> Column:
    """A variant's scalar as text that is equal where the values are: numbers as doubles, strings in quotes, true and false; null for null.

    Truth values and numbers never equal each other. Arrays and objects are their JSON.
    """
    kind = F.schema_of_variant(value)
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when(value.isNull() | (kind == "VOID"), None).when(number, F.try_variant_get(value, "$", "double").cast("string")).otherwise(F.to_json(value))


def payload_fields(payload: Column) -> Column:
    """An object (variant) as a map of scalar texts, what facts are evaluated by."""
    return F.transform_values(F.try_variant_get(payload, "$", "map<string,variant>"), lambda _, v: scalar_text(v))


def number(text: Column) -> Column:
    """The number of a scalar text; null for other scalars."""
    return text.try_cast("double")


def parsed(stored: DataFrame, dims: DataFrame | None = None, body: str = "body") -> DataFrame:
    """Definitions of a column of JSON texts, a row per text, with `problems`: all that is wrong with one; none: it may be used.

    Of a lifecycle what is missing takes its default: an occurrence fires every time, anything else once a local day.
    `wanted` and the values of `preconditions` are scalar texts. dims (signal, field, unit, aggregation) adds the
    watched field's unit and aggregation. A text that is no JSON object has one problem, as a null has.
    """
    v = F.try_parse_json(F.col(body))
    get = lambda path, kind: F.try_variant_get(v, "$." + path, kind)
    kind = lambda path: F.schema_of_variant(get(path, "variant"))
    words = lambda path: F.when(kind(path) == "STRING", F.nullif(F.trim(get(path, "string")), F.lit("")))
    rows = stored.withColumn("_object", F.schema_of_variant(v).startswith("OBJECT"))
    rows = rows.withColumns({
        "definition_id": words("id"), "version": F.when(kind("version") == "BIGINT", get("version", "int")), "signal": words("source.signal"), "condition": words("condition.type"),
        "event_type": words("event.type"), "field": get("source.field", "string"), "operator": F.coalesce(get("condition.operator", "string"), F.lit("gte")), "wanted": scalar_text(get("condition.value", "variant")),
        "periods": F.coalesce(number(scalar_text(get("condition.params.periods", "variant"))), number(scalar_text(get("condition.value", "variant")))).cast("int"),
        "enabled": F.coalesce(get("enabled", "boolean"), F.lit(True)), "wake_enabled": F.coalesce(get("wake.enabled", "boolean"), F.lit(True)), "for_subject": get("subject_id", "string"),
        "dedupe_key": F.coalesce(get("deduplication.key", "string"), F.lit("source_event_id")), "scope": F.coalesce(get("lifecycle.scope", "string"), F.lit("local_day")),
        "rearm": F.coalesce(get("lifecycle.rearm", "string"), F.lit("next_scope")), "cooldown_seconds": F.coalesce(get("lifecycle.cooldown_seconds", "double"), F.lit(0.0)),
        "_when": get("source.when", "variant"),
    })
    rows = rows.withColumns({
        "fire": F.coalesce(get("lifecycle.fire", "string"), F.when(F.col("condition") == "occurrence", "every").otherwise("once")),
        "preconditions": F.coalesce(F.try_variant_get("_when", "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")),
    })
    when_kind = F.coalesce(F.schema_of_variant("_when"), F.lit("VOID"))
    names = F.map_keys("preconditions")
    nested = F.filter(names, lambda k: F.schema_of_variant(F.element_at("preconditions", k)).rlike("^(ARRAY|OBJECT)"))
    problem = lambda bad, text: F.when(F.coalesce(bad, F.lit(False)), text)
    checks = [
        problem(F.col(c).isNull(), F.lit(f"{path}: required"))
        for c, path in (("definition_id", "id"), ("version", "version"), ("signal", "source.signal"), ("condition", "condition.type"), ("event_type", "event.type"))
    ] + [
        problem(~F.col("condition").isin(*OBSERVED, *CLOCKED, *rules.EVALUATORS), F.concat(F.lit("condition.type: unknown "), "condition")),
        problem(F.col("condition").isin("threshold_crossing", "streak") & ~F.col("operator").isin(*rules.OPS), F.concat(F.lit("condition.operator: unknown "), "operator")),
        problem(~F.col("scope").isin(*SCOPES) | ~F.col("fire").isin(*FIRES) | ~F.col("rearm").isin(*REARMS), F.lit("lifecycle: unknown part")),
        problem((F.col("rearm") == "never") & (F.col("scope") != "forever"), F.lit("lifecycle: rearm never needs scope forever")),
        problem((F.col("rearm") == "cooldown") & (F.col("cooldown_seconds") <= 0), F.lit("lifecycle: rearm cooldown needs cooldown_seconds")),
        problem(~when_kind.startswith("OBJECT") & (when_kind != "VOID"), F.lit("source.when: no object")),
        problem(F.size(nested) > 0, F.concat(F.lit("source.when: no scalar at "), F.array_join(nested, ", "))),
        problem(F.exists(names, lambda k: F.trim(k) == ""), F.lit("source.when: a field without a name")),
        problem(F.col("condition").isin(*CLOCKED) & (F.size(names) > 0), F.lit("source.when: a clock has no observation to look at")),
        problem((F.col("condition") == "streak") & (F.coalesce("periods", F.lit(0)) <= 0), F.lit("condition.params.periods: above 0")),
    ]
    problems = F.when(F.coalesce("_object", F.lit(False)), F.array_compact(F.array(*checks))).otherwise(F.array(F.lit("definition: no object")))
    rows = rows.withColumn("problems", problems).withColumn("preconditions", F.transform_values("preconditions", lambda _, x: scalar_text(x))).drop("_object", "_when")
    if dims is None:
        return rows.withColumns({"unit": F.lit(None).cast("string"), "aggregation": F.lit(None).cast("string")})
    return rows.join(dims.select("signal", "field", "unit", "aggregation"), ["signal", "field"], "left")


#: Definitions up to which the table of them is sent to every task.
FEW = 10_000


def _views(definitions: DataFrame) -> DataFrame:
    """Definitions with `view`: the same for those of a signal and subject that share field, scope and precondition."""
    text = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("preconditions"))))  # maps are no grouping keys
    return definitions.withColumn("view", F.concat_ws("|", "signal", F.coalesce("for_subject", F.lit("")), F.coalesce("field", F.lit("")), "scope", text))


def _seen_by(views: DataFrame, keys: list[str]) -> DataFrame:
    """Per signal (and subject): what its views ask of a fact. The definitions stay behind: they meet the facts after the sort."""
    by = views.groupBy(*keys, "view", "field", "scope").agg(F.first("preconditions").alias("preconditions"))
    return by.groupBy(*keys).agg(F.collect_list(F.struct("view", "field", "scope", "preconditions")).alias("views"))


def holds(d: Column, value: Column, before: Column) -> Column:
    """Whether an observation's definition (a struct) fires at `value` behind `before` (scalar texts). Clocked conditions never do."""
    wanted, now, was, line = d["wanted"], number(value), number(before), number(d["wanted"])
    over = lambda x: F.coalesce(*(F.when(d["operator"] == name, op(x, line)) for name, op in rules.OPS.items()))
    kind = d["condition"]
    out = (
        F.when(kind == "changed", before.isNotNull() & ~before.eqNullSafe(value))
        .when(kind == "equals", value.eqNullSafe(wanted)).when(kind == "enters", value.eqNullSafe(wanted) & ~before.eqNullSafe(wanted)).when(kind == "leaves", before.eqNullSafe(wanted) & ~value.eqNullSafe(wanted))
        .when(kind == "threshold_crossing", was.isNotNull() & ~over(was) & over(now)).when(kind == "delta", F.abs(now - was) >= F.abs(line)).when(kind == "occurrence", F.lit(True))
    )
    return F.coalesce(out, F.lit(False))


def passed(facts: DataFrame, definitions: DataFrame) -> DataFrame:
    """The pass: facts (FACT_COLUMNS; fields: map of scalar texts) under definitions (of parsed(), without problems).

    A row per subject, view, scope and day, and one per fact at which a definition's condition holds: `first` tells the
    former, `fired` are the definitions that hold at the row's fact, `definitions` (on first rows) all of the view,
    `before` and `now` the values with the facts that they come from, `last`, `last_at` the day's last ones and `total`,
    `n` the sum and number of its numbers.
    """
    usable = definitions.where((F.size("problems") == 0) & F.col("enabled"))
    usable = usable.withColumn("scope", F.when(F.col("condition") == "streak", "local_day").otherwise(F.col("scope")))  # runs are made of days
    views = _views(usable)
    everyone = _seen_by(views.where("for_subject IS NULL"), ["signal"]).withColumnRenamed("views", "_all")
    own = _seen_by(views.where("for_subject IS NOT NULL").withColumn("subject", F.col("for_subject").cast(facts.schema["subject"].dataType)), ["subject", "signal"]).withColumnRenamed("views", "_own")
    asking = views.groupBy("view").agg(F.array_sort(F.collect_list(F.struct(*_DEFINITION))).alias("definitions"))
    if usable.limit(FEW + 1).count() <= FEW:
        asking = F.broadcast(asking)
    rows = facts.select(*FACT_COLUMNS).join(everyone, "signal", "left").join(own, ["subject", "signal"], "left")
    both = F.concat(F.coalesce("_all", F.array().cast(everyone.schema["_all"].dataType)), F.coalesce("_own", F.array().cast(own.schema["_own"].dataType)))
    rows = rows.withColumn("_v", F.explode(both)).select(*FACT_COLUMNS, "_v.*")
    met = F.forall(F.map_entries("preconditions"), lambda e: F.map_contains_key("fields", e["key"]) & F.element_at("fields", e["key"]).eqNullSafe(e["value"]))
    rows = rows.where(met)
    now = F.struct(F.when(F.col("field").isNotNull(), F.element_at("fields", F.col("field"))).alias("value"), "source", "source_event_id", "observation_id")
    rows = rows.withColumns({
        "scope_key": F.when(F.col("scope") == "local_day", F.col("local_date").cast("string")).otherwise("forever"), "day": F.to_date("occurred_at"), "now": now,
    }).drop("fields", "preconditions", "source", "source_event_id")
    keys = ["subject", "signal", "view", "scope_key"]
    day = Window.partitionBy(*keys, "day")
    order = day.orderBy("occurred_at", "observation_id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({
        "before": F.lag("now").over(order), "first": F.row_number().over(order) == 1, "last": F.last("now").over(whole), "last_at": F.last("occurred_at").over(whole),
        "total": F.sum(number(F.col("now.value"))).over(day), "n": F.count(number(F.col("now.value"))).over(day),
    })
    rows = rows.join(asking, "view")
    fires = lambda before: F.filter("definitions", lambda d: holds(d, F.col("now.value"), before))
    rows = rows.withColumn("fired", fires(F.col("before.value"))).where(F.col("first") | (F.size("fired") > 0))
    # definitions stay behind once more; what a day's first fact fires is known only behind the second sort
    rows = rows.withColumn("fired", F.when(~F.col("first"), F.col("fired"))).drop("definitions")
    # a day's first fact comes behind the last one of the day before; other rows have no need of that, and stay spread
    chain = Window.partitionBy(*keys, F.when(~F.col("first"), F.col("day")), F.when(~F.col("first"), F.col("observation_id"))).orderBy("day")
    rows = rows.withColumn("before", F.when(F.col("first"), F.lag("last").over(chain)).otherwise(F.col("before"))).join(asking, "view")
    return rows.withColumn("fired", F.when(F.col("first"), fires(F.col("before.value"))).otherwise(F.col("fired"))).withColumn("definitions", F.when(F.col("first"), F.col("definitions")))


_SCOPE = ("subject", "definition_id", "version", "scope")


def scope_of(key: Column, version: Column) -> Column:
    """A state's scope: a rule of a new version starts anew."""
    return F.concat(key, F.lit("@v"), version.cast("string"))


#: What a hit's lifecycle is told by.
_LIFE = ("condition", "fire", "rearm", "cooldown_seconds", "occurred_at", "observation_id")


def hits(marks: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Facts at which definitions fire under their lifecycles, a row per fact and definition; of further `columns` only those given (None: all) are carried through sorts.

    Once a scope is one aggregation, combined before the shuffle. An occurrence counts once for each of its keys, and not
    without one. Only hits of definitions with a cooldown pass through an ordered fold.
    """
    rows = marks.where(F.size("fired") > 0).withColumn("d", F.explode("fired"))
    rows = rows.select("subject", "signal", "field", "scope_key", "occurred_at", "observation_id", "before", "now", "d.*").withColumn("scope", scope_of(F.col("scope_key"), F.col("version")))
    seen = F.when(F.col("condition") == "occurrence", F.coalesce(F.when(F.col("dedupe_key") == "source_event_id", F.coalesce(F.col("now.source_event_id").cast("string"), F.col("observation_id").cast("string"))), F.col("now.value")))
    rows = rows.withColumn("seen", seen).where((F.col("condition") != "occurrence") | F.col("seen").isNotNull())
    if columns is not None:
        rows = rows.select(*dict.fromkeys((*_SCOPE, "seen", *_LIFE, *columns)))
    rest = [c for c in rows.columns if c not in (*_SCOPE, "seen")]
    earliest = lambda df, keys: df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("occurred_at", "observation_id")).alias("x")).select(*keys, "x.*")
    occurrences = earliest(rows.where("condition = 'occurrence'"), [*_SCOPE, "seen"]).drop("seen")
    rows = rows.where("condition <> 'occurrence'").drop("seen").unionByName(occurrences)
    cool, once = F.col("rearm") == "cooldown", F.col("fire") == "once"
    single = earliest(rows.where(~cool & once), list(_SCOPE))
    apart = rules.spaced(rows.where(cool), _SCOPE, ("occurred_at", "observation_id"), "occurred_at", F.col("cooldown_seconds"))
    return rows.where(~cool & ~once).unionByName(single).unionByName(apart)


def streaks(marks: DataFrame, through: Column, longest: int = 90) -> DataFrame:
    """Definitions on runs of days: per subject the run that ends with `through`, and whether it reaches its length on that day.

    A day's value is the sum of a counted field, else the mean of its numbers (or its last one, of fields that keep one).
    """
    rows = marks.where("first").withColumn("d", F.explode("definitions")).where("d.condition = 'streak'")
    rows = rows.select("subject", "signal", "field", F.col("scope_key").try_cast("date").alias("local_date"), "day", "total", "n", number(F.col("last.value")).alias("last_value"), "last_at", "d.*")
    keys = ["subject", "signal", "field", "local_date", *_DEFINITION]
    days = rows.groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max_by("last_value", "last_at").alias("last_value"))
    value = F.when(F.col("aggregation").isin("daily_sum", "occurrence_count"), F.col("total")).when(F.col("aggregation").isin("main_of_day", "daily_total"), F.col("last_value")).otherwise(F.when(F.col("n") > 0, F.col("total") / F.col("n")))
    line = number(F.col("wanted"))
    passes = F.coalesce(*(F.when(F.col("operator") == name, op(value, line)) for name, op in rules.OPS.items()))
    return rules.runs_through(days.withColumn("passes", passes), ("subject", "signal", "field", *_DEFINITION), through, longest)


def absences(marks: DataFrame, now: Column) -> DataFrame:
    """Definitions on silence: per subject that was ever seen, seconds since its last fact, and whether they reach the limit."""
    rows = marks.where("first").withColumn("d", F.explode("definitions")).where("d.condition = 'absence'").select("subject", "signal", "field", "last_at", "scope_key", "d.*")
    keys = ["subject", "signal", "field", F.when(F.col("scope_key") == "forever", "forever").alias("_scope"), *_DEFINITION]
    last = rows.groupBy(*keys).agg(F.max("last_at").alias("last_seen"))
    silent = F.timestamp_diff("SECOND", F.col("last_seen"), now)
    return last.withColumn("silent_seconds", silent).withColumn("fires", F.coalesce(silent >= number(F.col("wanted")), F.lit(False)))


def _enveloped(rows: DataFrame, trigger: Column) -> DataFrame:
    """Rows with a deterministic event id and the state in which the event is stored."""
    ident = rules.event_id(F.col("subject"), F.col("definition_id"), F.col("version"), F.col("scope"), trigger)
    return rows.withColumns({"event_id": ident, "delivery_state": F.when(F.col("wake_enabled"), "pending").otherwise("not_dispatched")})


@dataclass
class Evaluation:
    """What definitions make of facts; `marks` is the pass, kept as a table, so that the rest reads it and not the facts."""

    marks: DataFrame
    through: Column
    now: Column

    def events(self) -> DataFrame:
        """All events: a stable id each, with the facts they hang on; clocked ones have the day in place of a fact."""
        hit = hits(self.marks, ("event_type", "signal", "field", "unit", "before", "now", "wake_enabled"))
        trigger = F.when(F.col("condition") == "occurrence", F.coalesce(F.col("now.source_event_id").cast("string"), F.col("observation_id").cast("string"))).otherwise(F.col("observation_id").cast("string"))
        ref = lambda c: F.struct("signal", f"{c}.source", f"{c}.source_event_id", f"{c}.observation_id")
        needs = F.when((F.col("condition") == "occurrence") | F.col("before").isNull(), F.array(ref("now"))).otherwise(F.array(ref("before"), ref("now")))
        seen = _enveloped(hit, trigger).select(
            *_SCOPE, "event_id", "event_type", "signal", "field", "unit", "condition", "occurred_at", F.when(F.col("condition") != "occurrence", F.col("before.value")).alias("previous"), F.col("now.value").alias("current"),
            needs.alias("fact_dependencies"), F.lit(True).alias("dependencies_complete"), "delivery_state",
        )

        def clocked(rows: DataFrame, previous: Column, current: Column) -> DataFrame:
            day = F.to_date(self.now).cast("string")
            rows = rows.where("fires").withColumn("scope", scope_of(F.coalesce("_scope", day), F.col("version")))
            trigger = F.concat_ws(":", F.lit("scheduled"), "signal", day)
            return _enveloped(rows, trigger).select(
                *_SCOPE, "event_id", "event_type", "signal", "field", "unit", "condition", self.now.alias("occurred_at"), previous.cast("string").alias("previous"), current.cast("string").alias("current"),
                F.array().cast(seen.schema["fact_dependencies"].dataType).alias("fact_dependencies"), F.lit(False).alias("dependencies_complete"), "delivery_state",
            )

        runs = streaks(self.marks, self.through).withColumn("_scope", F.lit(None).cast("string"))
        return seen.unionByName(clocked(runs, F.col("previous_length"), F.col("length"))).unionByName(clocked(absences(self.marks, self.now), F.lit(None), F.col("silent_seconds")))

    def states(self) -> DataFrame:
        """The state of every observed definition in every scope: the last value, how often it fired and when last."""
        rows = self.marks.where("first").withColumn("d", F.explode("definitions")).where(~F.col("d.condition").isin(*CLOCKED))
        rows = rows.select("subject", "d.definition_id", "d.version", scope_of(F.col("scope_key"), F.col("d.version")).alias("scope"), "last", "last_at")
        last = rows.groupBy(*_SCOPE).agg(F.max_by("last", F.struct("last_at", "last.observation_id")).alias("last"))
        fired = hits(self.marks, ()).groupBy(*_SCOPE).agg(F.count("*").alias("fired"), F.max("occurred_at").alias("last_fired_at"))
        return last.join(fired, list(_SCOPE), "left").select(*_SCOPE, F.col("last.value").alias("previous"), F.coalesce("fired", F.lit(0)).alias("fired"), "last_fired_at")


def evaluate(facts: DataFrame, definitions: DataFrame, through: Column, now: Column, keep: Callable[[DataFrame], DataFrame]) -> Evaluation:
    """All definitions over all facts in one scan. keep(df) writes the pass to a table that the executors share and reads it back.

    through: the day with which streaks end; now: the time of the evaluation. A fact that is late changes what follows
    it in time, as facts are taken by (occurred_at, observation_id).
    """
    # the definitions are read several times, and made by a long plan
    return Evaluation(keep(passed(facts, keep(definitions))), through, now)
