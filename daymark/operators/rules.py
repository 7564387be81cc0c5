"""Rules over ordered observations: evaluators as predicates on the value before, and lifecycles as windows or folds.

`previous` is the value before within (subject, definition, scope); a local-day scope starts anew each day.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPS: dict[str, Callable[[Column, Column], Column]] = {"gte": operator.ge, "gt": operator.gt, "lte": operator.le, "lt": operator.lt}
#: Conditions of one's own: name to a predicate over (definition, value, value before).
EVALUATORS: dict[str, Callable[[Definition, Column, Column], Column]] = {}


def register(name: str, evaluator: Callable[[Definition, Column, Column], Column]) -> None:
    """Make `name` a condition of definitions."""
    EVALUATORS[name] = evaluator


@dataclass(frozen=True)
class Definition:
    """A rule. scope: local_day or forever; fire: once or every (the default of occurrence rules); rearm: next_scope, cooldown or never."""

    id: str
    signal: str
    condition: str
    value: object = None
    operator: str = "gte"
    version: int = 1
    scope: str = "local_day"
    fire: str | None = None
    rearm: str = "next_scope"
    cooldown_seconds: float | None = None
    subject: object = None
    when: dict = field(default_factory=dict)

    def __post_init__(self):
        known = {"changed", "equals", "enters", "leaves", "threshold_crossing", "delta", "occurrence"}
        if self.fire is None:
            object.__setattr__(self, "fire", "every" if self.condition == "occurrence" else "once")
        if self.condition not in known | EVALUATORS.keys():
            raise ValueError(f"unknown condition {self.condition!r}")
        if self.operator not in OPS:
            raise ValueError(f"unknown operator {self.operator!r}")
        if self.scope not in ("local_day", "forever") or self.fire not in ("once", "every") or self.rearm not in ("next_scope", "cooldown", "never"):
            raise ValueError("illegal lifecycle")
        if self.rearm == "never" and self.scope != "forever":
            raise ValueError("a rule of a day is armed anew with the next day, so rearm=never needs scope=forever")
        if (self.cooldown_seconds or 0) < 0 or self.rearm == "cooldown" and not self.cooldown_seconds:
            raise ValueError("rearm=cooldown needs cooldown_seconds above 0")


def predicate(d: Definition, current: Column, previous: Column) -> Column:
    """Whether the rule's condition holds at an observation."""
    if d.condition in EVALUATORS:
        return F.coalesce(EVALUATORS[d.condition](d, current, previous), F.lit(False))
    v = F.lit(d.value)
    if d.condition == "changed":
        return previous.isNotNull() & ~previous.eqNullSafe(current)
    if d.condition == "equals":
        return current.eqNullSafe(v)
    if d.condition == "enters":
        return current.eqNullSafe(v) & ~previous.eqNullSafe(v)
    if d.condition == "leaves":
        return previous.eqNullSafe(v) & ~current.eqNullSafe(v)
    if d.condition == "threshold_crossing":
        op = OPS[d.operator]
        return F.coalesce(previous.isNotNull() & ~op(previous, v) & op(current, v), F.lit(False))
    if d.condition == "delta":
        return F.coalesce(F.abs(current - previous) >= F.abs(v), F.lit(False))
    return current.isNotNull()


def scope_columns(d: Definition) -> list[str]:
    return ["subject", "local_date"] if d.scope == "local_day" else ["subject"]


def hits(facts: DataFrame, d: Definition, value: str = "value", order: Sequence[str] = ("occurred_at", "observation_id"), occurrence_key: str | None = None) -> DataFrame:
    """Observations at which the rule fires, under its lifecycle, with the value before."""
    rows = facts.where(F.col("signal") == d.signal)
    if d.subject is not None:
        rows = rows.where(F.col("subject") == d.subject)
    for name, wanted in d.when.items():
        rows = rows.where(F.coalesce(F.col(name) == F.lit(wanted), F.lit(False)))
    scope = scope_columns(d)
    w = Window.partitionBy(*scope).orderBy(*order)
    if d.condition == "occurrence":
        first = F.row_number().over(Window.partitionBy(*scope, occurrence_key).orderBy(*order))
        out = rows.where(F.col(occurrence_key).isNotNull()).withColumn("previous", F.lit(None).cast("double")).withColumn("nth", first).where("nth = 1").drop("nth")
    else:
        out = rows.withColumn("previous", F.lag(value).over(w)).where(predicate(d, F.col(value), F.col("previous")))
    if d.rearm == "cooldown":
        return cooled(out, scope, d.cooldown_seconds, order)
    if d.fire == "once":
        return out.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
    return out


def cooled(hit: DataFrame, scope: Sequence[str], seconds: float, order: Sequence[str]) -> DataFrame:
    """Hits at least `seconds` after the last one that counted, in order of a scope."""
    return spaced(hit, scope, order, order[0], F.lit(float(seconds)))


def spaced(rows: DataFrame, keys: Sequence[str], order: Sequence[str], at: str, seconds: Column) -> DataFrame:
    """Of each key's rows in order the first, and then always the first that is `seconds` or more after the last one kept.

    Rows stream through sorted by key, so a task holds one time, however many rows a key has; inside a batch the search
    jumps from kept row to kept row.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    names, n_keys = rows.columns, len(keys)
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(at).cast("timestamp_ntz"))

    def starts(batch: pa.RecordBatch, last: list | None) -> tuple[np.ndarray, list]:
        """Whether each row begins another key than the row before it, and the last row's key."""
        new = np.zeros(batch.num_rows, bool)
        for i in range(n_keys):
            column = batch.column(f"_k{i}")
            a, b = column.slice(1), column.slice(0, len(column) - 1)
            new[1:] |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
            new[1:] |= pc.xor(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
        now = [batch.column(f"_k{i}") for i in range(n_keys)]
        new[0] = last is None or [c[0].as_py() for c in now] != last
        return new, [c[len(c) - 1].as_py() for c in now]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            new, last = starts(batch, last)
            t, gap = batch.column("_x").to_numpy(), batch.column("_gap").to_numpy()
            keep = np.zeros(len(t), bool)
            edges = [*np.flatnonzero(new).tolist(), len(t)]
            if edges[0] > 0:  # the first rows go on with the key of the last batch
                edges = [0, *edges]
            for lo, hi in zip(edges, edges[1:], strict=False):
                i = lo if new[lo] or held is None else lo + int(np.searchsorted(t[lo:hi], held + gap[lo]))
                while i < hi:
                    keep[i], held = True, int(t[i])
                    i += max(1, int(np.searchsorted(t[i:hi], held + gap[i])))
            yield pa.RecordBatch.from_arrays(batch.columns[: len(names)], names=names).filter(pa.array(keep))

    marked = rows.select(*names, *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), micros.alias("_x"), (seconds * 1_000_000).cast("long").alias("_gap"))
    return marked.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, rows.schema)


def folded(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, keep: Callable) -> DataFrame:
    """The rows of which keep(state, value) gives true: an ordered fold by key; keep returns (new state, whether), state starts as None.

    The rows of a key pass in order through one task in batches; nothing but the state is held.
    """
    import pyarrow as pa

    names, schema = rows.columns, rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            marks = []
            for key, x in zip(zip(*(batch.column(f"_k{i}").to_pylist() for i in range(len(keys))), strict=True), batch.column("_x").to_pylist(), strict=True):
                if key != now:
                    now, state = key, None
                state, kept = keep(state, x)
                marks.append(kept)
            yield pa.RecordBatch.from_arrays(batch.columns[: len(names)], names=names).filter(pa.array(marks, pa.bool_()))

    marked = rows.select(*names, *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), value.alias("_x"))
    return marked.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def absent(current: DataFrame, now: Column, seconds: float, keys: Sequence[str] = ("subject", "signal")) -> DataFrame:
    """Keys that were seen, but not for `seconds`."""
    last = current.groupBy(*keys).agg(F.max("occurred_at").alias("last_seen"))
    silence = F.timestamp_diff("SECOND", F.col("last_seen"), now)
    return last.withColumn("silent_seconds", silence.cast("long")).where(F.col("silent_seconds") >= seconds)


def silences(facts: DataFrame, seconds: float, until: Column, keys: Sequence[str] = ("subject", "signal")) -> DataFrame:
    """Observations behind which a key was silent for `seconds` or more: till its next one, or till `until`."""
    times = facts.select(*keys, "occurred_at").distinct()
    nxt = F.coalesce(F.lead("occurred_at").over(Window.partitionBy(*keys).orderBy("occurred_at")), until)
    micros = F.timestamp_diff("MICROSECOND", F.col("occurred_at"), nxt)
    return times.withColumn("_gap", micros).where(F.col("_gap") >= int(seconds * 1_000_000)).select(*keys, F.col("occurred_at").alias("last_seen"))


def streak_edges(runs: DataFrame, need: int) -> DataFrame:
    """Days on which a run of passing days reaches `need`: the run of the day before was shorter. Lengths must not be cut below need."""
    return runs.where((F.col("length") >= need) & (F.col("length") - 1 < need))


def scheduled_streaks(days: DataFrame, definitions: DataFrame, through: Column, longest: int = 90) -> DataFrame:
    """Daily definitions (definition_id, signal, operator, threshold, periods) over daily rows (subject, signal, local_date, value, completeness).

    Per subject and definition: length of the run of passing, complete days that ends with `through`, the length a day
    before, and whether it fires: the length reaches the definition's periods today and didn't yesterday.
    """
    v, t = F.col("value"), F.col("threshold")
    holds = F.lit(False)
    for name, op in OPS.items():
        holds = F.when(F.col("operator") == name, op(v, t)).otherwise(holds)
    inside = days.where((F.col("completeness") == "complete") & (F.col("local_date") <= through) & (F.col("local_date") >= F.date_sub(through, longest)))
    rows = inside.join(definitions, "signal")
    keys = ["subject", "definition_id"]
    return runs_through(rows.withColumn("passes", holds), (*keys, "periods"), through, longest).drop("periods")


def runs_through(days: DataFrame, keys: Sequence[str], through: Column, longest: int = 90) -> DataFrame:
    """Per key (periods among them) the run of passing days (local_date, passes) that ends with `through`: length, the length
    a day before, both up to `longest`, and fires: periods are reached on that day."""
    inside = (F.col("local_date") <= through) & (F.col("local_date") >= F.date_sub(through, longest))
    good = days.where(inside & F.coalesce("passes", F.lit(False))).select(*keys, "local_date").distinct()
    island = F.date_sub(F.col("local_date"), F.row_number().over(Window.partitionBy(*keys).orderBy("local_date")))
    runs = good.withColumn("island", island).groupBy(*keys, "island").agg(F.count("*").alias("length"), F.max("local_date").alias("last"))
    ending = runs.where(F.col("last") == through)
    length, before = F.least("length", F.lit(longest)), F.least(F.col("length") - 1, F.lit(longest))  # one day more was read
    return ending.select(*keys, length.cast("long").alias("length"), before.cast("long").alias("previous_length"), ((length >= F.col("periods")) & (before < F.col("periods"))).alias("fires"))


def states(facts: DataFrame, d: Definition, value: str = "value", order: Sequence[str] = ("occurred_at", "observation_id")) -> DataFrame:
    """The rule's state after its facts, a row per subject and scope: scope key with the version, last value, hits, last hit."""
    scope = scope_columns(d)
    seen = facts.where(F.col("signal") == d.signal).groupBy(*scope).agg(F.max_by(value, F.struct(*order)).alias("previous"))
    fired = hits(facts, d, value, order).groupBy(*scope).agg(F.count("*").alias("fired"), F.max("occurred_at").alias("last_fired_at"))
    key = F.col("local_date").cast("string") if "local_date" in scope else F.lit("forever")
    rows = seen.join(fired, scope, "left")
    return rows.select("subject", F.concat(key, F.lit(f"@v{d.version}")).alias("scope"), "previous", F.coalesce("fired", F.lit(0)).alias("fired"), "last_fired_at")


def for_facts(facts: DataFrame, definitions: DataFrame) -> DataFrame:
    """Facts with each definition that looks at them: the same signal, enabled, and of no subject or of this one."""
    d = definitions.where("enabled").select("definition_id", "signal", F.col("subject").alias("d_subject"))
    return facts.join(d, "signal").where(F.col("d_subject").isNull() | (F.col("d_subject") == F.col("subject"))).drop("d_subject")


def archived(archive: DataFrame, definitions: DataFrame) -> DataFrame:
    """definitions (definition_id, version, body) with what the archive makes of them: stored, known, or conflict (another body of the same version)."""
    held = archive.select("definition_id", "version", F.col("body").alias("_held"))
    decision = F.when(F.col("_held").isNull(), "stored").when(F.col("_held") == F.col("body"), "known").otherwise("conflict")
    return definitions.join(held, ["definition_id", "version"], "left").withColumn("decision", decision).drop("_held")


def event_id(*parts: Column) -> Column:
    """evt_ and half of the digest of the parts, each written with its length."""
    text = F.concat_ws("\x1f", *(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")) for p in parts))
    return F.concat(F.lit("evt_"), F.left(F.sha2(text, 256), F.lit(32)))
