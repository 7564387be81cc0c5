"""Latest values: the current row of a dimension, its freshness, carried values and revisions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def revision_key(revision: Column) -> Column:
    """A sortable key: null below whole numbers (padded), those below other text."""
    r = F.trim(revision.cast("string"))
    return F.when(r.isNull(), F.lit("0")).when(r.rlike("^[0-9]+$"), F.concat(F.lit("1"), F.lpad(r, 20, "0"))).otherwise(F.concat(F.lit("2"), r))


def compare_revisions(new: Column, old: Column) -> Column:
    """1, 0, -1, or null where two revisions can't be compared: null is below all, numbers by size, equal text is equal."""
    n, o = F.trim(new.cast("string")), F.trim(old.cast("string"))
    number = "^-?[0-9]+$"
    return (
        F.when(n.isNull() & o.isNull(), F.lit(0)).when(n.isNull(), F.lit(-1)).when(o.isNull(), F.lit(1))
        .when(n.rlike(number) & o.rlike(number), F.signum(n.try_cast("decimal(38,0)") - o.try_cast("decimal(38,0)")).cast("int"))
        .when(n == o, F.lit(0))
    )


def dimension_key(signal: Column, *dims: Column) -> Column:
    """The signal, and its dimension values behind a unit separator; null, zero and false are empty."""
    parts = [F.when(d.cast("string").isin("0", "0.0", "false") | d.isNull(), F.lit("")).otherwise(d.cast("string")) for d in dims]
    return F.concat_ws("\x1f", signal, *parts)


def current(facts: DataFrame, keys: Sequence[str] = ("subject", "signal"), order: Sequence[Column] | None = None) -> DataFrame:
    """The row with the greatest (occurred_at, observation_id), or `order`, of every key.

    One aggregation, combined before the shuffle. Spark keeps its row buffer by sorting each task's rows by key, as
    buffers of structs can't be hashed; a key's rows never meet in a window.
    """
    cols = [c for c in facts.columns if c not in keys]
    by = F.struct(*(order or (F.col("occurred_at"), F.col("observation_id"))))
    return facts.groupBy(*keys).agg(F.max_by(F.struct(*cols), by).alias("x")).select(*keys, "x.*")


def conflicts(facts: DataFrame, digest: str, keys: Sequence[str] = ("subject", "signal")) -> DataFrame:
    """Keys whose latest (occurred_at, revision) has rows of different content."""
    at = ["occurred_at", "revision"]
    contents = facts.groupBy(*keys, *at).agg(F.countDistinct(digest).alias("contents"))
    top = contents.groupBy(*keys).agg(F.max_by("contents", F.struct(*at)).alias("contents"))
    return top.where("contents > 1")


def with_freshness(rows: DataFrame, now: Column, ttl_seconds: Column) -> DataFrame:
    """status (unavailable, fresh or stale), value only while fresh, last_known always; a null ttl never ends."""
    age = F.timestamp_diff("SECOND", F.col("occurred_at"), now)
    status = F.when(F.col("value").isNull(), "unavailable").when(ttl_seconds.isNull() | (age <= ttl_seconds), "fresh").otherwise("stale")
    return rows.withColumn("status", status).withColumn("last_known", F.col("value")).withColumn("value", F.when(F.col("status") == "fresh", F.col("value")))


def carried(facts: DataFrame, value: Column, keys: Sequence[str] = ("subject", "signal")) -> DataFrame:
    """Every observation with the last reliable value up to it."""
    w = Window.partitionBy(*keys).orderBy("occurred_at", "observation_id").rowsBetween(Window.unboundedPreceding, 0)
    return facts.withColumn("last_known", F.last(value, ignorenulls=True).over(w))


def with_previous(facts: DataFrame, state: str, keys: Sequence[str] = ("subject", "signal")) -> DataFrame:
    """Every observation with the state of the one before."""
    return facts.withColumn("previous", F.lag(state).over(Window.partitionBy(*keys).orderBy("occurred_at", "observation_id")))


def advances(facts: DataFrame, arrival: Sequence[str], keys: Sequence[str] = ("subject", "signal")) -> DataFrame:
    """Whether an observation moved the current value when it arrived: later than all that had arrived before."""
    w = Window.partitionBy(*keys).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max("occurred_at").over(w)
    return facts.withColumn("advanced", seen.isNull() | (F.col("occurred_at") > seen))


def canonical_revisions(facts: DataFrame, fact: Sequence[str], revision: str = "revision") -> DataFrame:
    """One row of each fact: that of the greatest revision, then time, then id.

    Facts without any revision keep all rows, and so do rows without a source id (a null among `fact`), which are no
    revisions of each other. Only the greatest key of each fact is aggregated; rows meet it in a join.
    """
    named = reduce(and_, (F.col(c).isNotNull() for c in fact))
    place = F.struct(revision_key(F.col(revision)).alias("r"), "occurred_at", "observation_id")
    top = facts.where(named & F.col(revision).isNotNull()).groupBy(*fact).agg(F.max(place).alias("top_place"))
    rows = facts.join(top, list(fact), "left")
    return rows.where(F.col("top_place").isNull() | (place == F.col("top_place"))).select(*facts.columns)
