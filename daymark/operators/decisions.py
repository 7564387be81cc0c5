"""Decisions under a partial order of revisions: what an arrival does to its fact, and to the current value.

A null revision is below all others, whole numbers are ordered by size, and any other text equals itself and can't be
compared with anything else. So the greatest revisions of a fact are an antichain of one member: the first revision
that isn't null settles whether numbers or one text count from then on, and of numbers a running maximum is enough. No
fold over rows is needed: each decision follows from a few window values over the arrivals before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .corrections import FACT

ARRIVAL = ("received_at", "observation_id")


def _shaped(rows: DataFrame, revision: str) -> DataFrame:
    """_r: the revision without blanks around it; _number where it is a whole number."""
    text = F.trim(F.col(revision).cast("string"))
    return rows.withColumn("_r", text).withColumn("_number", F.when(F.col("_r").rlike("^-?[0-9]+$"), F.col("_r").try_cast("decimal(38,0)")))


def _ordered(rows: DataFrame, keys: Sequence[str], arrival: Sequence[str], digest: str) -> DataFrame:
    """Each arrival's place in the order of what its key (within `keys`) has accepted:

    order: 1 above all of it, 0 equal to one, -1 below the greatest, null where it can't be compared; first: nothing was
    there before; held: the content accepted at an equal revision. What isn't accepted (order other than 1) leaves no trace.
    """
    key = Window.partitionBy(*keys).orderBy(*arrival)
    before = key.rowsBetween(Window.unboundedPreceding, -1)
    kind = F.first(F.when(F.col("_r").isNotNull(), F.struct(F.col("_number").isNotNull().alias("numeric"), F.col("_r").alias("r"))), ignorenulls=True)
    rows = rows.withColumns({
        "_first": F.row_number().over(key) == 1, "_kind": kind.over(key.rowsBetween(Window.unboundedPreceding, 0)), "_was": kind.over(before),
        "_null_first": F.first(F.col("_r").isNull()).over(key), "_null_held": F.first(digest).over(key),
    })
    rows = rows.withColumn("_top", F.max(F.when(F.col("_kind.numeric"), F.col("_number"))).over(before))
    # the first arrival of a revision is the one that was accepted, if any of that revision was
    number_new = F.col("_number").isNotNull() & F.coalesce(F.col("_kind.numeric"), F.lit(False)) & (F.col("_top").isNull() | (F.col("_number") > F.col("_top")))
    accepted = F.col("_first") | F.when(F.col("_r").isNull(), F.lit(False)).when(F.col("_was").isNull(), F.lit(True)).otherwise(number_new)
    rows = rows.withColumn("_new", accepted)
    by = Window.partitionBy(*keys, F.coalesce(F.col("_number").cast("string"), F.col("_r"))).orderBy(*arrival)
    rows = rows.withColumns({"_taken": F.first("_new").over(by), "_held": F.first(digest).over(by), "_again": F.row_number().over(by) > 1})
    seen = F.col("_again") & F.col("_taken")
    order = (
        F.when(F.col("_new"), 1).when(F.col("_r").isNull(), F.when(F.col("_null_first"), 0).otherwise(-1)).when(seen, 0)
        .when(F.col("_kind.numeric") & F.col("_number").isNotNull(), -1)
    )
    held = F.when(F.col("_r").isNull(), F.col("_null_held")).otherwise(F.col("_held"))
    return rows.withColumns({"order": order, "first": F.col("_first"), "held": F.when(order == 0, held)})


_WORK = ("_r", "_number", "_first", "_kind", "_was", "_top", "_null_first", "_null_held", "_new", "_taken", "_held", "_again")


def fact_decisions(facts: DataFrame, revision: str, digest: str, keys: Sequence[str] = FACT, arrival: Sequence[str] = ARRIVAL) -> DataFrame:
    """facts with `decision`: against all accepted revisions of its fact an arrival is accepted, a duplicate, a conflict
    (the same revision with other content, or one that can't be compared) or stale. Only accepted ones count later."""
    rows = _ordered(_shaped(facts, revision), keys, arrival, digest)
    same = F.col(digest).eqNullSafe(F.col("held"))
    decision = F.when(F.col("order") == 1, "accept").when(F.col("order") == 0, F.when(same, "duplicate").otherwise("conflict")).when(F.col("order") == -1, "stale").otherwise("conflict")
    return rows.withColumn("decision", decision).drop(*_WORK, "order", "first", "held")


def current_decisions(facts: DataFrame, revision: str, digest: str, keys: Sequence[str] = ("subject", "signal"), arrival: Sequence[str] = ARRIVAL) -> DataFrame:
    """facts with `decision`: what an arrival does to the current value of its key: replace, ignore or conflict; and
    `advanced`: whether rules look at it, which they do where an observed value replaced the current one.

    A later time replaces and an earlier one is ignored. At the same time a higher revision replaces, a lower one is
    ignored, an equal one is ignored with the same content and a conflict with other or unknown content, and what can't
    be compared is a conflict.
    """
    before = Window.partitionBy(*keys).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    rows = _shaped(facts, revision).withColumn("_seen", F.max("occurred_at").over(before))
    rows = rows.withColumn("_late", F.coalesce(F.col("occurred_at") < F.col("_seen"), F.lit(False)))
    # arrivals of one time are compared with each other only while it is the newest: late ones are a group of their own
    rows = _ordered(rows, [*keys, "occurred_at", "_late"], arrival, digest)
    # against the one value that is held an equal revision is the greatest, not any that was accepted before it
    greatest = F.when(F.col("_number").isNotNull(), F.col("_number") == F.col("_top")).otherwise(F.when(F.col("_r").isNull(), F.col("_was").isNull()).otherwise(F.lit(True)))
    known = F.col(digest).isNotNull() & F.col("held").isNotNull()
    equal = F.when(~F.coalesce(greatest, F.lit(True)), "ignore").when(known & (F.col(digest) == F.col("held")), "ignore").otherwise("conflict")
    decision = F.when(F.col("_late"), "ignore").when(F.col("order") == 1, "replace").when(F.col("order") == 0, equal).when(F.col("order") == -1, "ignore").otherwise("conflict")
    rows = rows.withColumn("decision", decision)
    observed = F.col("availability") == "observed" if "availability" in facts.columns else F.lit(True)
    return rows.withColumn("advanced", observed & (F.col("decision") == "replace")).drop(*_WORK, "order", "first", "held", "_seen", "_late")
