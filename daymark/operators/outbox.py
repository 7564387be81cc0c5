"""The outbox: events with a delivery state machine, as a transition table and expressions over it."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States and the moves between them.
STATES = ("pending", "claimed", "delivered", "suppressed", "rejected", "dead_letter", "not_dispatched", "invalidated", "unknown")
TRANSITIONS = {
    "pending": ("claimed", "invalidated"),
    "claimed": ("pending", "delivered", "suppressed", "rejected", "dead_letter", "invalidated", "unknown"),
    "unknown": ("delivered", "suppressed", "rejected", "invalidated", "pending", "dead_letter"),
}
MOST_ATTEMPTS, BACKOFF_SECONDS, DRAIN = 5, 30, 100


class IllegalTransition(ValueError):
    """A move that the state machine doesn't have."""


def check_transition(now: str, to: str) -> None:
    if now not in STATES or to not in TRANSITIONS.get(now, ()):
        raise IllegalTransition(f"{now} -> {to}")


def can_move(now: Column, to: Column) -> Column:
    out = F.lit(False)
    for state, targets in TRANSITIONS.items():
        out = F.when(now == state, to.isin(*targets)).otherwise(out)
    return out


def next_state(status: Column, attempt: Column, most: int = MOST_ATTEMPTS) -> Column:
    """The state that a receipt leads to; null for an unknown status."""
    return (
        F.when(status.isin("accepted", "duplicate"), "delivered").when(status == "suppressed", "suppressed").when(status == "rejected", "rejected")
        .when(status == "enqueue_failed", F.when(attempt < most, "pending").otherwise("dead_letter"))
    )


def apply_receipts(events: DataFrame, receipts: DataFrame) -> DataFrame:
    """Events after their receipts (event_id, attempt, token, status): stale tokens change nothing; failures wait longer each time."""
    r = receipts.select("event_id", F.col("token").alias("r_token"), "status", F.col("at").alias("r_at"))
    rows = events.join(r, "event_id", "left")
    to = next_state(F.col("status"), F.col("attempt"))
    ok = F.coalesce((F.col("r_token") == F.col("token")) & can_move(F.col("state"), to), F.lit(False))
    wait = F.when(ok & (to == "pending"), F.timestamp_add("SECOND", (BACKOFF_SECONDS * F.pow(F.lit(2), F.col("attempt") - 1)).cast("int"), F.col("r_at")))
    return rows.withColumns({"next_attempt_at": wait, "state": F.when(ok, to).otherwise(F.col("state"))}).drop("r_token", "status", "r_at")


def claimable(events: DataFrame, now: Column) -> DataFrame:
    """Pending events, and claimed ones whose lease has ended, if they are due, not invalidated, and no dispatch of them has begun."""
    return events.where(_takeable(events, now))


def _takeable(events: DataFrame, now: Column) -> Column:
    due = F.coalesce(F.col("next_attempt_at") <= now, F.lit(True))
    expired = F.coalesce((F.col("state") == "claimed") & (F.col("lease_until") <= now), F.lit(False))
    valid = ~F.coalesce("invalidated", F.lit(False)) if "invalidated" in events.columns else F.lit(True)
    return ((F.col("state") == "pending") | expired) & due & valid & ~F.coalesce("started", F.lit(False))


def claimed(events: DataFrame, now: Column, worker: str, lease_seconds: int) -> DataFrame:
    """All events after a claiming round: claimable ones are claimed (attempt + 1, token, lease, reservation); claims whose lease ended after dispatch began are unknown."""
    lost = F.coalesce((F.col("state") == "claimed") & (F.col("lease_until") <= now), F.lit(False)) & F.col("started")
    take = _takeable(events, now)
    attempt = F.when(take, F.col("attempt") + 1).otherwise(F.col("attempt"))
    return events.withColumns({
        "state": F.when(lost, "unknown").when(take, "claimed").otherwise(F.col("state")), "attempt": attempt,
        "token": F.when(take, F.concat(F.lit(worker + ":"), attempt.cast("string"))).otherwise(F.col("token")),
        "lease_until": F.when(take, F.timestamp_add("SECOND", F.lit(lease_seconds), now)).otherwise(F.col("lease_until")),
        "reservation": F.when(take, F.concat(F.lit("resv_"), F.col("event_id").cast("string"), F.lit("_"), attempt.cast("string"))).otherwise(F.col("reservation")),
    })


def begun(events: DataFrame, tokens: DataFrame, now: Column) -> DataFrame:
    """Events with `may_dispatch` for (event_id, token): claimed with this token, not begun, not invalidated, lease still running; such are started."""
    rows = events.join(tokens.select("event_id", F.col("token").alias("_t")), "event_id", "left")
    ok = F.coalesce((F.col("state") == "claimed") & (F.col("token") == F.col("_t")) & ~F.col("started") & ~F.col("invalidated") & (F.col("lease_until") > now), F.lit(False))
    return rows.withColumns({"may_dispatch": ok, "started": F.col("started") | ok}).drop("_t")


def settled(events: DataFrame, receipts: DataFrame) -> DataFrame:
    """Events after receipts (event_id, token, status), each with `audit_only`: a stale token changes nothing but is kept for the record.

    An event invalidated meanwhile doesn't go back to pending; only a delivered one keeps its reservation.
    """
    rows = events.join(receipts.select("event_id", F.col("token").alias("_t"), F.col("status").alias("_s")), "event_id", "left")
    given = F.col("_s").isNotNull()
    fits = F.coalesce((F.col("token") == F.col("_t")) & F.col("state").isin("claimed", "unknown"), F.lit(False))
    to = next_state(F.col("_s"), F.col("attempt"))
    to = F.when(F.col("invalidated") & to.isin("pending", "dead_letter"), "invalidated").otherwise(to)
    moves = given & fits & F.coalesce(can_move(F.col("state"), to), F.lit(False))
    return rows.withColumns({
        "audit_only": given & ~moves, "reservation": F.when(moves & (to != "delivered"), None).otherwise(F.col("reservation")),
        "token": F.when(moves, None).otherwise(F.col("token")), "state": F.when(moves, to).otherwise(F.col("state")),
    }).drop("_t", "_s")


def waiting(events: DataFrame) -> DataFrame:
    """Events that are still to be delivered."""
    return events.where(F.col("state").isin("pending", "claimed"))


def enqueue(outbox: DataFrame, events: DataFrame) -> DataFrame:
    """The outbox with new events, each id once."""
    return outbox.unionByName(events.dropDuplicates(["event_id"]).join(outbox.select("event_id"), "event_id", "left_anti"))


def drain(rows: Iterable[dict], wake: Callable[[dict, int], str], now: datetime, most: int = DRAIN) -> list[dict]:
    """Deliver up to `most` events through wake(event, attempt) -> status; an exception leaves the outcome unknown."""
    out = []
    for row in list(rows)[:most]:
        row = dict(row) | {"attempt": (row.get("attempt") or 0) + 1}
        check_transition(row["state"], "claimed")
        try:
            status = wake(row, row["attempt"])
        except Exception as error:  # noqa: BLE001  whatever the host raised, the request may have arrived
            out.append(row | {"state": "unknown", "error": type(error).__name__})
            continue
        to = {"accepted": "delivered", "duplicate": "delivered", "suppressed": "suppressed", "rejected": "rejected"}.get(status)
        if to is None:
            to = "pending" if row["attempt"] < MOST_ATTEMPTS else "dead_letter"
            row["next_attempt_at"] = now + timedelta(seconds=BACKOFF_SECONDS * 2 ** (row["attempt"] - 1))
        check_transition("claimed", to)
        out.append(row | {"state": to})
    return out
