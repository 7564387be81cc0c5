"""Delivery of events to the host: one round over an outbox, with calls made where the rows are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import kept
from . import outbox

#: wake(event, attempt) -> status: accepted, duplicate, suppressed, rejected or enqueue_failed; event is a dict of the row.
Wake = Callable[[dict, int], str]
STATUSES = ("accepted", "duplicate", "suppressed", "rejected", "enqueue_failed")
_RECEIPT = "event_id {kind}, token string, attempt int, status string, error string"


def called(rows: DataFrame, wake: Wake) -> DataFrame:
    """Receipts (event_id, token, attempt, status, error) of calling wake for each row, in the tasks that hold the rows.

    What wake raises, and a status that isn't known, leave the outcome unknown: the request may have arrived. A task
    that is lost and run again calls again; the host tells repetitions by event and attempt and answers `duplicate`.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = _RECEIPT.format(kind=rows.schema["event_id"].dataType.simpleString())
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                status, error = "unknown", None
                try:
                    said = wake(row, row["attempt"])
                    status = said if said in STATUSES else "unknown"
                    error = None if said in STATUSES else f"status {said}"
                except Exception as problem:  # noqa: BLE001  the host's own
                    error = type(problem).__name__
                out.append({"event_id": row["event_id"], "token": row["token"], "attempt": row["attempt"], "status": status, "error": error})
            yield from pa.Table.from_pylist(out, schema=schema).to_batches()

    return rows.mapInArrow(run, ddl)


def round_(events: DataFrame, wake: Wake, now: Column, worker: str, lease_seconds: int = 60, most: int | None = None, keep: Callable[[DataFrame], DataFrame] = kept) -> tuple[DataFrame, DataFrame]:
    """(events, receipts) after one round: what may be taken is claimed under a lease, begun, delivered and settled.

    events: event_id, state, attempt, token, lease_until, next_attempt_at, started, invalidated, reservation and any more.
    A failure waits 30 s, then twice as long each time, and is a dead letter after the fifth; an unknown outcome stays
    so until a receipt or an operator settles it. most: events that a round takes at most, those due longest first.
    The receipts are kept as a table before they are applied, so that a plan read twice calls nobody twice.
    """
    due = outbox.claimable(events, now)
    if most is not None:
        due = due.orderBy(F.col("next_attempt_at").asc_nulls_first(), "event_id").limit(most)
    mine = due.select("event_id").withColumn("_mine", F.lit(True))
    rows = events.join(mine, "event_id", "left")
    taken = outbox.claimed(rows.where("_mine"), now, worker, lease_seconds)
    taken = outbox.begun(taken, taken.select("event_id", "token"), now).drop("_mine")
    receipts = keep(called(taken.where("may_dispatch").drop("may_dispatch"), wake))
    lost = receipts.where("status = 'unknown'").select("event_id").withColumn("_unknown", F.lit(True))
    done = outbox.settled(taken.drop("may_dispatch"), receipts.where("status <> 'unknown'").select("event_id", "token", "status")).drop("audit_only")
    done = done.join(lost, "event_id", "left")
    again = F.col("state") == "pending"
    wait = F.timestamp_add("SECOND", (outbox.BACKOFF_SECONDS * F.pow(F.lit(2), F.col("attempt") - 1)).cast("int"), now)
    done = done.withColumns({
        "state": F.when(F.col("_unknown"), "unknown").otherwise(F.col("state")), "next_attempt_at": F.when(again, wait).otherwise(F.col("next_attempt_at")), "started": F.col("started") & ~again,
        "lease_until": F.when(again, None).otherwise(F.col("lease_until")),
    }).drop("_unknown")
    idle = outbox.claimed(rows.where("_mine IS NULL").drop("_mine"), now, worker, lease_seconds) if most is None else rows.where("_mine IS NULL").drop("_mine")
    return idle.unionByName(done.select(idle.columns)), receipts
