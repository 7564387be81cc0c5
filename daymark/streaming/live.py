"""Streaming twins: live rules with state, first deliveries, and projections rebuilt for the days that a batch touches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import timedelta

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class ThresholdCrossing(StatefulProcessor):
    """Fires where a value reaches a threshold that the one before didn't; state per (subject, local_date): the last value.

    Rows of a batch are taken in (occurred_at, observation_id); one that is older than the last taken changes nothing. The
    state of a day that gets no more rows goes after `keep` (processing time).
    """

    def __init__(self, threshold: float, keep: timedelta):
        self.threshold, self.keep = threshold, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", T.StructType([T.StructField("at", T.LongType()), T.StructField("value", T.DoubleType())]), int(self.keep.total_seconds() * 1000))

    def handleInputRows(self, key, rows: Iterator, timer_values) -> Iterator:  # noqa: N802
        import pandas as pd

        now = pd.concat(list(rows)).sort_values(["occurred_at", "observation_id"])
        at, before = self.last.get() if self.last.exists() else (np.iinfo(np.int64).min, np.nan)
        now = now[now["occurred_at"].astype("int64") >= at]
        value = now["value"].to_numpy(np.float64)
        previous = np.concatenate(([before if before is not None else np.nan], value))[:-1]
        fired = now["observation_id"].to_numpy()[(previous < self.threshold) & (value >= self.threshold)]
        if len(now):
            self.last.update((int(now["occurred_at"].astype("int64").iloc[-1]), float(value[-1])))
        yield pd.DataFrame({"subject": [key[0]] * len(fired), "observation_id": pd.Series(fired, dtype="int64")})

    def close(self) -> None:
        pass


def threshold_hits(facts: DataFrame, threshold: float, keep: timedelta = timedelta(days=3)) -> DataFrame:
    """The live rule over streamed facts. Needs the RocksDB state store; states go after `keep` without rows."""
    return facts.groupBy("subject", "local_date").transformWithStateInPandas(ThresholdCrossing(threshold, keep), "subject long, observation_id long", "Append", "ProcessingTime")


#: Keys that a live occurrence rule remembers in a scope.
MOST_KEYS = 200


class Occurrence(StatefulProcessor):
    """Fires once for each key of a scope; state: a map of the keys, each with its number, of which the oldest go beyond `most`."""

    def __init__(self, most: int, keep: timedelta):
        self.most, self.keep = most, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = int(self.keep.total_seconds() * 1000)
        self.seen = handle.getMapState("seen", T.StructType([T.StructField("key", T.StringType())]), T.StructType([T.StructField("number", T.LongType())]), ttl)
        self.count = handle.getValueState("count", T.StructType([T.StructField("n", T.LongType())]), ttl)

    def handleInputRows(self, key, rows: Iterator, timer_values) -> Iterator:  # noqa: N802
        import pandas as pd

        now = pd.concat(list(rows)).sort_values(["occurred_at", "observation_id"])
        now = now[now["occurrence_key"].notna() & (now["occurrence_key"] != "")]
        held = {k[0]: v[0] for k, v in self.seen.iterator()}  # `most` entries at most
        n = self.count.get()[0] if self.count.exists() else 0
        fired = []
        for name, observation in zip(now["occurrence_key"], now["observation_id"], strict=True):
            if name in held:
                continue
            held[name] = n
            self.seen.updateValue((name,), (n,))
            fired.append((name, int(observation)))
            n += 1
            if len(held) > self.most:
                oldest = min(held, key=held.get)
                del held[oldest]
                self.seen.removeKey((oldest,))
        if fired:
            self.count.update((n,))
            yield pd.DataFrame({"subject": [key[0]] * len(fired), "occurrence_key": pd.Series([k for k, _ in fired], dtype="object"), "observation_id": [o for _, o in fired]})

    def close(self) -> None:
        pass


def occurrence_hits(facts: DataFrame, scope: Sequence[str] = ("subject", "local_date"), most: int = MOST_KEYS, keep: timedelta = timedelta(days=3)) -> DataFrame:
    """The live occurrence rule over streamed facts (subject first of `scope`, occurrence_key, occurred_at, observation_id).

    A key given again fires again only after `most` other keys of its scope, or when its scope had no rows for `keep`.
    Without a key a fact can't be told from a repetition and doesn't fire. Needs the RocksDB state store.
    """
    return facts.groupBy(*scope).transformWithStateInPandas(Occurrence(most, keep), "subject long, occurrence_key string, observation_id long", "Append", "ProcessingTime")


class Absence(StatefulProcessor):
    """Fires when `limit` ms have passed behind an observation without another, by timers of event time.

    State: the times that the watermark hasn't left `limit` behind yet, each with a timer. When a time's timer expires, all
    observations that could have ended its silence have come or are too late: it fires if none did, and is forgotten.
    So the order in which observations arrive within the watermark makes no difference.
    """

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getMapState("times", T.StructType([T.StructField("at", T.LongType())]), T.StructType([T.StructField("there", T.BooleanType())]))

    def handleInputRows(self, key, rows: Iterator, timer_values) -> Iterator:  # noqa: N802
        for batch in rows:
            for at in sorted(set(batch["occurred_at"].astype("datetime64[ms]").astype("int64"))):
                if not self.times.containsKey((int(at),)):
                    self.times.updateValue((int(at),), (True,))
                    self.handle.registerTimer(int(at) + self.limit)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803  named by Spark
        import pandas as pd

        at = expiredTimerInfo.getExpiryTimeInMs() - self.limit
        others = [k[0] for k in self.times.keys()]
        ended = any(at < t < at + self.limit for t in others)
        for t in others:
            if t <= at:
                self.times.removeKey((t,))
        if not ended:
            yield pd.DataFrame({"subject": [key[0]], "signal": pd.Series([key[1]], dtype="object"), "last_seen": [at]})

    def close(self) -> None:
        pass


def absences(facts: DataFrame, seconds: float, late: str = "1 hour", event_time: str = "occurred_at") -> DataFrame:
    """subject, signal, last_seen: each silence of `seconds` or more behind an observation, told once the watermark has passed it.

    The live twin of rules.silences() for facts that are at most `late` out of order. Needs the RocksDB state store.
    """
    rows = facts.select("subject", "signal", F.col(event_time).cast("timestamp").alias("occurred_at")).withWatermark("occurred_at", late)
    got = rows.groupBy("subject", "signal").transformWithStateInPandas(Absence(int(seconds * 1000)), "subject long, signal string, last_seen long", "Append", "EventTime")
    return got.select("subject", "signal", F.timestamp_millis("last_seen").alias("last_seen"))


def first_seen(facts: DataFrame, identity: Sequence[str], event_time: str = "occurred_at", within: str = "7 days") -> DataFrame:
    """The first delivery of an identity among those within a time of each other; permanent deduplication is a batch anti-join."""
    return facts.withWatermark(event_time, within).dropDuplicatesWithinWatermark(list(identity))


def daily_counts(facts: DataFrame, event_time: str = "occurred_at", late: str = "1 day", zone: Column | None = None) -> DataFrame:
    """Sum and count per subject, signal and local day (UTC without a zone), given out once the watermark has passed the day.

    The watermark is one of local wall time, so a day ends with its own midnight, whether clocks change in it or not.
    """
    at = F.col(event_time) if zone is None else F.from_utc_timestamp(F.col(event_time), F.coalesce(zone, F.lit("UTC")))
    rows = facts.withColumn("_local", at).withWatermark("_local", late)
    days = rows.groupBy("subject", "signal", F.window("_local", "1 day")).agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    return days.select("subject", "signal", F.to_date("window.start").alias("local_date"), "total", "n")


def rebuild_touched_days(store: str, fold: Callable[[DataFrame], DataFrame], out: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: append a batch's new facts to a table and fold the days again that it touches.

    Facts lie by local_date and batch, each batch written as a whole, so that a batch that is run twice writes the
    same files; only touched days are read again, and only their aggregates are replaced.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("local_date", "batch").parquet(store)
        days = [r.local_date for r in batch.select("local_date").distinct().collect()]  # the days of one batch
        touched = spark.read.parquet(store).where(F.col("local_date").isin(days)).drop("batch")  # prunes partitions
        fold(touched).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("local_date").parquet(out)

    return run


def deliver(store, wake: Callable[[dict, int], str], now: Callable[[], Column], worker: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: put a batch's new events into the store's outbox, do one delivery round, and publish its outcome.

    A batch that is run again after it was published does nothing. One that died before calls the host again for what it
    had claimed, with the same attempt.
    """
    from ..operators import delivery, outbox
    from ..store import Change

    def run(batch: DataFrame, number: int) -> None:
        change = f"{worker}-{number}"
        if store.applied(change):
            return
        at = store.snapshot()
        held = store.table("outbox", at) if "outbox" in at.tables else batch.limit(0)
        rows, _ = delivery.round_(outbox.enqueue(held, batch.select(held.columns)), wake, now(), worker)
        store.publish(change, {"outbox": Change(rows)}, at)

    return run
