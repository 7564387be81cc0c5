"""Hosts as data sources, and delivery with failures, waiting and dead letters."""

import datetime as dt
import json
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from daymark import store
from daymark.operators import delivery, outbox
from daymark.sources import ports
from daymark.streaming import live

HOST = '''
import datetime as dt, json, os

class Port:
    def __init__(self, options):
        self.folder = options["folder"]
    def shards(self):
        return sorted(f for f in os.listdir(self.folder) if f.endswith(".jsonl"))
    def _lines(self, shard):
        return open(f"{self.folder}/{shard}").read().splitlines()
    def latest(self, shard):
        return len(self._lines(shard))
    def read(self, shard, begin, end):
        for line in self._lines(shard)[begin:end]:
            yield json.loads(line)["subject"], dt.datetime(2024, 1, 1), line
    def wake(self, event, attempt):
        with open(f"{self.folder}/calls", "a") as f:
            f.write(event["event_id"] + "\\n")
        if event["event_id"] == "e2":
            raise ConnectionError("lost")
        return "accepted" if event["event_id"] == "e1" else "enqueue_failed"
'''


@pytest.fixture
def host(spark, tmp_path):
    folder = tmp_path / "host"
    folder.mkdir()
    names = {"__name__": "__main__"}  # so that the class travels as a whole
    exec(HOST, names)
    spark.dataSource.register(ports.hosted(ports.Reports, names["Port"]))
    spark.dataSource.register(ports.hosted(ports.Wakes, names["Port"]))
    return folder


def add(folder, shard, n):
    with open(folder / f"{shard}.jsonl", "a") as f:
        f.writelines(json.dumps({"subject": i, "shard": shard}) + "\n" for i in range(n))


def test_reports_are_read_as_a_table_and_as_a_stream(spark, host, tmp_path):
    add(host, "a", 3)
    add(host, "b", 2)
    read = lambda r: r.format("daymark_reports").option("folder", str(host)).load()
    got = read(spark.read)
    assert sorted((r.shard, r.place, r.subject) for r in got.collect()) == [("a.jsonl", i, i) for i in range(3)] + [("b.jsonl", i, i) for i in range(2)]
    assert got.rdd.getNumPartitions() == 2
    for _ in range(2):  # the second run goes on where the first one ended
        read(spark.readStream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(60)
        add(host, "a", 1)
        add(host, "c", 2)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.shard, r.place) for r in out.collect()) == [("a.jsonl", i) for i in range(4)] + [("b.jsonl", 0), ("b.jsonl", 1), ("c.jsonl", 0), ("c.jsonl", 1)]
    with pytest.raises(ValueError):
        ports.port({"port": "nothing"})
    assert type(ports.port({"port": "collections:OrderedDict"})).__name__ == "OrderedDict"


def test_events_go_through_the_sink(spark, host, tmp_path):
    schema = "event_id string, token string, attempt int"
    spark.createDataFrame([("e1", "t1", 1), ("e2", "t2", 1), ("e3", "t3", 2)], schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    sink = stream.writeStream.format("daymark_wakes").option("folder", str(host)).option("receipts", f"file://{tmp_path}/receipts").option("checkpointLocation", f"{tmp_path}/ck")
    sink.trigger(availableNow=True).start().awaitTermination(60)
    got = {r.event_id: (r.token, r.status, r.error) for r in ports.receipts(spark, f"file://{tmp_path}/receipts").collect()}
    assert got == {"e1": ("t1", "accepted", None), "e2": ("t2", "unknown", "ConnectionError"), "e3": ("t3", "enqueue_failed", None)}


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import tests
BOX = "event_id string, state string, attempt int, token string, lease_until timestamp_ntz, next_attempt_at timestamp_ntz, started boolean, invalidated boolean, reservation string"


class Flaky:
    """good: at once; late: at the third attempt; bad: never; odd: raises. Each call leaves a line."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self, event, attempt):
        with open(os.path.join(self.folder, f"{event['event_id']}-{attempt}"), "a") as f:
            f.write("x")
        kind = event["event_id"].split("-")[0]
        if kind == "odd":
            raise TimeoutError
        return "accepted" if kind == "good" or (kind == "late" and attempt == 3) else "enqueue_failed"


def event(name, **more):
    return {"event_id": name, "state": "pending", "attempt": 0, "token": None, "lease_until": None, "next_attempt_at": None, "started": False, "invalidated": False, "reservation": None} | more


def test_rounds_wait_and_give_up(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    rows = [event("good"), event("late"), event("bad"), event("odd"), event("gone", invalidated=True), event("begun", state="claimed", started=True, lease_until=dt.datetime(2024, 1, 1))]
    box = spark.createDataFrame([tuple(r.values()) for r in rows], BOX)
    now, waits = dt.datetime(2024, 1, 1, 12), []
    for _ in range(9):
        box, _ = delivery.round_(box, Flaky(str(calls)), F.lit(now), "w")
        box = store.kept(box)
        due = {r.event_id: r.next_attempt_at for r in box.where("state = 'pending' AND NOT invalidated").collect()}
        if "bad" in due:
            waits.append((due["bad"] - now).total_seconds())
        now = min(due.values(), default=now)
    got = {r.event_id: (r.state, r.attempt) for r in box.collect()}
    assert got == {"good": ("delivered", 1), "late": ("delivered", 3), "bad": ("dead_letter", 5), "odd": ("unknown", 1), "gone": ("pending", 0), "begun": ("unknown", 0)}
    assert waits[:1] == [30] and sorted(set(waits)) == [30, 60, 120, 240]
    assert {f.name: f.read_text() for f in calls.iterdir()} == {n: "x" for n in ("good-1", "late-1", "late-2", "late-3", "odd-1", *(f"bad-{i}" for i in range(1, 6)))}  # nobody is called twice
    assert {r.reservation is None for r in box.where("event_id <> 'good' AND event_id <> 'late' AND event_id <> 'odd'").collect()} == {True}


def test_a_round_takes_a_bounded_number(spark, tmp_path):
    rows = [event(f"good-{i}", next_attempt_at=dt.datetime(2024, 1, 1, 0, i)) for i in range(6)]
    box = spark.createDataFrame([tuple(r.values()) for r in rows], BOX)
    got, _ = delivery.round_(box, Flaky(str(tmp_path)), F.lit(dt.datetime(2024, 1, 2)), "w", most=2)
    assert sorted(r.event_id for r in got.where("state = 'delivered'").collect()) == ["good-0", "good-1"]
    with pytest.raises(outbox.IllegalTransition):
        outbox.check_transition("delivered", "pending")


def test_a_stream_delivers_and_publishes_each_batch_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    s, clock = store.Store(spark, str(tmp_path / "s")), [dt.datetime(2024, 1, 1)]
    run = live.deliver(s, Flaky(str(calls)), lambda: F.lit(clock[0]), "w")
    for number, names in enumerate((["good-a", "late-a"], ["good-b", "good-a"], ["bad-a"])):
        spark.createDataFrame([tuple(event(n).values()) for n in names], BOX).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(BOX).parquet(f"{tmp_path}/in")
        stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(90)
        clock[0] += dt.timedelta(seconds=200)
        assert s.applied(f"w-{number}")
    before = s.snapshot().number
    run(spark.createDataFrame([tuple(event("good-x").values())], BOX), 2)  # run again
    assert s.snapshot().number == before
    got = {r.event_id: (r.state, r.attempt) for r in s.table("outbox").collect()}
    assert got == {"good-a": ("delivered", 1), "late-a": ("delivered", 3), "good-b": ("delivered", 1), "bad-a": ("pending", 1)}
    assert (calls / "good-a-1").read_text() == "x"
