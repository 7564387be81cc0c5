"""Reports taken in from end to end, in pieces and again, against the same reports at once."""

import datetime as dt
import json

from pyspark.sql import functions as F

from daymark import schema, store
from daymark.engine import Engine
from daymark.ingestion import Ingestion
from daymark.operators import ruleset

STEPS = schema.Signal("steps", (schema.Field("n", "integer", "count", low=0, nullable=False, aggregation="daily_sum", trend="fluctuating"), schema.Field("where", "object", privacy="restricted", visibility="never")), identity="source_event_id")
MOOD = schema.Signal("mood", (schema.Field("v", "number", aggregation="numeric_dist", trend="drifting"),))


def report(name, *observations, producer="app", version=1):
    return json.dumps({"schema_version": version, "report_id": name, "producer": producer, "observations": list(observations)})


def seen(signal, value, at="2024-01-01T10:00:00+00:00", **more):
    return {"signal": signal, "signal_schema_version": 1, "occurred_at": at, "availability": "observed", "value": value} | more


def batch(spark, *payloads, at=dt.datetime(2024, 1, 3)):
    return spark.createDataFrame([(1, at, p) for p in payloads], "subject long, received_at timestamp_ntz, payload string")


def test_reports_become_facts_documents_values_events_and_receipts(spark, tmp_path):
    dims = schema.dimensions(spark, [STEPS, MOOD])
    rule = {"id": "many", "version": 1, "source": {"signal": "steps", "field": "n"}, "condition": {"type": "threshold_crossing", "operator": "gte", "value": 100}, "event": {"type": "walked"}}
    definitions = ruleset.parsed(spark.createDataFrame([(json.dumps(rule),)], "body string"), dims)
    zones = spark.createDataFrame([("Europe/Berlin",), ("UTC",)], "zone string")
    now = F.lit(dt.datetime(2024, 1, 3))
    first = [
        report("r1", seen("steps", {"n": 50, "where": {"lat": 1}}, source_event_id="a"), seen("steps", {"n": 120}, "2024-01-01T23:30:00Z", source_event_id="b", timezone="Europe/Berlin"), seen("steps", {"n": 120}, "2024-01-01T11:00:00Z", source_event_id="c")),
        report("r2", seen("mood", {"v": 1.5}), seen("mood", {"v": "high"}), seen("mood", {"v": 2}, "2024-01-01T10:00:00"), seen("sleep", {}), seen("mood", {"v": 1}, "2025-01-01T10:00:00Z"), seen("mood", {"v": 1}, timezone="Moon"), {"signal": "mood", "signal_schema_version": 1, "occurred_at": "2024-01-02T00:00:00Z", "availability": "no_data"}),
        report("r3", producer="x", version=7), "{broken",
    ]
    second = [report("r4", seen("steps", {"n": 50}, source_event_id="a"), seen("steps", {"n": 70}, "2024-01-02T09:00:00Z", source_event_id="a", source_revision="2"), seen("steps", {"n": 71}, "2024-01-02T09:00:00Z", source_event_id="a", source_revision="2"), seen("steps", {"n": 9}, source_event_id="a", source_revision="1"))]
    s = store.Store(spark, str(tmp_path / "s"))
    job = Ingestion(s, dims, definitions, zones)
    job.run("one", batch(spark, *first), now)
    told = {r.report_id: r for r in s.table("receipts").collect()}
    assert (told["r1"].accepted, told["r1"].problems) == (3, []) and told["r2"].accepted == 2
    assert {p["index"]: p["problems"] for p in told["r2"].problems} == {1: ["v: not number"], 2: ["occurred_at: no instant with an offset"], 3: ["signal: not declared"], 4: ["occurred_at: in the future"], 5: ["timezone: unknown"]}
    assert told["r3"].problems[0]["problems"] == ["report: unsupported_version"] and told[None].problems[0]["problems"] == ["report: malformed"]
    facts = {r.source_event_id: r for r in s.table("facts").where("signal = 'steps'").collect()}
    assert facts["b"].local_date == dt.date(2024, 1, 2) and facts["a"].fields == {"n": "50.0"}  # its own zone's day; restricted fields aren't kept
    docs = lambda: {(r.signal, r.local_date.day): r.total if r.signal == "steps" else r.sum_value for r in s.table("documents").collect()}
    assert docs() == {("steps", 1): 170.0, ("steps", 2): 120.0, ("mood", 1): 1.5}
    events = s.table("outbox").collect()
    assert [(e.definition_id, e.previous, e.current, e.state, e.unit) for e in events] == [("many", "50.0", "120.0", "pending", "count")]
    before = s.snapshot().tables["facts"]["folders"]
    job.run("two", batch(spark, *second, at=dt.datetime(2024, 1, 3, 1)), now)
    (r4,) = s.table("receipts").where("report_id = 'r4'").collect()
    assert (r4.accepted, r4.duplicates) == (1, 1) and {p["index"]: p["code"] for p in r4.problems} == {2: "fact_conflict", 3: "stale_fact_revision"}
    assert docs() == {("steps", 1): 120.0, ("steps", 2): 190.0, ("mood", 1): 1.5}  # the revision took its fact to another day
    after = s.snapshot().tables["facts"]["folders"]
    assert after["2024-01-01"] == before["2024-01-01"] and after["2024-01-02"] != before["2024-01-02"]
    assert job.run("two", batch(spark, *second), now).number == 2
    (value,) = s.table("current").where("signal = 'steps'").collect()
    assert value.fields == {"n": "70.0"}  # the latest in time
    assert len({e.event_id for e in s.table("outbox").collect()}) == s.table("outbox").count()
    other = store.Store(spark, str(tmp_path / "t"))
    whole = Ingestion(other, dims, definitions, zones)
    whole.run("all", batch(spark, *first).unionByName(batch(spark, *second, at=dt.datetime(2024, 1, 3, 1))), now)
    pick = lambda st: sorted(str(r) for r in st.table("facts").drop("fields").collect())
    assert pick(other) == pick(s)
    assert sorted(str(r) for r in other.table("documents").drop("minutes").collect()) == sorted(str(r) for r in s.table("documents").drop("minutes").collect())
    engine = Engine.over(s, dims)
    assert engine.get_trend(1, "steps", "n", F.lit("2024-01-01").cast("date"), F.lit("2024-01-03").cast("date")).first().current == 190.0
    later = engine.ingest("three", batch(spark, report("r5", seen("mood", {"v": 4}, "2024-01-02T10:00:00Z"))), now, definitions, zones)
    assert later.get_trend(1, "mood", "v", F.lit("2024-01-01").cast("date"), F.lit("2024-01-03").cast("date")).first().days_with_data == 2
    job.run("none", batch(spark, "{}").limit(0), now)
    assert docs()[("steps", 1)] == 120.0
