"""Operators on small tables: golden values, edge cases, streaming twins, declarations, the outbox."""

import datetime as dt
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from daymark import schema
from daymark.engine import Engine
from daymark.functions import scalars
from daymark.operators import attribution, corrections, current, daily, ingest, mirrors, outbox, projection, retention, rules, trends

FACTS = "subject long, signal string, occurred_at timestamp_ntz, observation_id long, value double, local_date date, availability string, source string, source_event_id string, state string"


def at(day, hour=0, minute=0):
    return dt.datetime(2024, 1, day, hour, minute)


def facts(spark, rows):
    """rows: (day, hour, value, state)."""
    return spark.createDataFrame([(1, "m", at(d, h), i, v, dt.date(2024, 1, d), "observed", "app", f"e{i}", s) for i, (d, h, v, s) in enumerate(rows)], FACTS)


def test_folds(spark):
    df = facts(spark, [(1, 1, 5.0, "walk"), (1, 2, None, None), (1, 4, 3.0, "run"), (1, 5, 9.0, "walk"), (2, 1, 1.0, "run")])
    dist = {r.local_date.day: r for r in daily.numeric_dist(df).collect()}
    assert (dist[1].min_value, dist[1].max_value, dist[1].sum_value, dist[1].n) == (3.0, 9.0, 17.0, 3)
    dwell = {(r.local_date.day, r.state): r.minutes for r in daily.state_dwell(df, "state").collect()}
    assert dwell == {(1, "walk"): 180.0, (1, "run"): 60.0}  # a null state keeps the one before; nothing after the last
    assert {r.local_date.day: r.main_value for r in daily.main_of_day(df).collect()} == {1: 9.0, 2: 1.0}
    assert {r.local_date.day: r.total for r in daily.cumulative_latest(df).collect()} == {1: 9.0, 2: 1.0}
    assert daily.numeric_dist(df.limit(0)).count() == 0
    kept = daily.rebuild(df, df.where("observation_id = 0").select(*corrections.FACT), df.where("observation_id = 2").select("subject", "signal", "local_date"))
    assert sorted(r.observation_id for r in kept.collect()) == [1, 2, 3]


def test_sleep_and_counter_goldens(spark):
    rows = spark.createDataFrame([(1, "s", dt.date(2024, 1, 1), "core", 250.0), (1, "s", dt.date(2024, 1, 1), "deep", 70.0), (1, "s", dt.date(2024, 1, 1), "rem", 110.0)], "subject long, signal string, local_date date, stage string, minutes double")
    got = {r.stage: (r.minutes, r.total) for r in daily.duration_sum_by_state(rows, "stage", "minutes").collect()}
    assert got == {"core": (250.0, 430.0), "deep": (70.0, 430.0), "rem": (110.0, 430.0)}


def test_revisions_and_carried_values(spark):
    pairs = [(None, None, 0), (None, "1", -1), ("2", "10", -1), ("10", "2", 1), ("a", "a", 0), ("a", "b", None), ("3", "b", None), (" 7 ", "7", 0), ("-1", "0", -1)]
    got = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string").select("i", current.compare_revisions(F.col("a"), F.col("b")).alias("c")).collect()
    assert {r.i: r.c for r in got} == {i: c for i, (*_, c) in enumerate(pairs)}
    df = facts(spark, [(1, 1, 5.0, None), (1, 2, None, None), (1, 3, 7.0, None)])
    assert [r.last_known for r in current.carried(df, F.col("value")).orderBy("observation_id").collect()] == [5.0, 5.0, 7.0]
    fresh = Engine(df).get_current(1, F.lit(at(1, 4)), F.lit(1800)).collect()[0]
    assert (fresh.status, fresh.value, fresh.last_known) == ("stale", None, 7.0)


def test_streaks_and_trends(spark):
    days = facts(spark, [(d, 1, v, None) for d, v in [(1, 9.0), (2, 9.0), (3, 1.0), (5, 9.0), (6, 9.0), (7, 9.0)]])
    good = F.col("value") > 5
    assert {r.local_date.day: r.length for r in trends.streaks(days, ("subject",), good).collect()} == {1: 1, 2: 2, 5: 1, 6: 2, 7: 3}
    day = lambda n: F.lit(dt.date(2024, 1, n))
    assert [trends.streak_through(days, ("subject",), good, day(n)).collect()[0].length for n in (2, 3, 4, 6)] == [2, 0, 0, 2]
    one = trends.fluctuating(facts(spark, [(1, 1, 4.0, None)]), ("subject",)).collect()[0]
    assert (one.current, one.baseline_median, one.baseline_n, one.direction) == (4.0, 4.0, 1, "flat")
    ranks = spark.range(1).select(*(trends.nearest_rank(F.array(*(F.lit(float(x)) for x in range(n))), 0.25).alias(f"n{n}") for n in (1, 3, 5, 7, 11))).collect()[0]
    assert list(ranks) == [0.0, 0.0, 1.0, 2.0, 2.0]  # round(p * (n - 1)), halves to even
    drift = trends.drifting(days, ("subject",)).collect()[0]
    assert drift.n_points == 6 and drift.total_delta == 0.0
    assert trends.drifting(facts(spark, [(1, 1, 4.0, None)]), ("subject",)).count() == 0


def test_rule_lifecycles(spark):
    df = facts(spark, [(1, 1, 1.0, None), (1, 2, 9.0, None), (1, 3, 1.0, None), (1, 4, 9.0, None), (2, 1, 9.0, None), (2, 2, 1.0, None), (2, 3, 9.0, None)])
    ids = lambda **d: sorted(r.observation_id for r in rules.hits(df, rules.Definition("r", "m", "threshold_crossing", 5.0, **d)).collect())
    assert ids(fire="every") == [1, 3, 6] and ids(fire="once") == [1, 6]
    assert ids(fire="every", scope="forever", rearm="never") == [1, 3, 6]
    assert ids(fire="every", scope="forever", rearm="cooldown", cooldown_seconds=3 * 3600.0) == [1, 6]
    assert ids(fire="every", when={"state": "x"}) == [] and ids(fire="every", subject=2) == []
    for bad in ({"condition": "x"}, {"operator": "x"}, {"rearm": "never"}, {"rearm": "cooldown"}, {"rearm": "cooldown", "cooldown_seconds": 0.0}, {"cooldown_seconds": -1.0}, {"fire": "x"}):
        with pytest.raises(ValueError):
            rules.Definition(**({"id": "r", "signal": "m", "condition": "equals"} | bad))
    assert rules.Definition("r", "m", "equals", scope="forever").fire == "once" and rules.Definition("r", "m", "occurrence").fire == "every"
    rules.register("odd_hour", lambda d, now, before: (now % 2 == 1) & before.isNotNull())
    assert sorted(r.observation_id for r in rules.hits(df, rules.Definition("r", "m", "odd_hour", fire="every")).collect()) == [1, 2, 3, 5, 6]
    events = Engine(df).evaluate(rules.Definition("r", "m", "equals", 9.0, fire="every")).collect()
    assert len({r.event_id for r in events}) == 4 and all(r.event_id.startswith("evt_") and len(r.event_id) == 36 for r in events)


def test_reports(spark):
    good = '{"schema_version":1,"report_id":"a","producer":"p","observations":[{"signal":"steps","occurred_at":"2026-08-27T10:30:00+08:00","availability":"observed","value":"{}"}]}'
    payloads = [good, "not json", good.replace('"schema_version":1', '"schema_version":2'), good.replace('"report_id":"a",', ""), good.replace("{}", "x" * 300_000)]
    got = {r.k: r for r in ingest.parse_reports(spark.createDataFrame(list(enumerate(payloads)), "k int, payload string")).collect()}
    assert [got[k].refused for k in range(5)] == [None, "malformed", "unsupported_version", "missing_field", "payload_too_large"]
    times = ["2026-08-27T10:30:00+08:00", "2026-08-27 10:30:00Z", "2026-08-27T10:30+08:00", "2026-08-27T10:30:00", "soon", None]
    rows = spark.createDataFrame(list(enumerate(times)), "k int, t string").select("k", ingest.instant(F.col("t")).alias("i")).collect()
    at_ = {r.k: r.i for r in rows}
    assert at_[0] == at_[2] == dt.datetime(2026, 8, 27, 2, 30) and at_[1] == dt.datetime(2026, 8, 27, 10, 30) and at_[3] is at_[4] is at_[5] is None
    snap = spark.createDataFrame([("r", "1700000000", [("battery", '{"level": 0.5}', None), ("focus", '""', None), ("weather", None, "denied")])], "report_id string, client_ts string, items array<struct<key:string,data:string,message:string>>")
    maps = spark.createDataFrame([("battery", "battery", "level", "level_ratio", 1.0), ("focus", "focus_state", "focused", "is_active", 1.0), ("weather", "weather", "temperature", "temperature_c", 1.0)], "key string, signal string, field string, name string, scale double")
    assert {r.signal: (r.availability, r.value) for r in ingest.device_snapshot(snap, maps).collect()} == {"battery": ("observed", 0.5), "focus_state": ("no_data", None), "weather": ("unavailable", None)}


def test_units_days_and_text(spark):
    one = spark.range(1).select(
        scalars.convert(F.lit(154.0), F.lit("lb"), F.lit("kg")).alias("lb"), scalars.convert(F.lit(1.0), F.lit("lb"), F.lit("cm")).alias("none"),
        scalars.relative_jump(F.lit(1.0), F.lit(0.0)).alias("jump"), scalars.backoff_seconds(F.lit(3)).alias("wait"), scalars.sanitized_problem(F.lit("bad  'x' at 12.5")).alias("said"),
        F.size(F.array(scalars.local_date(F.lit("2024-11-03 04:30:00").cast("timestamp"), F.lit("America/New_York")))).alias("n"), scalars.local_date(F.lit("2024-11-03 03:30:00").cast("timestamp"), F.lit("America/New_York")).alias("day"),
    ).collect()[0]
    assert abs(one.lb - 69.85322498) < 1e-9 and one.none is None and one.jump is None and one.wait == 120 and one.said == "bad <redacted> at <redacted>" and one.day == dt.date(2024, 11, 2)


def test_recurrence_and_mirrors(spark):
    rows = spark.createDataFrame([(1, dt.date(2024, 1, 31), "monthly", 1, None, None, None), (2, dt.date(2024, 1, 1), "daily", 10, None, dt.date(2024, 1, 25), None), (3, dt.date(2024, 1, 3), "weekly", 2, [0, 2], None, 3)], "id int, start date, freq string, interval int, byweekday array<int>, until date, count int")
    got = {}
    for r in mirrors.expand(rows, F.lit(dt.date(2024, 1, 1)), F.lit(dt.date(2024, 4, 30))).collect():
        got.setdefault(r.id, []).append((r.occurs_on.month, r.occurs_on.day))
    assert got == {1: [(1, 31), (3, 31)], 2: [(1, 1), (1, 11), (1, 21)], 3: [(1, 3), (1, 15), (1, 17)]}


def test_outbox_moves_and_drain():
    with pytest.raises(outbox.IllegalTransition):
        outbox.check_transition("delivered", "pending")
    said = iter(["accepted", "enqueue_failed", RuntimeError("lost"), "rejected"])

    def wake(row, attempt):
        got = next(said)
        if isinstance(got, Exception):
            raise got
        return got

    rows = [{"event_id": i, "state": "pending", "attempt": a} for i, a in enumerate((0, 1, 0, 0))]
    got = outbox.drain(rows, wake, at(1))
    assert [r["state"] for r in got] == ["delivered", "pending", "unknown", "rejected"] and got[1]["next_attempt_at"] == at(1) + dt.timedelta(seconds=60)


def test_declarations(spark):
    good = schema.Signal("steps", (schema.Field("step_count", "integer", "count", low=0, nullable=False, aggregation="daily_total", trend="fluctuating"), schema.Field("raw", "object", visibility="never", privacy="restricted")), identity="source_event_id")
    assert schema.validate([good]) == [] and [f.name for f in good.struct()] == ["step_count"] and schema.visible(good) == ["step_count"]
    assert schema.dimensions(spark, [good]).count() == 2
    bad = schema.Signal("x", (schema.Field("a", "enum"), schema.Field("b", "string", aggregation="daily_sum"), schema.Field("b", trend="drifting")), storage="nowhere", dimensions=("z",))
    assert len(schema.validate([bad, bad])) >= 7


def test_built_in_declarations(spark):
    from daymark import signals

    assert len(signals.SIGNALS) == 33 and schema.validate(signals.SIGNALS) == []
    dims = schema.dimensions(spark, signals.SIGNALS)
    assert dims.count() == sum(len(s.fields) for s in signals.SIGNALS) and dims.where("signal = 'battery'").count() == 3
    assert ("battery", "current_only", "current", 0, 0) in schema.mapping(signals.SIGNALS)
    assert "coordinate" not in signals.BY_KEY["location_city"].struct().names


def test_pages_retention_and_subjects(spark):
    assert [retention.page_size(x) for x in (None, 0, 10_000, -5, 7)] == [50, 50, 500, 1, 7]
    df = facts(spark, [(d, 1, 1.0, None) for d in range(1, 11)])
    engine = Engine(df, df.where("observation_id = 9").select(*corrections.FACT))
    plan = spark.createDataFrame([("m", 3, -1)], "signal string, detail_days int, aggregate_days int")
    assert engine.run_retention(plan, F.lit(at(11))).count() == 7 and engine.run_retention(plan, F.lit(at(11)), dry_run=False).count() == 3
    kept, cut = engine.export_subject(1)
    assert kept["facts"].count() == 10 and cut is None and engine.purge_subject(1)["facts"].count() == 0
    kept, cut = engine.export_subject(1, cap=4)
    assert kept["facts"].count() == 4 and [tuple(r) for r in cut.collect()] == [("facts", True)]
    line = engine.list_timeline(1, "m", 500).collect()
    assert [r.retracted for r in line] == [False] * 9 + [True] and line[-1].value is None
    gen = spark.createDataFrame([("complete", dt.date(2024, 1, 1), dt.date(2024, 1, 3), [dt.date(2024, 1, d) for d in (1, 2, 3)], [], None, None), ("complete", dt.date(2024, 1, 1), dt.date(2024, 1, 3), [dt.date(2024, 1, 1)], [], None, None)], "status string, start date, end date, accounted array<date>, incomplete array<date>, active_start date, active_end date")
    assert [r.may_activate for r in retention.activatable(gen).orderBy(F.size("accounted")).collect()] == [False, True]


def test_streaming_rule_equals_the_batch_rule(spark, tmp_path, drained):
    from daymark.streaming import live

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    df = facts(spark, [(d, h, float((d * 7 + h * 5) % 11), None) for d in (1, 2, 3) for h in range(12)])
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in").withColumn("occurred_at", F.col("occurred_at").cast("timestamp"))
    q = live.threshold_hits(stream, 5.0).writeStream.format("memory").queryName("live_hits").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    drained(q, df.count())
    got = sorted(r.observation_id for r in spark.table("live_hits").collect())
    want = sorted(r.observation_id for r in rules.hits(df, rules.Definition("r", "m", "threshold_crossing", 5.0, fire="every")).collect())
    assert got == want and got


def test_touched_days_are_rebuilt(spark, tmp_path):
    from daymark.streaming import live

    run = live.rebuild_touched_days(f"{tmp_path}/facts", lambda f: daily.daily_sum(f), f"{tmp_path}/daily")
    df = facts(spark, [(1, 1, 1.0, None), (2, 1, 2.0, None), (1, 2, 5.0, None)])
    run(df.where("observation_id < 2"), 0)
    run(df.where("observation_id = 2"), 1)
    run(df.where("observation_id = 2"), 1)  # a batch that is run again
    assert {r.local_date.day: r.total for r in spark.read.parquet(f"{tmp_path}/daily").collect()} == {1: 6.0, 2: 2.0}


def test_rows_without_a_source_id_are_no_revisions_of_each_other(spark):
    rows = [(1, "a", None, at(1)), (2, "a", "x", at(1)), (3, "a", "x", at(2)), (4, "a", None, at(3)), (5, None, "z", at(1)), (6, None, "b", at(2)), (7, "n", "9", at(1)), (8, "n", "10", at(1))]
    df = spark.createDataFrame([(o, f, r, t, 0) for o, f, r, t in rows], "observation_id long, source_event_id string, revision string, occurred_at timestamp_ntz, top long")
    got = current.canonical_revisions(df, ["source_event_id"])
    assert got.columns == df.columns and sorted(r.observation_id for r in got.collect()) == [3, 5, 6, 8]


def test_a_long_streak_fires_once(spark):
    first = dt.date(2024, 1, 1)
    days = spark.createDataFrame([(1, "m", first + dt.timedelta(k), 9.0, "complete") for k in range(95)], "subject long, signal string, local_date date, value double, completeness string")
    edges = rules.streak_edges(trends.streaks(days, ("subject", "signal"), F.col("value") > 5), 90).collect()
    assert [r.local_date for r in edges] == [first + dt.timedelta(89)]
    need = spark.createDataFrame([("r", "m", "gt", 5.0, 90)], "definition_id string, signal string, operator string, threshold double, periods int")
    fired = [k for k in range(87, 95) if rules.scheduled_streaks(days, need, F.lit(first + dt.timedelta(k))).where("fires").count()]
    assert fired == [89]


def test_a_latch_opens_only_on_a_day_without_a_streak(spark):
    marks = {1: 1, 2: 1, 3: 1, 5: 1, 6: 0, 7: 1, 8: 1, 9: 0, 10: 1}  # day 4 is missing
    days = spark.createDataFrame([(1, dt.date(2024, 1, d), m) for d, m in marks.items()], "subject long, local_date date, m int")
    got = {r.local_date.day: r.reason for r in trends.latched(days, ("subject",), F.col("m") == 1, 2).collect()}
    assert got == {1: "streak_too_short", 2: "streak_reached", 3: "already_firing", 5: "already_firing", 6: "recovered", 7: "streak_too_short", 8: "streak_reached", 9: "recovered", 10: "streak_too_short"}


def test_refused_values_are_no_predecessors(spark):
    rows = facts(spark, [(1, k, v, None) for k, v in enumerate([10.0, 100.0, 11.0, 12.0, 500.0, 400.0, 0.0, 7.0])])
    assert sorted(r.observation_id for r in corrections.jump_conflicts_sequential(rows, 0.5).collect()) == [1, 4, 5, 6]


def test_days_of_23_and_25_hours(spark):
    spans = [(1, dt.datetime(2026, 11, 1, 4), dt.datetime(2026, 11, 2, 5)), (2, dt.datetime(2026, 3, 8, 5), dt.datetime(2026, 3, 9, 4)), (3, dt.datetime(2026, 3, 9, 3), dt.datetime(2026, 3, 9, 3)), (4, dt.datetime(2026, 3, 9, 4), dt.datetime(2026, 3, 9, 3))]
    df = spark.createDataFrame([(*x, "America/New_York") for x in spans], "k long, a timestamp_ntz, b timestamp_ntz, z string")
    got = {(r.k, str(r.local_day)): r.minutes for r in attribution.split_at_midnight(df, "a", "b", "z").collect()}
    assert got == {(1, "2026-11-01"): 1500.0, (2, "2026-03-08"): 1380.0}


def test_sync_rounds(spark):
    keys, cols = ["item"], "item long, subject long, source string, start_at timestamp_ntz, title string, last_seen_sync_id string"
    held = spark.createDataFrame([(1, 7, "h", at(5), "a", "s1"), (2, 7, "h", at(20), "b", "s1"), (3, 7, "h", None, "c", "s1"), (4, 8, "h", at(5), "d", "s1"), (5, 7, "w", at(5), "e", "s1"), (6, 7, "h", at(6), "f", "s1")], cols)
    new = spark.createDataFrame([(6, at(6), "F")], "item long, start_at timestamp_ntz, title string")
    none = spark.createDataFrame([], "item long")
    ids = lambda sync, gone=none: {r.item: r.title for r in mirrors.synced(held, new, gone, sync, keys).collect()}
    assert ids(mirrors.Sync(7, "h", "s2", "full", ("2024-01-01", "2024-01-10"))) == {2: "b", 3: "c", 4: "d", 5: "e", 6: "F"}
    assert ids(mirrors.Sync(7, "h", "s2"), spark.createDataFrame([(1,)], "item long")) == {2: "b", 3: "c", 4: "d", 5: "e", 6: "F"}
    assert ids(mirrors.Sync(7, "h", "s2", "full", error="timeout")) == {1: "a", 2: "b", 3: "c", 4: "d", 5: "e", 6: "f"}
    for bad in ({"snapshot": "full"}, {"snapshot": "x"}, {"covers": ("2024-02-01", "2024-01-01")}):
        with pytest.raises(ValueError):
            mirrors.Sync(7, "h", "s", **bad)


def test_facade_reads_days_and_trends(spark):
    df = facts(spark, [(d, h, float(d), None) for d in (1, 2, 3, 5) for h in (1, 2)])
    dims = spark.createDataFrame([("m", "v", "count", "fluctuating", "always"), ("m", "w", None, "none", "always"), ("m", "x", None, "drifting", "never")], "signal string, field string, unit string, trend string, visibility string")
    engine = Engine(df, tables={"dims": dims})
    day = lambda k: F.lit(dt.date(2024, 1, k))
    got = engine.get_trend(1, "m", "v", day(1), day(6)).collect()[0]
    assert (got.days_with_data, got.days_missing, got.days_incomplete, got.model, got.unit, got.current, got.delta) == (4, 2, 0, "fluctuating", "count", 5.0, 3.0)
    assert [engine.get_trend(1, "m", f, day(1), day(6)).collect()[0].reason for f in ("w", "x", "y")] == ["no_model", "not_visible", "not_declared"]
    gens = spark.createDataFrame([(1, "m", "daily", "g1", 1, dt.date(2024, 1, 1), dt.date(2024, 1, 4), [], [dt.date(2024, 1, 2), dt.date(2024, 1, 4)], ["late"], "active")], "subject long, signal string, kind string, generation_id string, aggregation_version int, start date, end date, accounted array<date>, incomplete array<date>, reasons array<string>, status string")
    rows = [(1, "m", "daily", "g1", dt.date(2024, 1, k), 1.0 * k, "complete", n, True) for k, n in ((1, 3), (2, 3), (3, 0))] + [(1, "m", "daily", "g0", dt.date(2024, 1, 1), 9.0, "complete", 3, True)]
    held = spark.createDataFrame(rows, "subject long, signal string, kind string, generation_id string, local_date date, value double, completeness string, observations int, recomputed boolean")
    shown = Engine(df, tables={"dims": dims, "generations": gens, "aggregates": held}).get_daily(1, "m", day(1), day(6)).collect()
    assert {r.local_date.day: (r.value, r.completeness, r.has_data) for r in shown} == {1: (1.0, "complete", True), 2: (2.0, "incomplete", True), 4: (None, "incomplete", False)}
    with pytest.raises(ValueError):
        Engine(df).list_reminders(1)


def test_refusals_and_permissions(spark):
    texts = ['bad "a \\" b" at -3.5e7', "it's 'x' v2 and 12", "x" * 300, None, "  two   words\n", "a-5 x1 -5 (7) 1 2", 'a "b \'c\' d" e', "open 'quote", '"a\\\\" 3']
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(scalars.sanitized_problem(F.col("t"))).collect()]
    assert got[0] == f"bad {scalars.REDACTED} at {scalars.REDACTED}" and got[2] == "x" * 253 + "..." and got[3] is None and got[4] == "two words"
    r = scalars.REDACTED
    assert got[5:] == [f"a-{r} x1 {r} ({r}) {r} {r}", f"a {r} e", "open 'quote", f"{r} {r}"]
    values = ["off", "FALSE ", "0", "denied", "on", "", None, "whatever"]
    got = [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").orderBy("k").select(projection.refusal(F.col("v"))).collect()]
    assert got == ["switch_off"] * 3 + ["not_permitted"] + [None] * 4


@pytest.mark.parametrize("pipeline_too", [True, False])
def test_entry_points_work_without_the_optional_part(tmp_path, pipeline_too):
    """On a copy from which the text operators are deleted, with or without the pipeline's file."""
    root = Path(__file__).resolve().parents[1]
    gone = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(root / "daymark", tmp_path / "daymark", ignore=gone)
    for name in ("__spark_entry__.py", *(() if pipeline_too else ("corpus_pipeline.py",))):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    code = (
        "import __spark_entry__ as e\n"
        "assert len(e.queries()) > 60 and set(e.oracle_sql()) <= set(e.queries())\n"
        "assert not any(k.startswith('op1') or k == 'pipeline' for k in e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)})
