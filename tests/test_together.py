"""Stored definitions together, decisions, counters, rebuilds and published changes: structure, edge cases, plain versions."""

import datetime as dt
import json
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from daymark.operators import counters, decisions, nested, refold, ruleset
from daymark.plans import catalogue, shown, together

SF = "/root/testdata/sf0.001"


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_fifty_definitions_take_one_scan_of_the_facts(spark):
    definitions = ruleset.parsed(together.stored_definitions(spark, SF))
    path = spark.read.parquet(f"{SF}/events.parquet")
    assert scans(path) == 1
    plan = ruleset.passed(together.ruled_facts(spark, SF), definitions)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("event_type") and plan.count("events.parquet") == 1  # the definitions come from another table
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_definitions_are_checked(spark):
    good = {"id": "a", "version": 2, "source": {"signal": "steps", "field": "n"}, "condition": {"type": "equals", "value": 3}, "event": {"type": "x"}}
    cases = {
        "good": (good, []),
        "occurrence": (good | {"condition": {"type": "occurrence"}}, []),
        "no object": ([1], ["definition: no object"]),
        "missing": ({"version": "1"}, ["id: required", "version: required", "source.signal: required", "condition.type: required", "event.type: required"]),
        "unknown": (good | {"condition": {"type": "sometimes"}}, ["condition.type: unknown sometimes"]),
        "never": (good | {"lifecycle": {"rearm": "never"}}, ["lifecycle: rearm never needs scope forever"]),
        "cooldown": (good | {"lifecycle": {"rearm": "cooldown"}}, ["lifecycle: rearm cooldown needs cooldown_seconds"]),
        "part": (good | {"lifecycle": {"fire": "twice"}}, ["lifecycle: unknown part"]),
        "when": (good | {"source": good["source"] | {"when": {"a": [1], "b": 2}}}, ["source.when: no scalar at a"]),
        "clock": (good | {"condition": {"type": "absence", "value": 9}, "source": good["source"] | {"when": {"a": 1}}}, ["source.when: a clock has no observation to look at"]),
        "periods": (good | {"condition": {"type": "streak", "operator": "gte"}}, ["condition.params.periods: above 0"]),
        "when kind": (good | {"source": good["source"] | {"when": "x"}}, ["source.when: no object"]),
    }
    rows = [(name, json.dumps(body)) for name, (body, _) in cases.items()] + [("null", None), ("broken", "{")]
    got = {r["name"]: r for r in ruleset.parsed(spark.createDataFrame(rows, "name string, body string")).collect()}
    assert {n: r.problems for n, r in got.items()} == {n: p for n, (_, p) in cases.items()} | {"null": ["definition: no object"], "broken": ["definition: no object"]}
    assert (got["good"].fire, got["occurrence"].fire, got["good"].wanted, got["good"].version) == ("once", "every", "3.0", 2)
    dims = spark.createDataFrame([("steps", "n", "count", "daily_sum")], "signal string, field string, unit string, aggregation string")
    assert [r.unit for r in ruleset.parsed(spark.createDataFrame(rows[:1], "name string, body string"), dims).collect()] == ["count"]


def test_preconditions_states_and_values_keep_their_kinds(spark):
    at = lambda h: dt.datetime(2024, 1, 1 + h // 24, h % 24)
    rows = [(1, at(1), '{"v":"1","on":true}'), (2, at(2), '{"v":1,"on":1}'), (3, at(3), '{"v":1.0,"on":true}'), (4, at(4), '{"v":null,"on":true}'), (5, at(30), '{"v":1,"on":true}'), (6, at(31), '{"on":true}')]
    facts = spark.createDataFrame([(1, "m", "app", str(i), i, t, t.date(), v) for i, t, v in rows], "subject long, signal string, source string, source_event_id string, observation_id long, occurred_at timestamp_ntz, local_date date, payload string")
    facts = facts.withColumn("fields", ruleset.payload_fields(F.parse_json("payload")))
    body = {"id": "a", "version": 1, "source": {"signal": "m", "field": "v", "when": {"on": True}}, "condition": {"type": "changed"}, "event": {"type": "x"}, "lifecycle": {"scope": "forever", "fire": "every"}}
    definitions = ruleset.parsed(spark.createDataFrame([(json.dumps(body),)], "body string"))
    got = ruleset.Evaluation(ruleset.passed(facts, definitions), F.lit(dt.date(2024, 1, 2)), F.lit(at(40)))
    events = {e.occurred_at: e for e in got.events().collect()}
    assert set(events) == {at(3), at(4), at(31)}  # the number 1 isn't true, text isn't number, a null before is no change, and the day's end passes on
    assert [d.observation_id for d in events[at(31)].fact_dependencies] == [5, 6] and events[at(3)].delivery_state == "pending"
    (state,) = got.states().collect()
    assert (state.scope, state.previous, state.fired) == ("forever@v1", None, 3)


def test_decisions_equal_a_fold(spark):
    rng = random.Random(1)

    def compare(a, b):
        if a is None or b is None:
            return (a is not None) - (b is not None)
        num = lambda x: int(x) if x.strip().lstrip("-").isdigit() else None
        if num(a) is not None and num(b) is not None:
            return (num(a) > num(b)) - (num(a) < num(b))
        return 0 if a == b else None

    rows = [(g, i, rng.randrange(3), rng.choice([None, "a", "b", "1", "2", "-3", " 2 ", "10"]), rng.choice([None, "x", "y"])) for g in range(150) for i in range(9)]
    want_fact, want_now = {}, {}
    for g in range(150):
        accepted, held = [], None
        for _, i, at, rev, c in [r for r in rows if r[0] == g]:
            cmps = [(compare(rev, r), x) for r, x in accepted]
            equal = [x for o, x in cmps if o == 0]
            got = ("duplicate" if c in equal else "conflict") if equal else "conflict" if any(o is None for o, _ in cmps) else "stale" if any(o == -1 for o, _ in cmps) else "accept"
            accepted += [(rev, c)] * (got == "accept")
            want_fact[g, i] = got
            order = compare(rev, held[1]) if held else None
            now = "replace" if held is None or at > held[0] else "ignore" if at < held[0] else "conflict" if order is None else "replace" if order > 0 else "ignore" if order < 0 else "ignore" if c is not None and c == held[2] else "conflict"
            held = (at, rev, c) if now == "replace" else held
            want_now[g, i] = now
    df = spark.createDataFrame(rows, "g long, observation_id long, occurred_at long, revision string, content string")
    assert {(r.g, r.observation_id): r.decision for r in decisions.fact_decisions(df, "revision", "content", ("g",), ("observation_id",)).collect()} == want_fact
    got = decisions.current_decisions(df.withColumn("availability", F.when(F.col("observation_id") % 2 == 0, "observed").otherwise("no_data")), "revision", "content", ("g",), ("observation_id",)).collect()
    assert {(r.g, r.observation_id): r.decision for r in got} == want_now
    assert all(r.advanced == (r.decision == "replace" and r.observation_id % 2 == 0) for r in got)


def test_counters_are_the_same_for_any_cut():
    rng = random.Random(2)
    for _ in range(4000):
        cells = [counters.Cell(float(rng.randrange(9)), rng.choice([None, 1.0, 2.0, 3.0]), rng.choice([None, "1", "2", "10", "b"]), rng.choice([None, None, None, "e", "f"])) for _ in range(rng.randrange(1, 9))]
        held = None
        for c in cells:
            held = counters.step(held, c)
        cuts = sorted(rng.sample(range(len(cells) + 1), min(len(cells), rng.randrange(3))))
        parts = [counters.summed_up(cells[a:b]) for a, b in zip([0, *cuts], [*cuts, len(cells)], strict=True)]
        left = parts[0]
        for p in parts[1:]:
            left = counters.joined(left, p)
        right = parts[-1]
        for p in reversed(parts[:-1]):
            right = counters.joined(p, right)
        now = None
        for p in parts:
            now = counters.entered(p, now)
        assert counters.entered(left, None) == counters.entered(right, None) == now == held
        for was in [counters.Cell(5.0, 2.0, None, None), counters.Cell(4.0, None, "2", "e"), counters.Cell(99.0, 2.0, "2", "f"), counters.Cell(7.0)]:
            plain = was
            for c in cells:
                plain = counters.step(plain, c)
            assert counters.entered(left, was) == counters.entered(right, was) == plain


def test_long_segments_have_short_summaries():
    rising = [counters.Cell(float(i), float(i)) for i in range(5000)]
    assert all(len(counters.summed_up(x)[0]) <= 2 for x in (rising, rising[::-1]))


def test_counter_fold_edge_cases(spark):
    schema = "subject long, signal string, local_date date, observation_id long, value double, at double"
    day = dt.date(2024, 1, 1)
    df = spark.createDataFrame([(1, "m", day, 1, 5.0, None), (1, "m", day, 2, None, 9.0), (1, "m", day, 3, 4.0, None), (None, "m", day, 4, 1.0, 2.0), (2, "m", day, 5, 8.0, 3.0), (2, "m", day, 6, 2.0, 4.0)], schema)
    fold = lambda rows: counters.arrival_fold(rows, ("observation_id",), F.col("observation_id") % 3, at=F.col("at"))
    assert {r.subject: r.total for r in fold(df.where("observation_id < 4 OR subject IS NULL OR subject = 2").withColumn("observation_id", F.col("observation_id"))).collect()}.keys() == {1, None, 2}
    by = {r.subject: r.total for r in counters.arrival_fold(df, ("observation_id",), F.lit(1), at=F.col("at")).collect()}
    assert by == {1: 5.0, None: 1.0, 2: 2.0}
    assert fold(df.limit(0)).collect() == []


# rebuilds, paging, stores


def test_instances_are_counted_as_they_are_expanded(spark):
    from daymark.operators import mirrors

    rng = random.Random(3)
    rows = []
    for i in range(300):
        start = dt.date(2023, 1, 1) + dt.timedelta(days=rng.randrange(400))
        rows.append((i, start, rng.choice(["daily", "weekly", "monthly"]), rng.randrange(1, 5), rng.choice([None, [0, 3], [6], [2, 2, 5]]), rng.choice([None, start + dt.timedelta(days=90)]), rng.choice([None, 1, 7]), start.isoformat() + "T09:15:00+01:00"))
    df = spark.createDataFrame(rows, "i int, start date, freq string, interval int, byweekday array<int>, until date, count int, start_text string")
    low, high = dt.date(2023, 11, 5), dt.date(2024, 3, 31)
    want = {}
    for i, start, freq, every, days, until, count, _ in rows:
        hits, day = [], start
        while day <= min(high, until or high):
            monday = lambda d: d - dt.timedelta(days=d.weekday())
            if freq == "daily":
                ok = (day - start).days % every == 0
            elif freq == "weekly":
                ok = day.weekday() in (days or [start.weekday()]) and (monday(day) - monday(start)).days // 7 % every == 0
            else:
                ok = day.day == start.day and ((day.year - start.year) * 12 + day.month - start.month) % every == 0
            hits += [day] * ok
            day += dt.timedelta(days=1)
        want[i] = [d for d in hits[: count or len(hits)] if d >= low][:200]
    got = {}
    for r in mirrors.expand(df, F.lit(low), F.lit(high)).collect():
        got.setdefault(r.i, []).append(r.occurs_on)
        assert r.occurs_at == r.occurs_on.isoformat() + "T09:15:00+01:00"
    assert {i: sorted(v) for i, v in got.items()} == {i: v for i, v in want.items() if v}
    counts = {r.i: r.n for r in df.select("i", mirrors._in_window(F.lit(low), F.lit(high), 200)[1].alias("n")).collect()}
    assert counts == {i: len(v) for i, v in want.items()}
    everything = [(i, k) for i in range(300) for k in range(len(want[i]))]
    pages, after = [], (0, 0)
    for _ in range(3):  # each page goes on where the last one ended, inside a series or between two
        page = mirrors.expanded_page(df.repartition(5), ("i",), F.lit(low), F.lit(high), 37, after).select("base", "inner").collect()
        pages += [(r.base, r.inner) for r in page]
        after = (page[-1].base, page[-1].inner + 1)
    assert pages == everything[: len(pages)] and len(pages) == 111


def retraction_tables(spark):
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    day = lambda d: dt.date(2024, 1, d)
    rows = []
    for n, (source, event, d, h, v, rev) in enumerate([("app", "a", 1, 1, 5.0, "1"), ("app", "a", 2, 2, 7.0, "2"), ("watch", "a", 1, 3, 9.0, None), ("app", "b", 1, 4, 2.0, None), ("app", "c", 3, 5, 4.0, None)]):
        rows.append((1, "m", source, event, n, at(d, h), day(d), "observed", rev, {"v": str(v)}, "m"))
    facts = spark.createDataFrame(rows, "subject long, signal string, source string, source_event_id string, observation_id long, occurred_at timestamp_ntz, local_date date, availability string, revision string, fields map<string,string>, dimension string")
    dims = spark.createDataFrame([("m", "v", "daily_sum", "source_event_id", None, -1, "current_timeline_aggregate")], "signal string, field string, aggregation string, identity string, state_field string, detail_days int, storage string")
    ref = lambda source, event: [("m", source, event)]
    events = spark.createDataFrame(
        [("e1", 1, "m", ref("app", "c"), True, "pending", False, 1.0, day(3), "t1"), ("e2", 1, "m", ref("app", "c"), True, "claimed", True, 2.0, day(3), "t2"), ("e3", 1, "m", ref("watch", "c"), True, "pending", False, 3.0, day(3), "t3"), ("e4", 1, "m", None, False, "delivered", True, 4.0, day(2), "t4"), ("e5", 2, "m", ref("app", "c"), True, "pending", False, 5.0, day(3), "t5")],
        "event_id string, subject long, signal string, fact_dependencies array<struct<signal:string,source:string,source_event_id:string>>, dependencies_complete boolean, state string, started boolean, value double, local_date date, token string",
    )
    return facts, dims, events


def test_a_correction_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    from daymark import store
    from daymark.operators import corrections, current, publishing, refold

    facts, dims, events = retraction_tables(spark)
    new = spark.createDataFrame([(1, "m", "app", "c"), (1, "m", "app", "zz")], "subject long, signal string, source string, source_event_id string")
    s = store.Store(spark, str(tmp_path / "s"))
    assert s.snapshot().number == 0
    docs = refold.documents(facts, dims)
    now = current.current(refold.details(facts, dims), ["subject", "signal", "dimension"]).select("subject", "signal", "dimension", "observation_id", "occurred_at", "fields", F.lit("observed").alias("availability"))
    change = store.Change
    s.publish("first", {"facts": change(facts, "local_date"), "retractions": change(new.limit(0)), "documents": change(docs, "local_date"), "current": change(now), "events": change(events, "local_date")})
    seen = lambda: ({r.event_id: (r.state, r.value, r.token) for r in s.table("events").collect()}, {r.local_date.day: r.total for r in s.table("documents").collect()}, [r.observation_id for r in s.table("current").collect()], s.table("retractions").count())
    before = seen()
    assert before[1] == {1: 11.0, 2: 7.0, 3: 4.0} and before[2] == [4]
    real, calls = store.Store._write, []

    def dies(self, *args):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return real(self, *args)

    monkeypatch.setattr(store.Store, "_write", dies)
    with pytest.raises(RuntimeError):
        publishing.publish_retractions(s, "r1", new, dims)
    assert seen() == before and s.snapshot().number == 1  # two tables were written, none is seen
    monkeypatch.setattr(store.Store, "_write", real)
    flip = store.Store._flip

    def halts(self, number, change_id, tables):
        assert self._claims(self._path(f"{self.root}/_numbers/{number}"), change_id) or True
        raise RuntimeError("lost between the mark and the list")

    (tmp_path / "s" / "_numbers").mkdir(exist_ok=True)
    monkeypatch.setattr(store.Store, "_flip", halts)
    with pytest.raises(RuntimeError):
        publishing.publish_retractions(s, "r1", new, dims)
    assert seen() == before
    monkeypatch.setattr(store.Store, "_flip", flip)
    with pytest.raises(store.Overtaken):  # another change can't take the number that r1 holds
        s.publish("other", {"current": change(now)})
    done = publishing.publish_retractions(s, "r1", new, dims)
    after = seen()
    assert done.number == 2 and after[1] == {1: 11.0, 2: 7.0} and after[2] == [1] and after[3] == 2
    assert after[0] == {"e1": ("invalidated", None, None), "e2": ("unknown", None, "t2"), "e3": ("pending", 3.0, "t3"), "e4": ("delivered", None, None), "e5": ("pending", 5.0, "t5")}
    kept = s.snapshot().tables["events"]["folders"]
    assert publishing.publish_retractions(s, "r1", new, dims).number == 2 and s.snapshot().tables["events"]["folders"] == kept  # again: nothing more
    assert {r.event_id for r in s.table("events", s.snapshot(1)).where("state = 'pending'").collect()} == {"e1", "e3", "e5"}  # older readers keep their list
    with pytest.raises(store.Overtaken):
        s.publish("late", {"current": change(now)}, s.snapshot(1))
    assert s.table("facts", parts=["2024-01-01"]).count() == 3
    assert corrections.affected_days(facts, new).count() == 1


def test_merges_and_retention_are_published_by_parts(spark, tmp_path):
    from daymark import store
    from daymark.operators import publishing

    day = lambda d: dt.date(2024, 1, d)
    rows = [(1, "m", "daily", "g1", 1, day(d), "complete", [], 0, 1.0 * d) for d in (1, 2, 3)]
    cols = "subject long, signal string, kind string, generation_id string, aggregation_version int, local_date date, completeness string, reasons array<string>"
    held = spark.createDataFrame(rows, cols + ", version long, value double")
    gens = spark.createDataFrame([(1, "m", "daily", "g1", 1, day(1), day(3), [day(1), day(2), day(3)], [], [], "active")], "subject long, signal string, kind string, generation_id string, aggregation_version int, start date, end date, accounted array<date>, incomplete array<date>, reasons array<string>, status string")
    facts = spark.createDataFrame([("m", 1, day(d)) for d in (1, 2, 3, 6)], "signal string, observation_id int, local_date date")
    s = store.Store(spark, str(tmp_path / "s"))
    s.publish("0", {"aggregates": store.Change(held, "local_date"), "generations": store.Change(gens), "facts": store.Change(facts, "local_date")})
    batch = spark.createDataFrame([(1, "m", "daily", "g1", 1, day(6), "complete", [], 60.0, 1), (1, "m", "daily", "g1", 1, day(2), "complete", [], 21.0, 2), (1, "m", "daily", "g1", 1, day(2), "complete", [], 22.0, 3), (2, "m", "daily", None, 1, day(2), "incomplete", ["x"], 5.0, 4)], cols + ", value double, ord int")
    old = s.snapshot().tables["aggregates"]["folders"]
    batch = batch.withColumn("version", F.lit(None).cast("long")).select(*[c for c in batch.columns if c != "ord"], "ord")
    publishing.publish_merge(s, "1", batch, "ord")
    new = s.snapshot().tables["aggregates"]["folders"]
    assert new["2024-01-01"] == old["2024-01-01"] and new["2024-01-02"] != old["2024-01-02"] and set(new) == {"2024-01-01", "2024-01-02", "2024-01-03", "2024-01-06"}
    got = {(r.subject, r.local_date.day): (r.value, r.version, r.completeness) for r in s.table("aggregates").collect()}
    assert got == {(1, 1): (1.0, 0, "complete"), (1, 2): (22.0, 2, "complete"), (1, 3): (3.0, 0, "complete"), (1, 6): (60.0, 0, "complete"), (2, 2): (5.0, 0, "incomplete")}
    g = {r.subject: r for r in s.table("generations").collect()}
    assert [d.day for d in g[1].incomplete] == [4, 5] and g[1].reasons == ["unaccounted_bootstrap_gap"] and g[1].end == day(6)
    assert (g[2].generation_id, g[2].status, g[2].reasons) == ("legacy-v1", "incomplete", ["x"])
    plan = spark.createDataFrame([("m", 4, 2)], "signal string, detail_days int, aggregate_days int")
    publishing.publish_retention(s, "2", plan, F.lit(dt.datetime(2024, 1, 7)))
    assert sorted(r.local_date.day for r in s.table("facts").collect()) == [3, 6] and [r.local_date.day for r in s.table("aggregates").collect()] == [6]
    g = {r.subject: r for r in s.table("generations").collect()}
    assert (g[1].start, [d.day for d in g[1].accounted], [d.day for d in g[1].incomplete]) == (day(5), [6], [5]) and g[2].status == "incomplete"


def test_identities_are_filled_in_and_contradictions_kept(spark):
    from daymark.operators import publishing

    day = dt.date(2024, 1, 1)
    schema = "subject int, signal string, source string, digest string, fact_key string, dimension_key string, local_date date, content_digest string"
    held = [(1, "m", "s", "a", None, None, None, None), (1, "m", "s", "b", "f", None, None, None), (1, "m", "s", "c", "f", "d", day, "x"), (1, "m", "s", "d", "f", None, None, None), (1, "m", "s", "e", None, None, None, None)]
    new = [(1, "m", "s", "a", "f", "d", day, "x"), (1, "m", "s", "b", "f", "d", day, None), (1, "m", "s", "c", "g", "d", day, "x"), (1, "m", "s", "d", "g", "d", None, None)]
    got = {r.digest: r for r in publishing.backfilled(spark.createDataFrame(held, schema), spark.createDataFrame(new, schema)).collect()}
    assert {k: (r.fact_key, r.dimension_key, r.local_date, r.conflict) for k, r in got.items()} == {"a": ("f", "d", day, False), "b": ("f", "d", day, False), "c": ("f", "d", day, True), "d": ("f", None, None, True), "e": (None, None, None, False)}


def test_documents_of_odd_facts(spark):
    from daymark.operators import refold

    facts, dims, _ = retraction_tables(spark)
    assert refold.documents(facts.limit(0), dims).collect() == []
    kinds = [("duration_by_state", ['"walk"', "true", None, '{"state":"run"}', '"walk"']), ("event_list", ['[{"id":"1"},{"id":"1","x":2},{"note":"n"}]', "no list", None, '[{"title":"t"}]', "[]"]), ("main_of_day", ["1.0", None, '"x"', None, None]), ("numeric_dist", ["1.0", '"x"', "true", None, "3.0"])]
    for strategy, texts in kinds:
        rows = [(1, "m", "s", None, i, dt.datetime(2024, 1, 1, i), dt.date(2024, 1, 1), "observed", None, {"v": t}) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "subject long, signal string, source string, source_event_id string, observation_id long, occurred_at timestamp_ntz, local_date date, availability string, revision string, fields map<string,string>")
        (doc,) = refold.documents(df, dims.withColumn("aggregation", F.lit(strategy))).collect()
        if strategy == "duration_by_state":
            assert doc.minutes == {"walk": 60.0, "focused": 120.0, "run": 60.0}
        elif strategy == "event_list":
            assert [json.loads(e) for e in doc.events] == [{"id": "1"}, {"title": "t"}]
        elif strategy == "main_of_day":
            assert doc.main_value == '"x"'
        else:
            assert (doc.min_value, doc.max_value, doc.sum_value, doc.n) == (1.0, 3.0, 4.0, 2)


def test_spaced_rows_are_those_of_a_loop(spark):
    from daymark.operators import rules

    rng = random.Random(5)
    rows = [(rng.choice([None, "a", "b"]), i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(4000))) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, i int, t timestamp_ntz")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.i for r in rules.spaced(df, ("g",), ("t", "i"), "t", F.lit(300.0)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = set()
    for g in (None, "a", "b"):
        last = None
        for _, i, t in sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1])):
            if last is None or (t - last).total_seconds() >= 300:
                want.add(i)
                last = t
    assert got == want


def test_wake_facts_keep_kinds_and_photos(spark):
    from daymark.operators import projection

    rows = [("photo_added", "p" * 300, "s", "noon", '{"locale":"de","broadcast_active":true,"motion_state":1.5,"secret":1,"now_playing":{"a":1},"place_label":"' + "x" * 300 + '"}'), ("scene_change", "p", "s", "noon", '{"broadcast_state":3}'), ("other", "p", "s", "noon", "{}")]
    df = spark.createDataFrame(rows, "trigger string, photo_id string, scene string, time_of_day string, hints string")
    df = df.select("trigger", F.lit("w").alias("wake_id"), F.lit("x").alias("source"), F.lit("c").alias("change_digest"), F.array(F.lit("r")).alias("origin_refs"), F.try_variant_get(F.parse_json("hints"), "$", "map<string,variant>").alias("presence_hints"), "photo_id", "scene", "time_of_day")
    got = {r.trigger: r for r in projection.wake_facts(df).withColumn("presence_hints", F.transform_values("presence_hints", lambda _, v: F.to_json(v))).collect()}
    assert set(got) == {"photo_added", "scene_change"}
    assert got["photo_added"].presence_hints == {"locale": '"de"', "broadcast_active": "true", "motion_state": "1.5", "place_label": '"' + "x" * 200 + '"'}
    assert (len(got["photo_added"].photo_id), got["photo_added"].time_of_day) == (160, "noon") and got["scene_change"].photo_id is None and got["scene_change"].presence_hints == {"broadcast_state": "3"}


def test_first_clicks_of_a_subject_are_of_another_version_too(spark, tmp_path):
    con = duckdb.connect()
    # every other subject has no clicks before the batch
    con.execute(f"COPY (SELECT * FROM '{SF}/events.parquet' WHERE NOT (event_type = 'click' AND user_id % 2 = 0 AND ts < TIMESTAMP '2024-01-20')) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    for name in ("aggregate_merge", "aggregate_merge_generations"):
        cur = con.execute(catalogue.ORACLE_SQL[name])
        names = [c[0] for c in cur.description]
        assert sorted(map(repr, map(tuple, catalogue.QUERIES[name](spark, str(tmp_path)).select(names).collect()))) == sorted(map(repr, cur.fetchall()))


def test_rebuilds_deal_no_facts_by_their_signal(spark):
    # a few signals hold all facts, so that a few tasks would sort them
    facts, dims, gone = together.detailed(spark, SF), together.declarations(spark), together.gone(spark, SF)
    for df in (refold.documents(facts, dims, gone), refold.coverage(facts, dims, gone), catalogue.QUERIES["generation_refold"](spark, SF), catalogue.QUERIES["trend_by_field"](spark, SF)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"SortMergeJoin \[signal#\d+\], ", plan) and not re.search(r"SortMergeJoin \[signal#\d+, field#\d+\], ", plan)
        assert "BroadcastHashJoin [signal" in plan


def test_payloads_are_checked_where_they_are(spark):
    raw, dims = shown.nested_rows(spark, SF), spark.createDataFrame(shown.DECLARED, shown.FIELDS)
    plan = nested.ingested(raw, dims)._jdf.queryExecution().executedPlan().toString()
    # four of five payloads are of one signal: dealt by it they would be checked by one task
    assert "BroadcastHashJoin [signal" in plan and "SortMergeJoin" not in plan


def test_the_rule_pass_carries_no_definitions_through_its_second_sort(spark):
    definitions = ruleset.parsed(together.stored_definitions(spark, SF)).where("problems IS NOT NULL").localCheckpoint()
    plan = ruleset.passed(together.ruled_facts(spark, SF), definitions)._jdf.queryExecution().optimizedPlan().toString()
    windows = [k for k, line in enumerate(plan.splitlines()) if " Window [" in line]
    joins = [k for k, line in enumerate(plan.splitlines()) if re.search(r"Join Inner.*view#", line)]
    assert any(k < windows[0] for k in joins)  # the definitions come back behind the last window
    marks = ruleset.passed(together.ruled_facts(spark, SF), definitions)
    assert set(ruleset.hits(marks, ()).columns) == {*ruleset._SCOPE, *ruleset._LIFE}
