"""Live rules with maps and timers in their state against the batch rules, over shuffled batches and a restart."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from daymark.operators import rules
from daymark.streaming import live

SCHEMA = "subject long, signal string, occurred_at timestamp_ntz, observation_id long, local_date date, occurrence_key string"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def fed(spark, tmp_path, drained, name, batches, plan):
    """Rows that plan makes of batches fed one by one, the query being stopped and started again between them."""
    source, check, out = (str(tmp_path / f"{name}-{x}") for x in ("in", "check", "out"))
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        query = plan(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        drained(query, len(rows))
    return spark.read.parquet(out).collect()


def test_live_occurrences_equal_the_batch_rule(rocks, tmp_path, drained):
    rng = random.Random(1)
    day = dt.date(2024, 1, 1)
    rows = [(rng.randrange(3), "m", dt.datetime(2024, 1, 1, 0, 0, i), i, day, rng.choice([None, "", *"abcdef"])) for i in range(60)]
    rng.shuffle(rows)
    got = fed(rocks, tmp_path, drained, "o", [rows[:25], rows[25:], rows[:10]], live.occurrence_hits)
    batch = rules.hits(rocks.createDataFrame([r for r in rows if r[5]], SCHEMA), rules.Definition("r", "m", "occurrence"), "occurrence_key", occurrence_key="occurrence_key")
    assert sorted((r.subject, r.occurrence_key) for r in got) == sorted((r.subject, r.occurrence_key) for r in batch.collect())


def test_of_many_keys_the_oldest_are_forgotten(rocks, tmp_path, drained):
    at = lambda i: (1, "m", dt.datetime(2024, 1, 1, 0, 0, i), i, dt.date(2024, 1, 1), "abcd"[i % 4] if i < 8 else "d")
    got = fed(rocks, tmp_path, drained, "k", [[at(i) for i in range(9)]], lambda s: live.occurrence_hits(s, most=3))
    assert [(r.observation_id, r.occurrence_key) for r in sorted(got, key=lambda r: r.observation_id)] == [(i, "abcd"[i % 4]) for i in range(8)]  # each came back after three others; d was still there


def test_live_absences_equal_the_batch_rule(rocks, tmp_path, drained):
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.randrange(3), rng.choice("mn"), start + dt.timedelta(minutes=rng.randrange(6000)), i, start.date(), None) for i in range(60)]
    rows.sort(key=lambda r: r[2])
    near = rows[:20], rows[20:40], rows[40:]  # batches follow each other; inside of one, and by an hour across two, order is lost
    batches = [rng.sample(list(b), len(b)) for b in near]
    batches[0], batches[1] = batches[0] + batches[1][:2], batches[1][2:] + batches[0][:3]
    end = start + dt.timedelta(days=9)
    batches += [[(9, "m", end, 99, start.date(), None)], [(9, "m", end + dt.timedelta(days=1), 100, start.date(), None)]]
    got = fed(rocks, tmp_path, drained, "a", batches, lambda s: live.absences(s, 6 * 3600, "3 days"))
    facts = rocks.createDataFrame(rows, SCHEMA)
    want = rules.silences(facts, 6 * 3600, F.lit(end - dt.timedelta(days=3)).cast("timestamp_ntz")).collect()
    assert sorted((r.subject, r.signal, r.last_seen) for r in got if r.subject != 9) == sorted((r.subject, r.signal, r.last_seen) for r in want)
    assert want
