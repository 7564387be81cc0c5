"""The catalogue of queries: name -> Spark plan in QUERIES, and the equivalent SQL in ORACLE_SQL.

events are observations (user: subject, type: signal, props.k: revision, dimension, epoch or place), orders a series
over years per customer, lineitem shipments by state, conversations ordered occurrences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import corrections, current, daily, digest, ingest, mirrors, outbox, retention, rules, trends
from ..sources.facts import event_facts, line_facts, order_facts, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NOW, TODAY = "2024-01-31 00:00:00", "2024-01-31"
#: The facts in SQL.
EV = "(SELECT user_id AS subject, event_type AS signal, ts AS occurred_at, event_id AS observation_id, value, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(ts AS DATE) AS local_date, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"
SERIES = f"(SELECT subject, signal, local_date, max(cents) / 100.0::DOUBLE AS v FROM {EV} GROUP BY ALL)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def daily_max(s: SparkSession, d: str) -> DataFrame:
    """A value a day for the trend queries."""
    return daily.numeric_dist(event_facts(s, d), "cents").select("subject", "signal", "local_date", (F.col("max_value") / 100).alias("value"))


# daily aggregates


@query(f"SELECT subject, signal, local_date, min(cents) AS min_value, max(cents) AS max_value, sum(cents)::BIGINT AS sum_value, count(*) AS n FROM {EV} GROUP BY ALL")
def daily_numeric_dist(s, d):
    return daily.numeric_dist(event_facts(s, d), "cents")


@query(f"SELECT subject, signal, local_date, arg_max(value, (occurred_at, value)) AS total FROM {EV} GROUP BY ALL")
def daily_cumulative_latest(s, d):
    return daily.cumulative_latest(event_facts(s, d))


@query(f"""SELECT subject, signal, local_date, arg_max(value, (occurred_at, observation_id)) AS total,
  sum(CASE WHEN was IS NOT NULL AND k % 3 <> was THEN 1 ELSE 0 END)::BIGINT AS restarts
  FROM (SELECT *, lag(k % 3) OVER (PARTITION BY subject, signal, local_date ORDER BY occurred_at, observation_id) AS was FROM {EV}) GROUP BY ALL""")
def daily_counter_epoch_reset(s, d):
    return daily.cumulative_epochs(event_facts(s, d).withColumn("epoch", F.col("k") % 3), "epoch")


@query(f"SELECT subject, signal, local_date, sum(cents)::BIGINT AS total, count(*) AS n FROM {EV} GROUP BY ALL")
def daily_sum_count(s, d):
    return daily.daily_sum(event_facts(s, d), "cents")


@query(f"SELECT subject, signal, local_date, count(*)::DOUBLE AS total FROM {EV} GROUP BY ALL")
def daily_occurrence(s, d):
    return daily.occurrences(event_facts(s, d))


@query(f"SELECT subject, signal, local_date, arg_max(v, (occurred_at, observation_id)) FILTER (v IS NOT NULL) AS main_value, max(occurred_at) AS at FROM (SELECT *, CASE WHEN k % 5 > 0 THEN value END AS v FROM {EV}) GROUP BY ALL")
def main_of_day(s, d):
    return daily.main_of_day(event_facts(s, d).withColumn("value", F.when(F.col("k") % 5 > 0, F.col("value"))))


@query(f"""SELECT subject, local_date, state, sum(date_diff('microsecond', occurred_at, until))::BIGINT / 60000000.0::DOUBLE AS minutes FROM (
  SELECT subject, local_date, occurred_at, last_value(st IGNORE NULLS) OVER w AS state, lead(occurred_at) OVER (PARTITION BY subject, local_date ORDER BY occurred_at, observation_id) AS until
  FROM (SELECT *, CASE WHEN k % 4 > 0 THEN signal END AS st FROM {EV}) WINDOW w AS (PARTITION BY subject, local_date ORDER BY occurred_at, observation_id ROWS UNBOUNDED PRECEDING))
  WHERE state IS NOT NULL AND until IS NOT NULL GROUP BY ALL""")
def state_dwell(s, d):
    return daily.state_dwell(event_facts(s, d).withColumn("st", F.when(F.col("k") % 4 > 0, F.col("signal"))), "st", ("subject", "local_date"))


@query(f"SELECT subject, local_date, array_to_string(list_sort(list(DISTINCT 'p' || (k % 7))), ',') AS visited FROM {EV} GROUP BY ALL")
def place_dwell_visited(s, d):
    got = daily.visited(event_facts(s, d).withColumn("place", F.concat(F.lit("p"), (F.col("k") % 7).cast("string"))), "place", ("subject", "local_date"))
    return got.select("subject", "local_date", F.array_join("visited", ",").alias("visited"))


@query("""SELECT *, sum(minutes) OVER (PARTITION BY subject, local_date) AS total FROM (SELECT l_suppkey AS subject, l_shipdate::DATE AS local_date, l_returnflag AS state, sum(l_quantity) AS minutes FROM lineitem GROUP BY ALL)""")
def duration_sum_by_state(s, d):
    return daily.duration_sum_by_state(line_facts(s, d), "state", "value", ("subject", "local_date"))


@query(f"""SELECT subject, signal, local_date, observation_id, row_number() OVER (PARTITION BY subject, signal, local_date ORDER BY occurred_at, observation_id)::INT AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY subject, signal, local_date, k % 3 ORDER BY occurred_at, observation_id) AS n FROM {EV}) WHERE n = 1""")
def event_list_dedup(s, d):
    rows = event_facts(s, d).withColumn("ident", F.col("k") % 3)
    return daily.event_list(rows, ["ident"]).select("subject", "signal", "local_date", "observation_id", "place")


@query(f"""WITH x AS (SELECT subject, local_date, lag(k % 6) OVER w AS track, lag(signal <> 'error') OVER w AS playing, lag(occurred_at) OVER w AS since, occurred_at FROM {EV} WINDOW w AS (PARTITION BY subject, local_date ORDER BY occurred_at, observation_id)),
  y AS (SELECT subject, local_date, track, sum(date_diff('microsecond', since, occurred_at))::BIGINT / 60000000.0::DOUBLE AS minutes FROM x WHERE playing AND track IS NOT NULL GROUP BY ALL)
  SELECT *, row_number() OVER (PARTITION BY subject, local_date ORDER BY minutes DESC, track)::INT AS place FROM y QUALIFY place <= 3""")
def tally_top(s, d):
    return daily.tally(event_facts(s, d).withColumn("track", F.col("k") % 6), "track", F.col("signal") != "error", 3)


@query(f"SELECT subject, signal, local_date, string_agg(observation_id::VARCHAR, ',' ORDER BY occurred_at, observation_id) AS entries FROM {EV} GROUP BY ALL")
def subjective_entries(s, d):
    got = daily.subjective(event_facts(s, d).withColumn("entry", F.col("observation_id").cast("string")), "entry")
    return got.select("subject", "signal", "local_date", F.array_join(F.transform("entries", lambda e: e["value"]), ",").alias("entries"))


# current values


@query(f"SELECT subject, signal, k % 4 AS dim, arg_max(observation_id, (occurred_at, observation_id)) AS observation_id, arg_max(value, (occurred_at, observation_id)) AS value FROM {EV} GROUP BY ALL")
def current_by_dimension(s, d):
    rows = event_facts(s, d).withColumn("dim", F.col("k") % 4)
    return current.current(rows, ("subject", "signal", "dim")).select("subject", "signal", "dim", "observation_id", "value")


@query(f"""WITH c AS (SELECT subject, signal, arg_max(value, (occurred_at, observation_id)) AS v, max(occurred_at) AS as_of FROM {EV} GROUP BY ALL)
  SELECT subject, signal, as_of, v AS last_known, CASE WHEN f THEN v END AS value, CASE WHEN f THEN 'fresh' ELSE 'stale' END AS status
  FROM (SELECT *, date_sub('second', as_of, TIMESTAMP '{NOW}') <= CASE signal WHEN 'view' THEN 86400 WHEN 'click' THEN 3600 ELSE 43200 END AS f FROM c)""")
def current_ttl_state(s, d):
    ttl = F.when(F.col("signal") == "view", 86400).when(F.col("signal") == "click", 3600).otherwise(43200)
    got = current.with_freshness(current.current(event_facts(s, d)), now(), ttl)
    return got.select("subject", "signal", F.col("occurred_at").alias("as_of"), "last_known", "value", "status")


@query(f"""SELECT subject, signal, observation_id, last_value(CASE WHEN k % 3 > 0 THEN value END IGNORE NULLS) OVER (PARTITION BY subject, signal ORDER BY occurred_at, observation_id ROWS UNBOUNDED PRECEDING) AS last_known FROM {EV}""")
def last_known_fill(s, d):
    return current.carried(event_facts(s, d), F.when(F.col("k") % 3 > 0, F.col("value"))).select("subject", "signal", "observation_id", "last_known")


@query(f"""SELECT observation_id, coalesce(occurred_at > max(occurred_at) OVER (PARTITION BY subject, signal ORDER BY k, observation_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS advanced FROM {EV}""")
def current_advances(s, d):
    return current.advances(event_facts(s, d), ("k", "observation_id")).select("observation_id", "advanced")


@query("""SELECT a, b, CASE WHEN a IS NULL AND b IS NULL THEN 0 WHEN a IS NULL THEN -1 WHEN b IS NULL THEN 1 WHEN regexp_full_match(a, '-?[0-9]+') AND regexp_full_match(b, '-?[0-9]+') THEN sign(a::BIGINT - b::BIGINT)::INT WHEN a = b THEN 0 END AS compared
  FROM (SELECT DISTINCT CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN 'r' || (k % 2) ELSE k::VARCHAR END AS a, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 7 = 1 THEN 'r' || (k % 2) ELSE (k % 10)::VARCHAR END AS b FROM """ + EV + ")")
def revision_compare(s, d):
    k = F.col("k")
    label = F.concat(F.lit("r"), (k % 2).cast("string"))
    rows = event_facts(s, d).select(F.when(k % 5 == 0, None).when(k % 5 == 1, label).otherwise(k.cast("string")).alias("a"), F.when(k % 7 == 0, None).when(k % 7 == 1, label).otherwise((k % 10).cast("string")).alias("b"))
    return rows.distinct().withColumn("compared", current.compare_revisions(F.col("a"), F.col("b")))


#: Facts of two sources that give the same ids to different things.
FACTS = f"(SELECT *, CASE WHEN k % 2 = 0 THEN 'app' ELSE 'watch' END AS source, observation_id % 16 AS source_event_id, CASE WHEN observation_id % 4 > 0 THEN k END AS revision FROM {EV})"


def revised(s, d):
    """Facts of two sources that several observations revise; ids of the two mean different things."""
    rows = event_facts(s, d).withColumn("source", F.when(F.col("k") % 2 == 0, "app").otherwise("watch"))
    return rows.withColumn("source_event_id", F.col("observation_id") % 16).withColumn("revision", F.when(F.col("observation_id") % 4 > 0, F.col("k")))


@query(f"""SELECT observation_id, source, source_event_id, revision FROM (SELECT *, max(revision) OVER (PARTITION BY subject, signal, source, source_event_id) AS top,
  row_number() OVER (PARTITION BY subject, signal, source, source_event_id ORDER BY revision DESC NULLS LAST, occurred_at DESC, observation_id DESC) AS n FROM {FACTS}) WHERE top IS NULL OR n = 1""")
def canonical_revision(s, d):
    return current.canonical_revisions(revised(s, d), corrections.FACT).select("observation_id", "source", "source_event_id", "revision")


@query(f"""SELECT subject, signal, count(DISTINCT k % 10) AS contents FROM (SELECT *, max(local_date) OVER (PARTITION BY subject, signal) AS top FROM {EV}) WHERE local_date = top GROUP BY ALL HAVING contents > 1""")
def current_conflicts(s, d):
    rows = event_facts(s, d).withColumn("occurred_at", F.col("local_date")).withColumn("revision", F.lit(1)).withColumn("content", F.col("k") % 10)
    return current.conflicts(rows, "content")


@query(f"SELECT observation_id, CASE WHEN k % 4 = 0 THEN signal || chr(31) ELSE signal || chr(31) || (k % 4) END AS dimension_key FROM {EV}")
def dimension_keys(s, d):
    return event_facts(s, d).select("observation_id", current.dimension_key(F.col("signal"), F.col("k") % 4).alias("dimension_key"))


# corrections


RETRACTED = "source = 'app' AND source_event_id % 5 = 3"


def gone(s, d):
    """A fifth of one source's facts is retracted; the other's of the same ids aren't."""
    return revised(s, d).where(RETRACTED).select(*corrections.FACT)


GONE = f"(SELECT DISTINCT subject, signal, source, source_event_id FROM {FACTS} WHERE {RETRACTED})"


@query(f"SELECT subject, signal, local_date, sum(cents)::BIGINT AS total, count(*) AS n FROM {FACTS} f WHERE NOT EXISTS (SELECT 1 FROM {GONE} g WHERE g.subject = f.subject AND g.signal = f.signal AND g.source = f.source AND g.source_event_id = f.source_event_id) GROUP BY ALL")
def daily_without_retracted(s, d):
    return daily.daily_sum(corrections.without_retracted(revised(s, d), gone(s, d)), "cents")


@query(f"""SELECT observation_id, {RETRACTED} AS retracted, CASE WHEN {RETRACTED} THEN 'unavailable' ELSE 'observed' END AS availability, CASE WHEN NOT ({RETRACTED}) THEN value END AS value FROM {FACTS}""")
def retracted_timeline(s, d):
    return corrections.timeline(revised(s, d).withColumn("availability", F.lit("observed")), gone(s, d)).select("observation_id", "retracted", "availability", "value")


@query(f"SELECT subject, signal, k, min(observation_id) AS observation_id FROM {EV} GROUP BY ALL")
def dedupe_first_delivery(s, d):
    return corrections.first_deliveries(event_facts(s, d), ("subject", "signal", "k"), ("observation_id",)).select("subject", "signal", "k", "observation_id")


@query(f"""SELECT observation_id, CASE WHEN n = 0 THEN 'accept' WHEN k > top THEN 'accept' WHEN k < top THEN 'stale' WHEN c = held THEN 'duplicate' ELSE 'conflict' END AS decision FROM (
  SELECT *, count(*) OVER w AS n, max(k) OVER w AS top, arg_max(c, k) OVER w AS held FROM (SELECT *, k % 2 AS c, observation_id % 500 AS source_event_id FROM {EV})
  WINDOW w AS (PARTITION BY source_event_id ORDER BY observation_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
def revision_decisions(s, d):
    rows = event_facts(s, d).withColumn("source_event_id", F.col("observation_id") % 500).withColumn("content", F.col("k") % 2)
    return corrections.decide(rows, "k", "content", ("source_event_id",), ("observation_id",)).select("observation_id", "decision")


@query(f"SELECT subject, signal, k FROM {EV} GROUP BY ALL HAVING count(DISTINCT cents % 5) > 1")
def ambiguous_batch_facts(s, d):
    rows = event_facts(s, d).withColumn("content", F.col("cents") % 5).withColumn("revision", F.lit(1))
    return corrections.ambiguous_facts(rows, "revision", "content", ("subject", "signal", "k"))


@query(f"""SELECT observation_id, previous, abs(value - previous) / abs(previous) AS jump FROM (SELECT *, lag(value) OVER (PARTITION BY subject, signal ORDER BY occurred_at, observation_id) AS previous FROM {EV}) WHERE abs(value - previous) / abs(nullif(previous, 0)) > 5""")
def relative_jump_conflicts(s, d):
    return corrections.jump_conflicts(event_facts(s, d), 5.0).select("observation_id", "previous", F.abs("jump").alias("jump"))


@query(f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY subject, signal ORDER BY occurred_at, observation_id) AS n FROM {EV}),
  f AS (SELECT subject, signal, n, observation_id, value AS held, false AS bad FROM o WHERE n = 1 UNION ALL
  SELECT o.subject, o.signal, o.n, o.observation_id, CASE WHEN coalesce(abs(o.value - f.held) / abs(nullif(f.held, 0)) > 5, false) THEN f.held ELSE o.value END, coalesce(abs(o.value - f.held) / abs(nullif(f.held, 0)) > 5, false) FROM f JOIN o ON o.subject = f.subject AND o.signal = f.signal AND o.n = f.n + 1)
  SELECT subject, signal, observation_id FROM f WHERE bad""")
def relative_jump_sequential(s, d):
    return corrections.jump_conflicts_sequential(event_facts(s, d), 5.0)


@query(f"SELECT DISTINCT subject, signal, local_date FROM {FACTS} WHERE {RETRACTED}")
def affected_days(s, d):
    return corrections.affected_days(revised(s, d), gone(s, d))


@query(f"""SELECT observation_id, CASE WHEN was IN ('pending', 'claimed') AND {RETRACTED} THEN CASE WHEN begun THEN 'unknown' ELSE 'invalidated' END ELSE was END AS state, CASE WHEN NOT ({RETRACTED}) THEN value END AS value,
  CASE WHEN NOT ({RETRACTED}) OR (was = 'claimed' AND begun) THEN 't' || k END AS token FROM (SELECT *, CASE k % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'claimed' ELSE 'delivered' END AS was, k % 3 = 1 AND k % 5 < 2 AS begun FROM {FACTS})""")
def event_invalidation(s, d):
    k = F.col("k")
    state = F.when(k % 3 == 0, "pending").when(k % 3 == 1, "claimed").otherwise("delivered")
    events = revised(s, d).withColumns({"state": state, "started": (k % 3 == 1) & (k % 5 < 2), "token": F.concat(F.lit("t"), k.cast("string"))})
    return corrections.invalidate_events(events, gone(s, d)).select("observation_id", "state", "value", "token")


@query("""SELECT event_id, CASE WHEN n = 1 THEN 'accepted' WHEN c = f THEN 'duplicate' ELSE 'conflict' END AS claim FROM (SELECT event_id, c, first_value(c) OVER w AS f, row_number() OVER w AS n
  FROM (SELECT event_id, user_id, event_id % 40 AS r, ts, event_id % 3 AS c FROM events) WINDOW w AS (PARTITION BY user_id, r ORDER BY ts, c))""")
def report_claims(s, d):
    rows = read(s, d, "events").select("event_id", F.col("user_id").alias("subject"), F.lit("app").alias("producer"), (F.col("event_id") % 40).alias("report_id"), F.col("ts").alias("received_at"), (F.col("event_id") % 3).alias("payload_digest"))
    return ingest.claim_reports(rows).select("event_id", "claim")


# local days, units and checks

ZONES = "CASE k % 3 WHEN 0 THEN 'Asia/Shanghai' WHEN 1 THEN 'America/New_York' ELSE 'UTC' END"


def zone():
    return F.when(F.col("k") % 3 == 0, "Asia/Shanghai").when(F.col("k") % 3 == 1, "America/New_York").otherwise("UTC")


@query(f"SELECT observation_id, timezone({ZONES}, timezone('UTC', occurred_at))::DATE AS local_day FROM {EV}")
def local_day_tz(s, d):
    return event_facts(s, d).select("observation_id", F.to_date(F.from_utc_timestamp(F.to_timestamp(F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")), zone())).alias("local_day"))


@query(f"""SELECT observation_id, day::DATE AS local_day, date_diff('microsecond', greatest(occurred_at, day), least(until, day + INTERVAL 1 DAY)) / 60000000.0::DOUBLE AS minutes FROM
  (SELECT *, occurred_at + to_hours(k % 50) AS until FROM {EV}) e, LATERAL (SELECT unnest(generate_series(date_trunc('day', e.occurred_at), date_trunc('day', e.until), INTERVAL 1 DAY)) AS day) WHERE least(until, day + INTERVAL 1 DAY) > greatest(occurred_at, day)""")
def split_midnight(s, d):
    rows = event_facts(s, d).withColumn("until", F.expr("timestampadd(HOUR, k % 50, occurred_at)"))
    rows = rows.withColumn("day", F.explode(F.sequence(F.to_date("occurred_at"), F.to_date("until"), F.expr("INTERVAL 1 DAY"))))
    rows = rows.withColumns({"a": F.greatest("occurred_at", F.col("day").cast("timestamp_ntz")), "b": F.least("until", F.date_add("day", 1).cast("timestamp_ntz"))}).where("b > a")
    return rows.select("observation_id", F.col("day").alias("local_day"), (F.timestamp_diff("MICROSECOND", F.col("a"), F.col("b")) / 60_000_000).alias("minutes"))


@query(f"""SELECT observation_id, unit, CASE unit WHEN 'lb' THEN value * 0.45359237::DOUBLE WHEN 'g' THEN value * 0.001::DOUBLE WHEN 'kg' THEN value END AS kilograms,
  CASE WHEN unit NOT IN ('lb', 'g', 'kg') THEN 'invalid_units' WHEN CASE unit WHEN 'lb' THEN value * 0.45359237::DOUBLE WHEN 'g' THEN value * 0.001::DOUBLE ELSE value END NOT BETWEEN 2 AND 200 THEN 'out_of_range' ELSE '' END AS problems
  FROM (SELECT *, CASE k % 4 WHEN 0 THEN 'lb' WHEN 1 THEN 'g' WHEN 2 THEN 'kg' ELSE 'stone' END AS unit FROM {EV})""")
def unit_convert_validate(s, d):
    k = F.col("k") % 4
    rows = event_facts(s, d).withColumn("unit", F.when(k == 0, "lb").when(k == 1, "g").when(k == 2, "kg").otherwise("stone")).withColumn("availability", F.lit("observed"))
    got = ingest.problems(rows, F.col("occurred_at"), F.lit(2.0), F.lit(200.0), F.lit("kg"))
    return got.select("observation_id", "unit", F.col("canonical").alias("kilograms"), F.array_join("problems", ",").alias("problems"))


@query(f"""SELECT observation_id, CASE WHEN off > 86400 THEN 'clock_skew' ELSE '' END AS problems, CASE WHEN abs(off) > 600 THEN 'clock_drift' ELSE '' END AS warnings FROM (SELECT observation_id, (k - 50) * 4000 AS off FROM {EV})""")
def clock_check(s, d):
    rows = event_facts(s, d).withColumn("availability", F.lit("observed")).withColumn("unit", F.lit("count"))
    received = F.expr("timestampadd(SECOND, -(k - 50) * 4000, occurred_at)")
    got = ingest.problems(rows, received, F.lit(0.0), F.lit(1e9), F.lit("count"))
    return got.select("observation_id", F.array_join("problems", ",").alias("problems"), F.array_join("warnings", ",").alias("warnings"))


@query(f"SELECT observation_id, CASE WHEN signal IN ('click', 'view') THEN '' ELSE 'not_authorized' END AS problems FROM {EV}")
def auth_scope(s, d):
    rows = event_facts(s, d).withColumn("availability", F.lit("observed")).withColumn("unit", F.lit("count"))
    allowed = F.array(F.lit("click"), F.lit("view"))
    got = ingest.problems(rows, F.col("occurred_at"), F.lit(0.0), F.lit(1e9), F.lit("count"), allowed)
    return got.select("observation_id", F.array_join("problems", ",").alias("problems"))


@query(f"""SELECT 'r' || user_id AS report_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS index, event_type AS signal, CASE event_id % 3 WHEN 0 THEN 'observed' WHEN 1 THEN 'no_data' ELSE 'unavailable' END AS availability,
  event_id::VARCHAR AS source_event_id, CASE WHEN c > 200 THEN 'too_many_observations' END AS refused FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS c FROM events)""")
def report_parse(s, d):
    e = read(s, d, "events")
    state = F.when(F.col("event_id") % 3 == 0, "observed").when(F.col("event_id") % 3 == 1, "no_data").otherwise("unavailable")
    item = F.struct(F.col("event_id").alias("at"), F.col("event_type").alias("signal"), state.alias("state"), F.col("event_id").cast("string").alias("sample_id"))
    reports = e.groupBy("user_id").agg(F.array_sort(F.collect_list(item)).alias("observations"))
    payload = F.to_json(F.struct(F.lit(1).alias("schema_version"), F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("report_id"), F.lit("app").alias("producer"), "observations"))
    got = ingest.parse_reports(reports.select(payload.alias("payload")))
    return got.select("report_id", F.col("index").cast("int").alias("index"), "signal", "availability", "source_event_id", "refused")


@query(f"""SELECT observation_id, left(sha256(length(CAST(subject AS VARCHAR)) || ':' || subject || length(signal) || ':' || signal), 32) AS key FROM {EV}""")
def measurement_keys(s, d):
    return event_facts(s, d).select("observation_id", scalars.measurement_key(F.col("subject"), F.col("signal")).alias("key"))


# trends

FLUCT = f"""SELECT subject, signal, n AS n_days, cur AS current, m AS baseline_median, base[round_even(0.25 * (len(base) - 1), 0)::INT + 1] AS p25, base[round_even(0.75 * (len(base) - 1), 0)::INT + 1] AS p75, len(base) AS baseline_n, cur - m AS delta,
  CASE WHEN cur > m THEN 'up' WHEN cur < m THEN 'down' ELSE 'flat' END AS direction FROM (SELECT *, CASE WHEN len(base) % 2 = 1 THEN base[len(base) // 2 + 1] ELSE (base[len(base) // 2] + base[len(base) // 2 + 1]) / 2 END AS m FROM (
  SELECT subject, signal, len(vs) AS n, vs[-1] AS cur, list_sort(CASE WHEN len(vs) > 1 THEN vs[:-2] ELSE vs END) AS base FROM (SELECT subject, signal, list(v ORDER BY local_date) AS vs FROM {SERIES} GROUP BY ALL)))"""


@query(FLUCT)
def trend_fluctuating(s, d):
    return trends.fluctuating(daily_max(s, d), ("subject", "signal"))


@query("""WITH m AS (SELECT o_custkey AS subject, o_orderdate::DATE AS d, max(o_totalprice) AS v FROM orders GROUP BY ALL), p AS (SELECT subject, list({'d': d, 'v': v} ORDER BY d) AS pts FROM m GROUP BY ALL HAVING count(*) >= 2),
  q AS (SELECT subject, len(pts) AS n_points, pts[1].v AS first_value, pts[-1].v AS last_value, pts[-1].v - pts[1].v AS total_delta, (pts[-1].v - pts[1].v) / (pts[-1].d - pts[1].d) * 30.4375::DOUBLE AS per_month,
  CASE WHEN len(pts) >= 4 THEN (pts[-1].v - pts[len(pts) - greatest(2, len(pts) // 3) + 1].v) / (pts[-1].d - pts[len(pts) - greatest(2, len(pts) // 3) + 1].d) * 30.4375::DOUBLE END AS recent_per_month FROM p)
  SELECT *, coalesce(per_month * recent_per_month > 0 AND abs(recent_per_month) > abs(per_month), false) AS accelerating FROM q""")
def trend_drift(s, d):
    series = daily.numeric_dist(order_facts(s, d), keys=("subject", "local_date")).select("subject", "local_date", F.col("max_value").alias("value"))
    return trends.drifting(series, ("subject",))


@query("""WITH g AS (SELECT subject, d, d - lag(d) OVER (PARTITION BY subject ORDER BY d) AS gap FROM (SELECT DISTINCT o_custkey AS subject, o_orderdate::DATE AS d FROM orders)),
  a AS (SELECT subject, round_even(median(gap), 0)::BIGINT AS typical, count(gap) AS n_gaps, max(d) AS last_date FROM g GROUP BY ALL)
  SELECT *, DATE '2005-01-01' - last_date AS days_since, greatest(0, (DATE '2005-01-01' - last_date) - typical)::BIGINT AS overdue FROM a""")
def trend_cycles(s, d):
    return trends.cyclical(order_facts(s, d), ("subject",), F.lit("2005-01-01").cast("date"))


@query(f"""SELECT subject, signal, delta, magnitude, place FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY magnitude DESC, signal)::INT AS place FROM (SELECT *, abs(delta) / greatest(abs(baseline_median), 1.0::DOUBLE) AS magnitude FROM ({FLUCT})) WHERE baseline_n >= 2 AND magnitude > 0) WHERE place <= 8""")
def notable_changes_topk(s, d):
    return trends.notable(trends.fluctuating(daily_max(s, d), ("subject", "signal")), ("subject",)).select("subject", "signal", "delta", "magnitude", "place")


@query(f"""SELECT CASE WHEN signal IN ('click', 'view') THEN 'attention' ELSE 'business' END AS domain, subject, count(*) FILTER (direction = 'up') AS n_up, count(*) FILTER (direction = 'down') AS n_down, count(*) FILTER (direction = 'flat') AS n_flat FROM ({FLUCT}) GROUP BY ALL""")
def domain_board(s, d):
    return digest.board(trends.fluctuating(daily_max(s, d), ("subject", "signal")), {"attention": ("click", "view"), "business": ("signup", "purchase", "error")})


ISLANDS = f"(SELECT subject, signal, local_date, row_number() OVER (PARTITION BY subject, signal, isl ORDER BY local_date) AS length FROM (SELECT *, local_date - row_number() OVER (PARTITION BY subject, signal ORDER BY local_date)::INT AS isl FROM {SERIES} WHERE v >= 20))"


@query(f"SELECT subject, signal, local_date, length FROM {ISLANDS}")
def streak_lengths(s, d):
    return trends.streaks(daily_max(s, d), ("subject", "signal"), F.col("value") >= 20)


@query(f"SELECT k.subject, k.signal, coalesce(i.length, 0) AS length FROM (SELECT DISTINCT subject, signal FROM {SERIES}) k LEFT JOIN (SELECT * FROM {ISLANDS} WHERE local_date = DATE '2024-01-20') i USING (subject, signal)")
def streak_length(s, d):
    return trends.streak_through(daily_max(s, d), ("subject", "signal"), F.col("value") >= 20, F.lit("2024-01-20").cast("date"))


@query(f"SELECT subject, signal, local_date FROM {ISLANDS} WHERE length = 2")
def streak_edge_events(s, d):
    return rules.streak_edges(trends.streaks(daily_max(s, d), ("subject", "signal"), F.col("value") >= 20), 2).select("subject", "signal", "local_date")


# rules

LAG = f"(SELECT *, lag(value) OVER (PARTITION BY subject, local_date ORDER BY occurred_at, observation_id) AS previous FROM {EV} WHERE signal = 'view')"
LAGK = f"(SELECT *, lag(kk) OVER (PARTITION BY subject, local_date ORDER BY occurred_at, observation_id) AS previous FROM (SELECT *, k % 3 AS kk FROM {EV} WHERE signal = 'view'))"


def fired(s, d, definition: rules.Definition, column: str = "value", **more) -> DataFrame:
    rows = event_facts(s, d).withColumn("kk", F.col("k") % 3)
    return rules.hits(rows, definition, column, **more).select("subject", "observation_id")


def every(condition: str, value=None, operator: str = "gte", **more) -> rules.Definition:
    return rules.Definition("r", "view", condition, value, operator, **({"fire": "every"} | more))


@query(f"SELECT subject, observation_id FROM {LAGK} WHERE previous IS NOT NULL AND previous IS DISTINCT FROM kk")
def rule_changed(s, d):
    return fired(s, d, every("changed"), "kk")


@query(f"SELECT subject, observation_id FROM {LAGK} WHERE kk = 1")
def rule_equals(s, d):
    return fired(s, d, every("equals", 1), "kk")


@query(f"SELECT subject, observation_id FROM {LAGK} WHERE kk = 1 AND previous IS DISTINCT FROM 1")
def rule_enters(s, d):
    return fired(s, d, every("enters", 1), "kk")


@query(f"SELECT subject, observation_id FROM {LAGK} WHERE kk <> 1 AND previous = 1")
def rule_leaves(s, d):
    return fired(s, d, every("leaves", 1), "kk")


@query(f"SELECT subject, observation_id FROM {LAG} WHERE previous < 50 AND value >= 50")
def rule_threshold(s, d):
    return fired(s, d, every("threshold_crossing", 50.0))


@query(f"SELECT subject, observation_id FROM {LAG} WHERE abs(value - previous) >= 40")
def rule_delta(s, d):
    return fired(s, d, every("delta", 40.0))


@query(f"SELECT subject, observation_id FROM (SELECT *, row_number() OVER (PARTITION BY subject, local_date, k % 5 ORDER BY occurred_at, observation_id) AS n FROM {EV} WHERE signal = 'view') WHERE n = 1")
def rule_occurrence(s, d):
    rows = event_facts(s, d).withColumn("ident", F.col("k") % 5)
    return rules.hits(rows, every("occurrence"), occurrence_key="ident").select("subject", "observation_id")


@query(f"SELECT subject, observation_id FROM (SELECT *, row_number() OVER (PARTITION BY subject, local_date ORDER BY occurred_at, observation_id) AS n FROM {LAG} WHERE previous < 50 AND value >= 50) WHERE n = 1")
def rule_once_per_day(s, d):
    return fired(s, d, every("threshold_crossing", 50.0, fire="once"))


@query(f"""WITH RECURSIVE h AS (SELECT subject, occurred_at, observation_id FROM (SELECT *, lag(value) OVER (PARTITION BY subject ORDER BY occurred_at, observation_id) AS previous FROM {EV} WHERE signal = 'view') WHERE previous < 30 AND value >= 30),
  f AS (SELECT subject, min(occurred_at) AS fired_at FROM h GROUP BY ALL UNION ALL SELECT subject, (SELECT min(h.occurred_at) FROM h WHERE h.subject = f.subject AND h.occurred_at >= f.fired_at + INTERVAL 3 DAY) FROM f WHERE fired_at IS NOT NULL)
  SELECT h.subject, h.observation_id FROM h JOIN f ON h.subject = f.subject AND h.occurred_at = f.fired_at""")
def rule_cooldown(s, d):
    return fired(s, d, every("threshold_crossing", 30.0, scope="forever", rearm="cooldown", cooldown_seconds=3 * 86400))


@query(f"SELECT subject, signal, max(occurred_at) AS last_seen, date_sub('second', max(occurred_at), TIMESTAMP '{NOW}') AS silent_seconds FROM {EV} GROUP BY ALL HAVING silent_seconds >= 172800")
def absence_silence(s, d):
    return rules.absent(event_facts(s, d), now(), 172_800)


@query(f"""SELECT observation_id, 'evt_' || left(sha256(length(subject::VARCHAR) || ':' || subject || chr(31) || '2:r1' || chr(31) || '1:1' || chr(31) || length(local_date::VARCHAR) || ':' || local_date || chr(31) || length(observation_id::VARCHAR) || ':' || observation_id), 32) AS event_id FROM {EV}""")
def event_envelope_ids(s, d):
    return event_facts(s, d).select("observation_id", rules.event_id(F.col("subject"), F.lit("r1"), F.lit(1), F.col("local_date"), F.col("observation_id")).alias("event_id"))


# outbox

OUTCOME = "CASE event_id % 5 WHEN 0 THEN 'accepted' WHEN 1 THEN 'duplicate' WHEN 2 THEN 'suppressed' WHEN 3 THEN 'rejected' ELSE 'enqueue_failed' END"


@query(f"""SELECT event_id, CASE WHEN stale THEN 'claimed' ELSE CASE st WHEN 'accepted' THEN 'delivered' WHEN 'duplicate' THEN 'delivered' WHEN 'suppressed' THEN 'suppressed' WHEN 'rejected' THEN 'rejected' ELSE CASE WHEN attempt < 5 THEN 'pending' ELSE 'dead_letter' END END END AS state,
  CASE WHEN NOT stale AND st = 'enqueue_failed' AND attempt < 5 THEN ts + to_seconds((30 * 2 ^ (attempt - 1))::INT) END AS next_attempt_at FROM (SELECT event_id, ts, {OUTCOME} AS st, (event_id % 6 + 1)::INT AS attempt, event_id % 7 = 0 AS stale FROM events)""")
def outbox_next_state(s, d):
    e = read(s, d, "events")
    status = F.when(F.col("event_id") % 5 == 0, "accepted").when(F.col("event_id") % 5 == 1, "duplicate").when(F.col("event_id") % 5 == 2, "suppressed").when(F.col("event_id") % 5 == 3, "rejected").otherwise("enqueue_failed")
    events = e.select("event_id", F.lit("claimed").alias("state"), (F.col("event_id") % 6 + 1).cast("int").alias("attempt"), F.lit("t1").alias("token"))
    receipts = e.select("event_id", F.when(F.col("event_id") % 7 == 0, "t0").otherwise("t1").alias("token"), status.alias("status"), F.col("ts").alias("at"))
    return outbox.apply_receipts(events, receipts).select("event_id", "state", "next_attempt_at")


@query(f"""SELECT event_id FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'claimed' ELSE 'delivered' END AS state FROM events) WHERE (event_id % 2 = 0 OR ts + INTERVAL 15 DAY <= TIMESTAMP '{NOW}') AND event_id % 7 > 0 AND event_id % 4 > 0 AND (state = 'pending' OR (state = 'claimed' AND ts + INTERVAL 10 DAY <= TIMESTAMP '{NOW}'))""")
def outbox_claimable(s, d):
    e = read(s, d, "events").withColumn("state", F.when(F.col("event_id") % 3 == 0, "pending").when(F.col("event_id") % 3 == 1, "claimed").otherwise("delivered"))
    e = e.withColumns({"next_attempt_at": F.when(F.col("event_id") % 2 == 1, F.expr("ts + INTERVAL 15 DAY")), "lease_until": F.expr("ts + INTERVAL 10 DAY"), "started": F.col("event_id") % 4 == 0, "invalidated": F.col("event_id") % 7 == 0})
    return outbox.claimable(e, now()).select("event_id")


@query("SELECT event_id FROM events WHERE event_id % 3 <> 1")
def outbox_enqueue(s, d):
    e = read(s, d, "events").select("event_id")
    return outbox.enqueue(e.where("event_id % 3 = 0"), e.where("event_id % 3 <> 1"))


# mirrors and recurrence


@query("""SELECT item, version, title FROM (SELECT event_id % 1000 AS item, event_id AS version, event_type AS title, row_number() OVER (PARTITION BY event_id % 1000 ORDER BY event_id DESC) AS n FROM events) WHERE n = 1""")
def mirror_upsert(s, d):
    rows = read(s, d, "events").select((F.col("event_id") % 1000).alias("item"), F.col("event_id").alias("version"), F.col("event_type").alias("title"))
    return mirrors.upsert(rows.where("version % 2 = 0"), rows.where("version % 2 = 1"), ("item",), "version")


@query("SELECT event_id, user_id FROM events WHERE event_id % 3 > 0 OR ts >= TIMESTAMP '2024-01-15'")
def mirror_full_sync_delete(s, d):
    e = read(s, d, "events")
    return mirrors.full_snapshot(e, e.where("event_id % 3 > 0"), ("event_id",), F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")).select("event_id", "user_id")


@query("SELECT event_id FROM events WHERE event_id % 11 > 0")
def mirror_tombstone(s, d):
    e = read(s, d, "events").select("event_id")
    return mirrors.without_tombstones(e, e.where("event_id % 11 = 0"), ("event_id",))


@query("""SELECT user_id, day::DATE AS occurs_on FROM (SELECT DISTINCT user_id, DATE '2024-01-01' + (user_id % 7)::INT AS st, user_id % 3 + 1 AS every FROM events) u, LATERAL (SELECT unnest(generate_series(u.st::TIMESTAMP, TIMESTAMP '2024-03-31', INTERVAL 1 DAY)) AS day)
  WHERE (isodow(day) - 1 = isodow(st) - 1 OR isodow(day) - 1 = 2) AND (date_trunc('week', day)::DATE - date_trunc('week', st)::DATE) // 7 % every = 0 AND day >= TIMESTAMP '2024-02-01'""")
def recurrence_weekly_expand(s, d):
    series = read(s, d, "events").select("user_id").distinct().selectExpr(
        "user_id", "date_add(DATE '2024-01-01', int(user_id % 7)) AS start", "'weekly' AS freq", "int(user_id % 3 + 1) AS interval",
        "array_distinct(array(weekday(date_add(DATE '2024-01-01', int(user_id % 7))), 2)) AS byweekday", "CAST(NULL AS DATE) AS until", "CAST(NULL AS INT) AS count",
    )
    return mirrors.expand(series, F.lit("2024-02-01").cast("date"), F.lit("2024-03-31").cast("date")).select("user_id", "occurs_on")


@query("""SELECT user_id, day::DATE AS occurs_on FROM (SELECT user_id, day, row_number() OVER (PARTITION BY user_id ORDER BY day) AS n FROM (SELECT DISTINCT user_id, DATE '2024-01-01' + (user_id % 31)::INT AS st FROM events) u, LATERAL (SELECT unnest(generate_series(u.st::TIMESTAMP, TIMESTAMP '2024-12-31', INTERVAL 1 DAY)) AS day) WHERE day(day) = day(st)) WHERE n <= 6""")
def recurrence_monthly_expand(s, d):
    series = read(s, d, "events").select("user_id").distinct().selectExpr("user_id", "date_add(DATE '2024-01-01', int(user_id % 31)) AS start", "'monthly' AS freq", "1 AS interval", "CAST(NULL AS ARRAY<INT>) AS byweekday", "CAST(NULL AS DATE) AS until", "6 AS count")
    return mirrors.expand(series, F.lit("2024-01-01").cast("date"), F.lit("2024-12-31").cast("date")).select("user_id", "occurs_on")


# retention, coverage, digests, paging


@query(f"""SELECT observation_id FROM {EV} WHERE (signal = 'view' AND local_date < DATE '{TODAY}' - 7) OR (signal = 'click' AND local_date < DATE '{TODAY}' - 20)""")
def retention_cutoff(s, d):
    plan = s.createDataFrame([("view", 7, -1), ("click", 20, 365), ("error", -1, -1)], "signal string, detail_days int, aggregate_days int")
    return retention.expired(event_facts(s, d), retention.cutoffs(plan, now()), "local_date", "detail_before").select("observation_id")


@query(f"""SELECT k.subject, k.signal, g.day::DATE AS missing_date FROM (SELECT DISTINCT subject, signal FROM {EV} WHERE local_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25') k CROSS JOIN (SELECT unnest(generate_series(DATE '2024-01-05', DATE '2024-01-25', INTERVAL 1 DAY)) AS day) g
  WHERE NOT EXISTS (SELECT 1 FROM {EV} e WHERE e.subject = k.subject AND e.signal = k.signal AND e.local_date = g.day::DATE)""")
def generation_coverage_gaps(s, d):
    day = lambda x: F.lit(x).cast("date")
    return retention.coverage_gaps(event_facts(s, d), ("subject", "signal"), day("2024-01-05"), day("2024-01-25"))


@query(f"""SELECT *, sha256('any_error=' || any_error || ',big_purchase=' || big_purchase || ',fresh_click=' || fresh_click) AS fingerprint FROM (SELECT subject, bool_or(signal = 'error') AS any_error, bool_or(signal = 'purchase' AND value > 100) AS big_purchase, bool_or(signal = 'click' AND occurred_at > TIMESTAMP '2024-01-29') AS fresh_click FROM
  (SELECT subject, signal, arg_max(value, (occurred_at, observation_id)) AS value, max(occurred_at) AS occurred_at FROM {EV} GROUP BY ALL) GROUP BY ALL)""")
def health_glance_flags(s, d):
    c = F.col
    flags = {"any_error": c("signal") == "error", "big_purchase": (c("signal") == "purchase") & (c("value") > 100), "fresh_click": (c("signal") == "click") & (c("occurred_at") > F.lit("2024-01-29").cast("timestamp_ntz"))}
    return digest.glance(current.current(event_facts(s, d)), flags)


@query(f"SELECT subject, observation_id, occurred_at FROM {EV} WHERE (occurred_at, observation_id) > (TIMESTAMP '2024-01-10', 0) ORDER BY occurred_at, observation_id LIMIT 50")
def timeline_page(s, d):
    after = F.struct("occurred_at", "observation_id") > F.struct(F.lit("2024-01-10").cast("timestamp_ntz"), F.lit(0).cast("long"))
    return retention.page(event_facts(s, d), ("occurred_at", "observation_id"), after=after).select("subject", "observation_id", "occurred_at")


@query(f"""SELECT observation_id, CASE WHEN src = 'radio' THEN 'unknown_source' WHEN src = 'photo' THEN 'source_disabled' WHEN date_sub('second', occurred_at, TIMESTAMP '{NOW}') < 864000 THEN 'debounced' ELSE src END AS reason
  FROM (SELECT *, CASE k % 4 WHEN 0 THEN 'arrival' WHEN 1 THEN 'photo' WHEN 2 THEN 'radio' ELSE 'unlock' END AS src FROM {EV})""")
def wake_gate(s, d):
    k = F.col("k") % 4
    src = F.when(k == 0, "arrival").when(k == 1, "photo").when(k == 2, "radio").otherwise("unlock")
    return event_facts(s, d).select("observation_id", scalars.should_wake(src, ["arrival", "unlock", "broadcast"], F.col("occurred_at"), now(), 864_000).alias("reason"))


@query("SELECT c.c_custkey AS subject, n.n_name AS nation, r.r_name AS region, count(o.o_orderkey) AS n_orders, max(o.o_orderdate)::DATE AS last_order FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY ALL")
def subject_dimensions(s, d):
    nation, region, customer, orders = (read(s, d, t) for t in ("nation", "region", "customer", "orders"))
    by = orders.groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.to_date(F.max("o_orderdate")).alias("last_order"))
    rows = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).join(region, nation["n_regionkey"] == region["r_regionkey"]).join(by, customer["c_custkey"] == by["o_custkey"], "left")
    return rows.select(F.col("c_custkey").alias("subject"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.coalesce("n_orders", F.lit(0)).alias("n_orders"), "last_order")


@query("SELECT conv_id AS subject, count(*) AS n_turns, count(*) FILTER (role = 'user') AS n_user, sum(length(text))::BIGINT AS n_chars, arg_max(role, turn) AS last_role FROM conversations GROUP BY ALL")
def conversation_occurrences(s, d):
    return read(s, d, "conversations").groupBy(F.col("conv_id").alias("subject")).agg(
        F.count("*").alias("n_turns"), F.count_if(F.col("role") == "user").alias("n_user"), F.sum(F.length("text")).alias("n_chars"), F.max_by("role", "turn").alias("last_role")
    )


@query(f"""SELECT subject, session::INT AS session, min(occurred_at) AS began, count(*) AS n FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY subject ORDER BY occurred_at, observation_id) AS session FROM
  (SELECT *, date_diff('microsecond', lag(occurred_at) OVER (PARTITION BY subject ORDER BY occurred_at, observation_id), occurred_at) AS gap FROM {EV})) GROUP BY ALL""")
def activity_sessions(s, d):
    w = Window.partitionBy("subject").orderBy("occurred_at", "observation_id")
    gap = F.timestamp_diff("MICROSECOND", F.lag("occurred_at").over(w), F.col("occurred_at"))
    rows = event_facts(s, d).withColumn("new", F.coalesce((gap > 43_200_000_000).cast("int"), F.lit(1)))
    return rows.withColumn("session", F.sum("new").over(w).cast("int")).groupBy("subject", "session").agg(F.min("occurred_at").alias("began"), F.count("*").alias("n"))
