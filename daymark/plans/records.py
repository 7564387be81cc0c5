"""More of the catalogue: generations, coverage, attribution, retractions, mirrors, deliveries, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import attribution, corrections, generations, mirrors, outbox, projection, retention, rules, trends
from ..sources.facts import event_facts, read
from .catalogue import EV, FACTS, GONE, NOW, RETRACTED, ZONES, gone, query, revised, zone

D0, D1 = "2024-01-05", "2024-01-20"


def day(text):
    return F.lit(text).cast("date")


# generations of daily aggregates

#: A generation per subject and signal, of some days, in some state.
GEN = """(SELECT subject, signal, 'daily' AS kind, 'g' || g AS generation_id, 1 AS aggregation_version, DATE '2024-01-01' + (g % 3)::INT AS start, DATE '2024-01-20' + (g % 5)::INT AS "end",
  ['complete', 'active', 'building', 'failed', 'incomplete'][1 + (subject + g) % 5] AS status, TIMESTAMP '2024-02-01 00:00:00' + to_hours((g * 7 % 5)::INT) AS created_at
  FROM (SELECT DISTINCT user_id AS subject, event_type AS signal FROM events), (SELECT unnest([0, 1, 2, 3, 4]) AS g))"""


def gens(s, d):
    base = read(s, d, "events").select(F.col("user_id").alias("subject"), F.col("event_type").alias("signal")).distinct()
    rows = base.select("subject", "signal", F.lit("daily").alias("kind"), F.explode(F.array(*(F.lit(g) for g in range(5)))).alias("g"))
    state = F.element_at(F.array(*map(F.lit, ("complete", "active", "building", "failed", "incomplete"))), (1 + (F.col("subject") + F.col("g")) % 5).cast("int"))
    rows = rows.select(
        "subject", "signal", "kind", F.concat(F.lit("g"), F.col("g").cast("string")).alias("generation_id"), F.lit(1).alias("aggregation_version"), F.date_add(day("2024-01-01"), F.col("g") % 3).alias("start"),
        F.date_add(day("2024-01-20"), F.col("g") % 5).alias("end"), state.alias("status"), F.expr("timestampadd(HOUR, g * 7 % 5, TIMESTAMP_NTZ '2024-02-01 00:00:00')").alias("created_at"),
    )
    required = generations.days(F.col("start"), F.col("end"))
    odd = F.filter(required, lambda x: F.dayofmonth(x) % 11 == 0)
    return rows.withColumns({"accounted": F.array_except(required, odd), "incomplete": odd, "reasons": F.array(F.lit("detail_expired"))})


@query(f"""SELECT subject, signal, generation_id, status AS was, CASE WHEN ok THEN wanted ELSE status END AS status, NOT ok AS refused FROM (SELECT *, CASE status WHEN 'building' THEN wanted IN ('building', 'complete', 'failed', 'incomplete') WHEN 'complete' THEN wanted IN ('complete', 'active', 'failed')
  WHEN 'active' THEN wanted IN ('active', 'complete') WHEN 'incomplete' THEN wanted IN ('incomplete', 'failed') WHEN 'failed' THEN wanted = 'failed' END AS ok FROM (SELECT *, ['active', 'complete', 'failed'][1 + subject % 3] AS wanted FROM {GEN}))""")
def generation_transitions(s, d):
    g = gens(s, d)
    to = F.element_at(F.array(F.lit("active"), F.lit("complete"), F.lit("failed")), (1 + F.col("subject") % 3).cast("int"))
    was = g.select(*generations.IDENTITY, F.col("status").alias("was"))
    got = generations.moved(g, g.select(*generations.IDENTITY, to.alias("to"))).join(was, list(generations.IDENTITY))
    return got.select("subject", "signal", "generation_id", "was", "status", "refused")


@query(f"""SELECT subject, signal, generation_id, created_at FROM {GEN} WHERE "end" >= DATE '2024-01-22' AND start <= DATE '2024-02-01'""")
def generation_audit_overlap(s, d):
    return generations.audit(gens(s, d), day("2024-01-22"), day("2024-02-01")).select("subject", "signal", "generation_id", "created_at")


@query(f"""SELECT subject, signal, generation_id, CASE WHEN subject % 3 = 0 THEN 'inserted' WHEN subject % 3 = 1 THEN 'known' ELSE 'conflict' END AS decision FROM {GEN}""")
def generation_insert(s, d):
    g = gens(s, d)
    new = g.withColumn("end", F.when(F.col("subject") % 3 == 2, F.date_add("end", 1)).otherwise(F.col("end")))
    return generations.offered(g.where("subject % 3 <> 0"), new).select("subject", "signal", "generation_id", "decision")


DAILY = f"(SELECT subject, signal, local_date, sum(cents)::BIGINT AS value, count(*) AS observations FROM {EV} GROUP BY ALL)"


def daily_rows(s, d, generation="g1"):
    """Days of generation rows: every seventh is recomputed without observations."""
    rows = event_facts(s, d).groupBy("subject", "signal", "local_date").agg(F.sum("cents").alias("value"), F.count("*").alias("observations"))
    empty = F.dayofmonth("local_date") % 7 == 0
    return rows.withColumns({
        "kind": F.lit("daily"), "generation_id": F.lit(generation), "aggregation_version": F.lit(1), "completeness": F.when(F.dayofmonth("local_date") % 9 == 0, "incomplete").otherwise("complete"),
        "observations": F.when(empty, 0).otherwise(F.col("observations")), "recomputed": F.lit(True),
    })


@query(f"""WITH a AS (SELECT * FROM {GEN} WHERE status = 'active'), held AS (SELECT r.subject, r.signal, r.local_date, r.value, day(r.local_date) % 7 = 0 AS empty, CASE WHEN day(r.local_date) % 9 = 0 THEN 'incomplete' ELSE 'complete' END AS c
    FROM {DAILY} r JOIN a ON a.subject = r.subject AND a.signal = r.signal AND a.generation_id = 'g1' WHERE r.local_date BETWEEN DATE '{D0}' AND DATE '{D1}'),
  gaps AS (SELECT subject, signal, generation_id, local_date::DATE AS local_date FROM (SELECT subject, signal, generation_id, unnest(generate_series(start::TIMESTAMP, "end"::TIMESTAMP, INTERVAL 1 DAY)) AS local_date FROM a) WHERE day(local_date) % 11 = 0 AND local_date BETWEEN DATE '{D0}' AND DATE '{D1}')
  SELECT coalesce(h.subject, g.subject) AS subject, coalesce(h.signal, g.signal) AS signal, coalesce(g.generation_id, 'g1') AS generation_id, coalesce(h.local_date, g.local_date) AS local_date, h.value, h.subject IS NOT NULL AS has_data,
  CASE WHEN g.subject IS NOT NULL THEN 'incomplete' ELSE h.c END AS completeness FROM held h FULL JOIN gaps g ON g.subject = h.subject AND g.signal = h.signal AND g.local_date = h.local_date AND g.generation_id = 'g1' WHERE g.subject IS NOT NULL OR NOT h.empty""")
def daily_active_generation(s, d):
    got = generations.daily(daily_rows(s, d), gens(s, d), day(D0), day(D1))
    return got.select("subject", "signal", "generation_id", "local_date", "value", "has_data", "completeness")


@query(f"""WITH g AS (SELECT *, "end" - start + 1 AS n FROM {GEN} WHERE status = 'complete'), a AS (SELECT subject, signal, start AS s0, "end" AS e0 FROM {GEN} WHERE status = 'active')
  SELECT g.subject, g.signal, g.generation_id, g.generation_id <> 'g2' AND (s0 IS NULL OR (g.start <= s0 AND g."end" >= e0)) AS may_activate FROM g LEFT JOIN a ON a.subject = g.subject AND a.signal = g.signal""")
def generation_candidates(s, d):
    """Every generation but g2 has all of its days."""
    g = gens(s, d).withColumns({"accounted": generations.days(F.col("start"), F.col("end")), "incomplete": F.array().cast("array<date>")})
    rows = g.select(*generations.IDENTITY, "aggregation_version", F.explode("accounted").alias("local_date")).where("generation_id <> 'g2' OR dayofmonth(local_date) <> 10").withColumn("completeness", F.lit("complete"))
    return generations.candidates(g, rows).select("subject", "signal", "generation_id", "may_activate")


@query(f"SELECT subject, signal, generation_id, CASE WHEN generation_id = 'g4' THEN 'active' WHEN status = 'active' THEN 'complete' ELSE status END AS status FROM {GEN}")
def generation_cutover(s, d):
    g = gens(s, d)
    return generations.activated(g, g.where("generation_id = 'g4'")).select("subject", "signal", "generation_id", "status")


@query(f"""SELECT subject, signal, generation_id, CASE WHEN a THEN greatest("end", DATE '2024-01-28') ELSE "end" END AS "end", n + CASE WHEN a THEN 1 ELSE 0 END AS n_incomplete, CASE WHEN a THEN 'detail_expired,late_data' ELSE 'detail_expired' END AS reasons FROM
  (SELECT *, status = 'active' AS a, len(list_filter(generate_series(start::TIMESTAMP, "end"::TIMESTAMP, INTERVAL 1 DAY), lambda x: day(x) % 11 = 0)) AS n FROM {GEN})""")
def generation_mark_incomplete(s, d):
    g = gens(s, d)
    marks = g.select(*generations.SCOPE).distinct().withColumns({"local_date": day("2024-01-28"), "reason": F.lit("late_data")})
    got = generations.marked_incomplete(g, marks)
    return got.select("subject", "signal", "generation_id", "end", F.size("incomplete").cast("long").alias("n_incomplete"), F.array_join("reasons", ",").alias("reasons"))


@query(f"""SELECT subject, signal, generation_id, CASE WHEN a THEN least(start, DATE '2023-12-30') ELSE start END AS start, n + CASE WHEN a THEN (DATE '2024-01-02' - DATE '2023-12-30' + 1) - greatest(0, DATE '2024-01-02' - start + 1) ELSE 0 END AS n_accounted FROM
  (SELECT *, status = 'active' AS a, len(list_filter(generate_series(start::TIMESTAMP, "end"::TIMESTAMP, INTERVAL 1 DAY), lambda x: day(x) % 11 <> 0)) AS n FROM {GEN})""")
def generation_account_range(s, d):
    g = gens(s, d)
    ranges = g.select(*generations.SCOPE).distinct().withColumns({"from_day": day("2023-12-30"), "to_day": day("2024-01-02")})
    return generations.accounted(g, ranges).select("subject", "signal", "generation_id", "start", F.size("accounted").cast("long").alias("n_accounted"))


@query(f"""WITH g AS (SELECT subject, signal, generation_id, start, "end" FROM {GEN}), h AS (SELECT g.subject, g.signal, g.generation_id, count(DISTINCT local_date) FILTER (local_date < DATE '2024-01-10') AS held FROM g JOIN {DAILY} r ON r.subject = g.subject AND r.signal = g.signal AND r.local_date BETWEEN start AND "end" GROUP BY ALL)
  SELECT g.subject, g.signal, g.generation_id, (DATE '2024-01-10' - start) - coalesce(held, 0) AS n_incomplete, CASE WHEN (DATE '2024-01-10' - start) - coalesce(held, 0) = 0 THEN 'complete' ELSE 'incomplete' END AS status FROM g LEFT JOIN h USING (subject, signal, generation_id)""")
def generation_rebuild(s, d):
    g = gens(s, d)
    rows = daily_rows(s, d).drop("generation_id").join(g.select(*generations.IDENTITY), list(generations.SCOPE))
    got = generations.rebuilt(rows, g.select(*generations.IDENTITY, "aggregation_version", "start", "end"), day("2024-01-10"))
    return got.select("subject", "signal", "generation_id", F.size("incomplete").cast("long").alias("n_incomplete"), "status")


TREND_ROWS = f"(SELECT subject, signal, local_date, value, CASE WHEN day(local_date) % 5 = 0 THEN 'incomplete' ELSE 'complete' END AS c FROM {DAILY} WHERE local_date BETWEEN DATE '{D0}' AND DATE '{D1}')"


@query(f"""WITH c AS (SELECT subject, signal, count(*) FILTER (c = 'complete') AS w, count(*) FILTER (c <> 'complete') AS i FROM {TREND_ROWS} GROUP BY ALL),
  p AS (SELECT subject, signal, list(value::DOUBLE ORDER BY local_date) AS vs FROM {TREND_ROWS} WHERE c = 'complete' AND signal = 'view' GROUP BY ALL),
  q AS (SELECT *, vs[-1] AS cur, list_sort(CASE WHEN len(vs) > 1 THEN vs[:-2] ELSE vs END) AS base FROM p), f AS (SELECT *, CASE WHEN len(base) % 2 = 1 THEN base[len(base) // 2 + 1] ELSE (base[len(base) // 2] + base[len(base) // 2 + 1]) / 2 END AS m FROM q)
  SELECT c.subject, c.signal, w AS days_with_data, i AS days_incomplete, 16 - w - i AS days_missing, CASE c.signal WHEN 'view' THEN CASE WHEN w = 0 THEN 'no_data' END WHEN 'click' THEN 'not_visible' ELSE 'not_declared' END AS reason,
  CASE WHEN c.signal = 'view' THEN 'fluctuating' ELSE 'none' END AS model, CASE WHEN c.signal IN ('view', 'click') THEN 'count' END AS unit, cur AS current, round_even(cur - m, 3) AS delta FROM c LEFT JOIN f USING (subject, signal)""")
def trend_with_coverage(s, d):
    rows = daily_rows(s, d).withColumns({"field": F.lit("total"), "value": F.col("value").cast("double"), "completeness": F.when(F.dayofmonth("local_date") % 5 == 0, "incomplete").otherwise("complete")})
    dims = s.createDataFrame([("view", "total", "count", "fluctuating", "always"), ("click", "total", "count", "drifting", "never")], "signal string, field string, unit string, trend string, visibility string")
    got = trends.with_coverage(rows, dims, day(D0), day(D1))
    return got.select("subject", "signal", "days_with_data", "days_incomplete", F.col("days_missing"), "reason", "model", "unit", "current", "delta")


# local days


@query(f"""SELECT observation_id, (day)::DATE AS local_day, date_diff('microsecond', greatest(occurred_at, timezone('UTC', timezone(z, day))), least(until, timezone('UTC', timezone(z, day + INTERVAL 1 DAY)))) / 60000000.0::DOUBLE AS minutes FROM
  (SELECT *, timezone(z, timezone('UTC', occurred_at)) AS l0, timezone(z, timezone('UTC', until)) AS l1 FROM (SELECT observation_id, occurred_at + to_days((k % 90)::INT) AS occurred_at, occurred_at + to_days((k % 90)::INT) + to_hours((k % 50)::INT) AS until, {ZONES} AS z FROM {EV})) e,
  LATERAL (SELECT unnest(generate_series(date_trunc('day', e.l0), date_trunc('day', e.l1), INTERVAL 1 DAY)) AS day) WHERE least(until, timezone('UTC', timezone(z, day + INTERVAL 1 DAY))) > greatest(occurred_at, timezone('UTC', timezone(z, day)))""")
def split_midnight_dst(s, d):
    """Spans of up to two days across the spring, when New York has a day of 23 hours."""
    rows = event_facts(s, d).select("observation_id", "k", zone().alias("zone"), F.expr("timestampadd(DAY, k % 90, occurred_at)").alias("start_at"))
    rows = rows.withColumn("end_at", F.expr("timestampadd(HOUR, k % 50, start_at)"))
    return attribution.split_at_midnight(rows, "start_at", "end_at", "zone").select("observation_id", "local_day", "minutes")


@query(f"""SELECT observation_id, CASE strategy WHEN 'source_local_date' THEN CASE WHEN k % 3 = 0 THEN DATE '2024-02-29' ELSE inst END WHEN 'episode_end' THEN CASE WHEN k % 7 = 0 THEN inst WHEN k % 5 = 0 THEN NULL ELSE endd END ELSE inst END AS effective_day,
  CASE strategy WHEN 'source_local_date' THEN CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN 'no_local_date' ELSE 'bad_local_date' END WHEN 'episode_end' THEN CASE WHEN k % 7 = 0 THEN 'no_span' WHEN k % 5 = 0 THEN 'reversed_span' END END AS problem FROM
  (SELECT *, timezone({ZONES}, timezone('UTC', occurred_at))::DATE AS inst, timezone({ZONES}, timezone('UTC', occurred_at + INTERVAL 9 HOUR))::DATE AS endd, ['instant', 'source_local_date', 'episode_end'][1 + observation_id % 3] AS strategy FROM {EV})""")
def effective_date(s, d):
    k = F.col("k")
    rows = event_facts(s, d).withColumns({
        "strategy": F.element_at(F.array(F.lit("instant"), F.lit("source_local_date"), F.lit("episode_end")), (1 + F.col("observation_id") % 3).cast("int")),
        "source_date": F.when(k % 3 == 0, "2024-02-29").when(k % 3 == 2, "29.02.2024"), "end_at": F.when(k % 7 > 0, F.when(k % 5 == 0, F.expr("timestampadd(HOUR, -2, occurred_at)")).otherwise(F.expr("timestampadd(HOUR, 9, occurred_at)"))),
    })
    value, problem = attribution.effective_day(F.col("strategy"), F.col("occurred_at"), F.col("occurred_at"), F.col("end_at"), F.col("source_date"), zone())
    return rows.select("observation_id", value.alias("effective_day"), problem.alias("problem"))


@query(f"""SELECT local_date, CASE WHEN k % 4 = 0 THEN NULL ELSE {ZONES} END AS zone, count(*) AS n FROM (SELECT *, timezone(coalesce(CASE WHEN k % 4 = 0 THEN NULL ELSE {ZONES} END, 'UTC'), timezone('UTC', occurred_at))::DATE AS d FROM (SELECT * EXCLUDE (local_date) FROM {EV})) t, LATERAL (SELECT t.d AS local_date) GROUP BY ALL""")
def local_day_windows(s, d):
    z = F.when(F.col("k") % 4 > 0, zone())
    return event_facts(s, d).groupBy(attribution.local_day(F.col("occurred_at"), z).alias("local_date"), z.alias("zone")).agg(F.count("*").alias("n"))


@query(f"SELECT observation_id, CASE WHEN k % 4 = 0 THEN strftime(occurred_at, '%Y-%m-%d %H:%M') || ' UTC' ELSE strftime(timezone({ZONES}, timezone('UTC', occurred_at)), '%Y-%m-%d %H:%M') END AS as_of, CASE WHEN k % 2 = 0 THEN local_date END AS lenient FROM {EV}")
def as_of_text(s, d):
    rows = event_facts(s, d)
    text = F.when(F.col("k") % 2 == 0, F.concat(F.col("local_date").cast("string"), F.lit("T10:00:00Z"))).otherwise("yesterday")
    return rows.select("observation_id", attribution.as_of(F.col("occurred_at"), F.when(F.col("k") % 4 > 0, zone())).alias("as_of"), attribution.lenient_day(text).alias("lenient"))


# retractions, conflicts and evidence


@query(f"""WITH l AS (SELECT * FROM {FACTS} f WHERE NOT EXISTS (SELECT 1 FROM {GONE} g WHERE g.subject = f.subject AND g.signal = f.signal AND g.source = f.source AND g.source_event_id = f.source_event_id)),
  c AS (SELECT *, max(revision) OVER (PARTITION BY subject, signal, source, source_event_id) AS top, row_number() OVER (PARTITION BY subject, signal, source, source_event_id ORDER BY revision DESC NULLS LAST, occurred_at DESC, observation_id DESC) AS n FROM l),
  m AS (SELECT subject, signal, arg_max(observation_id, (occurred_at, observation_id)) AS observation_id, arg_max(value, (occurred_at, observation_id)) AS value FROM c WHERE (top IS NULL OR n = 1) AND k % 6 > 0 GROUP BY ALL)
  SELECT k.subject, k.signal, m.observation_id, m.value, CASE WHEN m.subject IS NULL THEN 'no_data' ELSE 'observed' END AS availability FROM (SELECT DISTINCT subject, signal FROM {EV}) k LEFT JOIN m ON m.subject = k.subject AND m.signal = k.signal""")
def retraction_reselect(s, d):
    """Every sixth row isn't observed."""
    rows = revised(s, d).withColumn("availability", F.when(F.col("k") % 6 > 0, "observed").otherwise("unavailable"))
    return corrections.reselected(rows, gone(s, d)).select("subject", "signal", "observation_id", "value", "availability")


@query(f"""WITH h AS (SELECT subject, local_date, observation_id, {RETRACTED} AS gone, source_event_id, signal, value, occurred_at FROM {FACTS} WHERE signal = 'view'),
  t AS (SELECT DISTINCT subject, local_date FROM h WHERE gone), r AS (SELECT h.* FROM h JOIN t USING (subject, local_date)),
  b AS (SELECT subject, local_date, arg_min(observation_id, (occurred_at, observation_id)) AS o FROM r WHERE value >= 20 GROUP BY ALL), a AS (SELECT subject, local_date, arg_min(observation_id, (occurred_at, observation_id)) AS o FROM r WHERE value >= 20 AND NOT gone GROUP BY ALL)
  SELECT subject, local_date, o AS observation_id, CASE WHEN bool_or(w = 0) AND bool_or(w = 1) THEN 'kept' WHEN bool_or(w = 0) THEN 'withdrawn' ELSE 'added' END AS change FROM (SELECT *, 0 AS w FROM b UNION ALL SELECT *, 1 AS w FROM a) GROUP BY ALL""")
def rule_replay(s, d):
    """The day's first view of 20 or more, by a condition of one's own, before and after retractions."""
    rules.register("at_least", lambda definition, now, before: now >= F.lit(definition.value))
    return corrections.replayed(revised(s, d), gone(s, d), rules.Definition("r", "view", "at_least", 20.0), rules.hits)


@query(f"""SELECT observation_id AS event_id, CASE WHEN k % 7 > 1 THEN ({RETRACTED}) OR EXISTS (SELECT 1 FROM {GONE} g WHERE g.subject = f.subject AND g.signal = f.signal AND g.source = f.source AND g.source_event_id = f.source_event_id + 1)
  ELSE EXISTS (SELECT 1 FROM {GONE} g WHERE g.subject = f.subject AND g.signal = f.signal) END AS gone FROM {FACTS} f""")
def event_dependencies(s, d):
    """Events of two facts each; some recorded none or not all."""
    rows, k = revised(s, d), F.col("k")
    two = F.array(F.struct("signal", "source", "source_event_id"), F.struct("signal", "source", (F.col("source_event_id") + 1).alias("source_event_id")))
    events = rows.select(F.col("observation_id").alias("event_id"), "subject", "signal", F.when(k % 7 > 0, two).alias("fact_dependencies"), (k % 7 > 1).alias("dependencies_complete"))
    return corrections.dependents(events, gone(s, d)).select("event_id", "gone")


@query(f"SELECT DISTINCT subject, signal, source_event_id, NOT (signal IN ('view', 'click') AND source_event_id = 3) AS refused FROM {FACTS} WHERE {RETRACTED}")
def retraction_refusal(s, d):
    dims = s.createDataFrame([("view", "source_event_id"), ("click", "source_event_id"), ("error", "singleton")], "signal string, identity string")
    asked = gone(s, d).distinct().withColumn("asked", F.col("source_event_id"))
    asked = asked.withColumn("source_event_id", F.when(F.col("asked") == 3, F.col("asked")))
    return corrections.refuse_unsupported(asked, dims).select("subject", "signal", F.col("asked").alias("source_event_id"), "refused")


CONFLICTS = "(SELECT event_id, user_id AS subject, 'c' || event_id AS conflict_id, event_type AS signal, ts AS created_at, CASE WHEN event_id % 5 = 0 THEN 'resolved' ELSE 'pending' END AS status, (event_id % 9)::VARCHAR AS candidate_revision FROM events)"


def conflict_rows(s, d):
    e = read(s, d, "events")
    return e.select("event_id", F.col("user_id").alias("subject"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("conflict_id"), F.col("event_type").alias("signal"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 5 == 0, "resolved").otherwise("pending").alias("status"), (F.col("event_id") % 9).cast("string").alias("candidate_revision"))


@query(f"SELECT conflict_id, created_at FROM {CONFLICTS} WHERE status = 'pending' AND signal = 'view' AND created_at BETWEEN TIMESTAMP '{D0} 00:00:00' AND TIMESTAMP '{D1} 00:00:00' ORDER BY created_at, conflict_id")
def conflict_scan(s, d):
    rows = conflict_rows(s, d).where((F.col("status") == "pending") & (F.col("signal") == "view") & F.col("created_at").between(day(D0).cast("timestamp_ntz"), day(D1).cast("timestamp_ntz")))
    return rows.orderBy("created_at", "conflict_id").select("conflict_id", "created_at")


@query(f"SELECT conflict_id, CASE WHEN ok THEN 'resolved' ELSE status END AS status, CASE WHEN ok THEN '5' END AS resolution_revision FROM (SELECT *, status = 'pending' AND event_id % 9 < 5 AND event_id % 2 = 0 AS ok FROM {CONFLICTS})")
def conflict_resolve(s, d):
    rows = conflict_rows(s, d)
    answers = rows.where("event_id % 2 = 0").select("subject", "conflict_id", F.lit("5").alias("revision"))
    return corrections.resolved(rows, answers).select("conflict_id", "status", "resolution_revision")


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS n_ids FROM events")
def conflict_record(s, d):
    rows = conflict_rows(s, d)
    return corrections.recorded(rows.where("event_id % 3 = 0"), rows.unionByName(rows)).agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("n_ids"))


@query(f"SELECT fact_key, revision, content_digest, EXISTS (SELECT 1 FROM {EV} e WHERE e.k % 2 = 0 AND e.observation_id % 40 = fact_key AND e.k = revision AND e.cents % 3 = content_digest) AS proven FROM (SELECT DISTINCT observation_id % 40 AS fact_key, k AS revision, cents % 3 AS content_digest FROM {EV})")
def identity_evidence(s, d):
    rows = event_facts(s, d).select((F.col("observation_id") % 40).alias("fact_key"), F.col("k").alias("revision"), (F.col("cents") % 3).alias("content_digest"))
    return corrections.proven(rows.where("revision % 2 = 0"), rows.distinct())


# rules


@query(f"""WITH x AS (SELECT subject, signal, local_date, max(cents) / 100.0::DOUBLE AS v FROM {EV} GROUP BY ALL), g AS (SELECT *, local_date - row_number() OVER (PARTITION BY subject, signal ORDER BY local_date)::INT AS isl FROM x WHERE v >= 15),
  l AS (SELECT x.subject, x.signal, x.local_date, coalesce(n, 0) AS length FROM x LEFT JOIN (SELECT subject, signal, local_date, row_number() OVER (PARTITION BY subject, signal, isl ORDER BY local_date) AS n FROM g) r USING (subject, signal, local_date)),
  m AS (SELECT *, max(CASE WHEN length >= 2 THEN local_date END) OVER w AS closed, max(CASE WHEN length = 0 THEN local_date END) OVER w AS opened FROM l WINDOW w AS (PARTITION BY subject, signal ORDER BY local_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), h AS (SELECT *, closed IS NOT NULL AND (opened IS NULL OR closed > opened) AS held FROM m)
  SELECT subject, signal, local_date, length, CASE WHEN held AND length = 0 THEN 'recovered' WHEN held THEN 'already_firing' WHEN length < 2 THEN 'streak_too_short' ELSE 'streak_reached' END AS reason, NOT held AND length >= 2 AS fires FROM h""")
def streak_trigger_latch(s, d):
    from .catalogue import daily_max

    return trends.latched(daily_max(s, d), ("subject", "signal"), F.col("value") >= 15, 2)


@query(f"""WITH x AS (SELECT subject, signal, local_date, max(cents) / 100.0::DOUBLE AS v FROM {EV} WHERE local_date <= DATE '{D1}' AND local_date >= DATE '{D1}' - 90 GROUP BY ALL), p AS (SELECT x.*, definition_id, periods FROM x JOIN (VALUES ('low', 'view', 'lt', 30.0, 2), ('high', 'click', 'gte', 10.0, 3)) t(definition_id, signal, op, threshold, periods) USING (signal) WHERE day(local_date) % 13 <> 0 AND CASE op WHEN 'lt' THEN v < threshold ELSE v >= threshold END),
  r AS (SELECT subject, definition_id, periods, count(*) AS n, max(local_date) AS last FROM (SELECT *, local_date - row_number() OVER (PARTITION BY subject, definition_id ORDER BY local_date)::INT AS isl FROM p) GROUP BY subject, definition_id, periods, isl)
  SELECT subject, definition_id, least(n, 90) AS length, least(n - 1, 90) AS previous_length, least(n, 90) >= periods AND least(n - 1, 90) < periods AS fires FROM r WHERE last = DATE '{D1}'""")
def scheduled_streaks(s, d):
    from .catalogue import daily_max

    days = daily_max(s, d).withColumn("completeness", F.when(F.dayofmonth("local_date") % 13 == 0, "incomplete").otherwise("complete"))
    defs = s.createDataFrame([("low", "view", "lt", 30.0, 2), ("high", "click", "gte", 10.0, 3)], "definition_id string, signal string, operator string, threshold double, periods int")
    return rules.scheduled_streaks(days, defs, day(D1))


@query(f"SELECT observation_id, definition_id FROM {EV} e JOIN (VALUES ('all', 'view', NULL), ('one', 'view', 5), ('other', 'click', NULL)) t(definition_id, signal, own) USING (signal) WHERE own IS NULL OR own = subject")
def definitions_for_facts(s, d):
    defs = s.createDataFrame([("all", "view", None, True), ("one", "view", 5, True), ("other", "click", None, True), ("off", "view", None, False)], "definition_id string, signal string, subject long, enabled boolean")
    return rules.for_facts(event_facts(s, d), defs).select("observation_id", "definition_id")


@query("SELECT event_id::VARCHAR AS definition_id, CASE event_id % 3 WHEN 0 THEN 'stored' WHEN 1 THEN 'known' ELSE 'conflict' END AS decision FROM events")
def definition_archive(s, d):
    rows = read(s, d, "events").select("event_id", F.col("event_id").cast("string").alias("definition_id"), F.lit(1).alias("version"), F.col("event_type").alias("body"))
    held = rows.where("event_id % 3 > 0").withColumn("body", F.when(F.col("event_id") % 3 == 2, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    return rules.archived(held, rows).select("definition_id", "decision")


# mirrors

MIRROR = f"(SELECT event_id AS item, user_id AS subject, CASE WHEN event_id % 4 = 0 THEN 'work' ELSE 'home' END AS source, CASE WHEN event_id % 6 > 0 THEN ts END AS start_at, event_type AS title, 's' || (event_id % 3) AS last_seen_sync_id, event_id % 5 = 0 AS is_completed FROM events)"


def mirror_rows(s, d):
    e = read(s, d, "events")
    return e.select(
        F.col("event_id").alias("item"), F.col("user_id").alias("subject"), F.when(F.col("event_id") % 4 == 0, "work").otherwise("home").alias("source"), F.when(F.col("event_id") % 6 > 0, F.col("ts")).alias("start_at"),
        F.col("event_type").alias("title"), F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string")).alias("last_seen_sync_id"), (F.col("event_id") % 5 == 0).alias("is_completed"),
    )


@query(f"""WITH m AS (SELECT * FROM {MIRROR}), o AS (SELECT * FROM m WHERE subject = 7 AND source = 'home'), f AS (SELECT item, subject, source, start_at, 'new' AS title, 's9' AS last_seen_sync_id, is_completed FROM m WHERE item % 50 = 1),
  u AS (SELECT * REPLACE (7 AS subject, 'home' AS source) FROM f UNION ALL SELECT * FROM o WHERE item NOT IN (SELECT item FROM f))
  SELECT item, subject, source, title, last_seen_sync_id FROM m WHERE NOT (subject = 7 AND source = 'home') UNION ALL SELECT item, subject, source, title, last_seen_sync_id FROM u WHERE item % 100 <> 51 AND NOT (coalesce(start_at::DATE BETWEEN DATE '{D0}' AND DATE '{D1}', false) AND last_seen_sync_id <> 's9')""")
def mirror_sync_round(s, d):
    m = mirror_rows(s, d)
    items = m.where("item % 50 = 1").withColumn("title", F.lit("new")).drop("subject", "source", "last_seen_sync_id")
    got = mirrors.synced(m, items, m.where("item % 100 = 51").select("item"), mirrors.Sync(7, "home", "s9", "full", (D0, D1), "c9"), ["item"])
    return got.select("item", "subject", "source", "title", "last_seen_sync_id")


@query(f"""SELECT user_id AS subject, 'home' AS source, CASE WHEN user_id = 7 THEN 'c9' ELSE 'c1' END AS cursor, CASE WHEN user_id = 7 THEN TIMESTAMP '{NOW}' ELSE TIMESTAMP '2024-01-01' END AS last_attempt, TIMESTAMP '2024-01-01' AS last_success, CASE WHEN user_id = 7 THEN 'timeout' END AS error
  FROM (SELECT DISTINCT user_id FROM events) WHERE user_id <> 7 UNION ALL SELECT 7, 'home', 'c1', TIMESTAMP '{NOW}', TIMESTAMP '2024-01-01', 'timeout'""")
def sync_state_failed_round(s, d):
    """A failed round keeps cursor and last success; subject 7 is there in all tables."""
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    state = read(s, d, "events").select(F.col("user_id").alias("subject")).where("subject <> 7").distinct().unionByName(s.range(7, 8).select(F.col("id").alias("subject")))
    state = state.select("subject", F.lit("home").alias("source"), F.lit("c1").alias("cursor"), stamp.alias("last_attempt"), stamp.alias("last_success"), F.lit(None).cast("string").alias("error"))
    return mirrors.sync_state(state, mirrors.Sync(7, "home", "s9", "incremental", cursor="c9", error="timeout"), F.lit(NOW).cast("timestamp_ntz"))


@query(f"SELECT item, start_at FROM {MIRROR} WHERE start_at IS NULL OR start_at BETWEEN TIMESTAMP '{D0} 00:00:00' AND TIMESTAMP '{D1} 00:00:00'")
def calendar_scan(s, d):
    return mirrors.calendar(mirror_rows(s, d), day(D0).cast("timestamp_ntz"), day(D1).cast("timestamp_ntz"), key="item").select("item", "start_at")


@query(f"SELECT item, start_at AS due_at FROM {MIRROR} WHERE NOT is_completed")
def reminder_scan(s, d):
    return mirrors.reminders(mirror_rows(s, d).withColumnRenamed("start_at", "due_at"), key="item").select("item", "due_at")


@query(f"""WITH b AS (SELECT *, row_number() OVER (ORDER BY d0, item) - 1 AS base FROM (SELECT item, start_at::DATE AS d0, item % 5 AS f, item % 3 + 1 AS every, CASE WHEN item % 11 = 0 THEN 12 END AS most FROM {MIRROR} WHERE start_at IS NOT NULL)),
  r AS (SELECT b.*, t::DATE AS occurs_on FROM b, LATERAL (SELECT unnest(generate_series(b.d0::TIMESTAMP, TIMESTAMP '2024-02-10', INTERVAL 1 DAY)) AS t) WHERE f < 3),
  h AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY occurs_on) AS nth FROM r WHERE CASE f WHEN 0 THEN (occurs_on - d0) % every = 0 WHEN 1 THEN isodow(occurs_on) IN (1, 4) AND ((date_trunc('week', occurs_on)::DATE - date_trunc('week', d0)::DATE) // 7) % every = 0 ELSE day(occurs_on) = day(d0) AND ((year(occurs_on) - year(d0)) * 12 + month(occurs_on) - month(d0)) % every = 0 END),
  y AS (SELECT base, item, occurs_on, true AS expanded FROM h WHERE occurs_on >= DATE '2024-01-20' AND (most IS NULL OR nth <= most) UNION ALL SELECT base, item, CASE WHEN f = 3 THEN d0 END, false FROM b WHERE f >= 3),
  z AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY occurs_on) - 1 AS inner_ FROM y)
  SELECT item, occurs_on, CASE WHEN occurs_on IS NOT NULL THEN strftime(occurs_on, '%Y-%m-%d') || 'T10:30:00+02:00' END AS occurs_at, expanded, base::INT AS base, inner_::INT AS "inner" FROM z WHERE base > 20 OR (base = 20 AND inner_ >= 2) ORDER BY base, inner_ LIMIT 400""")
def calendar_page_expanded(s, d):
    """Series of all kinds, some with a count, some single, some that can't be expanded."""
    f = F.col("item") % 5
    rows = mirror_rows(s, d).where("start_at IS NOT NULL")
    series = rows.select(
        "item", F.to_date("start_at").alias("start"), F.when(f == 0, "daily").when(f == 1, "weekly").when(f == 2, "monthly").alias("freq"), (F.col("item") % 3 + 1).cast("int").alias("interval"),
        F.when(f == 1, F.array(F.lit(0), F.lit(3))).alias("byweekday"), F.lit(None).cast("date").alias("until"), F.when(F.col("item") % 11 == 0, 12).alias("count"), F.when(f == 4, "freq").alias("problem"),
        F.concat(F.to_date("start_at").cast("string"), F.lit("T10:30:00+02:00")).alias("start_text"),
    )
    got = mirrors.expanded_page(series, ("start", "item"), day("2024-01-20"), day("2024-02-10"), 400, (20, 2))
    return got.select("item", "occurs_on", "occurs_at", "expanded", "base", "inner")


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'weekly' WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE 'daily' END AS freq, CASE event_id % 5 WHEN 0 THEN 2 WHEN 4 THEN 1 END AS "interval", CASE WHEN event_id % 5 = 4 THEN DATE '2024-03-01' END AS until,
  CASE event_id % 5 WHEN 1 THEN 'freq' WHEN 2 THEN 'interval' WHEN 3 THEN 'bysetpos' END AS problem FROM events""")
def recurrence_parse(s, d):
    forms = ['{"freq":"Weekly","interval":2,"byweekday":[0,2]}', '{"freq":"yearly"}', '{"freq":"daily","interval":0}', '{"freq":"monthly","bysetpos":2}', '{"freq":"daily","until":"2024-03-01T09:00:00Z"}']
    rows = read(s, d, "events").select("event_id", F.element_at(F.array(*map(F.lit, forms)), (1 + F.col("event_id") % 5).cast("int")).alias("rule"))
    return mirrors.parse_recurrence(rows, "rule").select("event_id", "freq", "interval", "until", "problem")


# deliveries

OUT = f"""(SELECT event_id, ['pending', 'claimed', 'delivered', 'unknown'][1 + event_id % 4] AS state, (event_id % 3)::INT AS attempt, 'w:' || (event_id % 3) AS token, CASE WHEN event_id % 4 = 1 THEN ts END AS lease_until, event_id % 5 = 0 AS started, event_id % 7 = 0 AS invalidated,
  CASE WHEN event_id % 8 = 0 THEN TIMESTAMP '2024-03-01' END AS next_attempt_at FROM events)"""


def outbox_rows(s, d):
    k = F.col("event_id")
    state = F.element_at(F.array(*map(F.lit, ("pending", "claimed", "delivered", "unknown"))), (1 + k % 4).cast("int"))
    return read(s, d, "events").select(
        "event_id", state.alias("state"), (k % 3).cast("int").alias("attempt"), F.concat(F.lit("w:"), (k % 3).cast("string")).alias("token"), F.when(k % 4 == 1, F.col("ts")).alias("lease_until"), (k % 5 == 0).alias("started"),
        (k % 7 == 0).alias("invalidated"), F.when(k % 8 == 0, F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")).alias("next_attempt_at"), F.lit("resv").alias("reservation"),
    )


MID = "2024-01-15 00:00:00"


@query(f"""SELECT event_id, CASE WHEN ended AND started THEN 'unknown' WHEN take THEN 'claimed' ELSE state END AS state, attempt + CASE WHEN take THEN 1 ELSE 0 END AS attempt, CASE WHEN take THEN 'z:' || (attempt + 1) ELSE token END AS token, CASE WHEN take THEN 'resv_' || event_id || '_' || (attempt + 1) ELSE 'resv' END AS reservation FROM
  (SELECT *, (state = 'pending' OR ended) AND NOT started AND NOT invalidated AND coalesce(next_attempt_at <= TIMESTAMP '{MID}', true) AS take FROM (SELECT *, coalesce(state = 'claimed' AND lease_until <= TIMESTAMP '{MID}', false) AS ended FROM {OUT}))""")
def outbox_claim(s, d):
    got = outbox.claimed(outbox_rows(s, d), F.lit(MID).cast("timestamp_ntz"), "z", 60)
    return got.select("event_id", "state", "attempt", "token", "reservation")


@query(f"SELECT event_id, coalesce(state = 'claimed' AND event_id % 3 > 0 AND NOT started AND NOT invalidated AND lease_until > TIMESTAMP '{MID}', false) AS may_dispatch FROM {OUT}")
def dispatch_fence(s, d):
    rows = outbox_rows(s, d)
    return outbox.begun(rows, rows.select("event_id", F.when(F.col("event_id") % 3 > 0, F.col("token")).otherwise("stale").alias("token")), F.lit(MID).cast("timestamp_ntz")).select("event_id", "may_dispatch")


@query(f"""SELECT event_id, CASE WHEN moves THEN too ELSE state END AS state, NOT moves AS audit_only, CASE WHEN moves AND too <> 'delivered' THEN NULL ELSE 'resv' END AS reservation FROM (SELECT *, event_id % 3 > 0 AND state IN ('claimed', 'unknown') AS moves FROM
  (SELECT *, CASE event_id % 2 WHEN 0 THEN 'delivered' ELSE CASE WHEN invalidated THEN 'invalidated' ELSE 'pending' END END AS too FROM {OUT}))""")
def receipt_apply(s, d):
    rows = outbox_rows(s, d)
    receipts = rows.select("event_id", F.when(F.col("event_id") % 3 > 0, F.col("token")).otherwise("stale").alias("token"), F.when(F.col("event_id") % 2 == 0, "accepted").otherwise("enqueue_failed").alias("status"))
    return outbox.settled(rows, receipts).select("event_id", "state", "audit_only", "reservation")


@query(f"SELECT event_id, state FROM {OUT} WHERE state IN ('pending', 'claimed')")
def pending_events(s, d):
    return outbox.waiting(outbox_rows(s, d)).select("event_id", "state")


# reading


@query(f"SELECT observation_id, n::INT AS place, total > 20 AS more FROM (SELECT observation_id, row_number() OVER (ORDER BY occurred_at, observation_id) AS n, count(*) OVER () AS total FROM {EV} WHERE signal = 'view') WHERE n <= 20")
def page_with_more(s, d):
    return retention.page_with_more(event_facts(s, d).where("signal = 'view'"), ("occurred_at", "observation_id"), 20).select("observation_id", "place", "more")


@query(f"SELECT collection, count(*) > 200 AS truncated FROM (SELECT signal AS collection FROM {EV} WHERE signal IN ('view', 'click') UNION ALL SELECT 'all' FROM {EV}) GROUP BY ALL")
def export_truncated(s, d):
    rows = event_facts(s, d)
    tables = {"all": rows, "view": rows.where("signal = 'view'"), "click": rows.where("signal = 'click'")}
    return retention.drained(tables, ("occurred_at", "observation_id"), 200)[1]


@query("""SELECT signal, d AS detail_days, a AS aggregate_days, h AS stores_history, h AND d = -1 AS details_forever, h AND a = -1 AS aggregates_forever FROM
  (SELECT s_name AS signal, CASE WHEN s_suppkey % 3 = 0 THEN -1 ELSE s_suppkey % 90 END AS d, CASE WHEN s_suppkey % 5 = 0 THEN -1 ELSE s_suppkey % 400 END AS a, s_suppkey % 4 IN (1, 2) AS h FROM supplier)""")
def retention_lookup(s, d):
    """What each signal keeps, of as many declarations as there are suppliers."""
    n = F.col("s_suppkey")
    storage = F.element_at(F.array(*map(F.lit, ("current_only", "current_timeline_aggregate", "current_short_timeline", "source_mirror"))), (n % 4 + 1).cast("int"))
    dims = read(s, d, "supplier").select(F.col("s_name").alias("signal"), storage.alias("storage"), F.when(n % 3 == 0, -1).otherwise(n % 90).cast("int").alias("detail_days"), F.when(n % 5 == 0, -1).otherwise(n % 400).cast("int").alias("aggregate_days"))
    return retention.lookup(dims).drop("storage")


# projections


@query(f"SELECT observation_id, CASE k % 6 WHEN 0 THEN 'switch_off' WHEN 1 THEN 'not_permitted' WHEN 4 THEN 'switch_off' END AS reason FROM {EV}")
def permission_reasons(s, d):
    words = ("off", " Denied ", "on", "", "enabled", "maybe")
    first = F.element_at(F.array(*map(F.lit, words)), (1 + F.col("k") % 6).cast("int"))
    states = F.create_map(F.lit("health"), first, F.lit("health_vitals"), F.when(F.col("k") % 6 == 4, "FALSE").otherwise("granted"))
    return event_facts(s, d).select("observation_id", projection.refused(states, ("steps", "health", "health_vitals")).alias("reason"))


@query(f"SELECT observation_id, signal AS motion_state, NULL::VARCHAR AS place_label, k::VARCHAR AS app_name FROM {EV}")
def signal_projection(s, d):
    rows = event_facts(s, d)
    snapshot, pull = F.create_map(F.lit("app_name"), F.col("k").cast("string"), F.lit("motion_state"), F.lit("x")), F.create_map(F.lit("motion_state"), F.col("signal"), F.lit("app_name"), F.lit("x"))
    return rows.select("observation_id", *projection.projected(snapshot, pull, "motion", ("motion_state", "place_label")), *projection.projected(snapshot, pull, "app", ("app_name",)))


@query(f"SELECT observation_id, (value IS DISTINCT FROM CASE WHEN k % 2 = 0 THEN value END) AND signal NOT IN ('battery', 'time') AND k % 3 > 0 AS worth, CASE WHEN k < 40 THEN 'stale' WHEN k = 40 THEN 'same_ts' ELSE 'newer' END AS arrival FROM {EV}")
def wake_worthiness(s, d):
    signal = F.when(F.col("k") % 3 == 0, "motion_state").otherwise(F.col("signal"))
    worth = projection.significant(signal, F.when(F.col("k") % 2 == 0, F.col("value")), F.col("value"))
    return event_facts(s, d).select("observation_id", worth.alias("worth"), projection.arrival(F.col("k"), F.lit(40)).alias("arrival"))


@query(f"""SELECT observation_id, CASE k % 3 WHEN 0 THEN 'photo_added' ELSE 'scene_change' END AS trigger, CASE WHEN k % 3 = 0 THEN 'new_photo' END AS says, repeat('w', 160) AS wake_id, NULL::VARCHAR AS source, least(k, 10) AS n_refs, signal AS locale FROM {EV} WHERE k % 3 < 2""")
def wake_projection(s, d):
    k = F.col("k")
    items = event_facts(s, d).select(
        "observation_id", F.when(k % 3 == 0, "photo_added").when(k % 3 == 1, "scene_change").otherwise("other").alias("trigger"), F.lit("w" * 300).alias("wake_id"), F.lit("").alias("source"), F.lit(None).cast("string").alias("change_digest"),
        F.when(k > 0, F.array_repeat(F.lit("r"), k)).otherwise(F.array().cast("array<string>")).alias("origin_refs"), F.create_map(F.lit("locale"), F.col("signal"), F.lit("secret"), F.lit("x")).alias("presence_hints"),
    )
    got = projection.wake_facts(items)
    return got.select("observation_id", "trigger", "says", "wake_id", "source", F.size("origin_refs").alias("n_refs"), F.try_element_at("presence_hints", F.lit("locale")).alias("locale"))


@query("""SELECT report_key, field, CASE WHEN n % 7 = 0 THEN 'split' || n % 3 WHEN n % 2 = 0 THEN report_key END AS storage_signal, min(ttl) AS ttl_seconds, n % 7 = 0 AS split_off FROM
  (SELECT l_suppkey AS n, 'r' || l_suppkey AS report_key, l_returnflag AS field, l_quantity::INT * 60 AS ttl FROM lineitem) GROUP BY ALL""")
def field_routes(s, d):
    """Where the fields of all reported lines are stored: split off, in their own signal, or nowhere."""
    n = F.col("l_suppkey")
    key = F.concat(F.lit("r"), n.cast("string")).alias("report_key")
    lines = read(s, d, "lineitem")
    reported = lines.select(key, F.col("l_returnflag").alias("field"), F.col("l_orderkey").cast("string").alias("capability"), (F.col("l_quantity").cast("int") * 60).alias("ttl_seconds"))
    fields = lines.select(n, F.col("l_returnflag").alias("field")).distinct()
    splits = fields.where("l_suppkey % 7 = 0").select(key, "field", F.concat(F.lit("split"), (n % 3).cast("string")).alias("split_signal"))
    return projection.routes(reported, splits, fields.where("l_suppkey % 2 = 0").select(key.alias("signal"), "field"))


@query(f"SELECT observation_id, CASE WHEN k % 5 = 0 THEN 'unavailable' WHEN k % 3 = 0 THEN 'no_observation' WHEN k % 2 = 0 THEN 'observed_zero' ELSE 'observed' END AS state FROM {EV}")
def observation_states(s, d):
    k = F.col("k")
    return event_facts(s, d).select("observation_id", projection.classified(F.when(k % 3 > 0, F.col("value")), k % 2 == 0, k % 5 > 0).alias("state"))


@query(f"""SELECT observation_id, '{{"a":"' || signal || '","k":"' || k || '","é":"ü"}}' AS canonical FROM {EV}""")
def canonical_json(s, d):
    values = F.create_map(F.lit("k"), F.col("k").cast("string"), F.lit("é"), F.lit("ü"), F.lit("a"), F.col("signal"))
    return event_facts(s, d).select("observation_id", scalars.canonical_json(values).alias("canonical"))


@query(f"SELECT observation_id, round_even(value / 7, 3) AS mean, round_even(k / 8.0, 2)::DOUBLE AS half FROM {EV}")
def reader_rounding(s, d):
    return event_facts(s, d).select("observation_id", trends.rounded(F.col("value") / 7).alias("mean"), trends.rounded(F.col("k") / 8, 2).cast("double").alias("half"))




# against the declarations


@query(f"""SELECT observation_id, CASE WHEN signal = 'error' THEN 'unknown_signal' ELSE array_to_string(list_sort(list_filter([
    CASE WHEN k % 7 = 0 THEN CASE WHEN signal = 'view' THEN 'missing:weight' END WHEN k % 7 = 1 THEN 'not_a_number:weight' WHEN k % 4 = 3 THEN 'invalid_units:weight' WHEN NOT w BETWEEN 2 AND 60 THEN 'out_of_range:weight' END,
    CASE WHEN k % 5 = 0 THEN 'not_boolean:flag' END, CASE WHEN k % 3 = 0 THEN 'not_a_member:mood' END], lambda x: x IS NOT NULL)), ',') END AS problems,
  CASE WHEN signal <> 'error' AND k % 7 > 1 AND k % 4 < 3 AND w BETWEEN 2 AND 60 THEN round(w, 6) END AS weight, signal <> 'error' AND k % 7 > 0 AND k % 4 IN (0, 1, 3) AS converted, CASE WHEN signal <> 'error' AND k % 5 > 0 THEN 'true' END AS flag, CASE WHEN signal <> 'error' AND k % 3 > 0 THEN 'good' END AS mood
  FROM (SELECT *, CASE k % 4 WHEN 0 THEN value * 0.45359237::DOUBLE WHEN 1 THEN value * 0.001::DOUBLE ELSE value END AS w FROM {EV})""")
def manifest_ingest(s, d):
    """view needs a weight, click may have one; coordinates are restricted, `extra` isn't declared, error isn't a signal."""
    from ..operators import manifest

    k = F.col("k")
    dims = [(g, f, t, u, lo, hi, n, p, e) for g, need in (("view", False), ("click", True), ("purchase", True), ("search", True), ("signup", True), ("login", True), ("logout", True), ("add_to_cart", True)) for f, t, u, lo, hi, n, p, e in (
        ("weight", "number", "kg", 2.0, 60.0, need, "personal", []), ("flag", "boolean", None, None, None, True, "public", []), ("mood", "enum", None, None, None, True, "public", ["good", "bad"]), ("coordinate", "object", None, None, None, True, "restricted", []))]
    dims = s.createDataFrame(dims, "signal string, field string, type string, unit string, low double, high double, nullable boolean, privacy string, enum array<string>")
    unit = F.when(k % 4 == 0, "lb").when(k % 4 == 1, "g").when(k % 4 == 2, "kg").otherwise("stone")
    weight = F.when(k % 7 == 1, "heavy").when(k % 7 > 0, F.col("value").cast("string"))
    values = F.create_map(F.lit("weight"), weight, F.lit("flag"), F.when(k % 5 == 0, "perhaps").otherwise("True"), F.lit("mood"), F.when(k % 3 == 0, "odd").otherwise("good"), F.lit("coordinate"), F.lit("1,2"), F.lit("extra"), F.lit("x"))
    rows = event_facts(s, d).withColumns({"availability": F.lit("observed"), "values": values, "units": F.create_map(F.lit("weight"), unit)})
    got = manifest.normalised(rows, dims)
    at = lambda m, f: F.try_element_at(m, F.lit(f))
    converted = F.coalesce(F.map_contains_key("source_units", F.lit("weight")) & F.try_element_at("source_values", F.lit("weight")).isNotNull(), F.lit(False))
    return got.select("observation_id", F.array_join("problems", ",").alias("problems"), F.round(at("stored", "weight").cast("double"), 6).alias("weight"), converted.alias("converted"), at("stored", "flag").alias("flag"), at("stored", "mood").alias("mood"))


@query(f"SELECT observation_id, CASE k % 4 WHEN 0 THEN 'Asia/Shanghai' WHEN 2 THEN 'UTC' END AS zone, CASE k % 4 WHEN 0 THEN 'declared' WHEN 1 THEN 'declared' WHEN 2 THEN 'host' ELSE 'missing' END AS zone_source, CASE WHEN k % 4 = 1 THEN 'unknown_zone' END AS zone_problem FROM {EV}")
def zone_validation(s, d):
    from ..operators import manifest

    k = F.col("k")
    rows = event_facts(s, d).withColumns({"timezone": F.when(k % 4 == 0, "Asia/Shanghai").when(k % 4 == 1, "Mars/Base"), "host_zone": F.when(k % 4 < 3, "UTC")})
    return manifest.known_zones(rows, s.createDataFrame([("Asia/Shanghai",), ("UTC",)], "zone string")).select("observation_id", "zone", "zone_source", "zone_problem")


@query(f"""SELECT observation_id, 'v2:' || sha256('{{"k":"' || k || '","s":"' || signal || '"}}') AS digest, 'o-' || observation_id AS id FROM {EV}""")
def semantic_digests(s, d):
    from ..operators import manifest

    rows = event_facts(s, d).withColumn("n", F.col("observation_id"))
    got = manifest.with_ids(rows, F.concat(F.lit("o-"), F.col("n").cast("string")))
    return got.select(F.col("n").alias("observation_id"), manifest.semantic_digest(F.create_map(F.lit("s"), F.col("signal"), F.lit("k"), F.col("k").cast("string"))).alias("digest"), F.col("observation_id").alias("id"))


@query(f"""WITH p AS (SELECT subject, signal, list(v ORDER BY local_date) AS vs FROM (SELECT subject, signal, local_date, max(cents) / 100.0::DOUBLE AS v FROM {EV} GROUP BY ALL) GROUP BY ALL), q AS (SELECT *, vs[-1] AS cur, list_sort(CASE WHEN len(vs) > 1 THEN vs[:-2] ELSE vs END) AS base FROM p),
  f AS (SELECT *, CASE WHEN len(base) % 2 = 1 THEN base[len(base) // 2 + 1] ELSE (base[len(base) // 2] + base[len(base) // 2 + 1]) / 2 END AS m FROM q WHERE len(base) >= 2), g AS (SELECT *, round_even(abs(round_even(cur - m, 3)) / greatest(abs(m), 1), 6) AS magnitude FROM f),
  r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY magnitude DESC, signal) AS place FROM g QUALIFY place <= 3), t AS (SELECT user_id AS subject, event_type AS signal, max(ts) AS seen FROM events WHERE event_type <> 'click' GROUP BY ALL)
  SELECT r.subject, r.signal, r.place::INT AS place, magnitude, CASE WHEN fresh THEN cur END AS current, CASE WHEN NOT fresh THEN cur END AS last_known, CASE WHEN NOT fresh THEN seen END AS as_of FROM (SELECT r.*, t.seen, coalesce(date_sub('second', t.seen, TIMESTAMP '{NOW}') <= 172800, false) AS fresh FROM r LEFT JOIN t ON t.subject = r.subject AND t.signal = r.signal) r""")
def notable_with_freshness(s, d):
    from .catalogue import daily_max

    keys = ("subject", "signal", "field")
    trend = trends.fluctuating(daily_max(s, d).withColumn("field", F.lit("v")), keys)
    reports = event_facts(s, d).where("signal <> 'click'").groupBy("subject", "signal").agg(F.max("occurred_at").alias("reported_at")).withColumn("field", F.lit("v"))
    ttl = event_facts(s, d).select("signal").distinct().withColumn("ttl_seconds", F.lit(172_800))
    got = trends.notable_readings(trend, reports, ttl, F.lit(NOW).cast("timestamp_ntz"), 3)
    return got.select("subject", "signal", "place", "magnitude", "current", "last_known", "as_of")


@query(f"""WITH v AS (SELECT *, lag(value) OVER (PARTITION BY subject, local_date ORDER BY occurred_at, observation_id) AS p FROM {EV} WHERE signal = 'view'), h AS (SELECT subject, local_date, count(*) AS fired, max(occurred_at) AS at FROM v WHERE p < 20 AND value >= 20 GROUP BY ALL)
  SELECT v.subject, strftime(v.local_date, '%Y-%m-%d') || '@v2' AS scope, arg_max(v.value, (v.occurred_at, v.observation_id)) AS previous, coalesce(any_value(h.fired), 0) AS fired, any_value(h.at) AS last_fired_at FROM v LEFT JOIN h USING (subject, local_date) GROUP BY v.subject, v.local_date""")
def rule_states(s, d):
    return rules.states(event_facts(s, d), rules.Definition("r", "view", "threshold_crossing", 20.0, version=2, fire="every"))


@query(f"""WITH x AS (SELECT subject, local_date, 'a' || (k % 3) AS artist, 't' || (k % 11) AS track, signal <> 'error' AS p, date_diff('microsecond', occurred_at, lead(occurred_at) OVER (PARTITION BY subject, local_date ORDER BY occurred_at, observation_id)) AS us FROM {EV}),
  t AS (SELECT subject, local_date, sum(us) AS us FROM x WHERE p AND us IS NOT NULL GROUP BY ALL), a AS (SELECT *, row_number() OVER (PARTITION BY subject, local_date ORDER BY us DESC, artist) AS n FROM (SELECT subject, local_date, artist, sum(us) AS us FROM x WHERE p AND us IS NOT NULL GROUP BY ALL)),
  h AS (SELECT subject, local_date, string_agg(track, ',' ORDER BY track) AS titles FROM (SELECT *, row_number() OVER (PARTITION BY subject, local_date ORDER BY track) AS n FROM (SELECT DISTINCT subject, local_date, track FROM x WHERE p)) WHERE n <= 4 GROUP BY ALL)
  SELECT b.subject, b.local_date, round(t.us::DOUBLE / 60000000, 2) AS total_minutes, round(a.us::DOUBLE / 60000000, 2) AS most_minutes, h.titles FROM (SELECT DISTINCT subject, local_date FROM x) b LEFT JOIN t USING (subject, local_date) LEFT JOIN (SELECT * FROM a WHERE n = 1) a USING (subject, local_date) LEFT JOIN h USING (subject, local_date)""")
def listening_digest(s, d):
    from ..operators import daily

    rows = event_facts(s, d).withColumns({"artist": F.concat(F.lit("a"), (F.col("k") % 3).cast("string")), "track": F.concat(F.lit("t"), (F.col("k") % 11).cast("string"))})
    got = daily.listening(rows, "track", "artist", F.col("signal") != "error", titles=4)
    return got.select("subject", "local_date", "total_minutes", F.array_max(F.map_values("by_artist")).alias("most_minutes"), F.array_join("distinct_titles", ",").alias("titles"))


@query(f"""WITH x AS (SELECT subject, local_date, occurred_at, observation_id, unnest([0, 1]) AS pos, k FROM {EV}), y AS (SELECT *, CASE WHEN pos = 0 THEN 'e' || (k % 5) ELSE 'meet' || '|' || (k % 3) END AS event_key FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY subject, local_date, event_key ORDER BY occurred_at, observation_id, pos) AS n FROM y)
  SELECT subject, local_date, event_key, row_number() OVER (PARTITION BY subject, local_date ORDER BY occurred_at, observation_id, pos)::INT AS place FROM z WHERE n = 1""")
def event_lists(s, d):
    from ..operators import daily

    none = F.lit(None).cast("string")
    k = F.col("k")
    one = F.struct(F.concat(F.lit("e"), (k % 5).cast("string")).alias("id"), F.lit("t").alias("title"), none.alias("start_time"))
    two = F.struct(none.alias("id"), F.lit("meet").alias("title"), (k % 3).cast("string").alias("start_time"))
    rows = event_facts(s, d).withColumn("items", F.array(one, two))
    return daily.listed_events(rows, "items", ("subject", "local_date")).select("subject", "local_date", "event_key", "place")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'accepted' END AS status, event_id % 3 = 1 AS refused FROM events")
def receipt_finalize(s, d):
    from ..operators import ingest

    e = read(s, d, "events").select("event_id", F.col("user_id").alias("subject"), F.lit("app").alias("producer"), F.col("event_id").alias("report_id"), F.col("event_type").alias("payload_digest"))
    receipts = e.where("event_id % 3 < 2").select("subject", "producer", "report_id", F.when(F.col("event_id") % 3 == 0, F.col("payload_digest")).otherwise("other").alias("payload_digest"), F.lit("accepted").alias("status"))
    return ingest.finalised(e, receipts).select("event_id", "status", "refused")


@query(f"SELECT count(*) AS n FROM (SELECT DISTINCT subject, signal, source, source_event_id FROM {FACTS} WHERE source_event_id % 10 IN (3, 4))")
def retraction_record(s, d):
    rows = revised(s, d).select(*corrections.FACT).distinct()
    held, new = rows.where("source_event_id % 10 = 3"), rows.where("source_event_id % 10 IN (3, 4)")
    return corrections.noted(held, new.unionByName(new)).agg(F.count("*").alias("n"))
