"""Further queries of the catalogue: reports and rejections, projections, read API, exports, generations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import corrections, current, daily, ingest, outbox, retention, rules, trends
from ..sources.facts import event_facts, read
from .catalogue import EV, FACTS, NOW, SERIES, daily_max, now, query, revised

CODES = "CASE k % 5 WHEN 0 THEN 'validation_failed' WHEN 1 THEN 'fact_conflict' WHEN 2 THEN 'fact_revision_details_incomplete' ELSE 'stale_fact_revision' END"


def code():
    k = F.col("k") % 5
    return F.when(k == 0, "validation_failed").when(k == 1, "fact_conflict").when(k == 2, "fact_revision_details_incomplete").otherwise("stale_fact_revision")


@query(f"SELECT subject AS report_id, k AS index, min({CODES}) AS code, array_to_string(list_sort(list(DISTINCT signal)), ',') AS problems FROM {EV} GROUP BY ALL")
def rejection_merge(s, d):
    rows = event_facts(s, d).select(F.col("subject").alias("report_id"), F.col("k").alias("index"), code().alias("code"), F.array("signal").alias("problems"))
    return ingest.merge_rejections(rows).withColumn("problems", F.array_join("problems", ","))


@query(f"""SELECT observation_id, CASE WHEN err = 'fact_conflict' THEN 'resolve_fact_conflict_and_use_new_report_id' WHEN k % 2 = 0 THEN CASE WHEN st IN ('rejected', 'conflict') THEN 'correct_payload_and_use_new_report_id' END
  ELSE CASE {CODES} WHEN 'fact_revision_details_incomplete' THEN 'restore_fact_evidence_and_use_new_report_id' WHEN 'fact_conflict' THEN 'resolve_fact_conflict_and_use_new_report_id' WHEN 'stale_fact_revision' THEN 'use_higher_fact_revision_and_new_report_id' ELSE 'correct_rejected_observations_and_use_new_report_id' END END AS action
  FROM (SELECT *, CASE WHEN k % 11 = 0 THEN 'fact_conflict' END AS err, CASE observation_id % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'duplicate' WHEN 2 THEN 'conflict' ELSE 'rejected' END AS st FROM {EV})""")
def recovery_actions(s, d):
    i = F.col("observation_id") % 4
    status = F.when(i == 0, "accepted").when(i == 1, "duplicate").when(i == 2, "conflict").otherwise("rejected")
    codes = F.when(F.col("k") % 2 == 1, F.array(code())).otherwise(F.array().cast("array<string>"))
    return event_facts(s, d).select("observation_id", ingest.recovery_action(status, F.when(F.col("k") % 11 == 0, "fact_conflict"), codes).alias("action"))


@query(f"SELECT observation_id, 'bad <redacted> for ' || signal || ' near <redacted>' AS said FROM {EV}")
def diagnostics_sanitized(s, d):
    raw = F.concat(F.lit("bad  'x"), F.col("k").cast("string"), F.lit("' for "), F.col("signal"), F.lit("  near "), F.col("k").cast("string"))
    return event_facts(s, d).select("observation_id", scalars.sanitized_problem(raw).alias("said"))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 200 THEN text[:200] || '…(截断)' ELSE text END AS shown FROM conversations")
def safe_context(s, d):
    return read(s, d, "conversations").select("conv_id", "turn", scalars.safe_text(F.col("text")).alias("shown"))


def lengthed(*parts: str) -> str:
    """SQL of the digest: every part behind its length."""
    return "sha256(" + " || chr(31) || ".join(f"length({p}) || ':' || {p}" for p in parts) + ")"


@query(f"""SELECT observation_id, CASE k % 3 WHEN 0 THEN {lengthed("subject::VARCHAR", "'app'", "signal", "observation_id::VARCHAR")} WHEN 1 THEN {lengthed("subject::VARCHAR", "'app'", "signal")} ELSE {lengthed("subject::VARCHAR", "'app'", "signal", "local_date::VARCHAR")} END AS fact_key FROM {EV}""")
def identity_digests(s, d):
    k = F.col("k") % 3
    rows = event_facts(s, d).withColumns({"source": F.lit("app"), "source_event_id": F.col("observation_id"), "occurred_at": F.col("local_date"), "availability": F.lit("observed"), "canonical": F.col("value"), "revision": F.col("k")})
    strategy = F.when(k == 0, "source_event_id").when(k == 1, "singleton").otherwise("deterministic_digest")
    return ingest.identities(rows, strategy).select("observation_id", "fact_key")


MOVES = " OR ".join(f"(a = '{a}' AND b IN ({', '.join(repr(b) for b in to)}))" for a, to in outbox.TRANSITIONS.items())
STATE_LIST = "[" + ", ".join(repr(x) for x in outbox.STATES) + "]"


@query(f"SELECT a, b, {MOVES} AS legal FROM (SELECT DISTINCT {STATE_LIST}[event_id % 9 + 1] AS a, {STATE_LIST}[event_id // 9 % 9 + 1] AS b FROM events)")
def outbox_transitions(s, d):
    states = F.array(*(F.lit(x) for x in outbox.STATES))
    rows = read(s, d, "events").select(F.get(states, (F.col("event_id") % 9).cast("int")).alias("a"), F.get(states, (F.floor(F.col("event_id") / 9) % 9).cast("int")).alias("b")).distinct()
    return rows.withColumn("legal", outbox.can_move(F.col("a"), F.col("b")))


@query("SELECT event_id, user_id AS subject, event_type, ts AS occurred_at FROM events WHERE event_type = 'purchase' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 500")
def events_page(s, d):
    ts = lambda x: F.lit(x).cast("timestamp_ntz")
    rows = read(s, d, "events").where((F.col("event_type") == "purchase") & F.col("ts").between(ts("2024-01-05"), ts("2024-01-20")))
    rows = rows.select("event_id", F.col("user_id").alias("subject"), "event_type", F.col("ts").alias("occurred_at"))
    return retention.page(rows, (F.desc("occurred_at"), F.desc("event_id")), 500)


@query("SELECT 'facts' AS collection, count(*) AS n FROM events WHERE user_id = 3 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey = 3")
def export_subject(s, d):
    tables = {"facts": event_facts(s, d).select("subject"), "orders": read(s, d, "orders").select(F.col("o_custkey").alias("subject"))}
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("collection"), "n") for name, df in retention.export_subject(tables, 3).items()]
    return parts[0].unionByName(parts[1])


@query(f"SELECT subject, count(*) AS n FROM {EV} WHERE subject <> 3 GROUP BY ALL")
def purge_subject(s, d):
    return retention.purge_subject({"facts": event_facts(s, d)}, 3)["facts"].groupBy("subject").agg(F.count("*").alias("n"))


@query(f"""SELECT subject, days = 25 AND NOT bad AS may_activate FROM (SELECT subject, count(DISTINCT local_date) FILTER (local_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-27') AS days, bool_or(k = 7) AS bad FROM {EV} GROUP BY ALL)""")
def generation_activation(s, d):
    day = lambda x: F.lit(x).cast("date")
    rows = event_facts(s, d).groupBy("subject").agg(F.collect_set("local_date").alias("accounted"), F.collect_set(F.when(F.col("k") == 7, F.col("local_date"))).alias("incomplete"))
    rows = rows.withColumns({"start": day("2024-01-03"), "end": day("2024-01-27"), "status": F.lit("complete"), "active_start": day("2024-01-05"), "active_end": day("2024-01-20")})
    return retention.activatable(rows).select("subject", "may_activate")


@query(f"SELECT observation_id, CASE k % 4 WHEN 0 THEN 'observed' WHEN 1 THEN 'no_data' ELSE 'unavailable' END AS availability FROM {EV}")
def availability_states(s, d):
    k = F.col("k") % 4
    data = F.when(k == 0, '{"a":1}').when(k == 1, '""').when(k == 2, "null")
    return event_facts(s, d).select("observation_id", scalars.availability(data).alias("availability"))


@query(f"""SELECT f.observation_id FROM {FACTS} f JOIN (SELECT subject, signal, source, source_event_id, max(k) AS held FROM {FACTS} WHERE k % 3 = 0 GROUP BY ALL) p USING (subject, signal, source, source_event_id) WHERE f.k <= p.held""")
def blocked_by_pending(s, d):
    rows = revised(s, d).withColumn("revision", F.col("k"))
    return corrections.blocked(rows, rows.where("k % 3 = 0"), F.col("revision")).select("observation_id")


@query(f"SELECT subject, signal, local_date, CASE signal WHEN 'view' THEN CASE WHEN n > 0 THEN total / n END WHEN 'click' THEN total::DOUBLE ELSE top END AS representative FROM (SELECT subject, signal, local_date, sum(cents)::BIGINT AS total, count(*) AS n, max(cents)::DOUBLE AS top FROM {EV} GROUP BY ALL)")
def daily_representative(s, d):
    rows = daily.numeric_dist(event_facts(s, d), "cents")
    strategy = F.when(F.col("signal") == "view", "numeric_dist").when(F.col("signal") == "click", "daily_sum").otherwise("main_of_day")
    total = F.col("sum_value").cast("double")
    return rows.select("subject", "signal", "local_date", daily.representative(strategy, total, F.col("sum_value"), F.col("n"), F.col("max_value").cast("double")).alias("representative"))


@query(f"SELECT subject, observation_id FROM {EV} WHERE signal = 'click' AND k % 2 = 0 AND value = 10.0 OR signal = 'click' AND k % 2 = 0 AND k = 4")
def rule_precondition(s, d):
    rows = event_facts(s, d).withColumn("even", F.col("k") % 2)
    a = rules.hits(rows, rules.Definition("r", "click", "equals", 10.0, fire="every", when={"even": 0}))
    b = rules.hits(rows, rules.Definition("r", "click", "equals", 4, fire="every", when={"even": 0}), "k")
    return a.select("subject", "observation_id").union(b.select("subject", "observation_id")).distinct()


@query(f"SELECT observation_id FROM (SELECT *, lag(k % 3) OVER (PARTITION BY subject, signal ORDER BY occurred_at, observation_id) AS was FROM {EV}) WHERE was IS DISTINCT FROM k % 3")
def state_changes_only(s, d):
    """Scheduled repeats of a declared state give no detail row."""
    rows = current.with_previous(event_facts(s, d).withColumn("st", F.col("k") % 3), "st")
    return rows.where(~F.col("previous").eqNullSafe(F.col("st"))).select("observation_id")


@query(f"SELECT subject, signal, max(length) AS longest FROM (SELECT subject, signal, row_number() OVER (PARTITION BY subject, signal, isl ORDER BY local_date) AS length FROM (SELECT *, local_date - row_number() OVER (PARTITION BY subject, signal ORDER BY local_date)::INT AS isl FROM {SERIES})) GROUP BY ALL")
def longest_activity_streak(s, d):
    return trends.streaks(daily_max(s, d), ("subject", "signal"), F.lit(True)).groupBy("subject", "signal").agg(F.max("length").alias("longest"))


@query(f"SELECT subject, signal, count(*) AS n_facts, count(*) FILTER (occurred_at < TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS n_old, min(occurred_at) AS first_at, max(occurred_at) AS last_at FROM {EV} GROUP BY ALL")
def signal_coverage(s, d):
    week = F.timestamp_add("DAY", F.lit(-7), now())
    return event_facts(s, d).groupBy("subject", "signal").agg(F.count("*").alias("n_facts"), F.count_if(F.col("occurred_at") < week).alias("n_old"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"))


@query(f"SELECT observation_id FROM {EV} e WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT subject, signal, k FROM {EV} WHERE observation_id % 2 = 0) x WHERE x.subject = e.subject AND x.signal = e.signal AND x.k = e.k) QUALIFY row_number() OVER (PARTITION BY subject, signal, k ORDER BY observation_id) = 1")
def append_new_facts(s, d):
    rows = event_facts(s, d)
    firsts = corrections.first_deliveries(rows, ("subject", "signal", "k"), ("observation_id",))
    return corrections.new_facts(firsts, rows.where("observation_id % 2 = 0"), ("subject", "signal", "k")).select("observation_id")
