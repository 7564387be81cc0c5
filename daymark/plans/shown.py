"""The catalogue, continued: nested payloads, the board over domains and the glance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import board, daily, delivery, nested, rules
from ..sources.facts import event_facts, read
from .catalogue import EV, NOW, now, query

# nested payloads


def nested_rows(s, d):
    """JSON payloads with unsorted keys, blanks, numbers in several spellings, and numbers that no double holds, at several depths."""
    k = F.col("k")
    big = F.when(k % 10 == 3, F.lit("1e400")).when(k % 10 == 4, F.lit("[2,{\"deep\":[-1E999, 7]}]")).otherwise(F.lit("\"1e400 is text\""))
    value = F.when(k % 8 == 1, F.lit("true")).when(k % 8 == 2, F.lit("null")).otherwise(F.concat((k % 90).cast("string"), F.lit(".50")))
    text = F.concat(
        F.lit('{ "tags":["b" , {"y":1.0,"x":null}], "level":'), value, F.lit(', "mode":"'), F.when(k % 6 == 0, "off").otherwise("on"), F.lit('","extra":'), big, F.lit(',"exact":{"lat":1}, "n": '), F.when(k % 9 == 5, "2.5").otherwise(k.cast("string")), F.lit("}"),
    )
    payload = F.when(k % 20 == 7, F.lit("[1]")).when(k % 20 == 9, F.lit('{"n":1,"n":2}')).otherwise(text)
    return event_facts(s, d).select("observation_id", F.when(F.col("signal") == "error", "unknown").otherwise("pulse").alias("signal"), "k", payload.alias("payload"))


DECLARED = (
    ("pulse", "level", "number", 0.0, 80.0, False, "personal", []), ("pulse", "mode", "enum", None, None, True, "personal", ["on"]), ("pulse", "tags", "array", None, None, True, "public", []),
    ("pulse", "n", "integer", None, None, True, "public", []), ("pulse", "exact", "object", None, None, True, "restricted", []),
)
FIELDS = "signal string, field string, type string, low double, high double, nullable boolean, privacy string, enum array<string>"


@query(f"""SELECT observation_id, CASE WHEN signal = 'error' THEN 'signal: not declared' WHEN k % 20 IN (7, 9) THEN 'payload: no object' WHEN k % 10 = 3 THEN 'extra: invalid_numeric_value' WHEN k % 10 = 4 THEN 'extra[1].deep[0]: invalid_numeric_value'
    ELSE array_to_string(list_filter([CASE WHEN k % 8 = 2 THEN 'level: missing' WHEN k % 8 = 1 THEN 'level: not number' WHEN k % 90 + 0.5 > 80 THEN 'level: out_of_range' END, CASE WHEN k % 6 = 0 THEN 'mode: not_a_member' END, CASE WHEN k % 9 = 5 THEN 'n: not integer' END], lambda x: x IS NOT NULL), ',') END AS problems,
  CASE WHEN problems = '' THEN 'exact,extra' END AS dropped, CASE WHEN problems = '' THEN '{{"level":' || (k % 90) || '.5,"mode":"on","n":' || k || ',"tags":["b",{{"x":null,"y":1}}]}}' END AS canonical FROM {EV}""")
def variant_ingest(s, d):
    got = nested.ingested(nested_rows(s, d), s.createDataFrame(DECLARED, FIELDS))
    return got.select("observation_id", F.array_join("problems", ",").alias("problems"), F.array_join("dropped", ",").alias("dropped"), "canonical")


@query(f"""SELECT observation_id, '{{"B":' || k || ',"a":[' || (k % 3) || ',{{"z":[],"é":' || (CASE WHEN k % 2 = 0 THEN 'true' ELSE '"x\\"y"' END) || '}}],"b":' || CASE WHEN k % 4 = 0 THEN 'null' ELSE (k % 4)::VARCHAR END || '}}' AS canonical FROM {EV}""")
def canonical_nested(s, d):
    """The same value in any order, spacing and spelling has one text."""
    k = F.col("k")
    inner = F.concat(F.lit('{"z" : [ ], "\\u00e9":'), F.when(k % 2 == 0, "true").otherwise('"x\\"y"'), F.lit("}"))
    text = F.when(k % 2 == 0, F.concat(F.lit('{"b":'), F.when(k % 4 == 0, "null").otherwise((k % 4).cast("string")), F.lit(', "a":['), (k % 3).cast("string"), F.lit(".0,"), inner, F.lit('],"B":'), k.cast("string"), F.lit("}")))
    text = text.otherwise(F.concat(F.lit('{"B":'), k.cast("string"), F.lit('.00,"a":['), (k % 3).cast("string"), F.lit(","), inner, F.lit('],\n"b":'), (k % 4).cast("string"), F.lit("}")))
    return event_facts(s, d).select("observation_id", nested.canonical(F.parse_json(text)).alias("canonical"))


# glance and board

NAMES = tuple(board.GLANCE)
LATEST = f"(SELECT subject, {list(NAMES)}[i + 1] AS signal, arg_max(k, observation_id) AS k FROM (SELECT *, observation_id % {len(NAMES)} AS i FROM {EV}) GROUP BY ALL)"


@query(f"""WITH l AS (SELECT *, k % 13 > 0 AND k % 17 > 0 AND k % 19 > 0 AS ok FROM {LATEST}), f AS (SELECT subject, coalesce(bool_or(ok AND signal = 'app' AND k % 2 = 1), false) AS app, coalesce(bool_or(ok AND signal = 'calendar' AND k % 3 > 0), false) AS cal,
    coalesce(bool_or(ok AND CASE signal WHEN 'steps' THEN k % 3 > 0 WHEN 'sleep' THEN k % 2 = 1 WHEN 'cycle' THEN k % 2 = 1 ELSE false END), false) AS health, coalesce(bool_or(ok AND signal = 'location' AND k % 3 > 0), false) AS loc, coalesce(bool_or(ok AND signal = 'now' AND k % 2 = 1), false) AS media,
    coalesce(bool_or(ok AND signal = 'mood'), false) AS mood, coalesce(bool_or(ok AND signal = 'mood' AND k % 2 = 1), false) AS rec, coalesce(bool_or(ok AND signal = 'reminders'), false) AS rem, coalesce(bool_or(ok AND signal = 'reminders' AND k % 3 > 0), false) AS due, coalesce(bool_or(ok AND signal = 'reminders' AND k % 2 > 0), false) AS over_,
    coalesce(bool_or(ok AND signal = 'weather' AND k % 3 <> 1), false) AS wea FROM l GROUP BY subject),
  j AS (SELECT subject, '{{' || array_to_string(list_filter([CASE WHEN app THEN '"app":{{"available":true,"recent_activity":true}}' END, CASE WHEN cal THEN '"calendar":{{"available":true,"has_upcoming":true}}' END, CASE WHEN health THEN '"health":{{"available":true,"notable_change":' || (subject % 3 = 0) || '}}' END,
    CASE WHEN loc THEN '"location":{{"available":true,"notable_change":' || (subject % 2 = 0) || '}}' END, CASE WHEN media THEN '"media":{{"active":true,"available":true,"notable_change":false}}' END, CASE WHEN mood THEN '"mood":{{"available":true,"recorded":' || rec || '}}' END,
    CASE WHEN rem THEN '"reminders":{{"available":true,"has_due":' || due || ',"has_overdue":' || over_ || '}}' END, CASE WHEN wea THEN '"weather":{{"available":true,"notable_change":false}}' END], lambda x: x IS NOT NULL), ',') || '}}' AS glance FROM f)
  SELECT subject, glance, sha256(glance) AS fingerprint FROM j""")
def glance(s, d):
    """Flags of each subject's latest documents, as JSON with a fingerprint."""
    k = F.col("k")
    names = F.array(*map(F.lit, NAMES))
    rows = event_facts(s, d).withColumn("signal", F.element_at(names, (F.col("observation_id") % len(NAMES) + 1).cast("int")))
    rows = rows.groupBy("subject", "signal").agg(F.max_by("k", "observation_id").alias("k"))
    odd = k % 2 == 1
    bodies = {
        "location": F.when(k % 3 > 0, '"place_label":"home"').otherwise('"place_label":" "'), "now": F.when(odd, '"now_playing":{"title":"t"}').otherwise('"now_playing":{"title":""}'), "app": F.when(odd, '"app_name":"a"').otherwise('"app_name":3'),
        "steps": F.when(k % 3 > 0, F.concat(F.lit('"step_count":'), k.cast("string"))).otherwise('"step_count":true'), "sleep": F.when(odd, '"deep_minutes":1.5').otherwise('"x":1'), "cycle": F.when(odd, '"is_active_period":false').otherwise('"is_active_period":"no"'),
        "weather": F.when(k % 3 == 0, '"alerts":[{"x":1},{"severity":"high"}]').when(k % 3 == 1, '"alerts":[{"x":1}]').otherwise('"humidity":0.5'), "mood": F.when(odd, '"recorded_today":true').otherwise('"recorded_today":false'),
        "reminders": F.concat(F.lit('"overdue_count":'), (k % 2).cast("string"), F.lit(',"due_today_count":'), (k % 3).cast("string")), "calendar": F.when(k % 3 == 0, '"calendar_events":[{"title":""}]').when(k % 3 == 1, '"calendar_events":[{"starts_in_min":5}]').otherwise('"calendar_next_event":{"start_time":"9"}'),
    }
    body = F.lit('"other":1')
    for name, text in bodies.items():
        body = F.when(F.col("signal") == name, text).otherwise(body)
    marks = F.concat(F.when(k % 13 == 0, ',"stale":true').otherwise(""), F.when(k % 17 == 0, ',"fresh":false').otherwise(""), F.when(k % 19 == 0, ',"disabled":true').otherwise(""))
    latest = rows.select("subject", "signal", F.parse_json(F.concat(F.lit("{"), body, marks, F.lit("}"))).alias("doc"))
    subjects = rows.select("subject").distinct()
    changed = subjects.where("subject % 2 = 0").select("subject", F.lit("location_signal").alias("signal")).unionByName(subjects.where("subject % 3 = 0").select("subject", F.lit("health_sleep").alias("signal")))
    return board.glance(latest, changed)


HEARD = f"(SELECT subject, local_date, 't' || k % 9 AS track, 'a' || k % 6 AS artist, signal <> 'error' AS playing, date_diff('microsecond', occurred_at, lead(occurred_at) OVER (PARTITION BY subject, local_date ORDER BY occurred_at, observation_id))::BIGINT AS us FROM {EV})"


@query(f"""WITH u AS (SELECT subject, count(*) AS n, max(local_date) AS last FROM {EV} GROUP BY ALL), h AS MATERIALIZED (SELECT * FROM {HEARD}), ba AS (SELECT subject, local_date, artist, round(sum(us) / 60000000.0::DOUBLE, 2) AS m FROM h WHERE playing AND us IS NOT NULL GROUP BY ALL), fs AS (SELECT subject, artist, min(local_date) AS first FROM ba GROUP BY ALL),
  tm AS (SELECT subject, local_date, round(sum(us) / 60000000.0::DOUBLE, 2) AS m FROM h WHERE playing AND us IS NOT NULL GROUP BY ALL), dt AS (SELECT subject, local_date, count(DISTINCT track) AS n FROM h WHERE playing GROUP BY ALL),
  pl AS (SELECT subject, local_date, 'p' || k % 7 AS place, date_diff('microsecond', occurred_at, lead(occurred_at) OVER (PARTITION BY subject, local_date ORDER BY occurred_at, observation_id))::BIGINT AS us FROM {EV}), dw AS (SELECT subject, local_date, place, sum(us)::BIGINT / 60000000.0::DOUBLE AS m FROM pl WHERE us IS NOT NULL GROUP BY ALL),
  vi AS (SELECT subject, local_date, string_agg(DISTINCT place, ',' ORDER BY place) AS v FROM pl GROUP BY ALL),
  ra AS (SELECT subject, list(CASE WHEN k % 7 > 0 THEN signal END ORDER BY CASE WHEN k % 5 > 0 THEN -k ELSE 0 END, observation_id) AS apps FROM {EV} WHERE k < 60 GROUP BY ALL),
  sc AS (SELECT subject, 's' || k % 8 AS scene, max((occurred_at, observation_id)) AS seen FROM {EV} WHERE signal = 'view' AND k % 4 > 0 GROUP BY ALL), s5 AS (SELECT subject, string_agg(scene, ',' ORDER BY seen DESC) AS scenes FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY seen DESC) AS r FROM sc) WHERE r <= 5 GROUP BY ALL),
  ph AS (SELECT subject, count(*) AS n FROM {EV} WHERE signal = 'view' GROUP BY ALL)
  SELECT u.subject, CASE WHEN u.n % 7 > 0 THEN 'p' || u.n % 7 END AS place, dw.m AS minutes_here, vi.v AS visited, CASE WHEN dw.m >= 240 THEN 'long_dwell' END AS stay, CASE WHEN u.n % 3 > 0 THEN 'a' || u.n % 6 END AS artist,
    coalesce((SELECT string_agg(artist, ',' ORDER BY m DESC, artist) FROM (SELECT artist, m FROM ba WHERE ba.subject = u.subject AND ba.local_date = u.last ORDER BY m DESC, artist LIMIT 3)), '') AS top_artists, tm.m AS minutes_heard, dt.n AS distinct_heard,
    CASE WHEN u.n % 3 > 0 AND (fs.first IS NULL OR fs.first >= u.last) THEN 'new_artist' END AS novelty, ra.apps[1] AS app_now, coalesce(array_to_string(list_filter(list_transform(range(1, len(apps) + 1), lambda i: CASE WHEN NOT list_contains(apps[1:i - 1], apps[i]) THEN apps[i] END), lambda x: x IS NOT NULL)[1:5], ','), '') AS apps,
    array_to_string(list_filter([CASE WHEN u.n % 2 = 0 THEN 'steps.step_count.up' END, CASE WHEN u.n % 3 = 0 THEN 'sleep.deep.down' END], lambda x: x IS NOT NULL), ',') AS health, CASE WHEN u.n % 4 = 0 THEN 'none' END AS weather, CASE WHEN u.n % 5 = 0 THEN 'none' END AS mood,
    CASE WHEN u.n % 2 = 0 THEN 'pay,call' ELSE '' END AS overdue, coalesce(ph.n, 0) AS photos, coalesce(s5.scenes, '') AS scenes FROM u LEFT JOIN dw ON dw.subject = u.subject AND dw.local_date = u.last AND dw.place = 'p' || u.n % 7 AND u.n % 7 > 0 LEFT JOIN vi ON vi.subject = u.subject AND vi.local_date = u.last
    LEFT JOIN tm ON tm.subject = u.subject AND tm.local_date = u.last LEFT JOIN dt ON dt.subject = u.subject AND dt.local_date = u.last LEFT JOIN fs ON fs.subject = u.subject AND fs.artist = 'a' || u.n % 6 LEFT JOIN ra ON ra.subject = u.subject LEFT JOIN s5 ON s5.subject = u.subject LEFT JOIN ph ON ph.subject = u.subject""")
def board_by_domain(s, d):
    """Each subject's board: place, music, apps, health, weather, mood, reminders and photos."""
    k = F.col("k")
    name = lambda prefix, col, n: F.concat(F.lit(prefix), (col % n).cast("string"))
    facts = event_facts(s, d).withColumns({"track": name("t", k, 9), "artist": name("a", k, 6), "place": name("p", k, 7)})
    listening = daily.listening(facts, "track", "artist", F.col("signal") != "error")
    dwell = daily.state_dwell(facts, "place", ("subject", "local_date")).groupBy("subject", "local_date").agg(F.map_from_entries(F.collect_list(F.struct("state", "minutes"))).alias("minutes"))
    places = daily.visited(facts, "place", ("subject", "local_date")).join(dwell, ["subject", "local_date"], "left")
    apps = facts.where("k < 60").groupBy("subject").agg(F.to_json(F.array_sort(F.collect_list(F.struct("observation_id", F.when(k % 7 > 0, F.col("signal")).otherwise("").alias("app"), F.when(k % 5 > 0, k).alias("ts"))))).alias("apps"))
    sums = facts.groupBy("subject").agg(F.count("*").alias("n")).join(apps, "subject", "left")
    n = F.col("n")
    snapshot = F.concat(
        F.lit('{"place_label":"'), F.when(n % 7 > 0, name("p", n, 7)).otherwise(""), F.lit('","now_playing":'), F.when(n % 3 > 0, F.concat(F.lit('{"title":"x","artist":"'), name("a", n, 6), F.lit('"}'))).otherwise("null"), F.lit(',"recent_apps":'), F.coalesce("apps", F.lit("[]")), F.lit("}"),
    )
    pull = F.concat(
        F.lit("{"), F.when(n % 4 > 0, '"condition":"rain",').otherwise(""), F.when(n % 5 > 0, '"recorded_today":true,').otherwise('"recorded_today":false,'),
        F.when(n % 2 == 0, '"reminders":[{"title":"pay","overdue":true},{"title":"later","overdue":false},{"overdue":true},{"title":"call","overdue":true}]').otherwise('"reminders":null'), F.lit("}"),
    )
    snapshots = sums.select("subject", F.parse_json(snapshot).alias("snapshot"), F.parse_json(pull).alias("pull"))
    line = lambda cond, place, signal, field, to: sums.where(cond).select("subject", F.lit(place).alias("place"), F.lit(signal).alias("signal"), F.lit(field).alias("field"), F.lit(to).alias("direction"))
    notable = line("n % 2 = 0", 1, "steps", "step_count", "up").unionByName(line("n % 3 = 0", 2, "sleep", "deep", "down"))
    photos = facts.where("signal = 'view'").select("subject", F.col("occurred_at").alias("taken_at"), F.col("observation_id").alias("photo_id"), F.when(k % 4 > 0, name("s", k, 8)).alias("scene"))
    b = board.board(snapshots, listening, places, notable, photos)
    joined = lambda c: F.array_join(c, ",")
    return b.select(
        "subject", F.col("location.now").alias("place"), F.col("location.minutes_today").alias("minutes_here"), joined("location.visited_today").alias("visited"), F.col("location.novelty").alias("stay"), F.col("media.now.artist").alias("artist"), joined("media.top_artists_today").alias("top_artists"),
        F.col("media.minutes_today").alias("minutes_heard"), F.col("media.distinct_today").cast("long").alias("distinct_heard"), F.col("media.novelty").alias("novelty"), F.col("app.now").alias("app_now"), joined("app.recent").alias("apps"), joined("health").alias("health"), F.col("weather.status").alias("weather"),
        F.col("mood.status").alias("mood"), joined("reminders.overdue").alias("overdue"), F.col("photos.recent_count").alias("photos"), joined("photos.scenes").alias("scenes"),
    )


@query(f"SELECT subject, signal, occurred_at AS last_seen FROM (SELECT *, coalesce(lead(occurred_at) OVER (PARTITION BY subject, signal ORDER BY occurred_at), TIMESTAMP '{NOW}') AS nxt FROM {EV}) WHERE date_diff('microsecond', occurred_at, nxt) >= 7 * 86400 * 1000000::BIGINT")
def absence_silences(s, d):
    """Every silence of a week or more, the batch twin of the live rule with timers."""
    return rules.silences(event_facts(s, d), 7 * 86_400, now())


# delivery


class _Host:
    """A host that answers by the event's id."""

    def __call__(self, event: dict, attempt: int) -> str:
        said = ("accepted", "duplicate", "suppressed", "rejected", "enqueue_failed", "no such status", "raises")[event["event_id"] % 7]
        if said == "raises":
            raise ConnectionError("lost")
        return said


@query("""WITH e AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'claimed' ELSE 'delivered' END AS state, event_id % 5 AS attempt, event_id % 4 = 0 AS started, event_id % 11 = 0 AS invalidated, CASE WHEN event_id % 3 = 1 THEN ts + INTERVAL 10 DAY END AS lease, CASE WHEN event_id % 2 = 1 THEN ts + INTERVAL 5 DAY END AS due FROM events),
  t AS (SELECT *, (state = 'pending' OR (state = 'claimed' AND lease <= TIMESTAMP '2024-01-20')) AND coalesce(due <= TIMESTAMP '2024-01-20', true) AND NOT started AND NOT invalidated AS mine, coalesce(state = 'claimed' AND started AND lease <= TIMESTAMP '2024-01-20', false) AS lost FROM e)
  SELECT event_id, CASE WHEN lost THEN 'unknown' WHEN NOT mine THEN state ELSE CASE event_id % 7 WHEN 0 THEN 'delivered' WHEN 1 THEN 'delivered' WHEN 2 THEN 'suppressed' WHEN 3 THEN 'rejected' WHEN 4 THEN CASE WHEN attempt + 1 < 5 THEN 'pending' ELSE 'dead_letter' END ELSE 'unknown' END END AS state,
    (attempt + CASE WHEN mine THEN 1 ELSE 0 END)::INT AS attempt, CASE WHEN mine AND event_id % 7 = 4 AND attempt + 1 < 5 THEN TIMESTAMP '2024-01-20' + to_seconds((30 * 2 ** attempt)::INT) ELSE due END AS next_attempt_at, CASE WHEN mine AND event_id % 7 = 4 AND attempt + 1 < 5 THEN false ELSE started OR mine END AS started FROM t""")
def outbox_round(s, d):
    """A round over the whole outbox: claimed, begun, delivered in the tasks, and settled."""
    e = read(s, d, "events")
    i = F.col("event_id")
    rows = e.select(
        "event_id", F.when(i % 3 == 0, "pending").when(i % 3 == 1, "claimed").otherwise("delivered").alias("state"), (i % 5).cast("int").alias("attempt"), F.lit("old:1").alias("token"), F.when(i % 3 == 1, F.expr("ts + INTERVAL 10 DAY")).alias("lease_until"),
        F.when(i % 2 == 1, F.expr("ts + INTERVAL 5 DAY")).alias("next_attempt_at"), (i % 4 == 0).alias("started"), (i % 11 == 0).alias("invalidated"), F.lit("r").alias("reservation"),
    )
    got, _ = delivery.round_(rows, _Host(), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), "w")
    return got.select("event_id", "state", "attempt", "next_attempt_at", "started")
