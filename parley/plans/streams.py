"""Queries over event streams in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.operators import replies, streams
from parley.sources.driver_tables import event_stream, table

WAIT_MS = 3_600_000
GAP_MS = 21_600_000


def ordered_two_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of two sources that arrive in the order of event_id and were captured up to two hours before; every third one
    tells how far its source is."""
    from parley.plans.audio import ordered_rows

    out = streams.release_order(streams.settled(ordered_rows(spark, sf_dir), WAIT_MS))
    return out.select("session_id", "arrival", "settled_ms", "bound_ms", "held", "late", F.col("place").cast("long").alias("place"))


def vad_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech events with a user's events as frames and their value as probability."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("at_ms", "event_id")) - 1
    frames = event_stream(spark, sf_dir).select("session_id", place.alias("chunk_idx"), (F.col("value") / 100).alias("speech_prob"))
    return streams.speech_events(frames, streams.Vad(threshold=0.3, silence_ms=96, late_silence_ms=64, late_after_ms=256, longest_ms=640, shortest_ms=64))


def debounce_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.bursts(event_stream(spark, sf_dir), GAP_MS)


def _recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in thousands as recordings, numbered from 1."""
    session = F.floor(F.col("event_id") / 1000)
    return table(spark, sf_dir, "events").select(session.alias("session_id"), F.row_number().over(Window.partitionBy(session).orderBy("ts", "event_id")).alias("n"), "value", "event_id")


def sliding_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _recordings(spark, sf_dir).select("session_id", F.col("n").cast("long").alias("n"), "value")
    return streams.envelope(rows).select("session_id", "n", F.round("mean", 8).alias("mean"), F.round("modulation", 8).alias("modulation"))


def lagged_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _recordings(spark, sf_dir).select("session_id", "n", F.col("value").alias("near"), (F.col("event_id") % 17).cast("double").alias("far"))
    return streams.best_lag(rows).select("session_id", F.round("correlation", 6).alias("correlation"))


def idle_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.idle_gaps(event_stream(spark, sf_dir), GAP_MS)


def exactly_once_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as replies: tasks are days of users, by UUID but for every eleventh; every seventh names another task, users from
    140 on are unknown but for one that is current, tasks of every fifth aren't registered, those of users that end in 3 are
    probes, and those of users that end in 4 open turns, which close at event 600."""
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "errored").when(F.col("event_type") == "signup", "message").when(F.col("event_type") == "click", "typing").otherwise("seen")
    day = F.floor(F.col("at_ms") / 86_400_000)
    task = F.format_string("00000000-0000-4000-8000-%06d%06d", "session_id", day)
    rows = event_stream(spark, sf_dir).select(
        F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("no "), task)).otherwise(task).alias("task_id"), F.when(F.col("event_id") % 7 == 0, F.lit("other")).alias("body_task_id"), "session_id", status.alias("status"),
        F.when(F.col("event_id") % 3 != 0, F.lit("text")).alias("reply_text"), F.col("event_id").alias("seq"),
    )
    sessions = rows.where("session_id < 140").select("session_id").distinct()
    tasks = rows.select("task_id", "session_id").distinct()
    pending = tasks.where("session_id % 5 <> 0").withColumn("task_session", F.when(F.col("session_id") % 6 == 1, F.lit(-1)).otherwise(F.col("session_id"))).drop("session_id")
    turns = tasks.where("session_id % 10 = 4").select("task_id", F.lit(600).cast("long").alias("closed_seq"))
    return streams.route(rows, sessions, pending, tasks.where("session_id % 10 = 3").select("task_id"), turns, current="141")


def sse_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each user's stream of tokens; a purchase finishes it."""
    line = F.when(F.col("event_type") == "purchase", F.lit("data: [DONE]")).when(F.col("event_type") == "error", F.lit(": keep-alive")).otherwise(
        F.concat(F.lit('data: {"choices":[{"delta":{"content":"'), F.col("event_type"), F.lit(' "}}]}'))
    )
    rows = event_stream(spark, sf_dir).select(F.col("session_id").alias("key"), F.col("event_id").alias("at"), line.alias("line"))
    return streams.reduced_stream(rows).select("key", "text", "closed")


def bounded_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the log of each user's tasks: few tasks come again and again, four are remembered at a time and three closed
    turns, some answers name another session, and some saves fail."""
    n = F.col("event_id")
    turn = n % 2 == 0
    action = (
        F.when(n % 11 < 4, "register").when(n % 11 < 7, "reply").when(n % 11 == 7, "saved").when(n % 11 == 8, "failed")
        .when(n % 11 == 9, F.when(turn, "open").otherwise("message")).otherwise(F.when(turn, "close").otherwise("message"))
    )
    task = F.floor(n / 3) % 9
    session = F.when(n % 17 == 3, "other").otherwise(F.concat(F.lit("s"), task % 2))
    rows = event_stream(spark, sf_dir).select(F.col("session_id").cast("string").alias("owner"), n.alias("seq"), action.alias("action"), F.concat(F.lit("t"), task).alias("task_id"), session.alias("session_id"))
    return replies.routed(rows, 4, 3)


SQL_EVENTS = "(SELECT event_id, user_id AS session_id, epoch_us(ts) // 1000 AS at_ms, event_type, value FROM events)"

SQL = {
    "bounded_replies": f"""WITH RECURSIVE e AS (SELECT CAST(session_id AS VARCHAR) AS owner, event_id AS seq, event_id % 11 AS m, 't' || (event_id // 3 % 9) AS task,
  CASE WHEN event_id % 17 = 3 THEN 'other' ELSE 's' || (event_id // 3 % 9 % 2) END AS sess FROM {SQL_EVENTS}),
r AS (SELECT *, CASE WHEN m < 4 THEN 'register' WHEN m < 7 THEN 'reply' WHEN m = 7 THEN 'saved' WHEN m = 8 THEN 'failed' WHEN seq % 2 = 1 THEN 'message' WHEN m = 9 THEN 'open' ELSE 'close' END AS action,
  row_number() OVER (PARTITION BY owner ORDER BY seq) AS k FROM e),
f(owner, k, seq, outcome, evicted, pend, fin, turns, ret) AS (
  SELECT owner, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, []::STRUCT(t VARCHAR, s VARCHAR, r BOOLEAN)[], []::VARCHAR[], []::VARCHAR[], []::VARCHAR[] FROM r WHERE k = 1
  UNION ALL SELECT owner, k, seq, outcome,
    CASE WHEN outcome = 'registered' AND len(pend) = 4 THEN pend[1].t WHEN outcome = 'finalized' AND NOT list_contains(fin, task) AND len(fin) = 4 THEN fin[1] WHEN outcome = 'closed' AND NOT list_contains(ret, task) AND len(ret) = 3 THEN ret[1] END,
    CASE WHEN outcome = 'registered' THEN list_append(pend, {{'t': task, 's': sess, 'r': false}})[-4:] WHEN outcome IN ('accepted', 'released') THEN list_transform(pend, lambda x: {{'t': x.t, 's': x.s, 'r': CASE WHEN x.t = task THEN outcome = 'accepted' ELSE x.r END}})
      WHEN outcome = 'finalized' THEN list_filter(pend, lambda x: x.t <> task) ELSE pend END,
    CASE WHEN outcome = 'finalized' AND NOT list_contains(fin, task) THEN list_append(fin, task)[-4:] ELSE fin END,
    CASE WHEN outcome = 'opened' THEN list_append(turns, task) WHEN outcome = 'closed' THEN list_filter(turns, lambda x: x <> task) ELSE turns END,
    CASE WHEN outcome = 'closed' AND NOT list_contains(ret, task) THEN list_append(ret, task)[-3:] ELSE ret END
  FROM (SELECT r.owner, r.k, r.seq, task, sess, pend, fin, turns, ret, CASE
      WHEN action = 'register' THEN CASE WHEN list_contains(list_transform(pend, lambda x: x.t), task) THEN 'known' ELSE 'registered' END
      WHEN action = 'saved' THEN 'finalized' WHEN action = 'failed' THEN 'released'
      WHEN action = 'open' THEN CASE WHEN list_contains(ret, task) OR list_contains(turns, task) THEN 'refused' ELSE 'opened' END
      WHEN action = 'close' THEN CASE WHEN list_contains(turns, task) THEN 'closed' WHEN list_contains(ret, task) THEN 'already_closed' ELSE 'unknown_turn' END
      WHEN action = 'message' AND list_contains(turns, task) THEN 'part' WHEN action = 'message' AND list_contains(ret, task) THEN 'already_finalized'
      WHEN list_contains(fin, task) THEN 'already_finalized' WHEN NOT list_contains(list_transform(pend, lambda x: x.t), task) THEN 'unregistered_task'
      WHEN list_filter(pend, lambda x: x.t = task)[1].s <> sess THEN 'session_mismatch' WHEN list_filter(pend, lambda x: x.t = task)[1].r THEN 'already_finalized' ELSE 'accepted' END AS outcome
    FROM f JOIN r ON r.owner = f.owner AND r.k = f.k + 1))
SELECT owner, seq, outcome, evicted FROM f WHERE k > 0""",
    "ordered_two_source": f"""WITH r AS (SELECT session_id, event_id % 3 = 0 AS progress, event_id % 2 AS source, at_ms - event_id % 7 * 1200000 AS captured_ms, at_ms AS now_ms, event_id AS arrival FROM {SQL_EVENTS}),
s AS (SELECT *, least(coalesce(max(captured_ms) FILTER (WHERE progress AND source = 0) OVER w, 0), coalesce(max(captured_ms) FILTER (WHERE progress AND source = 1) OVER w, 0)) AS settled_ms FROM r
  WINDOW w AS (PARTITION BY session_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b AS (SELECT *, greatest(settled_ms, now_ms - {WAIT_MS}, 0) AS bound_ms FROM s)
SELECT session_id, arrival, CAST(settled_ms AS BIGINT) AS settled_ms, CAST(bound_ms AS BIGINT) AS bound_ms, NOT progress AND captured_ms > bound_ms AS held, NOT progress AND captured_ms <= bound_ms AND captured_ms > settled_ms AS late,
  row_number() OVER (PARTITION BY session_id ORDER BY captured_ms, arrival) AS place FROM b""",
    "vad_segments": f"""WITH RECURSIVE r AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY at_ms, event_id) - 1 AS i, value / 100 >= 0.3 AS speech FROM {SQL_EVENTS}),
f(session_id, i, speaking, quiet, heard, frames, event) AS (SELECT session_id, CAST(-1 AS BIGINT), false, 0, 0, 0, CAST(NULL AS VARCHAR) FROM r WHERE i = 0
  UNION ALL SELECT session_id, i, CASE WHEN NOT was THEN speech ELSE NOT over_ END, CASE WHEN was AND NOT forced AND NOT over_ THEN q ELSE 0 END, CASE WHEN NOT was THEN speech::INT WHEN forced OR over_ THEN 0 ELSE heard + speech::INT END,
    CASE WHEN NOT was THEN speech::INT WHEN forced OR over_ THEN 0 ELSE frames + 1 END, CASE WHEN NOT was AND speech THEN 'start' WHEN forced THEN 'force' WHEN over_ AND heard >= 2 THEN 'end' END
  FROM (SELECT *, was AND NOT forced AND NOT speech AND q >= CASE WHEN frames + 1 >= 8 THEN 2 ELSE 3 END AS over_ FROM (
    SELECT r.session_id, r.i, r.speech, f.speaking AS was, f.heard, f.frames, CASE WHEN r.speech THEN 0 ELSE f.quiet + 1 END AS q, f.speaking AND f.frames + 1 >= 20 AS forced FROM f JOIN r ON r.session_id = f.session_id AND r.i = f.i + 1)))
SELECT session_id, i AS chunk_idx, event FROM f WHERE event IS NOT NULL""",
    "debounce_bursts": f"""WITH e AS (SELECT *, CASE WHEN at_ms - lag(at_ms) OVER (PARTITION BY session_id ORDER BY at_ms, event_id) < {GAP_MS} THEN 0 ELSE 1 END AS edge FROM {SQL_EVENTS}),
b AS (SELECT *, CAST(sum(edge) OVER (PARTITION BY session_id ORDER BY at_ms, event_id) AS BIGINT) AS burst FROM e)
SELECT session_id, burst, min(at_ms) AS first_ms, max(at_ms) AS last_ms, count(*) AS n FROM b GROUP BY session_id, burst""",
    "sliding_envelope": """WITH r AS (SELECT event_id // 1000 AS session_id, row_number() OVER (PARTITION BY event_id // 1000 ORDER BY ts, event_id) AS n, value FROM events),
w AS (SELECT *, avg(value) OVER l AS mean, stddev_pop(value) OVER l AS spread FROM r WINDOW l AS (PARTITION BY session_id ORDER BY n ROWS BETWEEN 95 PRECEDING AND CURRENT ROW))
SELECT session_id, n, round(mean, 8) AS mean, round(spread / (mean + 1e-9), 8) AS modulation FROM w WHERE n >= 96 AND n % 32 = 0""",
    "lagged_correlation": "WITH r AS (SELECT event_id // 1000 AS session_id, row_number() OVER (PARTITION BY event_id // 1000 ORDER BY ts, event_id) AS n, value AS near, CAST(event_id % 17 AS DOUBLE) AS far FROM events), l AS (SELECT session_id, near, "
    + ", ".join(f"lag(far, {k}) OVER (PARTITION BY session_id ORDER BY n) AS f{k}" for k in range(33))
    + " FROM r) SELECT session_id, round(greatest("
    + ", ".join(f"CASE WHEN count(f{k}) >= 24 THEN corr(near, f{k}) END" for k in range(33))
    + "), 6) AS correlation FROM l GROUP BY session_id",
    "idle_timeouts": f"""SELECT session_id, event_id, at_ms + {GAP_MS} AS expired_ms FROM (SELECT *, lead(at_ms) OVER (PARTITION BY session_id ORDER BY at_ms, event_id) AS next_ms FROM {SQL_EVENTS}) WHERE next_ms - at_ms > {GAP_MS}""",
    "exactly_once_router": f"""WITH r AS (SELECT CASE WHEN event_id % 11 = 0 THEN 'no ' ELSE '' END || printf('00000000-0000-4000-8000-%06d%06d', session_id, at_ms // 86400000) AS task_id, event_id % 11 <> 0 AS good, event_id % 7 = 0 AS other, session_id,
  CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'errored' WHEN 'signup' THEN 'message' WHEN 'click' THEN 'typing' ELSE 'seen' END AS status, event_id % 3 <> 0 AS has_text, event_id AS seq FROM {SQL_EVENTS}),
p AS (SELECT *, session_id % 5 <> 0 AS registered, session_id % 6 = 1 AS elsewhere, session_id < 140 OR session_id = 141 AS known, good AND NOT other AND status <> 'seen' AND session_id % 10 = 3 AND status <> 'typing' AS probe FROM r),
e AS (SELECT *, CASE WHEN NOT good THEN 'invalid_task_id' WHEN other THEN 'task_id_mismatch' WHEN status = 'seen' THEN 'invalid_status' WHEN probe THEN 'probe' WHEN NOT known THEN 'dropped' WHEN status = 'message' AND NOT has_text THEN 'empty_message_ignored'
  WHEN registered AND elsewhere THEN 'session_mismatch' WHEN status = 'typing' THEN 'accepted' WHEN status = 'message' AND session_id % 10 = 4 THEN CASE WHEN seq < 600 THEN 'accepted' ELSE 'already_finalized' END WHEN NOT registered THEN 'unregistered_task' END AS early FROM p)
SELECT task_id, session_id, status, seq, CASE WHEN probe THEN CASE WHEN row_number() OVER (PARTITION BY task_id, probe ORDER BY seq) = 1 THEN 'probe_resolved' WHEN NOT known THEN 'dropped' ELSE 'unregistered_task' END
  WHEN early IS NOT NULL THEN early WHEN row_number() OVER (PARTITION BY task_id, early IS NULL ORDER BY seq) = 1 THEN 'accepted' ELSE 'already_finalized' END AS disposition FROM e""",
    "sse_reduce": f"""WITH d AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY event_id) AS done FROM {SQL_EVENTS})
SELECT session_id AS key, coalesce(string_agg(event_type || ' ', '' ORDER BY event_id) FILTER (WHERE done = 0 AND event_type NOT IN ('purchase', 'error')), '') AS text, max(done) = 1 AS closed FROM d GROUP BY session_id""",
}

QUERIES = (ordered_two_source, vad_segments, debounce_bursts, sliding_envelope, lagged_correlation, idle_timeouts, exactly_once_router, sse_reduce, bounded_replies)
