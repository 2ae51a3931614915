"""Queries over events and vectors as streams of samples, utterances and timers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions import arrays as A
from parley.operators import audio, streams
from parley.plans.streams import SQL_EVENTS, WAIT_MS
from parley.plans.vectors import SQL_EMB, _embeddings
from parley.sources.driver_tables import event_stream, turns

def _total(samples: str):
    return F.round(F.aggregate(samples, F.lit(0.0), lambda a, x: a + x), 6)


def nearest_decimation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embeddings(spark, sf_dir).withColumns({"a": A.decimated(F.col("embedding"), 48_000, 16_000), "b": A.decimated(F.col("embedding"), 44_100, 16_000)})
    return rows.select("vec_id", F.size("a").alias("n_a"), F.size("b").alias("n_b"), _total("a").alias("sum_a"), _total("b").alias("sum_b"))


def vector_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaling, gains, smooth steps, silence for what isn't finite, pre-emphasis and mel scale of vectors."""
    rows = _embeddings(spark, sf_dir).withColumn("loud", A.scaled(F.col("embedding"), 2.5))
    broken = F.transform("embedding", lambda x, i: F.when(i % 7 == 0, F.lit(float("nan"))).when(i % 11 == 0, F.lit(float("inf"))).otherwise(x))
    first = F.element_at("embedding", 1)
    return rows.select(
        "vec_id", _total("loud").alias("scaled"), F.round(A.total(A.finite(broken)), 6).alias("finite"), F.round(A.smoothstep(first * 4), 6).alias("smooth"), F.round(A.gain_of_db(first * 20), 6).alias("gain"),
        F.round(A.total(A.emphasised(F.col("embedding"))), 6).alias("emphasised"), F.round(A.hz_to_mel(F.abs(first) * 8000), 6).alias("mel"), F.round(A.mel_to_hz(F.abs(first) * 40), 4).alias("hz"),
    )


def clock_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as chunks of 400 ms whose times drift, and jump now and then."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("event_id"))
    captured = place * 400 + F.col("event_id") % 13 * 9 + F.floor(place / 9) * 130
    rows = event_stream(spark, sf_dir).select("session_id", F.col("event_id").alias("at"), F.lit(6_400).cast("long").alias("n"), audio.sample_offset(captured, F.lit(400)).alias("expected"))
    return audio.clocked(rows).select("session_id", "at", "start", "resynced")


def aligned_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' even events as near chunks and odd ones as far chunks of 100 samples, on a line of their places."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("event_id"))
    rows = event_stream(spark, sf_dir).select("session_id", "event_id", (place * 60).cast("long").alias("start"), (F.col("event_id") % 50 + 10).alias("n"))
    return audio.aligned_blocks(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"))


def echo_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("event_id"))
    phase = F.floor(place / 18) % 2
    rows = event_stream(spark, sf_dir).select("session_id", F.col("event_id").alias("at"), (F.col("value") / 200).alias("correlation"), F.when(phase == 0, 0.05).otherwise(0.3).alias("active"))
    return audio.echo_regimes(rows)


def reference_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as windows with a coherence of their value."""
    rows = event_stream(spark, sf_dir).select("session_id", F.col("event_id").alias("at"), audio.gate_target(F.col("value") / 200).alias("target"))
    gains = audio.gate_gains(rows)
    return rows.join(gains, ["session_id", "at"]).select("session_id", "at", F.round("target", 6).alias("target"), F.round("gain", 6).alias("gain"))


def gate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_stream(spark, sf_dir).select("session_id", F.lit(5).alias("windows"), (F.col("event_id") % 4).alias("gated"), (-F.col("value") / 20).alias("mean_db"))
    return audio.gate_stats(rows, "session_id").select("session_id", "windows", "gated", F.round("mean_db", 6).alias("mean_db"))


def stall_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' views as system audio, other events as the microphone; what a watch of three days does until the last event."""
    rows = event_stream(spark, sf_dir)
    chunks = rows.select("session_id", F.when(F.col("event_type") == "view", "system").otherwise("mic").alias("source"), "at_ms")
    over = rows.groupBy("session_id").agg((F.max("at_ms") + 1).alias("at_ms")).select("session_id", F.lit("end").alias("source"), "at_ms")
    return audio.stall_actions(chunks.unionByName(over), 43_200_000)


def assembled_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pieces of 1,000 to 2,400 samples, three to a segment; a conversation is an utterance. Some segments have no text of their own."""
    rows = turns(spark, sf_dir)
    n = F.col("turn") % 3 * 700 + 1000
    pieces = rows.select(F.col("conv_id").alias("session_id"), F.lit(0).alias("utterance"), F.floor(F.col("turn") / 3).alias("segment"), F.col("turn").alias("piece"), F.col("turn").alias("at"), n.alias("n"), F.when(F.col("turn") == 4, " ").otherwise(F.col("text")).alias("text"))
    wholes = pieces.groupBy("session_id", "utterance", "segment").agg(F.sum("n").alias("n")).withColumn("text", F.when(F.col("session_id") % 2 == 0, F.concat(F.lit(" whole "), F.col("segment"))).otherwise(F.lit(" ")))
    return audio.utterances(pieces, wholes)


def dated_finals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' purchases as commits and clicks as final texts."""
    rows = event_stream(spark, sf_dir)
    commits = rows.where("event_type = 'purchase'").select("session_id", F.col("event_id").alias("at"), F.col("at_ms").alias("captured_ms"))
    finals = rows.where("event_type = 'click'").select("session_id", F.col("event_id").alias("at"), F.when(F.col("event_id") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" t"), F.col("event_id"))).alias("text"))
    return audio.dated_finals(commits, finals)


def throttled_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as partial texts, errors as final ones; a new one is shown after 12 hours."""
    rows = event_stream(spark, sf_dir).select("session_id", "at_ms", F.when(F.col("event_id") % 4 == 0, " ").otherwise("x").alias("text"), (F.col("event_type") == "error").alias("final"))
    return audio.throttled(rows, 43_200_000)


def two_phase_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' days as streams: the first event is the request, purchases end it."""
    rows = event_stream(spark, sf_dir).select(F.concat_ws("-", "session_id", F.floor(F.col("at_ms") / 172_800_000)).alias("key"), "at_ms", "event_id", "event_type")
    first = F.row_number().over(Window.partitionBy("key").orderBy("at_ms", "event_id")) == 1
    kind = F.when(first, "request").when(F.col("event_type") == "purchase", "done").otherwise("token")
    return audio.two_phase_timeouts(rows.withColumn("kind", kind).select("key", "at_ms", "kind"), 36_000_000, 18_000_000)


def released_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which arrival releases each utterance of two sources, and how many were late; every third event tells progress, some
    utterances are blank, and the clock steps back now and then."""
    rows = ordered_rows(spark, sf_dir)
    text = F.when(F.col("arrival") % 10 == 4, " ").otherwise("x")
    now = F.col("now_ms") - F.when(F.col("arrival") % 11 == 5, 40_000_000).otherwise(0)
    found = streams.released(rows.withColumns({"text": text, "now_ms": now}), WAIT_MS)
    return streams.with_late_counts(found.where("session_id is not null"))


def ordered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    captured = F.col("at_ms") - F.col("event_id") % 7 * 1_200_000
    kind = F.when(F.col("event_id") % 3 == 0, "progress").otherwise("utterance")
    return event_stream(spark, sf_dir).select("session_id", kind.alias("kind"), (F.col("event_id") % 2).alias("source"), captured.alias("captured_ms"), F.col("at_ms").alias("now_ms"), F.col("event_id").alias("arrival"))


def noise_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_stream(spark, sf_dir).select("session_id", F.col("event_id").alias("at"), F.col("value"))
    return streams.noise_floor(rows).select("session_id", "at", F.round(F.col("floor") + 1e-7, 4).alias("floor"))


def silence_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as blocks, loud where the value is high; and whether the far side (views) was heard within a day."""
    rows = event_stream(spark, sf_dir).select("session_id", F.col("event_id").alias("at"), (F.col("value") < 120).alias("silent"), "at_ms", F.when(F.col("event_type") == "view", "far").otherwise("near").alias("source"))
    skipped = streams.skipped_blocks(rows.select("session_id", "at", "silent"), 3)
    alive = streams.far_alive(rows.select("session_id", "at", "at_ms", "source"), 86_400_000).select("session_id", "at", "far_alive")
    return skipped.join(alive, ["session_id", "at"]).select("session_id", "at", "skipped", "far_alive")


def decoding_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as decoded tokens with durations; the frame where each ends."""
    token, duration = (F.col("event_id") % 5).cast("int"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 4).otherwise(0).cast("int")
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("event_id", token.alias("token"), duration.alias("duration")))), lambda t: F.struct(t["token"].alias("token"), t["duration"].alias("duration")))
    return event_stream(spark, sf_dir).groupBy("session_id").agg(pairs.alias("t")).select("session_id", streams.frame_cursor(F.col("t"), 0).alias("frame"))


_FOLD = f"(SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS k FROM {SQL_EVENTS})"
_PICKED = "list_sum(list_transform(range(0, CAST(ceil(len(v) * 16000 / {r}) AS BIGINT)), lambda i: v[(i * {r}) // 16000 + 1]))"
_TARGET = "CASE WHEN value / 200 >= 0.65 THEN power(10.0, -18 * power(least((value / 200 - 0.65) / (1 - 0.65), 1), 2) * (3 - 2 * least((value / 200 - 0.65) / (1 - 0.65), 1)) / 20) END"

SQL = {
    "nearest_decimation": f"SELECT vec_id, CAST(ceil(len(v) * 16000 / 48000) AS INTEGER) AS n_a, CAST(ceil(len(v) * 16000 / 44100) AS INTEGER) AS n_b, round({_PICKED.format(r=48000)}, 6) AS sum_a, round({_PICKED.format(r=44100)}, 6) AS sum_b FROM {SQL_EMB}",
    "vector_arithmetic": f"""WITH e AS (SELECT vec_id, v, v[1] AS f, greatest(least(v[1] * 4, 1), 0) AS t FROM {SQL_EMB})
SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * 2.5)), 6) AS scaled, round(list_sum(list_transform(v, lambda x, i: CASE WHEN (i - 1) % 7 = 0 OR (i - 1) % 11 = 0 THEN 0 ELSE x END)), 6) AS "finite", round(t * t * (3 - 2 * t), 6) AS smooth, round(power(10.0, f), 6) AS gain,
  round(list_sum(list_transform(v, lambda x, i: CASE WHEN i = 1 THEN x ELSE x - 0.97 * v[i - 1] END)), 6) AS emphasised, round(CASE WHEN abs(f) * 8000 < 1000 THEN abs(f) * 8000 * 3 / 200 ELSE 15 + ln(abs(f) * 8) * 27 / ln(6.4) END, 6) AS mel,
  round(CASE WHEN abs(f) * 40 < 15 THEN abs(f) * 40 * 200 / 3 ELSE 1000 * exp((abs(f) * 40 - 15) * ln(6.4) / 27) END, 4) AS hz FROM e""",
    "clock_smoothing": f"""WITH RECURSIVE r AS (SELECT session_id, event_id AS "at", k, CAST(round((k * 400 + event_id % 13 * 9 + k // 9 * 130 - 400) * 16) AS BIGINT) AS expected FROM {_FOLD}),
f(session_id, k, "at", start, resynced) AS (SELECT session_id, k, "at", expected, true FROM r WHERE k = 1
  UNION ALL SELECT r.session_id, r.k, r."at", CASE WHEN abs(r.expected - (f.start + 6400)) > 1600 THEN r.expected ELSE f.start + 6400 END, abs(r.expected - (f.start + 6400)) > 1600 FROM f JOIN r ON r.session_id = f.session_id AND r.k = f.k + 1)
SELECT session_id, "at", start, resynced FROM f""",
    "aligned_timelines": f"""WITH r AS (SELECT session_id, event_id, k * 60 AS s, k * 60 + event_id % 50 + 10 AS e FROM {_FOLD}), o AS (SELECT session_id, min(s) AS origin FROM r WHERE event_id % 2 = 0 GROUP BY session_id),
c AS (SELECT r.session_id, event_id % 2 AS far, (p - origin) // 128 AS block, p FROM (SELECT *, unnest(range(s, e)) AS p FROM r) r JOIN o ON o.session_id = r.session_id WHERE p >= origin),
n AS (SELECT session_id, block, count(*) AS near_n FROM c WHERE far = 0 GROUP BY session_id, block), f AS (SELECT session_id, block, count(*) AS far_n FROM c WHERE far = 1 GROUP BY session_id, block)
SELECT n.session_id, n.block, near_n, near_n - least(near_n, coalesce(far_n, 0)) AS bypassed FROM n LEFT JOIN f ON f.session_id = n.session_id AND f.block = n.block""",
    "echo_regimes": f"""WITH RECURSIVE r AS (SELECT session_id, event_id AS "at", k, value / 200 >= 0.6 AND (k // 18) % 2 = 1 AS shows, (k // 18) % 2 = 0 AS quiet FROM {_FOLD}),
s AS (SELECT 0),
f(session_id, k, "at", engaged, eng, byp) AS (SELECT session_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), true, CAST(0.0 AS DOUBLE), CAST(0.0 AS DOUBLE) FROM r WHERE k = 1
  UNION ALL SELECT session_id, k, "at", CASE WHEN engaged AND b >= 12 THEN false WHEN NOT engaged AND e >= 2 THEN true ELSE engaged END, CASE WHEN NOT engaged AND e >= 2 THEN 0 ELSE e END, CASE WHEN engaged AND b >= 12 THEN 0 ELSE b END FROM (
    SELECT r.session_id, r.k, r."at", f.engaged, CASE WHEN shows THEN eng + 1 WHEN quiet THEN eng * 0.5 ELSE eng * 0.9 END AS e, CASE WHEN shows THEN 0 WHEN quiet THEN byp + 1 ELSE byp * 0.9 END AS b FROM f JOIN r ON r.session_id = f.session_id AND r.k = f.k + 1))
SELECT session_id, "at", engaged FROM f WHERE k > 0""",
    "reference_gate": f"""WITH RECURSIVE r AS (SELECT session_id, event_id AS "at", k, {_TARGET} AS target FROM {_FOLD}),
f(session_id, k, "at", target, gain) AS (SELECT session_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST(1.0 AS DOUBLE) FROM r WHERE k = 1
  UNION ALL SELECT r.session_id, r.k, r."at", r.target, f.gain + CASE WHEN coalesce(r.target, 1) < f.gain THEN 0.2 ELSE 0.5 END * (coalesce(r.target, 1) - f.gain) FROM f JOIN r ON r.session_id = f.session_id AND r.k = f.k + 1)
SELECT session_id, "at", round(target, 6) AS target, round(gain, 6) AS gain FROM f WHERE k > 0""",
    "gate_summary": f"SELECT session_id, count(*) * 5 AS windows, CAST(sum(event_id % 4) AS BIGINT) AS gated, round(coalesce(sum(-value / 20 * (event_id % 4)) / nullif(sum(event_id % 4), 0), 0), 6) AS mean_db FROM {SQL_EVENTS} GROUP BY session_id",
    "stall_watch": f"""WITH e AS (SELECT session_id, event_type = 'view' AS sys, at_ms FROM {SQL_EVENTS}), o AS (SELECT session_id, max(at_ms) + 1 AS over_ FROM e GROUP BY session_id),
g AS (SELECT e.session_id, at_ms, coalesce(lead(at_ms) OVER (PARTITION BY e.session_id ORDER BY at_ms), over_) - at_ms AS gap FROM e JOIN o USING (session_id) WHERE sys),
d AS (SELECT session_id, k, at_ms + k * 43200000 AS due FROM (SELECT *, unnest(range(1, least(gap // 43200000, 4) + 1)) AS k FROM g)), p AS (SELECT session_id, min(due) AS given_up FROM d WHERE k = 4 GROUP BY session_id),
h AS (SELECT e.session_id, given_up, at_ms, coalesce(lead(at_ms) OVER (PARTITION BY e.session_id ORDER BY at_ms), over_) AS next_ms FROM e JOIN o USING (session_id) JOIN p USING (session_id)),
v AS (SELECT session_id, given_up, CASE WHEN given_up - max(at_ms) FILTER (WHERE at_ms <= given_up) >= 43200000 THEN 'ended' ELSE 'mic_only' END AS action FROM h GROUP BY session_id, given_up)
SELECT d.session_id, due AS at_ms, 'restart' AS action FROM d LEFT JOIN p USING (session_id) WHERE k <= 3 AND (given_up IS NULL OR due < given_up)
UNION ALL SELECT session_id, given_up, action FROM v
UNION ALL SELECT h.session_id, min(h.at_ms + 43200000), 'ended' FROM h JOIN v ON v.session_id = h.session_id AND v.action = 'mic_only' WHERE next_ms - h.at_ms >= 43200000 AND h.at_ms + 43200000 > h.given_up GROUP BY h.session_id""",
    "assembled_utterances": """WITH t AS (SELECT conv_id AS session_id, turn, turn // 3 AS segment, turn % 3 * 700 + 1000 AS n, CASE WHEN turn = 4 THEN '' ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS text FROM conversations WHERE length(trim(text)) > 0),
p AS (SELECT *, CASE WHEN n > 1600 AND text <> '' THEN text END AS said FROM t),
g AS (SELECT session_id, segment, string_agg(said, ' ' ORDER BY turn) AS joined, count(*) AS c, sum(n) AS total, max(turn) AS "at" FROM p GROUP BY session_id, segment),
w AS (SELECT *, CASE WHEN c = 1 THEN joined WHEN session_id % 2 = 0 AND total > 1600 THEN 'whole ' || segment ELSE joined END AS text FROM g),
f AS (SELECT session_id, string_agg(text, ' ' ORDER BY segment) AS text, max("at") AS "at" FROM w GROUP BY session_id)
SELECT session_id, 0 AS utterance, turn AS "at", said AS text, false AS final FROM p WHERE said IS NOT NULL UNION ALL SELECT session_id, 0, "at", text, true FROM f WHERE text IS NOT NULL""",
    "dated_finals": f"""WITH c AS (SELECT session_id, at_ms, row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS n FROM {SQL_EVENTS} WHERE event_type = 'purchase'),
f AS (SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS n FROM {SQL_EVENTS} WHERE event_type = 'click')
SELECT f.session_id, event_id AS "at", 't' || event_id AS text, at_ms AS captured_ms FROM f LEFT JOIN c ON c.session_id = f.session_id AND c.n = f.n WHERE event_id % 3 <> 0""",
    "throttled_partials": f"""WITH RECURSIVE r AS (SELECT session_id, at_ms, event_id % 4 <> 0 AS told, event_type = 'error' AS final, row_number() OVER (PARTITION BY session_id ORDER BY at_ms) AS k FROM {SQL_EVENTS}),
f(session_id, k, at_ms, last, shown) AS (SELECT session_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), false FROM r WHERE k = 1
  UNION ALL SELECT r.session_id, r.k, r.at_ms, CASE WHEN final THEN NULL WHEN told AND (last IS NULL OR r.at_ms - last >= 43200000) THEN r.at_ms ELSE last END, NOT final AND told AND (last IS NULL OR r.at_ms - last >= 43200000) FROM f JOIN r ON r.session_id = f.session_id AND r.k = f.k + 1)
SELECT session_id, at_ms FROM f WHERE shown""",
    "two_phase_timeouts": f"""WITH r AS (SELECT session_id || '-' || (at_ms // 172800000) AS key, at_ms, event_id, event_type FROM {SQL_EVENTS}), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY at_ms, event_id) AS k FROM r),
t AS (SELECT *, CASE WHEN k = 1 THEN 'request' WHEN event_type = 'purchase' THEN 'done' ELSE 'token' END AS kind FROM n),
l AS (SELECT *, lead(at_ms) OVER (PARTITION BY key ORDER BY at_ms, kind <> 'request') AS next_ms, at_ms + CASE WHEN kind = 'request' THEN 36000000 ELSE 18000000 END AS due FROM t)
SELECT key, min(due) AS expired_ms, arg_min(CASE WHEN kind = 'request' THEN 'startup' ELSE 'stalled' END, due) AS phase FROM l WHERE kind <> 'done' AND (next_ms IS NULL OR next_ms > due) GROUP BY key""",
    "released_order": f"""WITH r AS (SELECT session_id, event_id % 3 = 0 AS progress, event_id % 2 AS source, at_ms - event_id % 7 * 1200000 AS captured_ms, at_ms - CASE WHEN event_id % 11 = 5 THEN 40000000 ELSE 0 END AS now_ms, event_id AS arrival FROM {SQL_EVENTS}),
s AS (SELECT *, least(coalesce(max(captured_ms) FILTER (WHERE progress AND source = 0) OVER w, 0), coalesce(max(captured_ms) FILTER (WHERE progress AND source = 1) OVER w, 0)) AS settled_ms FROM r WINDOW w AS (PARTITION BY session_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b AS (SELECT *, greatest(settled_ms, now_ms - {WAIT_MS}) AS bound_ms FROM s),
u AS (SELECT a.session_id, a.arrival, a.captured_ms, min(b.arrival) AS released_by FROM b a LEFT JOIN b ON b.session_id = a.session_id AND b.arrival >= a.arrival AND b.bound_ms >= a.captured_ms WHERE NOT a.progress AND a.arrival % 10 <> 4 GROUP BY a.session_id, a.arrival, a.captured_ms),
l AS (SELECT u.*, u.captured_ms > b.settled_ms AS late FROM u LEFT JOIN b ON b.session_id = u.session_id AND b.arrival = u.released_by)
SELECT *, count(released_by) OVER (PARTITION BY session_id) AS n_released, count(*) FILTER (WHERE late) OVER (PARTITION BY session_id) AS n_late FROM l""",
    "noise_floors": f"""WITH RECURSIVE r AS (SELECT session_id, event_id AS "at", k, value FROM {_FOLD}),
f(session_id, k, "at", floor) AS (SELECT session_id, k, "at", greatest(value, 1e-5) FROM r WHERE k = 1 UNION ALL SELECT r.session_id, r.k, r."at", CASE WHEN r.value < f.floor * 1.005 THEN greatest(r.value, 1e-5) ELSE f.floor * 1.005 END FROM f JOIN r ON r.session_id = f.session_id AND r.k = f.k + 1)
SELECT session_id, "at", round(floor + 1e-7, 4) AS floor FROM f""",
    "silence_skips": f"""WITH r AS (SELECT *, value < 120 AS silent FROM {SQL_EVENTS}), g AS (SELECT *, sum(CASE WHEN silent THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY event_id) AS run FROM r),
s AS (SELECT *, silent AND count(*) FILTER (WHERE silent) OVER (PARTITION BY session_id, run ORDER BY event_id) > 3 AS skipped FROM g),
a AS (SELECT session_id, event_id, event_type, at_ms - max(at_ms) FILTER (WHERE event_type = 'view') OVER (PARTITION BY session_id ORDER BY at_ms ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 86400000 AS alive FROM {SQL_EVENTS})
SELECT s.session_id, s.event_id AS "at", skipped, coalesce(alive, false) AS far_alive FROM s JOIN a ON a.session_id = s.session_id AND a.event_id = s.event_id WHERE a.event_type <> 'view'""",
    "decoding_cursor": f"""WITH RECURSIVE r AS (SELECT session_id, k, event_id % 5 <> 0 AS told, CASE WHEN event_id % 3 = 0 THEN event_id % 4 ELSE 0 END AS d FROM {_FOLD}),
f(session_id, k, frame, n) AS (SELECT session_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM r WHERE k = 1
  UNION ALL SELECT session_id, k, frame + m, CASE WHEN m > 0 THEN 0 ELSE c END FROM (SELECT r.session_id, r.k, f.frame, f.n + told::BIGINT AS c, CASE WHEN d = 0 AND (NOT told OR f.n + told::BIGINT >= 10) THEN 1 ELSE d END AS m FROM f JOIN r ON r.session_id = f.session_id AND r.k = f.k + 1))
SELECT session_id, CAST(arg_max(frame, k) AS INTEGER) AS frame FROM f GROUP BY session_id""",
}

QUERIES = (
    nearest_decimation, vector_arithmetic, clock_smoothing, aligned_timelines, echo_regimes, reference_gate, gate_summary, stall_watch,
    assembled_utterances, dated_finals, throttled_partials, two_phase_timeouts, released_order, noise_floors, silence_skips, decoding_cursor,
)
