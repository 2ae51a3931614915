"""Queries over sessions as nested documents: split, merge, upsert, precedence, index refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.functions import times
from parley.operators import insights, sessions
from parley.plans.transcripts import SQL_DENSE, sql_collapsed
from parley.sources.driver_tables import table
from parley.sources.sessions import demo_sessions

CUT = 3


def _listed(items: str, *fields: str) -> Column:
    """Fields of the items of an array as text, for comparison."""
    return F.array_join(F.transform(items, lambda i: F.concat_ws(":", *[F.coalesce(i[f].cast("string"), F.lit("-")) for f in fields])), ",")


def _shown(rows: DataFrame, *more: Column | str) -> DataFrame:
    said = F.md5(F.array_join(F.transform("segments", lambda r: r["utterance"]), "\n"))
    return rows.select("session_id", "started_at", "ended_at", "title", F.size("segments").cast("long").alias("n_segments"), said.alias("said"), _listed("insights", "segment_index", "offset_ms").alias("notes"), _listed("blocks", "start_index", "end_index").alias("covered"), *more)


def split_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(sessions.split(demo_sessions(spark, sf_dir), F.lit(CUT)))


def merge_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions 2k and 2k + 1 as one, given in the wrong order for odd k."""
    rows = demo_sessions(spark, sf_dir).withColumn("n", F.substring("session_id", 2, 6).cast("int"))
    packed = rows.select("n", F.floor(F.col("n") / 2).alias("k"), F.struct(*[c for c in rows.columns if c != "n"]).alias("s"))
    swapped = F.col("k") % 2 == 1  # one grouping brings the two of a pair together
    side = lambda parity: F.any_value(F.when(F.col("n") % 2 == F.when(swapped, 1 - parity).otherwise(parity), F.col("s")), True)
    pairs = packed.groupBy("k").agg(side(0).alias("first"), side(1).alias("second")).where("first is not null and second is not null")
    more = [F.array_join("attendees", ",").alias("attendees"), "playbook", "backend_session_id", "notes_markdown", F.col("outcome.felt.provenance").alias("felt_by")]
    return _shown(sessions.merge(pairs), *more)


def insight_anchor_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.suggestions(demo_sessions(spark, sf_dir))


def insight_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every insight comes again with an id and another verdict; one more is new."""
    rows = demo_sessions(spark, sf_dir)
    kind = rows.schema["insights"].dataType.elementType
    again = F.transform("insights", lambda n: n.withField("id", F.coalesce(n["id"], F.concat(F.lit("late-"), n["offset_ms"]))).withField("producer", F.lit("assistant")).withField("feedback", F.lit(None).cast(kind["feedback"].dataType)))
    new = F.transform(F.slice("insights", 1, 1), lambda n: n.withField("message", F.lit("new")).withField("id", F.lit("new")))
    done = rows.select("session_id", insights.upserted(F.col("insights"), F.concat(again, new)).alias("insights"))
    return done.select("session_id", _listed("insights", "offset_ms", "message", "id", "producer").alias("notes"), F.size(F.filter("insights", lambda n: n["feedback"].isNotNull())).cast("long").alias("n_rated"))


def insight_dedupe_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types of each user as messages in time order: repeats of the last kept one, and taken ids, go."""
    note = F.struct(F.col("ts"), F.col("event_id"), F.col("event_type").alias("message"), F.when(F.col("event_id") % 4 == 0, (F.col("event_id") % 40).cast("string")).alias("id"))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(note)).alias("notes"))
    return rows.select("user_id", F.explode(insights.without_repeats(F.col("notes"))).alias("n")).select("user_id", "n.event_id")


def outcome_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of each customer after all its orders, in order, offered one: a person's (urgent orders) isn't overwritten by others'."""
    offer = F.struct("o_orderkey", F.struct(F.col("o_orderstatus").alias("value"), F.lit(None).cast("string").alias("decided_at"), F.when(F.col("o_orderpriority") == "1-URGENT", "user").otherwise("crm").alias("provenance"), F.lit(None).cast("string").alias("source"), F.lit(False).alias("publish_pending")).alias("label"))
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(offer)).alias("offers"))
    label = F.try_element_at("offers", F.lit(1))["label"]
    last = F.aggregate(F.slice("offers", F.lit(2), F.size("offers")), label, lambda held, o: insights.label_after(held, o["label"]))
    return per.select("o_custkey", last.alias("l")).select("o_custkey", "l.value", "l.provenance")


def unpublished_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.unpublished_outcomes(demo_sessions(spark, sf_dir))


def feedback_union_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), (F.col("event_id") % 25).alias("insight_id"), F.col("event_type").alias("verdict"), (F.col("event_id") % 3 == 0).alias("live"))
    return insights.feedback_union(rows.where("live").drop("live"), rows.where("not live").drop("live"))


def index_refresh_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    stats = orders.where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("session_id"), F.length("o_orderpriority").cast("long").alias("len"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("modified_ms"))
    index = orders.where("o_orderkey % 13 <> 0").select(F.col("o_orderkey").alias("session_id"), (F.length("o_orderpriority") + (F.col("o_orderkey") % 5 == 0).cast("int")).cast("long").alias("len"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("modified_ms"))
    return sessions.index_plan(stats, index)


def offsets_formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    shown = F.when(F.col("o_orderkey") % 10 == 0, F.lit("not a time")).otherwise(at)
    base = F.lit("1995-06-01T00:00:00Z")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", shown.alias("at"))
    ms = times.epoch_ms(F.col("at"))
    return rows.select("o_orderkey", ms.alias("epoch_ms"), times.delta_ms(base, F.col("at")).alias("delta_ms"), times.offset_text(F.col("o_orderkey") * 977).alias("offset"), times.rfc3339(ms).alias("again"), T.date_prefix(F.col("at")).alias("day"), times.backoff_seconds(F.col("o_orderkey") % 8).alias("backoff"))


SQL_SESSION = f"""(SELECT printf('s%06d', d.session_id) AS session_id, d.session_id AS n, count(*) AS size,
  printf('2026-01-01T%02d:%02d:00Z', (d.session_id // 60) % 24, d.session_id % 60) AS started_at, printf('2026-01-02T%02d:%02d:00Z', (d.session_id // 60) % 24, (d.session_id * 7) % 60) AS ended_at,
  CASE WHEN d.session_id % 3 <> 0 THEN 'Call ' || d.session_id END AS title FROM {SQL_DENSE} d GROUP BY d.session_id)"""
SQL_NOTES = f"(SELECT session_id AS n, seg_index AS i, seg_index * 15000 AS offset_ms, CASE WHEN seg_index % 4 <> 3 THEN seg_index END AS anchor FROM {SQL_DENSE} WHERE seg_index % 3 = 0)"
SQL_BLOCKS = f"(SELECT n, k * 2 AS s, k * 2 + 2 AS e FROM (SELECT n, size, unnest(range(0, size // 2)) AS k FROM {SQL_SESSION}))"

SQL = {
    "split_session": f"""WITH s AS (SELECT * FROM {SQL_SESSION} WHERE size > {CUT}), p AS (SELECT *, 0 AS part FROM s UNION ALL SELECT *, 1 FROM s),
d AS (SELECT * FROM {SQL_DENSE}), i AS (SELECT * FROM {SQL_NOTES}), b AS (SELECT * FROM {SQL_BLOCKS})
SELECT session_id || CASE WHEN part = 0 THEN '-a' ELSE '-b' END AS session_id, started_at, ended_at, CASE WHEN n % 2 = 0 THEN title END AS title,
  CASE WHEN part = 0 THEN {CUT} ELSE size - {CUT} END AS n_segments, (SELECT md5(string_agg(utterance, chr(10) ORDER BY seg_index)) FROM d WHERE d.session_id = p.n AND (CASE WHEN d.seg_index < {CUT} THEN 0 ELSE 1 END) = part) AS said,
  coalesce((SELECT string_agg((anchor - part * {CUT}) || ':' || offset_ms, ',' ORDER BY i.i) FROM i WHERE i.n = p.n AND anchor IS NOT NULL AND (CASE WHEN anchor < {CUT} THEN 0 ELSE 1 END) = part), '') AS notes,
  coalesce((SELECT string_agg((s - part * {CUT}) || ':' || (e - part * {CUT}), ',' ORDER BY s) FROM b WHERE b.n = p.n AND CASE WHEN part = 0 THEN e <= {CUT} ELSE s >= {CUT} END), '') AS covered
FROM p""",
    "merge_sessions": f"""WITH s AS (SELECT * FROM {SQL_SESSION}), d AS (SELECT * FROM {SQL_DENSE}), i AS (SELECT * FROM {SQL_NOTES}), b AS (SELECT * FROM {SQL_BLOCKS}),
m AS (SELECT a.*, z.n AS zn, z.session_id AS zid, z.size AS zsize, z.started_at AS zstart, z.ended_at AS zend, z.title AS ztitle FROM s a JOIN s z ON z.n = a.n + 1 AND a.n % 2 = 0)
SELECT session_id || '+' || zid AS session_id, started_at, greatest(ended_at, zend) AS ended_at, coalesce(title, ztitle) AS title, size + zsize AS n_segments,
  (SELECT md5(string_agg(utterance, chr(10) ORDER BY d.session_id, seg_index)) FROM d WHERE d.session_id IN (m.n, m.zn)) AS said,
  (SELECT string_agg(coalesce(CAST(anchor + CASE WHEN i.n = m.n THEN 0 ELSE m.size END AS VARCHAR), '-') || ':' || (offset_ms + CASE WHEN i.n = m.n THEN 0 ELSE 60000 END), ',' ORDER BY i.n, i.i) FROM i WHERE i.n IN (m.n, m.zn)) AS notes,
  coalesce((SELECT string_agg((s + CASE WHEN b.n = m.n THEN 0 ELSE m.size END) || ':' || (e + CASE WHEN b.n = m.n THEN 0 ELSE m.size END), ',' ORDER BY b.n, s) FROM b WHERE b.n IN (m.n, m.zn)), '') AS covered,
  array_to_string(list_concat(['p' || (n % 3), 'p' || (n % 5)], list_filter(CASE WHEN (zn % 3) = (zn % 5) THEN ['p' || (zn % 3)] ELSE ['p' || (zn % 3), 'p' || (zn % 5)] END, lambda x: NOT list_contains(['p' || (n % 3), 'p' || (n % 5)], x))), ',') AS attendees,
  CASE WHEN n % 6 = 0 THEN ' plan ' WHEN n % 6 = 1 THEN 'plan' WHEN zn % 6 = 1 THEN 'plan' END AS playbook, CAST(NULL AS VARCHAR) AS backend_session_id,
  CASE WHEN n % 4 = 0 THEN '# Notes ' || n END AS notes_markdown, CASE WHEN n % 3 = 0 THEN 'user' WHEN zn % 3 = 0 THEN 'crm' END AS felt_by
FROM m""",
    "insight_anchor_join": f"""WITH s AS (SELECT * FROM {SQL_SESSION}), i AS (SELECT i.*, d.source, {sql_collapsed("d.utterance")} AS c FROM {SQL_NOTES} i LEFT JOIN {SQL_DENSE} d ON d.session_id = i.n AND d.seg_index = i.anchor),
t AS (SELECT n, i, chr(10) || '- **' || printf('%02d:%02d', CAST(offset_ms // 60000 AS BIGINT), CAST(offset_ms // 1000 % 60 AS BIGINT)) || '** note ' || i || chr(10) ||
  CASE WHEN anchor IS NULL THEN '' ELSE '  > ' || CASE WHEN source = 'you' THEN 'You' ELSE 'Others' END || ': "' || CASE WHEN length(c) <= 160 THEN c WHEN contains(left(c, 160), ' ') THEN regexp_extract(left(c, 160), '^(.*) ', 1) || '…' ELSE left(c, 160) || '…' END || '"' || chr(10) END AS line FROM i)
SELECT s.session_id, '## Suggestions' || chr(10) || string_agg(line, '' ORDER BY t.i) AS markdown FROM s JOIN t ON t.n = s.n GROUP BY s.session_id""",
    "insight_upsert": f"""WITH i AS (SELECT * FROM {SQL_NOTES}), s AS (SELECT * FROM {SQL_SESSION})
SELECT s.session_id, string_agg(offset_ms || ':note ' || i || ':' || CASE WHEN i % 2 = 0 THEN 'n-' || i ELSE 'late-' || offset_ms END || ':' || CASE WHEN i % 2 = 0 THEN 'signals' ELSE 'assistant' END, ',' ORDER BY i) || ',0:new:new:signals' AS notes,
  CAST(1 AS BIGINT) AS n_rated FROM s JOIN i ON i.n = s.n GROUP BY s.session_id""",
    "insight_dedupe_last": """WITH RECURSIVE r AS (SELECT user_id, event_id, event_type AS message, CASE WHEN event_id % 4 = 0 THEN event_id % 40 END AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f(user_id, k, event_id, kept, last, ids) AS (SELECT user_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), false, CAST(NULL AS VARCHAR), CAST([] AS BIGINT[]) FROM r WHERE k = 1
  UNION ALL SELECT user_id, k, event_id, NOT same, CASE WHEN same THEN last ELSE message END, CASE WHEN same OR id IS NULL THEN ids ELSE list_append(ids, id) END FROM (
    SELECT r.*, f.last, f.ids, r.message IS NOT DISTINCT FROM f.last OR (r.id IS NOT NULL AND list_contains(f.ids, r.id)) AS same FROM f JOIN r ON r.user_id = f.user_id AND r.k = f.k + 1))
SELECT user_id, event_id FROM f WHERE kept""",
    "outcome_precedence": """WITH o AS (SELECT *, CASE WHEN o_orderpriority = '1-URGENT' THEN 'user' ELSE 'crm' END AS provenance FROM orders)
SELECT o_custkey, o_orderstatus AS value, provenance FROM o QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN provenance = 'user' THEN 0 ELSE 1 END, o_orderkey DESC) = 1""",
    "unpublished_outcomes": f"""WITH s AS (SELECT *, 'b' || (n // 4) AS backend_session_id FROM {SQL_SESSION} WHERE n % 2 = 0)
SELECT session_id, backend_session_id, 'felt' AS kind, 'good' AS value, 'user' AS provenance FROM s WHERE n % 3 = 0 AND n % 4 = 0
UNION ALL SELECT session_id, backend_session_id, 'converted', 'won', 'assistant' FROM s WHERE n % 5 = 0""",
    "feedback_union_priority": """SELECT user_id AS session_id, event_id % 25 AS insight_id, event_type AS verdict FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 25 ORDER BY CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END, event_type) = 1""",
    "index_refresh_plan": """WITH f AS (SELECT o_orderkey AS k, o_orderkey % 11 <> 0 AS is_file, o_orderkey % 13 <> 0 AS is_held FROM orders)
SELECT k AS session_id, CASE WHEN NOT is_file THEN 'drop' WHEN NOT is_held THEN 'add' WHEN k % 5 = 0 THEN 'refresh' ELSE 'reuse' END AS action FROM f WHERE is_file OR is_held""",
    "offsets_formatted": """WITH r AS (SELECT o_orderkey, o_orderdate AS made, o_orderkey % 10 <> 0 AS good, (o_orderkey * 977) // 1000 AS sec FROM orders)
SELECT o_orderkey, CASE WHEN good THEN greatest(epoch_ms(made) // 1000 * 1000, 0) END AS epoch_ms, CASE WHEN good THEN greatest(epoch_ms(made) // 1000 * 1000 - epoch_ms(TIMESTAMP '1995-06-01 00:00:00'), 0) ELSE 0 END AS delta_ms,
  CASE WHEN sec >= 3600 THEN printf('%d:%02d:%02d', sec // 3600, sec % 3600 // 60, sec % 60) ELSE printf('%02d:%02d', sec // 60, sec % 60) END AS "offset",
  CASE WHEN good THEN strftime(made, '%Y-%m-%dT%H:%M:%S.000Z') END AS again, CASE WHEN good THEN strftime(made, '%Y-%m-%d') ELSE 'not a time' END AS day,
  CAST(least(2 * power(2, o_orderkey % 8), 60) AS BIGINT) AS backoff FROM r""",
}

QUERIES = (
    split_session, merge_sessions, insight_anchor_join, insight_upsert, insight_dedupe_last, outcome_precedence, unpublished_outcomes, feedback_union_priority, index_refresh_plan, offsets_formatted,
)
