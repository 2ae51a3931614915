"""Queries over live sessions, edits, notes, ids and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import encoding as E
from parley.functions import text as T
from parley.functions import times
from parley.operators import audio, insights, live, sessions
from parley.plans.documents import CUT, SQL_NOTES, SQL_SESSION, _listed
from parley.plans.streams import SQL_EVENTS
from parley.plans.transcripts import SQL_CHAT, SQL_DENSE
from parley.sources.driver_tables import chat, dense_segments, event_stream, table, turns
from parley.sources.sessions import demo_sessions


def live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as what happens to a live session: a signup begins it, views are said, clicks are blocks."""
    kind = F.col("event_type")
    action = F.when(kind == "signup", "begin").when(kind == "view", "segment").when(kind == "click", "block").when(kind == "purchase", "playbook").otherwise("backend")
    value = F.when(F.col("event_id") % 4 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" v"), F.col("event_id"), F.lit(" ")))
    start = F.col("event_id") % 300
    rows = event_stream(spark, sf_dir).select(
        "session_id", F.col("event_id").alias("seq"), "at_ms", action.alias("action"), value.alias("value"), F.when(F.col("event_id") % 2 == 0, "you").otherwise("others").alias("source"),
        start.alias("start_index"), (start + F.col("event_id") % 7 - 1).alias("end_index"),
    )
    out = live.live_sessions(rows)
    return out.select("session_id", "started_at_ms", "updated_at_ms", "backend_session_id", "playbook", _listed("segments", "source", "utterance").alias("said"), _listed("blocks", "start_index", "end_index", "summary", "created_at_ms").alias("told"))


def live_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even sessions take over the insights of live ones; what is left are the live ones without a session."""
    rows = demo_sessions(spark, sf_dir).withColumn("n", F.substring("session_id", 2, 6).cast("int"))
    running = rows.where("n % 3 = 0").select("session_id", F.transform("insights", lambda i: i.withField("message", F.concat(i["message"], F.when(i["offset_ms"] % 2 == 0, "").otherwise("!"))).withField("offset_ms", i["offset_ms"] + F.when(F.size("insights") > 1, 1).otherwise(0))).alias("insights"))
    merged, left = live.merged_live(rows.where("n % 2 = 0").drop("n"), running)
    out = merged.select("session_id", _listed("insights", "offset_ms", "id").alias("notes"), F.lit(False).alias("is_left"))
    return out.unionByName(left.select("session_id", F.lit(None).cast("string").alias("notes"), F.lit(True).alias("is_left")))


def edit_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library after every session that may be split is: not the live ones, nor those with notes under way."""
    rows = demo_sessions(spark, sf_dir).withColumn("n", F.substring("session_id", 2, 6).cast("int"))
    rows = rows.withColumn("notes_status", F.when(F.col("n") % 5 == 0, "pending").otherwise(F.col("notes_status")))
    running = rows.where("n % 7 = 0").select("session_id")
    rows = rows.drop("n")
    made = sessions.split(rows, F.lit(CUT), running)
    return sessions.after_edit(rows, made).select("session_id", F.size("segments").cast("long").alias("n_segments"), "notes_status")


def notes_root_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's notes as the reply to their root has them, its chat without those replies and with one status
    changed, and whether the last message would settle the notes."""
    message = F.struct("pos", "id", "role", "status", "content", "parent_message_id")
    rows = chat(spark, sf_dir).groupBy("session_id").agg(F.array_sort(F.collect_list(message)).alias("chat"))
    root = F.concat_ws("-", "session_id", F.col("session_id") % 3)
    rows = rows.withColumns({"notes_root_message_id": root, "notes_markdown": F.when(F.col("session_id") % 4 != 0, F.lit("old"))})
    last = F.element_at("chat", -1)
    dropped = live.without_replies_to(F.col("chat"), F.when(F.col("session_id") % 2 == 0, F.col("notes_root_message_id")))
    changed = live.with_status(dropped, F.col("notes_root_message_id"), F.lit("cancelled"))
    settles = live.settles_notes(last["status"], last["parent_message_id"], F.col("notes_root_message_id"), F.concat_ws("-", "session_id", last["pos"] - 1))
    return rows.select("session_id", live.notes_of_root().alias("notes"), settles.alias("settles"), F.array_join(F.transform(changed, lambda m: F.concat_ws(":", m["id"], m["status"])), ",").alias("chat"))


def ui_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of chunk for each turn, the delta read back, and what isn't one."""
    text, key = F.col("text"), F.concat_ws("-", "conv_id", "turn")
    delta = E.chunk_json("text-delta", key, text)
    chunks = F.array(
        E.chunk_json("start", key), E.chunk_json("text-start", key), delta, E.chunk_json("text-end", key), E.chunk_json("data-activity", F.struct(F.col("role").alias("label")), F.lit(True)),
        E.chunk_json("error", F.lit("it failed")), E.chunk_json("finish", F.lit("stop")),
    )
    other = F.when(F.col("turn") % 2 == 0, E.chunk_json("text-end", key)).otherwise(F.lit("no json"))
    return turns(spark, sf_dir).select("conv_id", "turn", F.array_join(chunks, "\n").alias("chunks"), E.text_delta(delta).alias("again"), E.text_delta(other).alias("none"))


def session_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The insights of sessions as stored, with what means nothing left out."""
    rows = demo_sessions(spark, sf_dir).select("session_id", "title", "insights")
    return rows.select("session_id", E.session_json(rows).alias("document"))


def settings_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of every kind: set, missing, of another kind, and unreadable."""
    n = F.col("event_id") % 5
    document = F.when(n == 0, '{"micEnabled": true}').when(n == 1, '{"micEnabled": false, "future": 1}').when(n == 2, F.col("props")).when(n == 3, "{broken").otherwise('{"micEnabled": "yes"}')
    return table(spark, sf_dir, "events").select("event_id", E.settings(document).alias("s")).select("event_id", F.col("s.micEnabled").alias("mic_enabled"))


def ids_and_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of messages and replies for each turn, its digest, and the revision of its conversation."""
    key, given = F.concat_ws("-", "conv_id", "turn"), F.when(F.col("turn") % 2 == 0, F.lit(" ")).otherwise(F.concat(F.lit("m"), F.col("turn")))
    rows = turns(spark, sf_dir).select("conv_id", "turn", E.message_id(given, key, F.col("conv_id").cast("string"), F.col("text")).alias("message_id"), E.reply_id(key).alias("reply_id"), E.digest(F.col("text").cast("binary")).alias("digest"))
    part = F.struct(F.format_string("%03d", "turn").alias("name"), "digest")
    whole = rows.groupBy("conv_id").agg(E.revision(F.collect_list(part)).alias("revision"))
    return rows.join(whole, "conv_id")


def display_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sessions: a title, else the day; times and totals as a person reads them."""
    title = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" "))).when(F.col("o_orderkey") % 3 == 1, F.lit("  "))
    at = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.display_title(title, at).alias("title"), times.shown_date(at).alias("day"), times.shown_time(at).alias("time"), times.shown_number(F.col("o_totalprice")).alias("total"), times.shown_ago(F.col("o_orderkey") % 3 - 1, "day").alias("ago"))


def routes_and_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as audio outputs, and whether a session could begin on them."""
    codes = F.array(*[F.lit(x) for x in ("bltn", "blue", "blea", "usb ", "hdmi", "dprt", "thun", "airp", "none")])
    transport = F.element_at(codes, (F.col("p_size") % 9 + 1).cast("int"))
    route = audio.output_route(transport, F.when(F.col("p_partkey") % 2 == 0, F.lit("hdpn")))
    bit = lambda k: F.floor(F.col("p_partkey") / k) % 2 == 1
    ready = audio.can_listen(bit(1), bit(2), bit(4), bit(8), bit(16))
    return table(spark, sf_dir, "part").select("p_partkey", route.alias("route"), audio.echo_prior(route).alias("prior"), ready.alias("can_listen"))


def endpoint_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as endpoints of nations: those of one balance class are one, under the role that comes first."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("owner"), F.col("s_suppkey").alias("rank"), F.when(F.col("s_suppkey") % 2 == 0, "console").otherwise("communications").alias("role"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_suppkey") % 3).alias("id"))
    return audio.capture_endpoints(rows)


def latest_and_retired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's events as turns: the latest, how many still fit a memory of 32, and the first kind by name."""
    from parley.operators import transcripts

    rows = event_stream(spark, sf_dir)
    kept = transcripts.newest(rows, "session_id", 32, "event_id").groupBy("session_id").agg(F.count(F.lit(1)).alias("n_remembered"), F.min("event_id").alias("oldest"))
    last = rows.groupBy("session_id").agg(F.max_by("event_type", "event_id").alias("latest"), F.min("event_type").alias("first_name"))
    return last.join(kept, "session_id")


def feedback_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every insight rated, the rating published as it was or as it no longer is, and withdrawn."""
    rows = demo_sessions(spark, sf_dir).select("session_id", "backend_session_id", F.explode("insights").alias("i"))
    verdict = F.when(F.col("i.offset_ms") % 2 == 0, "helpful").otherwise("dismissed")
    rows = rows.select("session_id", F.col("i.offset_ms").alias("offset_ms"), F.col("i.producer").alias("producer"), insights.rated(F.col("i"), verdict, F.lit("t1"), F.lit("live"), F.col("backend_session_id").isNotNull()).alias("r"))
    published = F.struct(F.lit("helpful").alias("verdict"), F.when(F.col("offset_ms") % 30_000 == 0, "t1").otherwise("t0").alias("rated_at"))
    rows = rows.withColumns({"s": insights.settled(F.col("r"), published), "w": insights.rated(F.col("r"), F.lit(None).cast("string"), F.lit("t2"), F.lit("live"), F.lit(True))})
    return rows.select("session_id", "offset_ms", F.col("r.feedback.publish_pending").alias("rated"), F.col("s.feedback.publish_pending").alias("settled"), F.col("w.feedback_withdraw_pending").alias("withdrawn"))


def outcome_publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of orders offered to labels, what that does, and whether the result is cleared once it was published."""
    orders = table(spark, sf_dir, "orders")

    def label(value: Column, by: Column, source: Column, pending: bool) -> Column:
        return F.struct(value.alias("value"), F.lit("t").alias("decided_at"), by.alias("provenance"), source.alias("source"), F.lit(pending).alias("publish_pending"))

    by = lambda k: F.when(F.col("o_orderkey") % k == 0, "user").otherwise("crm")
    none = F.lit(None).cast("string")
    held = F.when(F.col("o_orderkey") % 4 != 0, label(F.col("o_orderstatus"), by(3), none, False))
    offered = F.when(F.col("o_orderkey") % 7 != 0, label(F.when(F.col("o_orderkey") % 2 == 0, "O").otherwise(F.col("o_orderstatus")), by(5), none, True))
    rows = orders.select("o_orderkey", held.alias("h"), offered.alias("o")).withColumn("after", insights.label_after(F.col("h"), F.col("o")))
    cleared = insights.label_published(F.col("after"), F.lit("O"), F.lit("crm"), none)
    return rows.select("o_orderkey", insights.label_write(F.col("h"), F.col("o")).alias("written"), F.col("after.value").alias("value"), F.col("after.publish_pending").alias("pending"), cleared["publish_pending"].alias("pending_after"))


def titles_and_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles set by hand and found in notes, and sessions whose segments are replaced, live and finished."""
    rows = demo_sessions(spark, sf_dir).withColumn("n", F.substring("session_id", 2, 6).cast("int"))
    by_hand = sessions.with_title(rows, F.when(F.col("n") % 2 == 0, F.concat(F.lit(" Mine "), F.col("n"))).otherwise(F.lit("  ")))
    found = sessions.with_auto_title(rows.withColumn("title", F.when(F.col("n") % 3 == 1, F.col("title"))))
    fewer = F.slice("segments", 1, 2)
    other = F.when(F.col("n") % 2 == 0, fewer).otherwise(F.transform("segments", lambda s: s.withField("utterance", F.upper(s["utterance"]))))
    replaced = sessions.with_segments(rows, fewer)
    holds = rows.select("session_id", sessions.blocks_still_hold(F.slice("blocks", 1, 1), F.col("segments"), other).alias("blocks_hold"))
    out = by_hand.select("session_id", F.col("title").alias("by_hand")).join(found.select("session_id", F.col("title").alias("found"), F.col("title_is_auto").alias("is_auto")), "session_id").join(holds, "session_id")
    return out.join(replaced.select("session_id", F.col("title").alias("replaced_title"), F.size("segments").cast("long").alias("n_segments"), (F.size("insights") + F.size("blocks")).cast("long").alias("n_described")), "session_id")


def library_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library's rows in order, with whether feedback waits to be published."""
    rows = sessions.library_order(sessions.summarised(demo_sessions(spark, sf_dir)))
    return rows.select("session_id", "title", "ended_at", "has_notes", "notes_status", "feedback_waiting", F.col("outcome").isNotNull().alias("has_outcome"))


def notes_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as what becomes of their notes."""
    from parley.operators import streams

    kind = F.col("event_type")
    status = F.when(kind == "signup", "pending").when(kind == "purchase", "completed").when(kind == "error", "errored").when(kind == "view", "cancelled").otherwise("typing")
    text = F.when(F.col("event_id") % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit("n"), F.col("event_id")))
    return streams.notes_lifecycle(event_stream(spark, sf_dir).select("session_id", F.col("event_id").alias("seq"), status.alias("status"), text.alias("text")))


def speaker_renaming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assigned speakers joined to segments by place, then some renamed in all sessions."""
    from parley.operators import speakers

    rows = dense_segments(spark, sf_dir).withColumns({"speaker_id": F.lit(None).cast("string"), "speaker_label": F.lit("guest")})
    assigned = rows.where("seg_index % 2 = 0").select("session_id", F.col("seg_index").alias("idx"), F.concat(F.lit("spk"), F.col("session_id") % 5).alias("speaker_id"), F.when(F.col("session_id") % 2 == 0, "Known").alias("label"))
    segment = F.struct("seg_index", "source", "utterance", "speaker_id", "speaker_label")
    nested = speakers.relabelled(rows, assigned).groupBy("session_id").agg(F.array_sort(F.collect_list(segment)).alias("segments"))
    names = spark.createDataFrame([("spk1", "Ann"), ("spk3", "Bob"), ("spk3", "Cy"), ("spk9", "No")], "speaker_id string, label string")
    return sessions.renamed_speaker(nested, names).select("session_id", F.array_join(F.transform("segments", lambda s: F.concat_ws(":", F.coalesce(s["speaker_id"], F.lit("-")), F.coalesce(s["speaker_label"], F.lit("-")))), ",").alias("labels"))


def visible_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of each chat that a thread shows."""
    from parley.operators import chats

    rows = chat(spark, sf_dir).withColumn("content", F.when(F.col("pos") % 3 == 1, F.lit(" ")).otherwise(F.col("content")))
    shown = chats.is_visible(F.col("role"), F.col("status"), F.col("content"), F.col("pos") == 1, F.col("session_id") % 2 == 0)
    return rows.where(shown).select("session_id", "pos", "id")


_BARE = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"

SQL = {
    "live_sessions": f"""WITH r AS (SELECT session_id, event_id AS seq, at_ms, event_type AS k, CASE WHEN event_id % 4 = 0 THEN '  ' ELSE ' v' || event_id || ' ' END AS value, CASE WHEN event_id % 2 = 0 THEN 'you' ELSE 'others' END AS source,
  event_id % 300 AS s, event_id % 300 + event_id % 7 - 1 AS e FROM {SQL_EVENTS}),
b AS (SELECT *, min(seq) FILTER (WHERE k = 'signup') OVER (PARTITION BY session_id) AS begun FROM r), a AS (SELECT *, trim(value) AS own FROM b WHERE seq >= begun AND (k <> 'signup' OR seq = begun)),
u AS (SELECT *, k = 'click' AND own <> '' AND e > s AS usable FROM a),
x AS (SELECT *, usable AND e > coalesce(max(CASE WHEN usable THEN e END) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS block FROM u)
SELECT session_id, min(at_ms) FILTER (WHERE k = 'signup') AS started_at_ms, arg_max(at_ms, seq) FILTER (WHERE k = 'signup' OR block OR (k = 'view' AND own <> '')) AS updated_at_ms,
  arg_max(value, seq) FILTER (WHERE k = 'error') AS backend_session_id, arg_max(value, seq) FILTER (WHERE k = 'purchase') AS playbook,
  coalesce(string_agg(source || ':' || own, ',' ORDER BY seq) FILTER (WHERE k = 'view' AND own <> ''), '') AS said,
  coalesce(string_agg(s || ':' || e || ':' || own || ':' || at_ms, ',' ORDER BY seq) FILTER (WHERE block), '') AS told FROM x GROUP BY session_id""",
    "live_merge": f"""WITH i AS (SELECT * FROM {SQL_NOTES}), s AS (SELECT *, (SELECT count(*) FROM i WHERE i.n = s.n) AS c FROM {SQL_SESSION} s),
m AS (SELECT s.session_id, s.n, i.i, i.offset_ms, CASE WHEN i.i % 2 = 0 THEN 'n-' || i.i END AS id, s.c, s.n % 3 = 0 AS has_live FROM s JOIN i ON i.n = s.n),
o AS (SELECT session_id, 0 AS part, i, offset_ms, id FROM m WHERE n % 2 = 0 UNION ALL
  SELECT session_id, 1, i, offset_ms + 1, id FROM m WHERE n % 2 = 0 AND has_live AND c > 1 AND id IS NULL)
SELECT session_id, string_agg(offset_ms || ':' || coalesce(id, '-'), ',' ORDER BY part, i) AS notes, false AS is_left FROM o GROUP BY session_id
UNION ALL SELECT session_id, NULL, true FROM s WHERE n % 3 = 0 AND n % 2 <> 0""",
    "edit_guards": f"""WITH s AS (SELECT *, CASE WHEN n % 5 = 0 THEN 'pending' WHEN n % 4 = 0 THEN 'completed' END AS status, size > {CUT} AND n % 5 <> 0 AND n % 7 <> 0 AS cut FROM {SQL_SESSION})
SELECT session_id, size AS n_segments, status AS notes_status FROM s WHERE NOT cut
UNION ALL SELECT session_id || '-a', {CUT}, NULL FROM s WHERE cut UNION ALL SELECT session_id || '-b', size - {CUT}, NULL FROM s WHERE cut""",
    "notes_root_reply": f"""WITH c AS (SELECT *, session_id || '-' || (session_id % 3) AS root FROM {SQL_CHAT}), z AS (SELECT session_id, max(pos) AS last FROM c GROUP BY session_id),
r AS (SELECT session_id, arg_min(content, pos) AS content FROM c WHERE role = 'assistant' AND status = 'completed' AND parent_message_id = root GROUP BY session_id),
l AS (SELECT c.session_id, c.status, c.parent_message_id, c.root FROM c JOIN z ON z.session_id = c.session_id AND z.last = c.pos),
k AS (SELECT session_id, string_agg(id || ':' || CASE WHEN id = root THEN 'cancelled' ELSE status END, ',' ORDER BY pos) AS chat FROM c WHERE NOT (session_id % 2 = 0 AND parent_message_id IS NOT DISTINCT FROM root) GROUP BY session_id)
SELECT l.session_id, CASE WHEN l.session_id % 4 <> 0 THEN coalesce(r.content, 'old') END AS notes, l.parent_message_id IS NOT NULL AND l.status IN ('completed', 'errored') AS settles, coalesce(k.chat, '') AS chat
FROM l LEFT JOIN r USING (session_id) LEFT JOIN k USING (session_id)""",
    "ui_chunks": f"""WITH t AS (SELECT *, conv_id || '-' || turn AS k FROM conversations WHERE length({_BARE.format("text")}) > 0)
SELECT conv_id, turn, concat_ws(chr(10), '{{"type":"start","messageId":"' || k || '"}}', '{{"type":"text-start","id":"' || k || '"}}', '{{"type":"text-delta","id":"' || k || '","delta":' || CAST(to_json(text) AS VARCHAR) || '}}', '{{"type":"text-end","id":"' || k || '"}}',
  '{{"type":"data-activity","data":{{"label":"' || role || '"}},"transient":true}}', '{{"type":"error","errorText":"it failed"}}', '{{"type":"finish","finishReason":"stop"}}') AS chunks, text AS again, CAST(NULL AS VARCHAR) AS "none" FROM t""",
    "session_documents": f"""WITH i AS (SELECT n, string_agg('{{"offset_ms":' || offset_ms || ',"severity":"green","message":"note ' || i || '","segment_index":' || coalesce(CAST(anchor AS VARCHAR), 'null')
    || CASE WHEN i % 2 = 0 THEN ',"id":"n-' || i || '","producer":"signals"' ELSE '' END
    || CASE WHEN i % 6 = 0 THEN ',"feedback":{{"verdict":"helpful","rated_at":"2026-01-01T00:00:00Z","surface":"library","publish_pending":' || (i = 0) || '}}' ELSE '' END || '}}', ',' ORDER BY i) AS notes FROM {SQL_NOTES} GROUP BY n)
SELECT session_id, '{{"session_id":"' || session_id || '","title":' || coalesce('"' || title || '"', 'null') || ',"insights":[' || coalesce(notes, '') || ']}}' AS document FROM {SQL_SESSION} s LEFT JOIN i ON i.n = s.n""",
    "settings_documents": "SELECT event_id, event_id % 5 = 0 AS mic_enabled FROM events",
    "ids_and_digests": f"""WITH t AS (SELECT *, conv_id || '-' || turn AS k FROM conversations WHERE length({_BARE.format("text")}) > 0), h AS (SELECT *, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(k)) AS d, sha256(text) AS digest FROM t),
w AS (SELECT conv_id, left(sha256(string_agg(printf('%03d', turn) || ':' || digest, chr(10) ORDER BY printf('%03d', turn))), 16) AS revision FROM h GROUP BY conv_id)
SELECT h.conv_id, turn, CASE WHEN turn % 2 = 0 THEN k || ':msg:' || left(sha256(k || chr(10) || h.conv_id || chr(10) || text), 16) ELSE 'm' || turn END AS message_id,
  concat_ws('-', substr(d, 1, 8), substr(d, 9, 4), '5' || substr(d, 14, 3), (['8', '9', 'a', 'b'])[CAST(CAST('0x' || substr(d, 17, 1) AS INTEGER) % 4 + 1 AS INTEGER)] || substr(d, 18, 3), substr(d, 21, 12)) AS reply_id, digest, revision FROM h JOIN w ON w.conv_id = h.conv_id""",
    "display_titles": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE strftime(o_orderdate, '%-m/%-d/%Y') END AS title, strftime(o_orderdate, '%-m/%-d/%Y') AS day, strftime(CAST(o_orderdate AS TIMESTAMP), '%-I:%M %p') AS time,
  regexp_replace(format('{:,.3f}', CAST(o_totalprice AS DOUBLE)), '[.]?0+$', '') AS total, CASE o_orderkey % 3 WHEN 0 THEN 'yesterday' WHEN 1 THEN 'today' ELSE 'tomorrow' END AS ago FROM orders""",
    "routes_and_readiness": """WITH p AS (SELECT p_partkey, p_size % 9 AS c, p_partkey % 2 = 0 AS phones, (p_partkey // 1) % 2 = 1 AS b1, (p_partkey // 2) % 2 = 1 AS b2, (p_partkey // 4) % 2 = 1 AS b4, (p_partkey // 8) % 2 = 1 AS b8, (p_partkey // 16) % 2 = 1 AS b16 FROM part),
r AS (SELECT *, CASE WHEN c = 0 AND phones THEN 'headphones' WHEN c = 0 THEN 'internal_speakers' WHEN c IN (1, 2) THEN 'bluetooth' WHEN c = 3 THEN 'usb' WHEN c IN (4, 5, 6) THEN 'external_display' WHEN c = 7 THEN 'airplay' ELSE 'other' END AS route FROM p)
SELECT p_partkey, route, CASE WHEN route IN ('internal_speakers', 'external_display', 'airplay') THEN 'echo_prone' WHEN route = 'headphones' THEN 'clear' ELSE 'unknown' END AS prior, b1 AND CASE WHEN b4 OR NOT b8 THEN b2 ELSE NOT b16 END AS can_listen FROM r""",
    "endpoint_sets": """SELECT s_nationkey AS owner, s_suppkey AS rank, CASE WHEN s_suppkey % 2 = 0 THEN 'console' ELSE 'communications' END AS role, s_suppkey % 3 AS id FROM supplier WHERE s_suppkey % 5 <> 0
QUALIFY row_number() OVER (PARTITION BY s_nationkey, s_suppkey % 3 ORDER BY s_suppkey) = 1""",
    "latest_and_retired": f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_id DESC) AS k FROM {SQL_EVENTS})
SELECT session_id, arg_max(event_type, event_id) AS latest, min(event_type) AS first_name, count(*) FILTER (WHERE k <= 32) AS n_remembered, min(event_id) FILTER (WHERE k <= 32) AS oldest FROM e GROUP BY session_id""",
    "feedback_lifecycle": f"""WITH i AS (SELECT s.session_id, i.offset_ms, i.i % 2 = 0 AS signals, s.n % 2 = 0 AND i.i % 2 = 0 AS publish FROM {SQL_NOTES} i JOIN {SQL_SESSION} s ON s.n = i.n)
SELECT session_id, offset_ms, publish AS rated, publish AND NOT (offset_ms % 30000 = 0) AS settled, signals AS withdrawn FROM i""",
    "outcome_publication": """WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderkey % 4 <> 0 AS has, o_orderkey % 7 <> 0 AS off, CASE WHEN o_orderkey % 3 = 0 THEN 'user' ELSE 'crm' END AS hp, CASE WHEN o_orderkey % 5 = 0 THEN 'user' ELSE 'crm' END AS op, CASE WHEN o_orderkey % 2 = 0 THEN 'O' ELSE o_orderstatus END AS ov FROM orders),
w AS (SELECT *, CASE WHEN NOT off THEN 'not_offered' WHEN NOT has THEN 'recorded' WHEN hp = 'user' AND op <> 'user' THEN 'refused' WHEN s = ov AND hp = op THEN 'unchanged' ELSE 'recorded' END AS written FROM o),
a AS (SELECT *, CASE WHEN written = 'recorded' THEN ov WHEN has THEN s END AS value, CASE WHEN written = 'recorded' THEN op WHEN has THEN hp END AS by_, CASE WHEN written = 'recorded' THEN true WHEN has THEN false END AS pending FROM w)
SELECT k AS o_orderkey, written, value, pending, CASE WHEN value = 'O' AND by_ = 'crm' THEN false ELSE pending END AS pending_after FROM a""",
    "titles_and_segments": f"""WITH s AS (SELECT *, (SELECT count(*) FROM {SQL_DENSE} d WHERE d.session_id = s.n AND d.seg_index < 2 AND upper(d.utterance) <> d.utterance) AS cased FROM {SQL_SESSION} s)
SELECT session_id, CASE WHEN n % 2 = 0 THEN 'Mine ' || n END AS by_hand, CASE WHEN n % 3 = 1 THEN title WHEN n % 4 = 0 THEN 'Notes ' || n END AS "found", CASE WHEN n % 3 <> 1 AND n % 4 = 0 THEN true ELSE n % 2 = 1 END AS is_auto,
  size < 2 OR n % 2 = 0 OR cased = 0 AS blocks_hold, CASE WHEN n % 2 = 0 THEN title END AS replaced_title, least(size, 2) AS n_segments, CAST(0 AS BIGINT) AS n_described FROM s""",
    "library_rows": f"""SELECT session_id, title, ended_at, n % 4 = 0 AS has_notes, CASE WHEN n % 4 = 0 THEN 'completed' END AS notes_status, n % 2 = 0 AS feedback_waiting, n % 3 = 0 OR n % 5 = 0 AS has_outcome FROM {SQL_SESSION}""",
    "notes_lifecycle": f"""WITH r AS (SELECT session_id, event_id, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'errored' WHEN 'view' THEN 'cancelled' END AS status, CASE WHEN event_id % 3 <> 0 THEN 'n' || event_id END AS text FROM {SQL_EVENTS})
SELECT session_id, arg_max(status, event_id) FILTER (WHERE status IS NOT NULL) AS status, arg_max(text, event_id) FILTER (WHERE status = 'completed' AND text IS NOT NULL) AS notes FROM r GROUP BY session_id""",
    "speaker_renaming": f"""SELECT session_id, string_agg(CASE WHEN seg_index % 2 = 0 THEN 'spk' || (session_id % 5) || ':' || CASE WHEN session_id % 5 = 1 THEN 'Ann' WHEN session_id % 5 = 3 THEN 'Bob' WHEN session_id % 2 = 0 THEN 'Known' ELSE '-' END ELSE '-:guest' END, ',' ORDER BY seg_index) AS labels FROM {SQL_DENSE} GROUP BY session_id""",
    "visible_thread": f"""SELECT session_id, pos, id FROM {SQL_CHAT} WHERE role <> 'assistant' OR status = 'errored' OR (pos = 1 AND session_id % 2 = 0) OR (pos % 3 <> 1 AND length({_BARE.format("content")}) > 0)""",
}

QUERIES = (
    live_sessions, live_merge, edit_guards, notes_root_reply, ui_chunks, session_documents, settings_documents, ids_and_digests, display_titles, routes_and_readiness, endpoint_sets, latest_and_retired,
    feedback_lifecycle, outcome_publication, titles_and_segments, library_rows, notes_lifecycle, speaker_renaming, visible_thread,
)
