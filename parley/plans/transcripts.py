"""Queries over conversations as transcripts and chats, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import chats, transcripts
from parley.operators.sessions import status_label
from parley.sources.driver_tables import chat, dense_segments, segments, table, turns

BLOCK_TARGET = 1000
HISTORY_MESSAGES = chats.HISTORY_MESSAGES
HISTORY_CHARS = chats.HISTORY_CHARS
LIVE_ROWS = 500

# SQL pieces: white space of the driver's tables is ASCII.
SQL_SEGMENTS = """(SELECT conv_id AS session_id, turn AS seg_index, CASE WHEN role = 'user' THEN 'you' ELSE 'others' END AS source,
  regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS utterance FROM conversations WHERE role <> 'system' AND length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 0)"""
SQL_DENSE = f"(SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seg_index) - 1 AS seg_index, source, utterance FROM {SQL_SEGMENTS})"
SQL_CHAT = """(SELECT conv_id || '-' || turn AS id, conv_id AS session_id, turn AS pos, role, CASE WHEN turn % 5 = 4 THEN 'errored' ELSE 'completed' END AS status,
  text AS content, CASE WHEN role = 'assistant' THEN conv_id || '-' || (turn - 1) END AS parent_message_id FROM conversations)"""


def sql_collapsed(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '\\s+', ' ', 'g'), '^ | $', '', 'g')"


def sql_title(x: str) -> str:
    lines = f"list_filter(list_transform(string_split_regex({x}, '\\r?\\n'), lambda l: regexp_replace(regexp_replace(l, '^#+', ''), '^\\s+|\\s+$', '', 'g')), lambda l: length(l) > 0)"
    bare = sql_collapsed(f"""regexp_replace(({lines})[1], '^[*_`"#]+|[*_`"#]+$', '', 'g')""")
    word = f"regexp_extract(left({bare}, 80), '^(.*) ', 1, 's')"
    return f"""CASE WHEN length({bare}) <= 80 THEN {bare} WHEN contains(left({bare}, 80), ' ') AND strlen({word}) >= 40 THEN regexp_replace({word}, '\\s+$', '') || '…'
      ELSE regexp_replace(left({bare}, 80), '\\s+$', '') || '…' END"""


def session_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library: size, title, status and last turn of each conversation, newest last turn first."""
    rows = turns(spark, sf_dir)
    answer = F.when(F.col("role") == "assistant", F.col("text"))
    per = rows.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_segments"),
        F.sum(F.length("text").cast("long")).alias("total_chars"),
        F.max("turn").alias("last_turn"),
        F.min_by(answer, F.when(F.col("role") == "assistant", F.col("turn"))).alias("notes"),
    )
    title = F.coalesce(T.first_title_line(F.col("notes")), F.concat(F.lit("Conversation "), F.col("conv_id")))
    has_notes = F.col("notes").isNotNull()
    return per.select("conv_id", "n_segments", "total_chars", "last_turn", has_notes.alias("has_notes"), title.alias("title"), status_label(has_notes, F.lit("pending")).alias("status")).orderBy(F.desc("last_turn"), "conv_id")


def transcript_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.rendered(segments(spark, sf_dir))


def session_transcript_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.concat(F.lit("<<<"), F.col("text"), F.lit(">>>>"))
    return turns(spark, sf_dir).select("conv_id", "turn", T.strip_markers(fenced).alias("stripped"), T.spread_markers(fenced).alias("spread"))


def tail_and_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.tail_chars(text, 40).alias("tail"), T.clamp(text, 60).alias("clamped"))


def excerpt_160(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


def title_from_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("\n## **"), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.first_title_line(marked).alias("title"))


def speaker_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.with_run_edges(segments(spark, sf_dir)).select("session_id", "seg_index", "source", "first_in_run", "last_in_run")


def coalesced_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.coalesced_runs(segments(spark, sf_dir))


def distinct_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("seg_index") > 1, F.concat(F.col("source"), F.lit(" "), F.col("seg_index")))
    return transcripts.speakers(segments(spark, sf_dir).withColumn("label", label), "source", "label")


def chat_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.first_replies(chat(spark, sf_dir)).select("session_id", "id", "pos", "reply_id", "reply_status")


def recent_chat_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.recent(chat(spark, sf_dir)).select("session_id", "pos", "id", "role")


def history_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.within_budget(chats.history(chat(spark, sf_dir)), HISTORY_MESSAGES, HISTORY_CHARS)


def next_block_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.next_block_end(dense_segments(spark, sf_dir), BLOCK_TARGET)


def block_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.packed_blocks(dense_segments(spark, sf_dir), BLOCK_TARGET)


def contiguous_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("block"), (F.col("o_orderkey") % 7).alias("start_index"), (F.col("o_orderkey") % 7 + 1 + F.col("o_orderkey") % 5).alias("end_index")
    )
    return transcripts.coverage(blocks)


def severity_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "RED").when(F.col("event_type") == "purchase", "Orange").otherwise(F.col("event_type"))
    message = F.when(F.col("event_id") % 3 == 0, " No_Signal. ").when(F.col("event_id") % 3 == 1, "no signal").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", transcripts.severity(kind).alias("severity"), transcripts.is_no_signal(message).alias("no_signal"))


def status_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each order as a session, kept when its customer is known and in the first segment."""
    orders = table(spark, sf_dir, "orders")
    known = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "errored").when(F.col("o_orderkey") % 2 == 0, "cancelled")
    return orders.join(known, "o_custkey", "left_semi").select("o_orderkey", status_label(F.col("o_orderpriority") == "1-URGENT", status).alias("label"))


def carry_over_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat(spark, sf_dir).select("session_id", "id", "pos", "role")
    return chats.carried_over(rows.where("pos >= 2"), rows.where("pos <= 3").withColumn("role", F.lit("earlier")))


def append_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat(spark, sf_dir)
    held = rows.where("pos <= 2 and session_id % 10 <> 0")
    offered = rows.where("pos >= 1 and pos <= 3").withColumn("content", F.when(F.col("session_id") % 2 == 0, F.lit("changed")).otherwise(F.col("content")))
    return chats.append_outcome(held, offered)


def live_list_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 500 events of each user, as a live list keeps them."""
    kept = transcripts.newest(table(spark, sf_dir, "events"), "user_id", LIVE_ROWS, "ts", "event_id")
    return kept.select("user_id", "event_id", F.col("rank").cast("long").alias("rank"))


SQL = {
    "session_library": f"""
WITH t AS (SELECT * FROM conversations WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 0),
g AS (SELECT conv_id, count(*) AS n_segments, CAST(sum(length(text)) AS BIGINT) AS total_chars, max(turn) AS last_turn, arg_min(text, turn) FILTER (WHERE role = 'assistant') AS notes FROM t GROUP BY conv_id)
SELECT conv_id, n_segments, total_chars, last_turn, notes IS NOT NULL AS has_notes, coalesce({sql_title("notes")}, 'Conversation ' || conv_id) AS title,
  CASE WHEN notes IS NOT NULL THEN 'ready' ELSE 'summarizing' END AS status FROM g""",
    "transcript_render": f"SELECT session_id, string_agg(CASE WHEN source = 'you' THEN 'user: ' ELSE 'others: ' END || utterance, chr(10) ORDER BY seg_index) AS transcript FROM {SQL_SEGMENTS} GROUP BY session_id",
    "session_transcript_stripped": """SELECT conv_id, turn, replace(replace('<<<' || text || '>>>>', '<<<', ''), '>>>', '') AS stripped,
  replace(replace('<<<' || text || '>>>>', '<<<', '< < <'), '>>>', '> > >') AS spread FROM conversations WHERE length(trim(text)) > 0""",
    "tail_and_clamp": """SELECT doc_id, right(text, 40) AS tail, regexp_replace(left(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 60), '\\s+$', '') AS clamped FROM documents""",
    "excerpt_160": f"""SELECT doc_id, CASE WHEN length(c) <= 160 THEN c WHEN contains(left(c, 160), ' ') THEN regexp_extract(left(c, 160), '^(.*) ', 1) || '…' ELSE left(c, 160) || '…' END AS excerpt
  FROM (SELECT doc_id, {sql_collapsed("text")} AS c FROM documents)""",
    "title_from_notes": f"SELECT doc_id, {sql_title("t")} AS title FROM (SELECT doc_id, chr(10) || '## **' || text AS t FROM documents)",
    "speaker_runs": f"""SELECT session_id, seg_index, source, source IS DISTINCT FROM lag(source) OVER w AS first_in_run, source IS DISTINCT FROM lead(source) OVER w AS last_in_run
  FROM {SQL_SEGMENTS} WINDOW w AS (PARTITION BY session_id ORDER BY seg_index)""",
    "coalesced_runs": f"""WITH e AS (SELECT *, CASE WHEN source IS DISTINCT FROM lag(source) OVER (PARTITION BY session_id ORDER BY seg_index) THEN 1 ELSE 0 END AS edge FROM {SQL_SEGMENTS}),
r AS (SELECT *, CAST(sum(edge) OVER (PARTITION BY session_id ORDER BY seg_index) AS BIGINT) AS run FROM e)
SELECT session_id, run, source, min(seg_index) AS first_index, count(*) AS n, string_agg(utterance, ' ' ORDER BY seg_index) AS utterance FROM r GROUP BY session_id, run, source""",
    "distinct_speakers": f"""WITH s AS (SELECT *, CASE WHEN seg_index > 1 THEN source || ' ' || seg_index END AS label FROM {SQL_SEGMENTS})
SELECT session_id, source, min(seg_index) AS first_index, count(*) AS n, arg_min(label, seg_index) FILTER (WHERE label IS NOT NULL) AS first_label FROM s GROUP BY session_id, source""",
    "chat_pairing": f"""WITH c AS (SELECT * FROM {SQL_CHAT}),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id, parent_message_id ORDER BY pos) AS k FROM c WHERE role = 'assistant')
SELECT u.session_id, u.id, u.pos, r.id AS reply_id, r.status AS reply_status FROM c u LEFT JOIN r ON r.session_id = u.session_id AND r.parent_message_id = u.id AND r.k = 1 WHERE u.role = 'user'""",
    "recent_chat_12": f"SELECT session_id, pos, id, role FROM {SQL_CHAT} QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY pos DESC) <= 12",
    "history_budget": f"""WITH c AS (SELECT * FROM {SQL_CHAT}),
a AS (SELECT * FROM c WHERE role = 'user' AND status = 'completed' AND length(trim(content)) > 0),
r AS (SELECT * FROM c WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY session_id, parent_message_id ORDER BY pos) = 1),
h AS (SELECT session_id, pos, 0 AS part, 'user' AS role, content FROM a UNION ALL
  SELECT a.session_id, a.pos, 1, 'assistant', r.content FROM a JOIN r ON r.session_id = a.session_id AND r.parent_message_id = a.id WHERE r.status = 'completed' AND length(trim(r.content)) > 0),
b AS (SELECT *, row_number() OVER n AS back, sum(length(content)) OVER n AS chars FROM h WINDOW n AS (PARTITION BY session_id ORDER BY pos DESC, part DESC)),
o AS (SELECT *, max(CASE WHEN back > {HISTORY_MESSAGES} OR (chars > {HISTORY_CHARS} AND back > 1) THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY pos DESC, part DESC) AS over_ FROM b),
u AS (SELECT *, max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY pos, part) AS opened FROM o WHERE over_ = 0),
e AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY session_id ORDER BY pos, part) THEN 1 ELSE 0 END AS edge FROM u WHERE opened = 1),
g AS (SELECT *, CAST(sum(edge) OVER (PARTITION BY session_id ORDER BY pos, part) AS BIGINT) AS run FROM e)
SELECT session_id, run, role, string_agg(content, chr(10) || chr(10) ORDER BY pos, part) AS content FROM g GROUP BY session_id, run, role""",
    "next_block_end": f"""WITH r AS (SELECT *, sum(length(utterance) + 8) OVER (PARTITION BY session_id ORDER BY seg_index) AS running FROM {SQL_DENSE})
SELECT session_id, CAST(min(seg_index + 1) FILTER (WHERE running >= {BLOCK_TARGET}) AS BIGINT) AS block_end FROM r GROUP BY session_id""",
    "block_packing": f"""WITH RECURSIVE s AS (SELECT session_id, seg_index, length(utterance) + 8 AS cost FROM {SQL_DENSE}),
f(session_id, i, start_index, chars, block, done) AS (
  SELECT session_id, seg_index, CASE WHEN cost >= {BLOCK_TARGET} THEN 1 ELSE 0 END, CASE WHEN cost >= {BLOCK_TARGET} THEN 0 ELSE cost END, CASE WHEN cost >= {BLOCK_TARGET} THEN 1 ELSE 0 END,
    CASE WHEN cost >= {BLOCK_TARGET} THEN struct_pack(start_index := CAST(0 AS BIGINT), chars := CAST(cost AS BIGINT)) END FROM s WHERE seg_index = 0
  UNION ALL
  SELECT f.session_id, s.seg_index, CASE WHEN f.chars + s.cost >= {BLOCK_TARGET} THEN s.seg_index + 1 ELSE f.start_index END, CASE WHEN f.chars + s.cost >= {BLOCK_TARGET} THEN 0 ELSE f.chars + s.cost END,
    f.block + CASE WHEN f.chars + s.cost >= {BLOCK_TARGET} THEN 1 ELSE 0 END,
    CASE WHEN f.chars + s.cost >= {BLOCK_TARGET} THEN struct_pack(start_index := CAST(f.start_index AS BIGINT), chars := CAST(f.chars + s.cost AS BIGINT)) END
  FROM f JOIN s ON s.session_id = f.session_id AND s.seg_index = f.i + 1)
SELECT session_id, CAST(block - 1 AS BIGINT) AS block, done.start_index AS start_index, CAST(i + 1 AS BIGINT) AS end_index, done.chars AS chars FROM f WHERE done IS NOT NULL""",
    "contiguous_coverage": """WITH b AS (SELECT o_custkey AS session_id, o_orderkey AS block, o_orderkey % 7 AS start_index, o_orderkey % 7 + 1 + o_orderkey % 5 AS end_index FROM orders),
r AS (SELECT *, coalesce(max(end_index) OVER (PARTITION BY session_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM b),
k AS (SELECT *, max(CASE WHEN start_index > reach THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY block) AS broken FROM r)
SELECT session_id, CAST(max(end_index) AS BIGINT) AS covered_to, count(*) FILTER (WHERE broken = 0) AS used, CAST(coalesce(max(end_index) FILTER (WHERE broken = 0), 0) AS BIGINT) AS contiguous_to FROM k GROUP BY session_id""",
    "severity_normalise": """SELECT event_id, CASE event_type WHEN 'error' THEN 'red' WHEN 'purchase' THEN 'orange' ELSE 'green' END AS severity, event_id % 3 <> 2 AS no_signal FROM events""",
    "status_labels": """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'ready' WHEN o_orderstatus = 'O' THEN 'summarizing' WHEN o_orderstatus = 'P' THEN 'failed' WHEN o_orderkey % 2 = 0 THEN 'none' ELSE 'transcript only' END AS label
  FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')""",
    "carry_over_chat": f"""WITH c AS (SELECT session_id, id, pos, role FROM {SQL_CHAT}), now_ AS (SELECT * FROM c WHERE pos >= 2)
SELECT * FROM now_ UNION ALL SELECT session_id, id, pos, 'earlier' AS role FROM c WHERE pos <= 3 AND NOT EXISTS (SELECT 1 FROM now_ n WHERE n.session_id = c.session_id AND n.id = c.id)""",
    "append_outcomes": f"""WITH c AS (SELECT * FROM {SQL_CHAT}), held AS (SELECT * FROM c WHERE pos <= 2 AND session_id % 10 <> 0),
offered AS (SELECT session_id, id, role, CASE WHEN session_id % 2 = 0 THEN 'changed' ELSE content END AS content, status, parent_message_id FROM c WHERE pos BETWEEN 1 AND 3)
SELECT o.session_id, o.id, CASE WHEN NOT EXISTS (SELECT 1 FROM held k WHERE k.session_id = o.session_id) THEN 'missing' WHEN h.id IS NULL THEN 'inserted'
  WHEN h.role = o.role AND h.content = o.content AND h.status = o.status AND h.parent_message_id IS NOT DISTINCT FROM o.parent_message_id THEN 'identical' ELSE 'conflicting' END AS verdict
FROM offered o LEFT JOIN held h ON h.session_id = o.session_id AND h.id = o.id""",
    "live_list_cap": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events QUALIFY rank <= 500",
}

QUERIES = (
    session_library, transcript_render, session_transcript_stripped, tail_and_clamp, excerpt_160, title_from_notes, speaker_runs, coalesced_runs, distinct_speakers, chat_pairing,
    recent_chat_12, history_budget, next_block_end, block_packing, contiguous_coverage, severity_normalise, status_labels, carry_over_chat, append_outcomes, live_list_cap,
)
