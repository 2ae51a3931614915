"""Queries over messages for a language model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import prompts as P
from parley.functions import text as T
from parley.operators import chats, transcripts
from parley.plans.transcripts import SQL_CHAT, SQL_DENSE
from parley.sources.driver_tables import chat, dense_segments

STRETCH = 3


def sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _playbook() -> Column:
    return F.when(F.col("session_id") % 3 == 0, F.concat(F.lit(" step "), F.col("session_id"))).when(F.col("session_id") % 3 == 1, F.lit("  "))


def block_summary_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests to digest each stretch of three segments of each session, with what was carried over from earlier ones."""
    block = F.floor(F.col("seg_index") / STRETCH)
    stretches = transcripts.rendered(dense_segments(spark, sf_dir).withColumn("session_id", F.concat_ws(":", "session_id", block))).withColumnRenamed("session_id", "key")
    stretches = stretches.withColumns({"session_id": F.split_part("key", F.lit(":"), F.lit(1)).cast("long"), "block": F.split_part("key", F.lit(":"), F.lit(2)).cast("long")})
    blocks = F.array(F.struct(F.lit("old").alias("summary")), F.struct(F.when(F.col("session_id") % 2 == 0, F.concat(F.lit(" covered "), F.col("session_id"))).otherwise(F.lit(" ")).alias("summary")))
    return P.block_messages(stretches.withColumns({"playbook": _playbook(), "state": P.carried_summary(blocks)})).select("session_id", "block", "prompt")


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with their transcript, the part after the first two segments, and summaries of those for even ones."""
    rows = dense_segments(spark, sf_dir)
    tail = transcripts.rendered(rows.where("seg_index >= 2")).withColumnRenamed("transcript", "tail")
    summaries = F.when(F.col("session_id") % 2 == 0, F.array(F.lit(" first block "), F.concat(F.lit("block of "), F.col("session_id")))).otherwise(F.array().cast("array<string>"))
    return transcripts.rendered(rows).join(tail, "session_id", "left").select("session_id", "transcript", F.coalesce("tail", F.lit("")).alias("tail"), summaries.alias("summaries"))


def session_summary_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request to summarise each session; even ones are long ones with summarised blocks, some showed a screen."""
    screen = F.when(F.col("session_id") % 5 == 0, F.concat(F.lit(" window <<<"), F.col("session_id"), F.lit(">>> ")))
    return P.session_messages(_covered(spark, sf_dir).withColumns({"playbook": _playbook(), "screen": screen})).select("session_id", "prompt")


def sections_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of each conversation as summaries of blocks, within budgets from 100 to 1,500 characters."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seg_index", "utterance"))), lambda s: s["utterance"])
    rows = dense_segments(spark, sf_dir).groupBy("session_id").agg(lines.alias("s"))
    return rows.select("session_id", P.sections_within(F.col("s"), (F.col("session_id") % 15 + 1) * 100).alias("sections"))


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's transcript as the room heard it, its latest messages, and notes for some."""
    heard = transcripts.room_transcript(dense_segments(spark, sf_dir))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(": ", "role", T.strip_markers(T.trim_ws(F.col("content")))).alias("line")))), lambda m: m["line"])
    last = chats.recent(chat(spark, sf_dir), P.RECENT_MESSAGES).groupBy("session_id").agg(F.array_join(lines, "\n").alias("messages"))
    notes = F.when(F.col("session_id") % 3 != 0, F.concat(F.lit(" # Notes <<<"), F.col("session_id")))
    return heard.join(last, "session_id", "left").select("session_id", "transcript", F.coalesce("messages", F.lit("")).alias("messages"), notes.alias("notes"), F.concat(F.lit("  what about "), F.col("session_id"), F.lit("? ")).alias("question"))


def chat_context_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question about each conversation with its context, as a local model gets it."""
    return _context(spark, sf_dir).select("session_id", P.chat_message(F.col("notes"), F.col("transcript"), F.col("messages"), F.col("question")).alias("prompt"))


def relay_chat_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a remote model gets it: smaller budgets, an instruction, and the screen for every other one."""
    rows = _context(spark, sf_dir)
    parts = [F.col(c) for c in ("notes", "transcript", "messages", "question")]
    screen = F.when(F.col("session_id") % 4 == 0, F.lit(" <<<window>>> ")).otherwise(F.lit(" "))
    return rows.select("session_id", P.relay_message(*parts).alias("plain"), P.relay_message(*parts, screen=screen).alias("with_screen"))


def request_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is sent for each conversation: system prompt with clipped notes, then the history of messages."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("pos", "role", "content"))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    rows = chat(spark, sf_dir).where("role <> 'system'").groupBy("session_id").agg(turns.alias("history"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda m: m["content"]), "\n").alias("notes"))
    system = F.when(F.col("session_id") % 4 != 0, P.system_prompt("Be brief.", F.when(F.col("session_id") % 2 == 0, F.col("notes"))))
    sent = rows.select("session_id", F.posexplode(P.request_messages(system, F.col("history"))).alias("n", "m"))
    return sent.select("session_id", F.col("n").cast("long").alias("n"), "m.role", "m.content")


_CONTEXT_SQL = f"""h AS (SELECT session_id, string_agg(CASE WHEN source = 'you' THEN 'You: ' ELSE 'Room: ' END || replace(replace(utterance, '<<<', ''), '>>>', ''), chr(10) ORDER BY seg_index) AS transcript FROM {SQL_DENSE} GROUP BY session_id),
l AS (SELECT * FROM {SQL_CHAT} QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY pos DESC) <= 12),
m AS (SELECT session_id, string_agg(role || ': ' || replace(replace(regexp_replace(content, '^\\s+|\\s+$', '', 'g'), '<<<', ''), '>>>', ''), chr(10) ORDER BY pos) AS messages FROM l GROUP BY session_id),
c AS (SELECT h.session_id, transcript, coalesce(messages, '') AS messages, coalesce(CASE WHEN h.session_id % 3 <> 0 THEN '# Notes ' || h.session_id END, 'Not available') AS notes, 'what about ' || h.session_id || '?' AS question FROM h LEFT JOIN m USING (session_id))"""


def _context_sql(b: P.Budgets) -> str:
    part = lambda title, mark, text, most: f"{sql(f'{title}{chr(10)}{P.GUARD}{chr(10)}<<<{mark}>>>{chr(10)}')} || right({text}, {most}) || {sql(f'{chr(10)}<<<END_{mark}>>>')}"
    return " || chr(10) || chr(10) || ".join((part("SESSION NOTES", "SESSION_SUMMARY", "notes", b.notes), part("TRANSCRIPT", "SESSION_TRANSCRIPT", "transcript", b.transcript), part("PREVIOUS QUESTIONS", "PREVIOUS_QUESTIONS", "messages", b.chat)))


_PLAYBOOK = "CASE WHEN session_id % 3 = 0 THEN 'step ' || session_id ELSE '' END"
_RENDERED = "string_agg(CASE WHEN source = 'you' THEN 'user: ' ELSE 'others: ' END || utterance, chr(10) ORDER BY seg_index)"
_SCREEN = f"{sql(P.SCREEN_GUARD + chr(10) + '<<<SCREEN_CONTEXT>>>' + chr(10))} || 'window' || {sql(chr(10) + '<<<END_SCREEN_CONTEXT>>>' + chr(10) + chr(10))}"

SQL = {
    "block_summary_prompt": f"""WITH t AS (SELECT session_id, seg_index // {STRETCH} AS block, {_RENDERED} AS transcript FROM {SQL_DENSE} GROUP BY ALL)
SELECT session_id, block, {sql(P.BLOCK_LEAD)} || CASE WHEN {_PLAYBOOK} = '' THEN '' ELSE {sql(P.BLOCK_LENS)} || {_PLAYBOOK} || CASE WHEN session_id % 2 = 0 THEN {sql(P.BLOCK_CARRY)} || 'covered ' || session_id ELSE '' END END || {sql(P.BLOCK_TAIL)} || transcript AS prompt FROM t""",
    "session_summary_prompt": f"""WITH d AS (SELECT * FROM {SQL_DENSE}), t AS (SELECT session_id, {_RENDERED} AS transcript FROM d GROUP BY session_id), a AS (SELECT session_id, {_RENDERED} AS tail FROM d WHERE seg_index >= 2 GROUP BY session_id)
SELECT t.session_id, {sql(P.SUMMARY_LEAD)} || CASE WHEN t.session_id % 3 = 0 THEN {sql(P.SUMMARY_LENS)} || 'step ' || t.session_id ELSE '' END || {sql(P.SUMMARY_TAIL)} ||
  CASE WHEN t.session_id % 2 = 0 THEN {sql(P.ROLLING_PREFACE)} || 'SECTION 1 SUMMARY:' || chr(10) || 'first block' || chr(10) || chr(10) || 'SECTION 2 SUMMARY:' || chr(10) || 'block of ' || t.session_id || {sql(P.FINAL_STRETCH)} || coalesce(tail, '') ELSE transcript END ||
  CASE WHEN t.session_id % 5 = 0 THEN {sql(P.SCREEN_FRAME[0])} || 'window < < <' || t.session_id || '> > >' || {sql(P.SCREEN_FRAME[1])} ELSE '' END AS prompt FROM t LEFT JOIN a USING (session_id)""",
    "sections_budget": f"""WITH r AS (SELECT session_id, list(utterance ORDER BY seg_index) AS s, (session_id % 15 + 1) * 100 AS budget FROM {SQL_DENSE} GROUP BY session_id),
f AS (SELECT *, len(s) AS n, array_to_string(list_transform(s, lambda x, i: 'SECTION ' || i || ' SUMMARY:' || chr(10) || x), chr(10) || chr(10)) AS whole FROM r),
k AS (SELECT *, least(n, greatest(budget // (length('SECTION ' || (n + 1) || ' SUMMARY:') + 1 + 2 + 16), 1)) AS kept FROM f),
g AS (SELECT *, greatest(budget - list_sum(list_transform(range(1, kept + 1), lambda i: length('SECTION ' || i || ' SUMMARY:') + 1)) - 2 * (kept - 1), 0) // kept AS share FROM k),
c AS (SELECT *, array_to_string(list_transform(s[n - kept + 1:], lambda x, i: 'SECTION ' || i || ' SUMMARY:' || chr(10) || regexp_replace(left(x, CAST(share AS BIGINT)), '\\s+$', '')), chr(10) || chr(10)) AS part FROM g)
SELECT session_id, CASE WHEN length(whole) <= budget THEN whole ELSE regexp_replace(left(part, budget), '\\s+$', '') END AS sections FROM c""",
    "chat_context_prompt": f"WITH {_CONTEXT_SQL} SELECT session_id, {_context_sql(P.LOCAL)} || {sql(chr(10) * 2 + 'QUESTION' + chr(10))} || question AS prompt FROM c",
    "relay_chat_prompt": f"""WITH {_CONTEXT_SQL} SELECT session_id, {sql(P.ANSWER_INSTRUCTION + chr(10) * 2)} || {_context_sql(P.RELAY)} || {sql(chr(10) * 2 + 'QUESTION' + chr(10))} || right(question, 2000) AS plain,
  {sql(P.ANSWER_INSTRUCTION + chr(10) * 2)} || {_context_sql(P.RELAY_WITH_SCREEN)} || {sql(chr(10) * 2 + 'QUESTION' + chr(10))} || CASE WHEN session_id % 4 = 0 THEN {_SCREEN} ELSE '' END || right(question, 1500) AS with_screen FROM c""",
    "request_messages": f"""WITH c AS (SELECT * FROM {SQL_CHAT} WHERE role <> 'system'), n AS (SELECT session_id, regexp_replace(string_agg(content, chr(10) ORDER BY pos), '^\\s+|\\s+$', '', 'g') AS notes FROM c GROUP BY session_id),
s AS (SELECT session_id, 'Be brief.' || CASE WHEN session_id % 2 = 0 AND length(notes) > 0 THEN chr(10) || chr(10) || 'Summary of the call:' || chr(10) || '<<<' || chr(10) ||
  replace(replace(CASE WHEN length(notes) <= 4000 THEN notes ELSE left(notes, 4000) || '…' END, '<<<', '< < <'), '>>>', '> > >') || chr(10) || '>>>' ELSE '' END AS content FROM n WHERE session_id % 4 <> 0),
a AS (SELECT session_id, -1 AS pos, 'system' AS role, content FROM s UNION ALL SELECT session_id, pos, role, content FROM c)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY pos) - 1 AS n, role, content FROM a""",
}

QUERIES = (block_summary_prompt, session_summary_prompt, sections_budget, chat_context_prompt, relay_chat_prompt, request_messages)
