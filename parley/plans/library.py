"""Queries over stored sessions: documents, versions, index and change feed; and small functions and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import arrays as A
from parley.functions import text as T
from parley.functions import times
from parley.operators import catalogs, insights, speakers, streams
from parley.plans.documents import SQL_NOTES, SQL_SESSION
from parley.plans.streams import SQL_EVENTS
from parley.plans.vectors import SQL_CENTROIDS, SQL_EMB, _embeddings
from parley.sources import audio as audio_files
from parley.sources.driver_tables import event_stream, table
from parley.sources.folders import new_folder
from parley.sources.sessions import demo_sessions, read_sessions, session_files, write_sessions
from parley.sources.store import SessionStore, SummaryIndex
from parley.streaming import processors


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("n", F.substring("session_id", 2, 6).cast("int"))


def stored_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions saved, some saved again with another title, some deleted; read back with the last that the feed says of them."""
    store = SessionStore(spark, new_folder(spark, "sessions"), buckets=8)
    rows = demo_sessions(spark, sf_dir)
    store.save(rows)
    store.save(_numbered(rows).where("n % 3 = 1").withColumn("title", F.concat(F.lit("Again "), "n")).drop("n"))
    store.delete(_numbered(rows).where("n % 5 = 0").select("session_id"))
    told = store.changes().groupBy("session_id").agg(F.max_by("kind", "version").alias("last_change"), F.count(F.lit(1)).alias("n_changes"))
    return told.join(store.read().select("session_id", "title", F.size("segments").cast("long").alias("n_segments")), "session_id", "left")


def session_documents_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions written as documents and read again, with what listing their files tells; some hold fields from elsewhere."""
    folder = new_folder(spark, "documents")
    rows = _numbered(demo_sessions(spark, sf_dir))
    lenient = F.transform("insights", lambda i: i.withField("producer", F.when(F.col("n") % 2 == 0, i["producer"]).otherwise(F.lit("robot"))))
    write_sessions(rows.withColumn("insights", lenient).drop("n"), folder)
    stats = session_files(spark, folder)
    read = read_sessions(spark, folder)
    known = F.size(F.filter("insights", lambda i: i["producer"].isNotNull())).cast("long")
    return read.join(stats, "session_id").select("session_id", "title", F.size("segments").cast("long").alias("n_segments"), F.size("chat").cast("long").alias("n_chat"), known.alias("n_known"), (F.col("len") > 100).alias("is_long"), "title_is_auto")


def summary_index_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index written for some files, then refreshed for others: what is taken over and what is made anew."""
    index = SummaryIndex(spark, new_folder(spark, "index"), "string")
    orders = table(spark, sf_dir, "orders")
    stats = orders.select(F.col("o_orderkey").cast("string").alias("session_id"), F.col("o_orderkey").alias("k"), F.length("o_orderpriority").cast("long").alias("len"), F.lit(1).cast("long").alias("modified_ms"))
    old = stats.where("k % 7 <> 0").select("session_id", "len", F.when(F.col("k") % 3 == 0, F.lit(0).cast("long")).otherwise(F.col("modified_ms")).alias("modified_ms"), F.lit("old").alias("summary"))
    index.save(old)
    now = stats.where("k % 5 <> 0")
    return index.refreshed(now.drop("k"), now.select("session_id", F.lit("new").alias("summary"))).select("session_id", "summary")


def small_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as lines of a vocabulary and as folders of a cache: ids of pieces, and the first folder that is there."""
    parts = table(spark, sf_dir, "part")
    lines = parts.select(F.concat_ws(" ", "p_brand", F.when(F.col("p_partkey") % 9 == 0, F.lit("none")).otherwise(F.col("p_partkey").cast("string"))).alias("value"))
    vocabulary = catalogs.vocabulary_of(lines).withColumn("folder", F.lit(None).cast("string"))
    folders = parts.select(F.concat(F.lit("key "), F.col("p_size")).alias("key"), F.col("p_partkey").alias("rank"), F.concat(F.lit("f"), F.col("p_partkey")).alias("folder"), (F.col("p_partkey") % 4 == 1).alias("present"))
    found = catalogs.first_existing(folders).select(F.col("key").alias("piece"), F.lit(None).cast("long").alias("id"), "folder")
    return vocabulary.select("piece", "id", "folder").unionByName(found)


def text_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and gaps, joined word pieces, titles of sessions and elapsed times over documents."""
    text = F.col("text")
    pieces = F.transform(F.split(text, " "), lambda w: F.concat(F.lit("▁"), w))
    title = T.session_title(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# "), F.col("lang"))), F.when(F.col("doc_id") % 3 == 1, F.array("lang", "source")).otherwise(F.array().cast("array<string>")), F.when(F.col("doc_id") % 5 == 0, "").otherwise("2026-01-02T03:04:05Z"))
    shown = table(spark, sf_dir, "documents").where("text is not null and lang is not null and source is not null")
    return shown.select("doc_id", F.size(T.words_and_gaps(F.regexp_replace(text, "[^a-zA-Z0-9' ]", ""))).cast("long").alias("n_pieces"), T.detokenised(pieces).alias("again"), title.alias("title"), times.since(F.col("doc_id") * 10, F.lit(500).cast("long")).alias("since"), T.is_session_id(F.when(F.col("doc_id") % 4 == 0, "../x").when(F.col("doc_id") % 4 == 1, "").otherwise(F.col("lang"))).alias("is_id"))


def insights_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session is offered its own insights again and a new one; of those that are the same none is appended."""
    rows = demo_sessions(spark, sf_dir)
    new = F.transform(F.slice("insights", 1, 1), lambda n: n.withField("message", F.lit("new")).withField("id", F.lit("fresh")).withField("offset_ms", times.since(F.lit(90_000).cast("long"), F.lit(30_000).cast("long"))))
    kept = insights.without_repeats(F.concat("insights", F.filter("insights", lambda i: i["id"].isNotNull()), new))
    return rows.select("session_id", F.size(kept).cast("long").alias("n"), F.element_at(kept, -1)["offset_ms"].alias("last_offset"), F.size(F.filter(kept, lambda i: i["id"].isNotNull())).cast("long").alias("n_with_id"))


def voiceprints_after_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of even number as known voices by label, the others as a session whose speakers are found among them and added."""
    rows = _embeddings(spark, sf_dir)
    prints = speakers.centroids(rows.where("vec_id % 2 = 0"), "label").select(F.concat(F.lit("spk_"), "label").alias("speaker_id"), F.col("label").alias("rank"), F.lit(None).cast("string").alias("label"), "centroid", F.col("n").alias("sample_count"))
    heard = rows.where("vec_id % 2 = 1").select(F.col("vec_id").alias("idx"), "embedding")
    best = speakers.best_prints(heard, prints, -1.0)
    added = speakers.centroids(heard.join(best, "idx").select("speaker_id", "embedding"), "speaker_id").select("speaker_id", F.col("centroid").alias("mean"), "n")
    out = speakers.updated_prints(prints.drop("rank"), added)
    return out.select("speaker_id", "sample_count", F.round(A.total(F.col("centroid")), 6).alias("total"))


def wav_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as WAV files of 16 and 48 kHz, read as samples of 16 kHz."""
    folder = new_folder(spark, "wav")
    rate = F.when(F.col("vec_id") % 2 == 0, 16_000).otherwise(48_000)
    audio_files.write_wav(_embeddings(spark, sf_dir).select(F.col("vec_id").cast("string").alias("name"), A.to_pcm(F.transform("embedding", lambda x: x * 4)).alias("samples"), rate.alias("rate")), folder)
    read = audio_files.wav_files(spark, folder)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return read.select(F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("long").alias("vec_id"), "source_rate", F.size("samples").cast("long").alias("n"), F.round(total, 3).alias("total"))


def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as chat turns: signups register, views are deltas, clicks resume, purchases reply, errors cancel."""
    kind = F.col("event_type")
    action = F.when(kind == "signup", "register").when(kind == "view", "delta").when(kind == "click", "resume").when((kind == "purchase") & (F.col("event_id") % 3 == 0), "reply").when((kind == "error") & (F.col("event_id") % 4 == 0), "cancel").otherwise("none")
    text = F.when(kind == "view", F.concat(F.lit("d"), F.col("event_id"))).when(kind == "purchase", F.concat(F.lit("r"), F.col("event_id")))
    rows = event_stream(spark, sf_dir).select(F.col("session_id").alias("turn_id"), F.col("event_id").alias("seq"), action.alias("action"), text.alias("text"))
    return streams.turn_outputs(rows).select("turn_id", "seq", F.col("n").cast("long").alias("n"), "type", "text")


def coalesced_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types of users as deltas, joined by hours."""
    rows = event_stream(spark, sf_dir).select(F.col("session_id").alias("key"), F.timestamp_millis("at_ms").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("delta"))
    return processors.coalesced_deltas(rows, "1 hour").select("key", F.unix_millis("start").alias("start_ms"), "text")


SQL = {
    "wav_roundtrip": f"""WITH s AS (SELECT vec_id, list_transform(v, lambda x: CAST(trunc(greatest(least(x * 4, 1), -1) * 32767) AS DOUBLE) / 32768) AS a FROM {SQL_EMB})
SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 16000 ELSE 48000 END AS source_rate, CASE WHEN vec_id % 2 = 0 THEN len(a) ELSE CAST(ceil(len(a) / 3.0) AS BIGINT) END AS n,
  round(CASE WHEN vec_id % 2 = 0 THEN list_sum(a) ELSE list_sum(list_transform(range(0, CAST(ceil(len(a) / 3.0) AS BIGINT)), lambda i: a[i * 3 + 1])) END, 3) AS total FROM s""",
    "chat_turns": f"""WITH r AS (SELECT session_id AS turn_id, event_id AS seq, CASE WHEN event_type = 'signup' THEN 'register' WHEN event_type = 'view' THEN 'delta' WHEN event_type = 'click' THEN 'resume' WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'reply' WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'cancel' END AS a FROM {SQL_EVENTS}),
b AS (SELECT *, min(seq) FILTER (WHERE a = 'register') OVER (PARTITION BY turn_id) AS begun FROM r), c AS (SELECT *, min(seq) FILTER (WHERE a IN ('reply', 'cancel') AND seq > begun) OVER (PARTITION BY turn_id) AS closed FROM b WHERE seq >= begun),
s AS (SELECT *, closed IS NULL OR seq < closed AS open_, coalesce(string_agg('d' || seq, '' ORDER BY seq) FILTER (WHERE a = 'delta' AND (closed IS NULL OR seq < closed)) OVER (PARTITION BY turn_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS said FROM c),
t AS (SELECT *, CASE WHEN a = 'reply' AND seq = closed THEN CASE WHEN said = '' THEN 'r' || seq ELSE chr(10) || chr(10) || 'r' || seq END ELSE '' END AS added FROM s),
w AS (SELECT *, said || coalesce(max(added) OVER (PARTITION BY turn_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS whole FROM t),
o AS (SELECT turn_id, seq, unnest(CASE WHEN a = 'register' THEN [{{'n': 0, 't': CASE WHEN seq = begun THEN 'start' ELSE 'refused' END, 'x': ''}}] WHEN a = 'resume' THEN [{{'n': 0, 't': 'start', 'x': ''}}, {{'n': 1, 't': 'text-start', 'x': ''}}, {{'n': 2, 't': 'text-delta', 'x': whole}}]
  WHEN a = 'delta' AND open_ THEN [{{'n': 0, 't': 'text-delta', 'x': 'd' || seq}}] WHEN a = 'cancel' AND seq = closed THEN [{{'n': 0, 't': 'finish', 'x': ''}}]
  WHEN a = 'reply' AND seq = closed THEN [{{'n': 0, 't': 'text-delta', 'x': added}}, {{'n': 1, 't': 'text-end', 'x': ''}}, {{'n': 2, 't': 'finish', 'x': ''}}] ELSE [] END) AS e FROM w)
SELECT turn_id, seq, CAST(e.n AS BIGINT) AS n, e.t AS type, e.x AS text FROM o""",
    "coalesced_deltas": f"SELECT session_id AS key, at_ms // 3600000 * 3600000 AS start_ms, string_agg(event_type, '' ORDER BY event_id) AS text FROM {SQL_EVENTS} GROUP BY 1, 2",
    "stored_sessions": f"""SELECT session_id, CASE WHEN n % 5 = 0 THEN 'removed' ELSE 'saved' END AS last_change, 1 + (n % 3 = 1)::INT + (n % 5 = 0)::INT AS n_changes,
  CASE WHEN n % 5 <> 0 THEN CASE WHEN n % 3 = 1 THEN 'Again ' || n ELSE title END END AS title, CASE WHEN n % 5 <> 0 THEN size END AS n_segments FROM {SQL_SESSION}""",
    "session_documents_read": f"""SELECT session_id, title, size AS n_segments, 0 AS n_chat, CASE WHEN n % 2 = 0 THEN (SELECT count(*) FROM {SQL_NOTES} i WHERE i.n = s.n AND i.i % 2 = 0) ELSE 0 END AS n_known, true AS is_long, n % 2 = 1 AS title_is_auto FROM {SQL_SESSION} s""",
    "summary_index_refresh": "SELECT CAST(o_orderkey AS VARCHAR) AS session_id, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 0 THEN 'old' ELSE 'new' END AS summary FROM orders WHERE o_orderkey % 5 <> 0",
    "small_selections": """SELECT p_brand AS piece, p_partkey AS id, CAST(NULL AS VARCHAR) AS folder FROM part WHERE p_partkey % 9 <> 0
UNION ALL SELECT 'key ' || p_size, NULL, 'f' || min(p_partkey) FROM part WHERE p_partkey % 4 = 1 GROUP BY p_size""",
    "text_pieces": """WITH d AS (SELECT *, text AS t FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL)
SELECT doc_id, len(regexp_extract_all(regexp_replace(t, '[^a-zA-Z0-9'' ]', '', 'g'), '[a-zA-Z0-9'']+|[^a-zA-Z0-9'']+')) AS n_pieces, regexp_replace(t, '^[\\s\\x{0085}\\x{2028}\\x{2029}\\x{00A0}]+', '') AS again,
  CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN lang || ', ' || source || CASE WHEN doc_id % 5 = 0 THEN '' ELSE ' (2026-01-02)' END WHEN doc_id % 5 = 0 THEN '' ELSE '2026-01-02' END AS title,
  greatest(doc_id * 10 - 500, 0) AS since, doc_id % 4 > 1 AS is_id FROM d""",
    "insights_appended": f"""WITH i AS (SELECT n, count(*) AS c, count(*) FILTER (WHERE i % 2 = 0) AS named FROM {SQL_NOTES} GROUP BY n)
SELECT session_id, c + 1 AS n, 60000 AS last_offset, named + 1 AS n_with_id FROM {SQL_SESSION} s JOIN i ON i.n = s.n""",
    "voiceprints_after_session": f"""WITH c AS (SELECT label, c, n FROM {SQL_CENTROIDS.replace(SQL_EMB, f"(SELECT * FROM {SQL_EMB} WHERE vec_id % 2 = 0)")} JOIN (SELECT label, count(*) AS n FROM {SQL_EMB} WHERE vec_id % 2 = 0 GROUP BY label) USING (label)),
b AS (SELECT e.vec_id, e.v, c.label FROM {SQL_EMB} e, c WHERE e.vec_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY e.vec_id ORDER BY list_cosine_similarity(e.v, c.c) DESC, c.label) = 1),
a AS (SELECT label, count(*) AS k, sum(list_sum(v)) AS s FROM b GROUP BY label)
SELECT 'spk_' || c.label AS speaker_id, n + coalesce(k, 0) AS sample_count, round((list_sum(c) * n + coalesce(s, 0)) / (n + coalesce(k, 0)), 6) AS total FROM c LEFT JOIN a ON a.label = c.label""",
}

QUERIES = (stored_sessions, session_documents_read, summary_index_refresh, small_selections, text_pieces, insights_appended, voiceprints_after_session, wav_roundtrip, chat_turns, coalesced_deltas)
