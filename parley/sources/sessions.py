"""Sessions as nested rows: stored JSON documents, and a demonstration set built from the driver's conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley import schemas as S
from parley.functions.encoding import session_json
from parley.functions.text import is_session_id
from parley.sources.driver_tables import dense_segments
from parley.sources.folders import write_files

SUFFIX = ".json"


def known_or_null(value: Column, allowed: tuple[str, ...]) -> Column:
    """Unknown values of a lenient enumeration read as null."""
    return F.when(value.isin(*allowed), value)


def session_files(spark: SparkSession, folder: str) -> DataFrame:
    """session_id, len, modified_ms of the session files of a folder; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder)
    name = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    return files.select(name.alias("session_id"), F.col("length").alias("len"), F.unix_millis("modificationTime").alias("modified_ms")).where(is_session_id(F.col("session_id")))


def read_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Session documents, one JSON file each. Missing fields get defaults; unreadable files are skipped."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", f"*{SUFFIX}").text(folder)
    parsed = files.select(F.from_json("value", S.SESSION).alias("s")).where("s.session_id is not null").select("s.*")
    return with_defaults(parsed)


def session_file(spark: SparkSession, folder: str, session_id: str) -> DataFrame:
    """The file of one session, or no row; only that file is listed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{session_id}{SUFFIX}").load(folder)
    return files.select(F.lit(session_id).alias("session_id"), F.col("length").alias("len"), F.unix_millis("modificationTime").alias("modified_ms"))


def write_sessions(sessions: DataFrame, folder: str) -> None:
    """One JSON document for each session, named by its id; ids that could leave the folder are refused."""
    known = sessions.where(is_session_id(F.col("session_id")))
    write_files(known.select(F.col("session_id").alias("name"), session_json(known).cast("binary").alias("content")), folder, SUFFIX)


def with_defaults(sessions: DataFrame) -> DataFrame:
    lists = {"segments": S.SEGMENT, "insights": S.INSIGHT, "blocks": S.BLOCK, "chat": S.CHAT, "attendees": "string"}
    filled = {name: F.coalesce(F.col(name), F.array().cast(f"array<{kind}>")) for name, kind in lists.items()}

    def lenient(insight: Column) -> Column:
        rating = insight["feedback"]
        kept = F.when(rating["verdict"].isin(*S.VERDICTS) & rating["surface"].isin(*S.SURFACES), rating)
        return (
            insight.withField("producer", known_or_null(insight["producer"], S.PRODUCERS))
            .withField("feedback", kept)
            .withField("feedback_withdraw_pending", F.coalesce(insight["feedback_withdraw_pending"], F.lit(False)))
        )

    out = sessions.withColumns(filled | {"title_is_auto": F.coalesce("title_is_auto", F.lit(False)), "relay_session_id": F.coalesce("relay_session_id", "session_id")})
    return out.withColumn("insights", F.transform("insights", lenient))


def demo_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session for each conversation: an insight on every third segment, a block for every two, some titles and outcomes."""
    place = F.col("seg_index")
    rows = F.array_sort(F.collect_list(F.struct("seg_index", "source", "utterance")))
    base = dense_segments(spark, sf_dir).groupBy("session_id").agg(rows.alias("rows"), F.max(place).alias("last"))
    number = F.col("session_id")

    def insight(r: Column) -> Column:
        i = r["seg_index"]
        return F.struct(
            (i * 15_000).alias("offset_ms"),
            F.lit("green").alias("severity"),
            F.concat(F.lit("note "), i).alias("message"),
            F.when(i % 4 != 3, i).alias("segment_index"),
            F.when(i % 2 == 0, F.concat_ws("-", F.lit("n"), i)).alias("id"),
            F.when(i % 2 == 0, "signals").alias("producer"),
            F.when(i % 6 == 0, F.struct(F.lit("helpful").alias("verdict"), F.lit("2026-01-01T00:00:00Z").alias("rated_at"), F.lit("library").alias("surface"), (i == 0).alias("publish_pending"))).cast(S.FEEDBACK).alias("feedback"),
            F.lit(False).alias("feedback_withdraw_pending"),
        )

    def label(value: str, provenance: Column, pending: Column) -> Column:
        return F.struct(F.lit(value).alias("value"), F.lit("2026-01-01T00:00:00Z").alias("decided_at"), provenance.alias("provenance"), F.lit(None).cast("string").alias("source"), pending.alias("publish_pending")).cast(S.LABEL)

    felt = F.when(number % 3 == 0, label("good", F.when(number % 2 == 0, "user").otherwise("crm"), number % 4 == 0))
    converted = F.when(number % 5 == 0, label("won", F.lit("assistant"), F.lit(True)))
    blocks = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("last") + 1) / 2).cast("long")), lambda k: F.struct((k * 2).alias("start_index"), (k * 2 + 2).alias("end_index"), F.concat(F.lit("block "), k).alias("summary"), k.alias("created_at_ms")))
    text = F.lit(None).cast("string")
    return base.select(
        F.format_string("s%06d", "session_id").alias("session_id"),
        F.format_string("s%06d", "session_id").alias("relay_session_id"),
        F.when(number % 2 == 0, F.concat(F.lit("b"), F.floor(number / 4))).alias("backend_session_id"),
        F.format_string("2026-01-01T%02d:%02d:00Z", F.floor(number / 60) % 24, number % 60).alias("started_at"),
        F.format_string("2026-01-02T%02d:%02d:00Z", F.floor(number / 60) % 24, (number * 7) % 60).alias("ended_at"),
        F.when(number % 3 != 0, F.concat(F.lit("Call "), number)).alias("title"),
        (number % 2 == 1).alias("title_is_auto"),
        F.transform("rows", lambda r: F.struct(r["source"].alias("source"), r["utterance"].alias("utterance"), text.alias("speaker_id"), text.alias("speaker_label"))).cast(f"array<{S.SEGMENT}>").alias("segments"),
        F.transform(F.filter("rows", lambda r: r["seg_index"] % 3 == 0), insight).cast(f"array<{S.INSIGHT}>").alias("insights"),
        F.filter(blocks, lambda b: b["end_index"] <= F.col("last") + 1).cast(f"array<{S.BLOCK}>").alias("blocks"),
        F.when(number % 4 == 0, F.concat(F.lit("# Notes "), number)).alias("notes_markdown"),
        F.when(number % 4 == 0, "completed").alias("notes_status"),
        text.alias("notes_error"),
        text.alias("notes_root_message_id"),
        text.alias("notes_pending_root_message_id"),
        F.array().cast(f"array<{S.CHAT}>").alias("chat"),
        F.array(F.concat(F.lit("p"), number % 3), F.concat(F.lit("p"), number % 5)).alias("attendees"),
        text.alias("calendar_event_id"),
        F.when(number % 6 == 0, F.lit(" plan ")).when(number % 6 == 1, "plan").alias("playbook"),
        F.when(felt.isNotNull() | converted.isNotNull(), F.struct(felt.alias("felt"), converted.alias("converted"))).cast(S.OUTCOME).alias("outcome"),
    )
