"""Sessions while they are live, and what happens to their notes and chat afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators.insights import upserted

BLOCK_SUMMARY_CHARS = 1200
SETTLING = ("completed", "errored", "cancelled", "silent", "message")


def live_sessions(events: DataFrame) -> DataFrame:
    """Live sessions after their events (session_id, seq, at_ms, action, value, source, start_index, end_index), without a fold.

    ``begin`` opens a session; a second one changes nothing, and what comes before it is lost. ``backend``, ``playbook``
    and ``participants`` set a value, the last one counts. ``segment`` appends a trimmed text that isn't blank. ``block``
    appends a summary that isn't blank, unless it is empty, reversed, or ends no later than an earlier one."""
    whole = Window.partitionBy("session_id")
    before = whole.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    action, own = F.col("action"), T.trim_ws(F.col("value"))
    rows = events.withColumn("begun", F.min(F.when(action == "begin", F.col("seq"))).over(whole)).where("seq >= begun and (action != 'begin' or seq = begun)")
    usable = (action == "block") & (F.length(own) > 0) & (F.col("end_index") > F.col("start_index"))
    reached = F.max(F.when(usable, F.col("end_index"))).over(before)  # refused blocks end no later than accepted ones
    rows = rows.withColumns({"own": own, "block": usable & (F.col("end_index") > F.coalesce(reached, F.lit(-1)))})
    said = (action == "segment") & (F.length("own") > 0)
    touched = (action == "begin") | said | F.col("block")

    def last(name: str) -> Column:
        return F.max_by("value", F.when(action == name, F.col("seq")))

    segments = F.array_sort(F.collect_list(F.when(said, F.struct("seq", "source", F.col("own").alias("utterance")))))
    block = F.struct("seq", "start_index", "end_index", T.clamp(F.col("own"), BLOCK_SUMMARY_CHARS).alias("summary"), F.col("at_ms").alias("created_at_ms"))
    blocks = F.array_sort(F.collect_list(F.when(F.col("block"), block)))
    return rows.groupBy("session_id").agg(
        F.min(F.when(action == "begin", F.col("at_ms"))).alias("started_at_ms"), F.max_by("at_ms", F.when(touched, F.col("seq"))).alias("updated_at_ms"),
        last("backend").alias("backend_session_id"), last("playbook").alias("playbook"), last("participants").alias("participants"),
        segments.alias("segments"), blocks.alias("blocks"),
    )


def notes_of_root() -> Column:
    """The notes as the first completed reply to their root message has them; as they are without one; none where there are none."""
    reply = F.filter("chat", lambda m: (m["role"] == "assistant") & (m["status"] == "completed") & (m["parent_message_id"] == F.col("notes_root_message_id")))
    return F.when(F.col("notes_markdown").isNotNull(), F.coalesce(F.try_element_at(reply, F.lit(1))["content"], "notes_markdown"))


def without_replies_to(chat: Column, root: Column) -> Column:
    """A chat less the replies to a message; all of it for a null message."""
    return F.when(root.isNull(), chat).otherwise(F.filter(chat, lambda m: ~m["parent_message_id"].eqNullSafe(root)))


def with_status(chat: Column, message_id: Column, status: Column) -> Column:
    """A chat with another status for one message, if it has it."""
    return F.transform(chat, lambda m: m.withField("status", F.when(m["id"] == message_id, status).otherwise(m["status"])))


def settles_notes(status: Column, parent: Column, root: Column, pending_root: Column) -> Column:
    """Whether an event ends the turn that writes the notes: a settling status, in answer to their root or pending root."""
    return F.coalesce(status.isin(*SETTLING) & parent.isNotNull() & (parent.eqNullSafe(root) | parent.eqNullSafe(pending_root)), F.lit(False))


def editable(sessions: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Sessions that may be split or merged: not live, and with no notes under way."""
    settled = sessions.where((~F.col("notes_status").eqNullSafe(F.lit("pending"))) & F.col("notes_pending_root_message_id").isNull())
    return settled if live is None else settled.join(live.select("session_id"), "session_id", "left_anti")


def merged_live(sessions: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions with the insights of their live records, notes refreshed where there were any; and the live records that are left."""
    joined = sessions.join(live.select("session_id", F.col("insights").alias("_live")), "session_id", "left")
    told = F.coalesce(F.size("_live") > 0, F.lit(False))
    insights, notes = F.when(told, upserted(F.col("insights"), F.col("_live"))), F.when(told, notes_of_root())
    out = joined.withColumns({"insights": F.coalesce(insights, "insights"), "notes_markdown": F.when(told, notes).otherwise(F.col("notes_markdown"))})
    return out.select(*sessions.columns), live.join(sessions.select("session_id"), "session_id", "left_anti")
