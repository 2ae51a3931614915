"""Operators over chat messages (session_id, pos, id, role, status, content, parent_message_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import is_blank

HISTORY_MESSAGES = 16
HISTORY_CHARS = 8000


def counts_as_history(role: Column, status: Column, content: Column) -> Column:
    return (status == "completed") & ~is_blank(content) & role.isin("user", "assistant")


def first_replies(chat: DataFrame) -> DataFrame:
    """Each user message with the first assistant message, by position, that names it as parent; nulls without one."""
    replies = chat.where("role = 'assistant'").select("session_id", F.col("parent_message_id").alias("id"), F.struct("pos", "id", "status", "content").alias("reply"))
    first = replies.groupBy("session_id", "id").agg(F.min_by("reply", F.col("reply.pos")).alias("reply"))
    users = chat.where("role = 'user'")
    return users.join(first, ["session_id", "id"], "left").select(
        "session_id", "id", "pos", "status", "content", F.col("reply.id").alias("reply_id"), F.col("reply.status").alias("reply_status"), F.col("reply.content").alias("reply_content")
    )


def history(chat: DataFrame, boundary_pos: str | None = None) -> DataFrame:
    """Alternating question and answer rows before a boundary: questions that count, each followed by its reply if that counts."""
    pairs = first_replies(chat if boundary_pos is None else chat.where(F.col("role") != "user").unionByName(chat.where((F.col("role") == "user") & (F.col("pos") < F.col(boundary_pos)))))
    asked = pairs.where(counts_as_history(F.lit("user"), F.col("status"), F.col("content")))
    answered = counts_as_history(F.lit("assistant"), F.col("reply_status"), F.col("reply_content"))
    user = F.struct(F.lit(0).alias("part"), F.lit("user").alias("role"), F.col("content").alias("content"))
    reply = F.struct(F.lit(1).alias("part"), F.lit("assistant").alias("role"), F.col("reply_content").alias("content"))
    rows = asked.select("session_id", "pos", F.explode(F.when(answered, F.array(user, reply)).otherwise(F.array(user))).alias("m"))
    return rows.select("session_id", "pos", "m.part", "m.role", "m.content")


def within_budget(messages: DataFrame, most_messages: int = HISTORY_MESSAGES, most_chars: int = HISTORY_CHARS) -> DataFrame:
    """The longest run of newest messages within both limits (the newest always stays), from its first user message on,
    neighbours of one role merged. Messages are ordered by (pos, part)."""
    key = Window.partitionBy("session_id")
    newest = key.orderBy(F.desc("pos"), F.desc("part"))
    rows = messages.withColumns({"back": F.row_number().over(newest), "chars": F.sum(F.length("content")).over(newest)})
    over = (F.col("back") > most_messages) | ((F.col("chars") > most_chars) & (F.col("back") > 1))
    kept = rows.withColumn("over", F.max(over.cast("int")).over(newest)).where("over = 0")
    oldest = key.orderBy("pos", "part")
    opened = F.max((F.col("role") == "user").cast("int")).over(oldest)
    kept = kept.withColumn("opened", opened).where("opened = 1")
    edge = (~F.col("role").eqNullSafe(F.lag("role").over(oldest))).cast("int")
    kept = kept.withColumn("edge", edge).withColumn("run", F.sum("edge").over(oldest))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "part", "content"))), lambda m: m["content"])
    return kept.groupBy("session_id", "run", "role").agg(F.array_join(texts, "\n\n").alias("content"))


def recent(chat: DataFrame, n: int = 12) -> DataFrame:
    """The last n messages of each session."""
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("pos")))
    return chat.withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")


def carried_over(current: DataFrame, earlier: DataFrame) -> DataFrame:
    """Current messages and the earlier ones whose id isn't among them."""
    return current.unionByName(earlier.join(current, ["session_id", "id"], "left_anti").select(*current.columns))


def append_outcome(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """What appending would do: inserted, identical or conflicting by id and payload; missing without a session."""
    payload = F.struct("role", "content", "status", "parent_message_id")
    held = existing.select("session_id", "id", payload.alias("held"))
    known = existing.select("session_id").distinct().withColumn("known", F.lit(True))
    rows = incoming.withColumn("payload", payload).join(held, ["session_id", "id"], "left").join(known, "session_id", "left")
    verdict = F.when(F.col("known").isNull(), "missing").when(F.col("held").isNull(), "inserted").when(F.col("held") == F.col("payload"), "identical").otherwise("conflicting")
    return rows.select("session_id", "id", verdict.alias("verdict"))


def is_visible(role: Column, status: Column, content: Column, is_notes_reply: Column, has_notes: Column) -> Column:
    """Thread filter: all but blank assistant messages that neither failed nor stand for existing notes."""
    return (role != "assistant") | (status == "errored") | (is_notes_reply & has_notes) | ~is_blank(content)
