"""Insights, their feedback, and outcome labels: upserts, precedence and publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley import schemas as S
from parley.functions import text as T
from parley.functions import times


def _same(existing: Column, incoming: Column) -> Column:
    """By id when both have one, else by offset and message."""
    both = existing["id"].isNotNull() & incoming["id"].isNotNull()
    return F.when(both, existing["id"] == incoming["id"]).otherwise((existing["offset_ms"] == incoming["offset_ms"]) & (existing["message"] == incoming["message"]))


def _adopted(existing: Column, incoming: Column) -> Column:
    changed = existing.withField("id", F.coalesce(existing["id"], incoming["id"])).withField("producer", F.coalesce(existing["producer"], incoming["producer"]))
    changed = changed.withField("feedback", incoming["feedback"]).withField("feedback_withdraw_pending", incoming["feedback_withdraw_pending"])
    return F.when(incoming["id"].isNull(), existing).otherwise(changed)


def upserted(existing: Column, incoming: Column) -> Column:
    """Incoming insights, one after the other, into an array: the first that is the same adopts id, producer and feedback; others are appended."""

    def add(notes: Column, note: Column) -> Column:
        at = F.array_position(F.transform(notes, lambda n: _same(n, note)), F.lit(True))
        changed = F.transform(notes, lambda n, i: F.when(i == at.cast("int") - 1, _adopted(n, note)).otherwise(n))
        return F.when(at > 0, changed).otherwise(F.concat(notes, F.array(note)))

    return F.aggregate(incoming, existing, add)


def without_repeats(notes: Column) -> Column:
    """In order, less those that repeat the last kept message or whose id is taken."""
    kept = F.filter(notes, lambda _: F.lit(False))

    def add(done: Column, note: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        taken = note["id"].isNotNull() & F.exists(done, lambda d: d["id"].eqNullSafe(note["id"]))
        return F.when(last["message"].eqNullSafe(note["message"]) | taken, done).otherwise(F.concat(done, F.array(note)))

    return F.aggregate(notes, kept, add)


def suggestions(sessions: DataFrame) -> DataFrame:
    """session_id and a Markdown list of its insights with offset and quoted segment; null when there is nothing to list."""
    quoted = F.col("segments")

    def item(note: Column) -> Column:
        segment = F.try_element_at(quoted, (note["segment_index"] + 1).cast("int"))
        quote = F.concat(F.lit("  > "), T.speaker_name(segment["speaker_label"], segment["source"]), F.lit(': "'), T.excerpt(segment["utterance"]), F.lit('"\n'))
        head = F.concat(F.lit("\n- **"), times.offset_text(note["offset_ms"]), F.lit("** "), T.trim_ws(note["message"]), F.lit("\n"))
        return F.concat(head, F.coalesce(quote, F.lit("")))

    told = F.filter("insights", lambda n: ~T.is_blank(n["message"]))
    text = F.concat(F.lit("## Suggestions\n"), F.array_join(F.transform(told, item), ""))
    return sessions.select("session_id", F.when(F.size(told) > 0, text).alias("markdown"))


def rated(note: Column, verdict: Column, rated_at: Column, surface: Column, backend_known: Column) -> Column:
    """An insight after a rating (null verdict: withdrawn). Only ratings of relayed signals on a known backend are to be published."""
    publish = backend_known & (note["producer"] == "signals").eqNullSafe(F.lit(True))
    rating = F.struct(verdict.alias("verdict"), rated_at.alias("rated_at"), surface.alias("surface"), publish.alias("publish_pending")).cast(S.FEEDBACK)
    withdrawn = publish & note["feedback"].isNotNull()
    return note.withField("feedback", F.when(verdict.isNotNull(), rating)).withField("feedback_withdraw_pending", F.when(verdict.isNull(), withdrawn | note["feedback_withdraw_pending"]).otherwise(F.lit(False)))


def settled(note: Column, published: Column) -> Column:
    """An insight after its rating (or, with null, its withdrawal) was published; a rating changed since stays pending."""
    same = note["feedback"]["verdict"].eqNullSafe(published["verdict"]) & note["feedback"]["rated_at"].eqNullSafe(published["rated_at"])
    cleared = F.when(published.isNotNull() & same, note["feedback"].withField("publish_pending", F.lit(False))).otherwise(note["feedback"])
    return note.withField("feedback", cleared).withField("feedback_withdraw_pending", note["feedback_withdraw_pending"] & published.isNotNull())


def feedback_union(live: DataFrame, finished: DataFrame) -> DataFrame:
    """Ratings (session_id, insight_id, verdict) of live and finished sessions; live ones win."""
    rows = live.withColumn("rank", F.lit(0)).unionByName(finished.withColumn("rank", F.lit(1)))
    first = F.row_number().over(Window.partitionBy("session_id", "insight_id").orderBy("rank", "verdict"))
    return rows.withColumn("n", first).where("n = 1").drop("n", "rank")


def unpublished_outcomes(sessions: DataFrame) -> DataFrame:
    """One row for each outcome label that waits to be published, of sessions that a backend knows."""
    labels = F.array(F.struct(F.lit("felt").alias("kind"), F.col("outcome.felt").alias("label")), F.struct(F.lit("converted").alias("kind"), F.col("outcome.converted").alias("label")))
    rows = sessions.where("backend_session_id is not null and outcome is not null").select("session_id", "backend_session_id", F.explode(labels).alias("l"))
    return rows.where("l.label.publish_pending").select("session_id", "backend_session_id", "l.kind", "l.label.value", "l.label.provenance")


def label_write(existing: Column, incoming: Column) -> Column:
    """What offering a label does: not_offered, refused, unchanged or recorded. A person's label gives way to a person's only."""
    human = (existing["provenance"] == "user") & (incoming["provenance"] != "user")
    same = (existing["value"] == incoming["value"]) & (existing["provenance"] == incoming["provenance"]) & existing["source"].eqNullSafe(incoming["source"])
    return F.when(incoming.isNull(), "not_offered").when(existing.isNull(), "recorded").when(human, "refused").when(same, "unchanged").otherwise("recorded")


def label_after(existing: Column, incoming: Column) -> Column:
    return F.when(label_write(existing, incoming) == "recorded", incoming).otherwise(existing)


def label_published(label: Column, value: Column, provenance: Column, source: Column) -> Column:
    """No longer pending if it still is the label that was published."""
    same = (label["value"] == value) & (label["provenance"] == provenance) & label["source"].eqNullSafe(source)
    return F.when(same, label.withField("publish_pending", F.lit(False))).otherwise(label)


def accepted_block(blocks: Column, block: Column) -> Column:
    """Blocks after appending one, unless it is empty, reversed, or ends no later than what is covered."""
    covered = F.coalesce(F.array_max(F.transform(blocks, lambda b: b["end_index"])), F.lit(0).cast("long"))
    fits = (block["end_index"] > block["start_index"]) & (block["end_index"] > covered) & ~T.is_blank(block["summary"])
    return F.when(fits, F.concat(blocks, F.array(block))).otherwise(blocks)
