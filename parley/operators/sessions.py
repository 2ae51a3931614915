"""Operators over sessions as nested rows: library, index refresh, split, merge and edits.

A session has session_id, started_at and ended_at (RFC 3339 strings, ordered as strings), title, title_is_auto,
segments, insights, blocks and chat (arrays in order), notes, attendees, playbook and outcome; see ``schemas``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.functions import times
from parley.operators.live import editable


def summarised(sessions: DataFrame) -> DataFrame:
    """The library's row of each session, with a flag for feedback that waits to be published."""
    waiting = F.exists("insights", unpublished)
    return sessions.select(
        "session_id", "title", "ended_at", F.col("notes_markdown").isNotNull().alias("has_notes"), "notes_status", "outcome",
        (F.col("backend_session_id").isNotNull() & waiting).alias("feedback_waiting"),
    )


def unpublished(insight: Column) -> Column:
    """An insight with an id whose rating, or whose withdrawal, waits to be published."""
    return insight["id"].isNotNull() & F.when(insight["feedback"].isNotNull(), insight["feedback"]["publish_pending"]).otherwise(insight["feedback_withdraw_pending"])


def status_label(has_notes: Column, status: Column) -> Column:
    return F.when(has_notes, "ready").when(status == "pending", "summarizing").when(status == "errored", "failed").when(status == "cancelled", "none").otherwise("transcript only")


def library_order(sessions: DataFrame) -> DataFrame:
    """Newest end first, by the string; ties by id."""
    return sessions.orderBy(F.desc("ended_at"), "session_id")


def index_plan(stats: DataFrame, index: DataFrame) -> DataFrame:
    """For files (session_id, len, modified_ms) and index entries alike: reuse, refresh, add or drop."""
    held = index.select("session_id", F.col("len").alias("held_len"), F.col("modified_ms").alias("held_ms"))
    both = stats.join(held, "session_id", "full")
    action = (
        F.when(F.col("len").isNull(), "drop")
        .when(F.col("held_len").isNull(), "add")
        .when((F.col("len") == F.col("held_len")) & (F.col("modified_ms") == F.col("held_ms")), "reuse")
        .otherwise("refresh")
    )
    return both.select("session_id", action.alias("action"))


def refreshed_index(stats: DataFrame, index: DataFrame, summaries: DataFrame) -> DataFrame:
    """The new index: entries to reuse as they are, and summaries (session_id, summary) of the files to add or refresh.
    Only those files need to be summarised: join the plan first when reading them."""
    plan = index_plan(stats, index)
    kept = index.join(plan.where("action = 'reuse'"), "session_id", "left_semi")
    new = plan.where("action in ('add', 'refresh')").join(stats, "session_id").join(summaries, "session_id")
    return kept.unionByName(new.select(*[F.col(c) for c in kept.columns]))


def _rebased(item: Column, by: Column, *fields: str) -> Column:
    out = item
    for name in fields:
        out = out.withField(name, item[name] + by)
    return out


def split_insights(insights: Column, at: Column) -> tuple[Column, Column]:
    """Before and from a segment index; those without an anchor are in neither."""
    first = F.filter(insights, lambda i: i["segment_index"] < at)
    second = F.transform(F.filter(insights, lambda i: i["segment_index"] >= at), lambda i: _rebased(i, -at, "segment_index"))
    return first, second


def split_blocks(blocks: Column, at: Column) -> tuple[Column, Column]:
    """Whole blocks before and after a segment index; those across it are in neither."""
    first = F.filter(blocks, lambda b: b["end_index"] <= at)
    second = F.transform(F.filter(blocks, lambda b: (b["start_index"] >= at) & (b["end_index"] > at)), lambda b: _rebased(b, -at, "start_index", "end_index"))
    return first, second


def split(sessions: DataFrame, at: Column, live: DataFrame | None = None) -> DataFrame:
    """Two sessions for each that can be cut at a segment index inside it, is not among the ``live`` ones and has no notes
    under way. The first keeps chat, outcome and notes root; notes are cleared in both, and automatic titles dropped."""
    cut = editable(sessions, live).withColumn("_at", at.cast("long")).where((F.col("_at") > 0) & (F.col("_at") < F.size("segments")))
    place = F.col("_at").cast("int")
    insights, blocks = split_insights(F.col("insights"), F.col("_at")), split_blocks(F.col("blocks"), F.col("_at"))
    empty_chat = F.filter("chat", lambda _: F.lit(False))

    def part(number: int) -> Column:
        changed = {
            "session_id": F.concat_ws("-", "session_id", F.lit("ab"[number])),
            "backend_session_id": F.lit(None).cast("string"),
            "title": F.when(~F.col("title_is_auto"), F.col("title")),
            "title_is_auto": F.lit(False),
            "segments": F.slice("segments", 1, place) if number == 0 else F.slice("segments", place + 1, F.size("segments")),
            "insights": insights[number],
            "blocks": blocks[number],
            "notes_markdown": F.lit(None).cast("string"),
            "notes_status": F.lit(None).cast("string"),
            "notes_error": F.lit(None).cast("string"),
            "notes_pending_root_message_id": F.lit(None).cast("string"),
        }
        if number:
            outcome = sessions.schema["outcome"].dataType
            changed |= {"chat": empty_chat, "outcome": F.lit(None).cast(outcome), "notes_root_message_id": F.lit(None).cast("string")}
        return F.struct(*[changed.get(c, F.col(c)).alias(c) for c in sessions.columns])

    return cut.select(F.explode(F.array(part(0), part(1))).alias("part")).select("part.*")


def after_edit(sessions: DataFrame, made: DataFrame) -> DataFrame:
    """The library after a split or merge: what was made takes the place of its inputs."""
    ids = made.select(F.explode(F.split(F.regexp_replace("session_id", "-[ab]$", ""), r"\+")).alias("session_id")).distinct()
    return sessions.join(ids, "session_id", "left_anti").unionByName(made)


def picked_label(first: Column, second: Column) -> Column:
    """The first label, unless only the second is a person's."""
    human = (second["provenance"] == "user") & (first["provenance"] != "user")
    return F.when(first.isNull(), second).when(human, second).otherwise(first)


def merge(pairs: DataFrame) -> DataFrame:
    """One session from each pair (first and second as structs of sessions) without notes under way; the one that started
    first leads. Pairs of live sessions are to be left out before (``live.editable``)."""
    for side in ("first", "second"):
        pairs = pairs.where(~F.col(f"{side}.notes_status").eqNullSafe(F.lit("pending")) & F.col(f"{side}.notes_pending_root_message_id").isNull())
    swap = F.col("first.started_at") > F.col("second.started_at")
    led = pairs.select(F.when(swap, F.col("second")).otherwise(F.col("first")).alias("a"), F.when(swap, F.col("first")).otherwise(F.col("second")).alias("b"))
    a, b = F.col("a"), F.col("b")
    count = F.size(a["segments"]).cast("long")
    later = times.delta_ms(a["started_at"], b["started_at"])
    trimmed = T.trim_ws(a["playbook"]) == T.trim_ws(b["playbook"])
    playbook = F.when(a["playbook"].isNull(), b["playbook"]).when(b["playbook"].isNull() | trimmed, a["playbook"])
    outcome = F.struct(picked_label(a["outcome"]["felt"], b["outcome"]["felt"]).alias("felt"), picked_label(a["outcome"]["converted"], b["outcome"]["converted"]).alias("converted"))
    changed = {
        "session_id": F.concat_ws("+", a["session_id"], b["session_id"]),
        "backend_session_id": F.when(a["backend_session_id"] == b["backend_session_id"], a["backend_session_id"]),
        "started_at": F.least(a["started_at"], b["started_at"]),
        "ended_at": F.greatest(a["ended_at"], b["ended_at"]),
        "title_is_auto": F.when(a["title"].isNotNull(), a["title_is_auto"]).otherwise(b["title_is_auto"]),
        "segments": F.concat(a["segments"], b["segments"]),
        "insights": F.concat(a["insights"], F.transform(b["insights"], lambda i: _rebased(i, count, "segment_index").withField("offset_ms", i["offset_ms"] + later))),
        "blocks": F.concat(a["blocks"], F.transform(b["blocks"], lambda x: _rebased(x, count, "start_index", "end_index"))),
        "chat": F.concat(a["chat"], b["chat"]),
        "notes_markdown": F.when(a["notes_markdown"].isNotNull() & b["notes_markdown"].isNotNull(), F.concat(a["notes_markdown"], F.lit("\n\n---\n\n"), b["notes_markdown"])).otherwise(F.coalesce(a["notes_markdown"], b["notes_markdown"])),
        "notes_pending_root_message_id": F.lit(None).cast("string"),
        "attendees": F.concat(a["attendees"], F.array_except(b["attendees"], a["attendees"])),
        "playbook": playbook,
        "outcome": F.when(a["outcome"].isNotNull() | b["outcome"].isNotNull(), outcome),
    }
    names = pairs.schema["first"].dataType.names
    return led.select(*[changed[c].alias(c) if c in changed else F.coalesce(a[c], b[c]).alias(c) for c in names])


def with_title(sessions: DataFrame, title: Column) -> DataFrame:
    """A title set by hand: trimmed, none if empty, no longer automatic."""
    own = T.trim_ws(title)
    return sessions.withColumns({"title": F.when(F.length(own) > 0, own), "title_is_auto": F.lit(False)})


def with_auto_title(sessions: DataFrame) -> DataFrame:
    """An automatic title for sessions that have notes and no title."""
    due = F.col("title").isNull() & F.col("notes_markdown").isNotNull()
    found = T.session_title(F.col("notes_markdown"), F.col("attendees"), F.col("ended_at"))
    return sessions.withColumns({"title": F.when(due, found).otherwise(F.col("title")), "title_is_auto": F.when(due, True).otherwise(F.col("title_is_auto"))})


def with_segments(sessions: DataFrame, segments: Column) -> DataFrame:
    """Other segments: what described the old ones goes, and so does an automatic title."""
    none = {c: F.filter(c, lambda _: F.lit(False)) for c in ("insights", "blocks")}
    gone = {c: F.lit(None).cast("string") for c in ("notes_markdown", "notes_status", "notes_error", "notes_root_message_id", "notes_pending_root_message_id")}
    return sessions.withColumns({"segments": segments, **none, **gone, "title": F.when(~F.col("title_is_auto"), F.col("title")), "title_is_auto": F.lit(False)})


def blocks_still_hold(blocks: Column, before: Column, after: Column) -> Column:
    """Whether the segments that blocks cover are the same in source and utterance."""
    covered = F.coalesce(F.array_max(F.transform(blocks, lambda b: b["end_index"])), F.lit(0)).cast("int")

    def head(segments: Column) -> Column:
        return F.slice(F.transform(segments, lambda s: F.struct(s["source"], s["utterance"])), F.lit(1), F.greatest(covered, F.lit(1)))

    fits = (covered <= F.size(before)) & (covered <= F.size(after))
    return (covered == 0) | (fits & (head(before) == head(after)))


def renamed_speaker(sessions: DataFrame, names: DataFrame) -> DataFrame:
    """New labels (speaker_id, label) on every segment of those speakers, in all sessions. ``names`` may be large: sessions are
    joined with the map of names of their own speakers only. A speaker named twice has the label that is first in order."""
    names = names.groupBy("speaker_id").agg(F.min("label").alias("label"))
    spoken = sessions.select("session_id", F.explode(F.array_distinct(F.transform("segments", lambda s: s["speaker_id"]))).alias("speaker_id"))
    own = spoken.join(names, "speaker_id").groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("speaker_id", "label"))).alias("_names"))
    relabelled = F.transform("segments", lambda s: s.withField("speaker_label", F.coalesce(F.try_element_at(F.col("_names"), s["speaker_id"]), s["speaker_label"])))
    return sessions.join(own, "session_id", "left").withColumn("segments", F.when(F.col("_names").isNull(), F.col("segments")).otherwise(relabelled)).drop("_names")
