"""Batch forms of the stateful stream operators; the ``streaming`` package has their continuous forms."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley import schemas as S
from parley.functions import text as T

CHUNK_MS = 32


@dataclass(frozen=True)
class Vad:
    """Limits of the speech segmenter, in milliseconds; chunks are of 32 ms and counts are cut off."""

    threshold: float = 0.5
    silence_ms: int = 600
    late_silence_ms: int = 400
    late_after_ms: int = 10_000
    longest_ms: int = 30_000
    shortest_ms: int = 100

    def chunks(self, ms: int) -> int:
        return max(ms // CHUNK_MS, 1)


class Stretch(NamedTuple):
    """Where a stretch of speech stands, in places of chunks: its first one (-1: none is open), the last one with speech (or
    where it was cut), and how many had speech."""

    first: Any
    spoken: Any
    heard: Any


#: What a chunk does to a stretch; an end that had too little speech isn't told.
NOTHING, BEGINS, ENDS, CUT, FADES = range(5)
TOLD = {BEGINS: "start", ENDS: "end", CUT: "force"}


def after_chunk(vad: Vad, now: Stretch, at: Any, speech: Any, pick: Callable[[Any, Any, Any], Any]) -> tuple[Any, Stretch]:
    """What the chunk at a place does, and the stretch after it. The rules, for columns and for plain values alike (``pick``
    chooses by a condition): speech opens a stretch; one as long as allowed is cut, and goes on from the next chunk; one
    whose chunks since the last speech reach the allowed silence, which is shorter for a long stretch, ends."""
    length = at - now.first + 1
    silence = pick(length >= vad.chunks(vad.late_after_ms), min(vad.chunks(vad.late_silence_ms), vad.chunks(vad.silence_ms)), vad.chunks(vad.silence_ms))
    closing = pick(now.heard >= vad.chunks(vad.shortest_ms), ENDS, FADES)
    quiet = pick(at - now.spoken >= silence, closing, NOTHING)
    inside = pick(length >= vad.chunks(vad.longest_ms), CUT, pick(speech, NOTHING, quiet))
    does = pick(now.first < 0, pick(speech, BEGINS, NOTHING), inside)
    first = pick(does == BEGINS, at, pick(does == CUT, at + 1, pick(does == NOTHING, now.first, -1)))
    spoken = pick(does == CUT, at, pick(speech, at, now.spoken))
    heard = pick(does == CUT, 0, pick(does == BEGINS, 1, pick(speech, now.heard + 1, now.heard)))
    return does, Stretch(first, spoken, heard)


def settled(rows: DataFrame, max_wait_ms: int, expected: tuple[int, ...] = (0, 1)) -> DataFrame:
    """Rows (session_id, kind utterance or progress, source, captured_ms, now_ms, arrival) with how far the expected sources are
    settled when the row arrives (by their progress alone, 0 before any; without expected sources everything is), the bound
    up to which utterances are released then, and whether the row's own is held or released late."""
    so_far = Window.partitionBy("session_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = F.lit(0).cast("long")
    reached = [F.coalesce(F.max(F.when((F.col("kind") == "progress") & (F.col("source") == s), F.col("captured_ms"))).over(so_far), zero) for s in expected]
    all_of_it = F.lit((1 << 63) - 1)
    out = rows.withColumn("settled_ms", F.least(*reached, all_of_it) if len(reached) else all_of_it)
    out = out.withColumn("bound_ms", F.greatest("settled_ms", F.greatest(F.col("now_ms") - max_wait_ms, zero)))
    own = (F.col("kind") == "utterance") & ~F.coalesce(T.is_blank(F.col("text")), F.lit(True)) if "text" in rows.columns else F.col("kind") == "utterance"
    return out.withColumns({"held": own & (F.col("captured_ms") > F.col("bound_ms")), "late": own & (F.col("captured_ms") <= F.col("bound_ms")) & (F.col("captured_ms") > F.col("settled_ms"))})


def released(rows: DataFrame, max_wait_ms: int, expected: tuple[int, ...] = (0, 1)) -> DataFrame:
    """For each utterance (with a ``text``, only those that aren't blank) the arrival that releases it: the first from its own on
    whose bound reaches it (null: it is still held), and whether that is late. A clock may step back, and bounds with it, so
    what is held goes through the arrivals of its session in order. Sessions stream through a task one after the other, in
    batches that don't end with a session; only what is held is kept. Without a time an utterance is never released."""
    marked = settled(rows.repartition("session_id"), max_wait_ms, expected)
    spoken = F.col("kind") == "utterance"
    if "text" in rows.columns:
        spoken &= ~F.coalesce(T.is_blank(F.col("text")), F.lit(True))
    kind = rows.schema["session_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []
        session, session_type = None, pa.null()

        def told(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = [session_type, pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["session_id", "arrival", "captured_ms", "released_by", "late"])

        for batch in batches:
            out: list[tuple] = []
            session_type = batch["session_id"].type
            for of, arrival, captured, bound, passed, own in zip(*(batch[name].to_pylist() for name in ("session_id", "arrival", "captured_ms", "bound_ms", "settled_ms", "own")), strict=True):
                if of != session:
                    out += [(session, first, at, None, None) for at, first in held]
                    session, held = of, []
                if own and captured is None:
                    out.append((of, arrival, None, None, None))
                elif own:
                    heapq.heappush(held, (captured, arrival))
                while held and held[0][0] <= bound:
                    at, first = heapq.heappop(held)
                    out.append((of, first, at, arrival, at > passed))
            yield told(out)
        if held:
            yield told([(session, first, at, None, None) for at, first in held])

    told = marked.select("session_id", "arrival", "captured_ms", "bound_ms", "settled_ms", spoken.alias("own")).sortWithinPartitions("session_id", "arrival")
    return told.mapInArrow(run, f"session_id {kind}, arrival long, captured_ms long, released_by long, late boolean")


def late_counts(released_rows: DataFrame) -> DataFrame:
    """Utterances of each session that were released, and how many of them late."""
    return released_rows.groupBy("session_id").agg(F.count("released_by").alias("n_released"), F.count_if(F.col("late")).alias("n_late"))


def with_late_counts(released_rows: DataFrame) -> DataFrame:
    """The utterances with the counts of their session beside them; the release is worked out once."""
    session = Window.partitionBy("session_id")
    return released_rows.withColumns({"n_released": F.count("released_by").over(session), "n_late": F.count_if(F.col("late")).over(session)})


def release_order(rows: DataFrame) -> DataFrame:
    """Place of each row in event time within its session; arrival decides ties."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("captured_ms", "arrival"))
    return rows.withColumn("place", place)


def speech_events(frames: DataFrame, vad: Vad | None = None) -> DataFrame:
    """session_id, chunk_idx and event (start, end, force) of frames (session_id, chunk_idx, speech_prob), by a fold over each
    session. Its array grows by events, not by frames."""
    v = vad or Vad()
    none = F.array().cast("array<struct<chunk_idx:long,does:int>>")
    fields = Stretch._fields
    start = F.struct(*[F.lit(-1).cast("int").alias(name) for name in fields], F.lit(0).alias("at"), none.alias("events"))

    def pick(condition: Column, a: Column | int, b: Column | int) -> Column:
        return F.when(condition, a).otherwise(b)

    def step(state: Column, frame: Column) -> Column:
        does, after = after_chunk(v, Stretch(*[state[name] for name in fields]), state["at"], frame["speech_prob"] >= v.threshold, pick)
        event = F.array(F.struct(frame["chunk_idx"].cast("long").alias("chunk_idx"), does.cast("int").alias("does")))
        told = F.when(does.isin(*TOLD), F.concat(state["events"], event)).otherwise(state["events"])
        return F.struct(*[value.cast("int").alias(name) for name, value in zip(fields, after, strict=True)], (state["at"] + 1).alias("at"), told.alias("events"))

    frames_of = F.array_sort(F.collect_list(F.struct("chunk_idx", "speech_prob")))
    folded = frames.groupBy("session_id").agg(F.aggregate(frames_of, start, step)["events"].alias("events"))
    names = F.create_map(*[F.lit(x) for pair in TOLD.items() for x in pair])
    return folded.select("session_id", F.explode("events").alias("e")).select("session_id", "e.chunk_idx", names[F.col("e.does")].alias("event"))


def bursts(rows: DataFrame, gap_ms: int) -> DataFrame:
    """Events (session_id, at_ms) with gaps of less than ``gap_ms`` as one burst."""
    order = Window.partitionBy("session_id").orderBy("at_ms", "event_id")
    edge = F.coalesce((F.col("at_ms") - F.lag("at_ms").over(order) >= gap_ms).cast("int"), F.lit(1))
    numbered = rows.withColumn("edge", edge).withColumn("burst", F.sum("edge").over(order))
    return numbered.groupBy("session_id", "burst").agg(F.min("at_ms").alias("first_ms"), F.max("at_ms").alias("last_ms"), F.count(F.lit(1)).alias("n"))


def envelope(rows: DataFrame, size: int = 96, every: int = 32) -> DataFrame:
    """Mean and modulation (population deviation over mean) of the last ``size`` values (session_id, n from 1, value), at every ``every``-th."""
    last = Window.partitionBy("session_id").orderBy("n").rowsBetween(1 - size, 0)
    mean, spread = F.avg("value").over(last), F.stddev_pop("value").over(last)
    return rows.withColumns({"mean": mean, "modulation": spread / (mean + 1e-9)}).where((F.col("n") >= size) & (F.col("n") % every == 0))


def best_lag(rows: DataFrame, most: int = 32, least_pairs: int = 24) -> DataFrame:
    """Largest correlation of ``near`` with ``far`` up to ``most`` places earlier, over rows (session_id, n, near, far); null for too few pairs."""
    order = Window.partitionBy("session_id").orderBy("n")
    lagged = rows.withColumns({f"far{k}": F.lag("far", k).over(order) for k in range(most + 1)})
    per_lag = [F.when(F.count(F.col(f"far{k}")) >= least_pairs, F.corr("near", f"far{k}")).alias(f"c{k}") for k in range(most + 1)]
    found = lagged.groupBy("session_id").agg(*per_lag)
    return found.select("session_id", F.greatest(*[f"c{k}" for k in range(most + 1)]).alias("correlation"))


def idle_gaps(rows: DataFrame, limit_ms: int) -> DataFrame:
    """When a session's timer ran out: ``limit_ms`` after an event with no next one by then. The last event has no timeout yet."""
    following = F.lead("at_ms").over(Window.partitionBy("session_id").orderBy("at_ms", "event_id"))
    return rows.withColumn("next_ms", following).where(F.col("next_ms") - F.col("at_ms") > limit_ms).select("session_id", "event_id", (F.col("at_ms") + limit_ms).alias("expired_ms"))


UUID = r"^(\{|urn:uuid:)?[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}\}?$"


def route(events: DataFrame, sessions: DataFrame, pending: DataFrame, probes: DataFrame | None = None, turns: DataFrame | None = None, current: str | None = None) -> DataFrame:
    """Dispositions of reply events (task_id, body_task_id, session_id, status, reply_text, seq) for known sessions and
    pending tasks (task_id, task_session).

    Ids must be UUIDs. The first answer to a task of ``probes`` (task_id) resolves it. Sessions are known by the table or
    as the ``current`` one. A message to an open turn of ``turns`` (task_id, closed_seq: where it closes, null while open)
    is a part of it and finalizes nothing; to a closed one it comes too late. Of the other terminal events of a task the
    first by seq is accepted. What a row tells by itself is found before it meets the tables, so that its texts stay behind; the
    first answer of a task is found where the tables are met by task, in the same pass."""
    known = sessions.select(F.col("session_id").cast("string").alias("session_id")).distinct().withColumn("known", F.lit(True))
    session = F.col("session_id").cast("string")
    fault = (
        F.when(~F.coalesce(F.rlike("task_id", F.lit(UUID)), F.lit(False)), "invalid_task_id")
        .when(F.col("body_task_id").isNotNull() & (F.col("body_task_id") != F.col("task_id")), "task_id_mismatch")
        .when(F.coalesce(T.is_blank(session), F.lit(True)), "session_id_required")
        .when(~F.coalesce(F.col("status").isin(*S.REPLY_STATUSES), F.lit(False)), "invalid_status")
    )
    blank = F.coalesce(T.is_blank(F.col("reply_text")), F.lit(True))
    rows = events.select("task_id", session.alias("session_id"), F.col("session_id").alias("_session"), "status", "seq", fault.alias("fault"), blank.alias("blank"))
    rows = rows.join(known, "session_id", "left").join(pending.withColumn("task_session", F.col("task_session").cast("string")), "task_id", "left")
    none = F.lit(None).cast("boolean")
    rows = rows.withColumn("probed", none) if probes is None else rows.join(probes.select("task_id").distinct().withColumn("probed", F.lit(True)), "task_id", "left")
    if turns is None:
        rows = rows.withColumns({"turn": none, "closed_seq": F.lit(None).cast("long")})
    else:
        rows = rows.join(turns.select("task_id", F.lit(True).alias("turn"), "closed_seq"), "task_id", "left")
    here = F.col("known").isNotNull() | (F.col("session_id") == F.lit(current) if current is not None else F.lit(False))
    message = F.col("status") == "message"
    terminal = F.col("status").isin(*S.TERMINAL_STATUSES) | message
    answers = F.col("status").isin("completed", "errored", "message")
    early = (
        F.when(F.col("fault").isNotNull(), F.col("fault"))
        .when(F.col("probed").isNotNull() & answers, "probe")
        .when(~here, "dropped")
        .when(message & F.col("blank"), "empty_message_ignored")
        .when(F.col("task_session").isNotNull() & (F.col("task_session") != F.col("session_id")) & (F.col("status") != "stream"), "session_mismatch")
        .when(~terminal, "accepted")
        .when(message & F.col("turn").isNotNull(), F.when(F.col("closed_seq").isNull() | (F.col("seq") < F.col("closed_seq")), "accepted").otherwise("already_finalized"))
        .when(F.col("task_session").isNull(), "unregistered_task")
    )
    rows = rows.withColumn("early", early)
    task = Window.partitionBy("task_id")
    first, answered = F.min(F.when(F.col("early").isNull(), F.col("seq"))), F.min(F.when(F.col("early") == "probe", F.col("seq")))
    rows = rows.withColumns({"first_seq": first.over(task), "probe_seq": answered.over(task)})
    final = (
        F.when(F.col("early") == "probe", F.when(F.col("seq") == F.col("probe_seq"), "probe_resolved").when(~here, "dropped").otherwise("unregistered_task"))
        .when(F.col("early").isNotNull(), F.col("early"))
        .when(F.col("seq") == F.col("first_seq"), "accepted")
        .otherwise("already_finalized")
    )
    return rows.select("task_id", F.col("_session").alias("session_id"), "status", "seq", final.alias("disposition"))


def turn_outputs(events: DataFrame) -> DataFrame:
    """What the events of chat turns (turn_id, seq, action, text) put out (turn_id, seq, n, type, text): a turn is registered
    once, takes deltas while it is open, replays its text on a resume, and ends once by a reply, a cancellation or an error."""
    turn = Window.partitionBy("turn_id")
    before = turn.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    action, text = F.col("action"), F.coalesce("text", F.lit(""))
    rows = events.withColumn("begun", F.min(F.when(action == "register", F.col("seq"))).over(turn)).where("seq >= begun")
    rows = rows.withColumn("closed", F.min(F.when(action.isin("reply", "cancel", "error") & (F.col("seq") > F.col("begun")), F.col("seq"))).over(turn))
    open_ = F.col("closed").isNull() | (F.col("seq") < F.col("closed"))
    # the text of a turn is joined once; what was said before a row is as much of it as the deltas so far are long
    delta = (action == "delta") & open_
    rows = rows.withColumn("length", F.coalesce(F.sum(F.when(delta, F.length(text))).over(before), F.lit(0)).cast("int"))
    deltas = F.transform(F.array_sort(F.collect_list(F.struct("seq", text.alias("text")))), lambda d: d["text"])
    texts = rows.where(delta).groupBy("turn_id").agg(F.array_join(deltas, "").alias("all"))
    telling = action.isin("resume", "reply")
    told = rows.where(telling).join(texts, "turn_id", "left").withColumn("said", F.left(F.coalesce("all", F.lit("")), F.col("length"))).drop("all")
    rows = rows.where(~telling | action.isNull()).withColumn("said", F.lit("")).unionByName(told)
    rest = T.continuation(F.col("said"), text)
    ends = action.isin("reply", "cancel", "error") & (F.col("seq") == F.col("closed"))
    rows = rows.withColumn("added", F.when(ends & (action == "reply"), F.when(F.startswith(text, F.col("said")), F.substring(text, F.length("said") + 1, F.length(text))).otherwise(rest)).otherwise(F.lit("")))
    rows = rows.withColumn("whole", F.concat("said", F.coalesce(F.max("added").over(before), F.lit(""))))

    def out(kind: str, value: Column | str = "") -> Column:
        return F.struct(F.lit(kind).alias("type"), (F.lit(value) if isinstance(value, str) else value).alias("text"))

    finished = [out("text-end"), out("finish")]
    parts = (
        F.when(action == "register", F.array(F.when(F.col("seq") == F.col("begun"), out("start")).otherwise(out("refused"))))
        .when(action == "resume", F.array(out("start"), out("text-start"), out("text-delta", F.col("whole"))))
        .when((action == "delta") & open_, F.array(out("text-delta", text)))
        .when(ends & (action == "cancel"), F.array(out("finish")))
        .when(ends & (action == "error"), F.array(out("error", text), out("finish")))
        .when(ends & (F.col("added") == ""), F.array(*finished))
        .when(ends, F.array(out("text-delta", F.col("added")), *finished))
    )
    return rows.select("turn_id", "seq", F.posexplode(parts).alias("n", "o")).select("turn_id", "seq", "n", "o.type", "o.text")


def token_stream(lines: DataFrame) -> DataFrame:
    """Kind (token, reasoning, finished, error, other) and text of server-sent lines (key, at, line)."""
    body = F.trim(F.regexp_extract("line", r"^data:(.*)$", 1))
    json = F.from_json(body, "choices array<struct<delta:struct<content:string,reasoning_content:string>,finish_reason:string>>, error struct<message:string>")
    rows = lines.withColumns({"body": body, "json": json}).withColumn("first", F.try_element_at("json.choices", F.lit(1)))
    kind = (
        F.when(F.col("body") == "[DONE]", "finished")
        .when(F.col("json.error.message").isNotNull(), "error")
        .when(F.length("first.delta.content") > 0, "token")
        .when(F.length("first.delta.reasoning_content") > 0, "reasoning")
        .when(F.col("first.finish_reason").isNotNull(), "finished")
        .otherwise("other")
    )
    text = F.when(kind == "token", F.col("first.delta.content")).when(kind == "reasoning", F.col("first.delta.reasoning_content")).when(kind == "error", F.col("json.error.message"))
    return rows.select("key", "at", kind.alias("kind"), text.alias("text"))


def reduced_stream(lines: DataFrame) -> DataFrame:
    """The text of each stream: its tokens before it finished or failed."""
    rows = token_stream(lines)
    done = F.max(F.col("kind").isin("finished", "error").cast("int")).over(Window.partitionBy("key").orderBy("at"))
    tokens = F.transform(F.array_sort(F.collect_list(F.when((F.col("kind") == "token") & (F.col("done") == 0), F.struct("at", "text")))), lambda t: t["text"])
    return rows.withColumn("done", done).groupBy("key").agg(F.array_join(tokens, "").alias("text"), F.max("done").cast("boolean").alias("closed"), F.max(F.when(F.col("kind") == "error", F.col("text"))).alias("error"))


def frame_cursor(tokens: Column, blank: int, most_per_frame: int = 10) -> Column:
    """Frame after greedy decoding of (token, duration) pairs: a duration moves on; a blank without one moves by 1, and so
    does the last token that a frame may give."""
    start = F.struct(F.lit(0).alias("frame"), F.lit(0).alias("in_frame"))

    def step(state: Column, pair: Column) -> Column:
        count = state["in_frame"] + (pair["token"] != blank).cast("int")
        stuck = (pair["duration"] == 0) & ((pair["token"] == blank) | (count >= most_per_frame))
        by = F.when(stuck, 1).otherwise(pair["duration"])
        return F.struct((state["frame"] + by).alias("frame"), F.when(by > 0, 0).otherwise(count).alias("in_frame"))

    return F.aggregate(tokens, start, step)["frame"]


def noise_floor(values: DataFrame, growth: float = 1.005, least: float = 1e-5) -> DataFrame:
    """Running floor (session_id, at, floor) of values (session_id, at, value): follows lower values at once, otherwise grows by
    a factor. The floor after i is the least of value_j * growth^(i - j) for j up to i, so it is a running minimum."""
    w = Window.partitionBy("session_id").orderBy("at")
    rows = values.withColumn("i", F.row_number().over(w))
    # logarithms, as growth^i overflows on long recordings
    scaled = F.log(F.greatest("value", F.lit(least))) - F.col("i") * math.log(growth)
    low = F.min(scaled).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.select("session_id", "at", F.exp(low + F.col("i") * math.log(growth)).alias("floor"))


def notes_lifecycle(events: DataFrame) -> DataFrame:
    """Notes of each session after its events (session_id, seq, status, text) in order: pending keeps old notes, completed
    replaces them, errored and cancelled keep them."""
    empty = F.struct(F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("notes"))

    def step(state: Column, event: Column) -> Column:
        notes = F.when((event["status"] == "completed") & (F.length(F.trim(event["text"])) > 0), event["text"]).otherwise(state["notes"])
        return F.when(event["status"].isin(*S.NOTES_STATUSES), F.struct(event["status"].alias("status"), notes.alias("notes"))).otherwise(state)

    ordered = F.array_sort(F.collect_list(F.struct("seq", "status", "text")))
    return events.groupBy("session_id").agg(F.aggregate(ordered, empty, step).alias("n")).select("session_id", "n.status", "n.notes")


def skipped_blocks(blocks: DataFrame, limit: int = 125) -> DataFrame:
    """Blocks (session_id, at, silent) with whether inference is skipped: more than ``limit`` silent blocks in a row up to
    here. Activity starts the count anew."""
    in_order = Window.partitionBy("session_id").orderBy("at")
    runs = blocks.withColumn("_run", F.sum(F.when(F.col("silent"), 0).otherwise(1)).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    silent_so_far = F.count_if(F.col("silent")).over(Window.partitionBy("session_id", "_run").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return runs.withColumn("skipped", F.coalesce(F.col("silent"), F.lit(False)) & (silent_so_far > limit)).drop("_run")


def far_alive(chunks: DataFrame, within_ms: int = 400) -> DataFrame:
    """Chunks (session_id, source near or far, at_ms) of the near source with whether the far one was heard within the time
    before."""
    so_far = Window.partitionBy("session_id").orderBy("at_ms", "source").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heard = F.max(F.when(F.col("source") == "far", F.col("at_ms"))).over(so_far)
    return chunks.withColumn("far_ms", heard).where("source = 'near'").withColumn("far_alive", F.coalesce(F.col("at_ms") - F.col("far_ms") <= within_ms, F.lit(False)))
