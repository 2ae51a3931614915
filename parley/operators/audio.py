"""Streams of samples as tables: blocks, alignment of two sides, echo, gate, mixing, stalls and utterances.

A chunk is a row (session_id, at, samples) or, where only lengths matter, (session_id, start, n). Work on positions is
joins, windows and grouping (more of them in ``recordings``); what depends on its own past step by step (clock, echo
regime, gate) runs through the rows of one session in a task, which are bounded by the length of a recording.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as T

RATE = 16_000
SHIFT = 128
PREROLL = 3_200
DRIFT = 1_600
LEAST_SAMPLES = 1_600
STALL_MS = 10_000
RESTARTS = 3

# From which correlation on there is an echo, from which share of loud blocks on the near side is heard, and up to
# which one it is quiet; by kind of analysis, what is kept of the evidence for an echo and added to it, and against one; how
# much of either switches.
ECHO_FROM, HEARD_FROM, QUIET_TO = 0.6, 0.2, 0.1
EVIDENCE = {"echo": (1.0, 1.0, 0.0, 0.0), "quiet": (0.5, 0.0, 1.0, 1.0), "other": (0.9, 0.0, 0.9, 0.0)}
ENOUGH = (2.0, 12.0)

# What is known of an output by its transport, and of its echo by its route.
ROUTES = {
    "bltn": "internal_speakers", "blue": "bluetooth", "blea": "bluetooth", "usb ": "usb", "hdmi": "external_display", "dprt": "external_display", "thun": "external_display", "airp": "airplay",
}
PRIORS = {"internal_speakers": "echo_prone", "external_display": "echo_prone", "airplay": "echo_prone", "headphones": "clear"}


def _mapped(value: Column, table: dict[str, str], other: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value), F.lit(other))


def output_route(transport: Column, data_source: Column) -> Column:
    """The route of an output by the code of its transport; built-in ones can be headphones."""
    return F.when((transport == "bltn") & (data_source == "hdpn"), "headphones").otherwise(_mapped(transport, ROUTES, "other"))


def echo_prior(route: Column) -> Column:
    """What a route says about an echo before anything is heard: echo_prone, clear or unknown."""
    return _mapped(route, PRIORS, "unknown")


def capture_endpoints(defaults: DataFrame) -> DataFrame:
    """Distinct endpoints (owner, rank, role, id) of each owner, under the role with the smallest rank."""
    first = F.row_number().over(Window.partitionBy("owner", "id").orderBy("rank"))
    return defaults.where("id is not null").withColumn("_n", first).where("_n = 1").drop("_n")


def can_listen(speech_ready: Column, local_ready: Column, prefers_local: Column, has_relay: Column, pairing: Column) -> Column:
    """Whether a session can begin: speech is ready, and the side that will answer is."""
    return speech_ready & F.when(prefers_local | ~has_relay, local_ready).otherwise(~pairing)


def _offsets(chunks: DataFrame) -> DataFrame:
    """Chunks with the position of their first sample and the one after their last in the session."""
    up_to = Window.partitionBy("session_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.size("samples").cast("long")).over(up_to)
    return chunks.withColumn("end", end).withColumn("start", F.col("end") - F.size("samples"))


def with_preroll(chunks: DataFrame, most: int = PREROLL) -> DataFrame:
    """Each chunk with the last ``most`` samples up to its end: what is put before speech that starts there."""
    rows = _offsets(chunks)
    near = Window.partitionBy("session_id").orderBy("end").rangeBetween(-(most - 1), 0)
    ring = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "samples")).over(near)), lambda c: c["samples"]))
    return rows.withColumn("ring", ring).withColumn("preroll", F.slice("ring", F.greatest(F.size("ring") - most + 1, F.lit(1)), F.lit(most))).drop("ring", "start", "end")


def normalised(cells: DataFrame, *keys: str) -> DataFrame:
    """Values (x) less their mean over the rows of the same keys, by the sample deviation (z); a single one stays as it is."""
    stats = cells.groupBy(*keys).agg(F.avg("x").alias("_mean"), F.stddev_samp("x").alias("_sd"), F.count(F.lit(1)).alias("_n"))
    z = F.when(F.col("_n") > 1, (F.col("x") - F.col("_mean")) / (F.col("_sd") + 1e-5)).otherwise(F.col("x"))
    return cells.join(stats, list(keys)).withColumn("z", z).drop("_mean", "_sd", "_n")


def sample_offset(captured_ms: Column, epoch_ms: Column) -> Column:
    """Samples from the epoch to a time, signed, rounded."""
    return F.round((captured_ms - epoch_ms) * RATE / 1000).cast("long")


def clocked(chunks: DataFrame, drift: int = DRIFT) -> DataFrame:
    """Where each chunk (session_id, at, expected, n) starts: where the one before ended, unless the expected place is more
    than ``drift`` samples off; then there. Only places of a new start are folded; the rest is a window."""
    w = Window.partitionBy("session_id").orderBy("at")
    ahead = F.col("expected") - F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = chunks.withColumn("ahead", ahead)
    marks = "array<struct<at:long,ahead:long>>"

    def step(done: Column, row: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))["ahead"]
        anew = last.isNull() | (F.abs(row["ahead"] - last) > drift)
        return F.when(anew, F.concat(done, F.array(F.struct(row["at"].cast("long").alias("at"), row["ahead"].cast("long").alias("ahead"))))).otherwise(done)

    found = rows.groupBy("session_id").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("at", "ahead"))), F.array().cast(marks), step).alias("m"))
    resets = found.select("session_id", F.explode("m").alias("m")).select("session_id", "m.at", F.col("m.ahead").alias("reset"))
    joined = rows.join(resets, ["session_id", "at"], "left")
    held = F.last("reset", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return joined.select("session_id", "at", "n", (F.col("expected") - F.col("ahead") + held).alias("start"), F.col("reset").isNotNull().alias("resynced"))


def aligned_blocks(near: DataFrame, far: DataFrame, size: int = SHIFT) -> DataFrame:
    """For each block of ``size`` samples from the first near one on: how many near samples lie in it, and how many of those
    have none of the far side's (chunks session_id, start, n; those of one side don't overlap). Far samples before the
    first near one are stale."""
    first = near.groupBy("session_id").agg(F.min("start").alias("origin"))

    def spread(chunks: DataFrame, name: str) -> DataFrame:
        rows = chunks.join(first, "session_id").withColumns({"a": F.greatest(F.col("start") - F.col("origin"), F.lit(0)), "b": F.col("start") + F.col("n") - F.col("origin")}).where("b > a")
        blocks = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / size), F.floor((F.col("b") - 1) / size))))
        inside = F.least(F.col("b"), (F.col("block") + 1) * size) - F.greatest(F.col("a"), F.col("block") * size)
        return blocks.groupBy("session_id", "block").agg(F.sum(inside).alias(name))

    both = spread(near, "near_n").join(spread(far, "far_n"), ["session_id", "block"], "left")
    return both.select("session_id", "block", "near_n", (F.col("near_n") - F.least("near_n", F.coalesce("far_n", F.lit(0)))).alias("bypassed"))


def _by_session(rows: DataFrame, order: str, run, schema: str) -> DataFrame:
    """Rows of each session, in order, through a function of their frame that gives columns."""

    def session(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pd.DataFrame({"session_id": pdf["session_id"], order: pdf[order], **run(pdf)})

    kind = rows.schema["session_id"].dataType.simpleString()
    return rows.groupBy("session_id").applyInPandas(session, f"session_id {kind}, {order} long, {schema}")


def echo_regimes(analyses: DataFrame, engaged: bool = True) -> DataFrame:
    """Whether echo cancelling is engaged after each analysis (session_id, at, correlation, active: share of blocks with
    sound nearby). Evidence for it and against it fades or grows with each analysis by the factors of its kind, and is used
    up by a switch. The fold over a session keeps its switches only; the analyses between them follow by a window."""
    kind = F.when((F.col("correlation") >= ECHO_FROM) & (F.col("active") >= HEARD_FROM), "echo").when(F.col("active") <= QUIET_TO, "quiet").otherwise("other")
    weights = {name: F.array(*[F.lit(x) for x in factors]) for name, factors in EVIDENCE.items()}
    weight = F.when(kind == "echo", weights["echo"]).when(kind == "quiet", weights["quiet"]).otherwise(weights["other"])
    none = F.array().cast("array<struct<at:long,on:boolean>>")
    start = F.struct(F.lit(engaged).alias("on"), F.lit(0.0).alias("pro"), F.lit(0.0).alias("con"), none.alias("switches"))

    def step(state: Column, row: Column) -> Column:
        pro, con = (state[name] * row["weight"][i] + row["weight"][i + 1] for name, i in (("pro", 0), ("con", 2)))
        up, down = ~state["on"] & (pro >= ENOUGH[0]), state["on"] & (con >= ENOUGH[1])
        on = up | (state["on"] & ~down)
        switch = F.array(F.struct(row["at"].cast("long").alias("at"), on.alias("on")))
        told = F.when(up | down, F.concat(state["switches"], switch)).otherwise(state["switches"])
        return F.struct(on.alias("on"), F.when(up, 0.0).otherwise(pro).alias("pro"), F.when(down, 0.0).otherwise(con).alias("con"), told.alias("switches"))

    rows = analyses.select("session_id", F.col("at").cast("long").alias("at"), weight.alias("weight"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "weight")))
    switches = rows.groupBy("session_id").agg(F.aggregate(ordered, start, step)["switches"].alias("s")).select("session_id", F.inline("s"))
    so_far = Window.partitionBy("session_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.coalesce(F.last("on", ignorenulls=True).over(so_far), F.lit(engaged))
    return rows.join(switches, ["session_id", "at"], "left").select("session_id", "at", known.alias("engaged"))


def gate_gains(windows: DataFrame, attack: float = 0.2, release: float = 0.5) -> DataFrame:
    """The gain after each window (session_id, at, target; null releases towards 1): a fifth of the way down to a lower
    target, half of the way otherwise."""

    def run(pdf: pd.DataFrame) -> dict[str, list]:
        gain, out = 1.0, []
        for target in pdf["target"].fillna(1.0):
            gain += (attack if target < gain else release) * (target - gain)
            out.append(gain)
        return {"gain": out}

    return _by_session(windows, "at", run, "gain double")


def gate_target(coherence: Column, threshold: float = 0.65, most_db: float = 18.0) -> Column:
    """The gain that a window of this coherence asks for; null below the threshold."""
    t = F.greatest(F.least((coherence - threshold) / (1 - threshold), F.lit(1.0)), F.lit(0.0))
    return F.when(coherence >= threshold, F.pow(F.lit(10.0), -most_db * t * t * (3 - 2 * t) / 20))


def gate_stats(parts: DataFrame, *keys: str) -> DataFrame:
    """Windows, gated windows and mean attenuation over parts (windows, gated, mean_db), each mean weighted by its gated windows."""
    gated = F.sum("gated")
    mean = F.when(gated > 0, F.sum(F.col("mean_db") * F.col("gated")) / gated).otherwise(0.0)
    return parts.groupBy(*keys).agg(F.sum("windows").alias("windows"), gated.alias("gated"), mean.alias("mean_db"))


def stall_actions(chunks: DataFrame, limit_ms: int = STALL_MS, restarts: int = RESTARTS) -> DataFrame:
    """What a watch over the system's audio does (session_id, at_ms, action), for chunks (session_id, source system or mic,
    at_ms) and a last row (source ``end``): each time that ``limit_ms`` pass without system audio or restart, a restart;
    after ``restarts`` in a row, mic_only while the microphone is heard, else ended. Nothing follows those two but the end
    of a session whose microphone falls silent as well."""
    w = Window.partitionBy("session_id")
    over = chunks.groupBy("session_id").agg(F.max(F.when(F.col("source") == "end", F.col("at_ms"))).alias("over"))
    system = chunks.where("source = 'system'").withColumn("next_ms", F.lead("at_ms").over(w.orderBy("at_ms"))).join(over, "session_id")
    gaps = system.select("session_id", "at_ms", (F.coalesce("next_ms", "over") - F.col("at_ms")).alias("gap"))
    times = F.least(F.floor(F.col("gap") / limit_ms), F.lit(restarts + 1))
    due = gaps.where(F.col("gap") >= limit_ms).select("session_id", F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("k"), "at_ms").select("session_id", "k", (F.col("at_ms") + F.col("k") * limit_ms).alias("due"))
    first = due.where(F.col("k") == restarts + 1).groupBy("session_id").agg(F.min("due").alias("given_up"))
    tried = due.join(first, "session_id", "left").where((F.col("k") <= restarts) & (F.col("given_up").isNull() | (F.col("due") < F.col("given_up"))))
    heard = chunks.where("source != 'end'").join(first, "session_id")
    last = heard.groupBy("session_id", "given_up").agg(F.max(F.when(F.col("at_ms") <= F.col("given_up"), F.col("at_ms"))).alias("last"))
    verdict = F.when(F.col("given_up") - F.col("last") >= limit_ms, "ended").otherwise("mic_only")
    stopped = last.withColumn("action", verdict)
    # after that, the first silence of both sides ends the session
    both = heard.join(over, "session_id").withColumn("next_ms", F.coalesce(F.lead("at_ms").over(w.orderBy("at_ms")), "over"))
    silent = both.where((F.col("next_ms") - F.col("at_ms") >= limit_ms) & (F.col("at_ms") + limit_ms > F.col("given_up")))
    ended = silent.groupBy("session_id").agg(F.min(F.col("at_ms") + limit_ms).alias("at_ms")).join(stopped.where("action = 'mic_only'").select("session_id"), "session_id", "left_semi")
    return tried.select("session_id", F.col("due").alias("at_ms"), F.lit("restart").alias("action")).unionByName(stopped.select("session_id", F.col("given_up").alias("at_ms"), "action")).unionByName(ended.select("session_id", "at_ms", F.lit("ended").alias("action")))


def decoded(n: Column, text: Column, least: int = LEAST_SAMPLES) -> Column:
    """The trimmed text of a stretch of samples; null for too few of them or a blank text."""
    return F.when((n > least) & ~T.is_blank(text), T.trim_ws(text))


def utterances(pieces: DataFrame, wholes: DataFrame) -> DataFrame:
    """Interim and final texts (session_id, utterance, at, text, final) of utterances.

    An utterance has segments (cut where it got too long), a segment pieces: rows (session_id, utterance, segment, piece,
    at, n, text), and a text of its own: (session_id, utterance, segment, n, text). Each piece with a text is interim. The
    final text joins the segments': a single piece stands for its segment, else the segment's own text does, else its pieces do."""
    key = ["session_id", "utterance", "segment"]
    heard = pieces.withColumn("said", decoded(F.col("n"), F.col("text")))
    interim = heard.where("said is not null").select("session_id", "utterance", "at", F.col("said").alias("text"), F.lit(False).alias("final"))
    told = F.array_sort(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("piece", "said"))))
    joined = F.array_join(F.transform(told, lambda p: p["said"]), " ")
    parts = heard.groupBy(*key).agg(F.nullif(joined, F.lit("")).alias("joined"), F.count(F.lit(1)).alias("pieces"), F.max("at").alias("at"))
    own = wholes.select(*key, decoded(F.col("n"), F.col("text")).alias("whole"))
    segments = parts.join(own, key, "left").withColumn("text", F.when(F.col("pieces") == 1, F.col("joined")).otherwise(F.coalesce("whole", "joined")))
    texts = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("segment", "text"))))
    final = segments.groupBy("session_id", "utterance").agg(F.array_join(F.transform(texts, lambda s: s["text"]), " ").alias("text"), F.max("at").alias("at"))
    return interim.unionByName(final.where("text != ''").select("session_id", "utterance", "at", "text", F.lit(True).alias("final")))


def dated_finals(commits: DataFrame, finals: DataFrame) -> DataFrame:
    """Final texts (session_id, at, text) with the capture time of the commit they answer: the first one that of the first
    commit (session_id, at, captured_ms), and so on. Blank ones use up their commit and are left out."""
    order = Window.partitionBy("session_id").orderBy("at")
    asked = commits.select("session_id", F.row_number().over(order).alias("n"), "captured_ms")
    said = finals.select("session_id", "at", "text", F.row_number().over(order).alias("n"))
    return said.join(asked, ["session_id", "n"], "left").where(~T.is_blank(F.col("text"))).select("session_id", "at", T.trim_ws(F.col("text")).alias("text"), "captured_ms")


def throttled(partials: DataFrame, every_ms: int = 500) -> DataFrame:
    """Partial texts (session_id, at_ms, text, final) that are shown: with blanks left out, the first one, and each that
    comes ``every_ms`` after the last shown; a final text lets the next partial through."""

    def run(pdf: pd.DataFrame) -> dict[str, list]:
        last, out = None, []
        for at, text, final in zip(pdf["at_ms"], pdf["text"], pdf["final"], strict=True):
            shown = not final and bool((text or "").strip()) and (last is None or at - last >= every_ms)
            last = None if final else at if shown else last
            out.append(shown)
        return {"shown": out}

    return _by_session(partials, "at_ms", run, "shown boolean").where("shown").drop("shown")


def two_phase_timeouts(rows: DataFrame, first_ms: int = 120_000, idle_ms: int = 60_000) -> DataFrame:
    """When a stream (key, at_ms, kind: request, token or done) timed out, and in which phase: no token within ``first_ms`` of
    its request (startup), or none for ``idle_ms`` after one (stalled). Streams that are done in time have no row; the last
    token of an unfinished stream counts."""
    following = F.lead("at_ms").over(Window.partitionBy("key").orderBy("at_ms", F.col("kind") != "request"))
    limit = F.when(F.col("kind") == "request", first_ms).otherwise(idle_ms)
    late = rows.withColumns({"next_ms": following, "due": F.col("at_ms") + limit}).where((F.col("kind") != "done") & (F.col("next_ms").isNull() | (F.col("next_ms") > F.col("due"))))
    first = F.min(F.struct("due", F.when(F.col("kind") == "request", "startup").otherwise("stalled").alias("phase")))
    return late.groupBy("key").agg(first.alias("f")).select("key", F.col("f.due").alias("expired_ms"), F.col("f.phase").alias("phase"))
