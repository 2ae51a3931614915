"""Blocks, timelines, mixes, watches and replies: batch forms against plain loops, continuous forms against the batch forms."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parley.operators import audio, replies, speakers, streams
from parley.operators import recordings as R
from parley.streaming import processors as P
from parley.streaming import recordings as L
from parley.streaming.replies import Replies


def run_stream(spark, tmp_path, frames, schema, build):
    """Each frame is one file; the query is started anew, from its checkpoint, for each."""
    P.use_rocksdb(spark)
    folder = tmp_path / "in"
    out = []
    for i, pdf in enumerate(frames):
        spark.createDataFrame(pdf, schema).coalesce(1).write.mode("append").parquet(str(folder / f"b={i:03d}"))
        rows = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(folder))
        query = build(rows).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    return out


def timed(df, processor, key="session_id", at="now_ms"):
    return P.stateful(df.withColumn("now", F.timestamp_millis(at)).withWatermark("now", "0 seconds"), key, processor, "EventTime")


def frame(rows, schema):
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def cut(pdf, by, parts=3):
    places = pdf[by].rank(method="dense")
    return [pdf[(places > places.max() * k / parts) & (places <= places.max() * (k + 1) / parts)] for k in range(parts)]


def same(a, b):
    return len(a) == len(b) and all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-9) for x, y in zip(a, b, strict=True))


CHUNKS = "session_id long, at long, far boolean, start long, samples array<double>, now_ms long"


def two_sides(seed, n=60):
    """Chunks of both sides in the order of their arrival: gaps, overlaps, repeated ones, and a far side that lags a little."""
    draw = random.Random(seed)
    rows = []
    for session in (1, 2):
        place = {False: 500 * session, True: 500 * session - 700}
        for k in range(n):
            far = k % 2 == 1
            length = draw.randint(0, 700)
            place[far] += draw.choice([0, 0, 0, 150, -90, 900])
            rows.append((session, k, far, place[far], [draw.uniform(-1, 1) for _ in range(length)], 1_000 + k))
            place[far] += length
    return rows


def aligned_by_hand(rows, size):
    line = {False: {}, True: {}}
    reached, origin = {False: None, True: None}, None
    for _, _, far, start, samples, _ in sorted(rows, key=lambda r: r[1]):
        origin = start if origin is None and not far else origin
        for i, x in enumerate(samples):
            if reached[far] is None or start + i >= reached[far]:
                line[far][start + i] = x
        reached[far] = max(start + len(samples), reached[far] if reached[far] is not None else start)
    last = max(line[False])
    places = range(origin, last + 1)
    return [([line[False].get(p) for p in places[i : i + size]], [line[True].get(p) for p in places[i : i + size]]) for i in range(0, len(places), size)]


def test_aligned_samples(spark):
    rows = two_sides(1)
    df = spark.createDataFrame(frame(rows, CHUNKS), CHUNKS)
    got = R.aligned_samples(df.where("not far"), df.where("far"), 128).collect()
    for session in (1, 2):
        want = aligned_by_hand([r for r in rows if r[0] == session], 128)
        mine = sorted((r for r in got if r.session_id == session), key=lambda r: r.block)
        assert [r.block for r in mine] == list(range(len(want)))
        assert all(same(r.near, near) and same(r.far, far) for r, (near, far) in zip(mine, want, strict=True))
    assert any(None in r.near for r in got) and any(None in r.far for r in got)


def test_aligner_equals_the_whole_recording(spark, tmp_path):
    pdf = frame(two_sides(2) + [(s, 999, False, 0, None, 2_000) for s in (1, 2)], CHUNKS)
    df = spark.createDataFrame(pdf, CHUNKS).where("samples is not null")
    want = {(r.session_id, r.block): r for r in R.aligned_samples(df.where("not far"), df.where("far")).collect()}
    got = run_stream(spark, tmp_path, cut(pdf, "at"), CHUNKS, lambda rows: timed(rows, L.Aligner()))
    assert len(got) == len(want) > 50
    assert all(same(r.near, want[r.session_id, r.block].near) and same(r.far, want[r.session_id, r.block].far) for r in got)


def test_aligner_waits_for_the_far_side_so_long_only(spark, tmp_path):
    near = [(1, k, False, k * 1_000, [float(k)] * 1_000, 1_000 + k) for k in range(10)]
    late = [(1, 20, True, 500, [5.0] * 3_000, 1_100), (1, 21, False, 10_000, [10.0] * 1_000, 1_101)]
    got = run_stream(spark, tmp_path, [frame(near, CHUNKS), frame(late, CHUNKS)], CHUNKS, lambda rows: timed(rows, L.Aligner()))
    assert [r.block for r in got] == list(range(len(got)))
    told = sum(len(r.near) for r in got)
    assert told == 3_500 - 3_500 % 128  # the far side has reached 3,500, and 11,000 less the wait is not beyond
    far = [x for r in got for x in r.far]
    read = 2_000 - 2_000 % 128  # what was told before the far side came
    assert all(x is None for x in far[:read]) and all(x == 5.0 for x in far[read:])


def test_aligner_gives_up_a_quiet_far_side_by_its_timer(spark, tmp_path):
    first = frame([(1, 0, False, 100, [1.0] * 300, 1_000)], CHUNKS)
    other = [frame([(2, k, True, 0, [0.0], 5_000 * k)], CHUNKS) for k in (1, 2)]
    got = run_stream(spark, tmp_path, [first, *other], CHUNKS, lambda rows: timed(rows, L.Aligner()))
    assert [(r.session_id, r.block, len(r.near)) for r in got] == [(1, 0, 128), (1, 1, 128)] and all(x is None for r in got for x in r.far)


def test_a_side_holds_so_much_only():
    side = L.Side({}, None)
    side.add(0, np.ones(1_000), None)
    side.add(1_000 + L.UNREAD + 1, np.ones(10), None)
    assert min(side.stretches) == 1_000 + L.UNREAD + 1
    for k in range(3):
        side.add(side.end, np.full(L.UNREAD, k), None)
    assert min(side.stretches) >= side.end - 2 * L.UNREAD and side.read(side.end - 5, side.end).tolist() == [2.0] * 5


PUSHES = "session_id long, at long, source int, samples array<int>"


def pushes(seed, sources, sessions=3, n=40):
    draw = random.Random(seed)
    return [(s, k, draw.choice([*range(sources), draw.randint(-1, sources)]) if draw.random() < 0.6 else 0, [draw.randint(-32_768, 32_767) for _ in range(draw.randint(0, 30))]) for s in range(sessions) for k in range(n)]


def mixed_by_hand(rows, sources, lead):
    """One sample after the other: a mixed one goes out while every source has one, or one has more than the lead."""
    waiting, out = [[] for _ in range(sources)], []
    for _, at, source, samples in rows:
        told = []
        if 0 <= source < sources:
            waiting[source] += samples
            while all(waiting) or sources > 1 and max(map(len, waiting)) > lead:
                told.append(max(-32_768, min(32_767, sum(w.pop(0) for w in waiting if w))))
            out.append((at, told))
    return out


@pytest.mark.parametrize("sources", [1, 2, 3])
def test_mix_in_closed_form(spark, tmp_path, sources):
    rows = pushes(sources, sources) + [(9, 0, 0, [1, 2, 3])]
    df = spark.createDataFrame(frame(rows, PUSHES), PUSHES)
    blocks = R.mixed_blocks(df, sources, 25, 16).collect()
    places = {(r.session_id, r.at): r.n for r in R.mixed_places(df.select("session_id", "at", "source", F.size("samples").alias("size")), sources, 25).collect()}
    live = run_stream(spark, tmp_path, cut(frame(rows, PUSHES), "at"), PUSHES, lambda d: P.stateful(d, "session_id", L.Mixer(sources, 25)))
    for session in {r[0] for r in rows}:
        want = mixed_by_hand([r for r in rows if r[0] == session], sources, 25)
        mine = [x for r in sorted((r for r in blocks if r.session_id == session), key=lambda r: r.block) for x in r.samples]
        assert mine == [x for _, told in want for x in told]
        assert {at: n for (s, at), n in places.items() if s == session} == {at: len(told) for at, told in want}
        assert sorted((r.at, r.samples) for r in live if r.session_id == session) == want
    assert R.mixed_blocks(df.limit(0), sources).count() == 0


SAMPLES = "session_id long, at long, samples array<double>"


def test_blocks_and_rings(spark, tmp_path):
    draw = random.Random(4)
    rows = [(s, k, [draw.uniform(-1, 1) for _ in range(draw.choice([0, 3, 17, 40]))]) for s in (1, 2) for k in range(30)]
    pdf = frame(rows, SAMPLES)
    batch = {(r.session_id, r.block): r.samples for r in R.reblocked(spark.createDataFrame(pdf, SAMPLES), 16).collect()}
    live = run_stream(spark, tmp_path, cut(pdf, "at"), SAMPLES, lambda df: P.stateful(df, "session_id", L.Reblocker(16, 40)))
    line = {s: [x for r in rows if r[0] == s for x in r[2]] for s in (1, 2)}
    assert batch == {(s, i): line[s][16 * i : 16 * i + 16] for s in line for i in range(len(line[s]) // 16)}
    assert {(r.session_id, r.block): r.samples for r in live} == batch
    assert all(r.ring == line[r.session_id][max(16 * r.block + 16 - 40, 0) : 16 * r.block + 16] for r in live)


def test_overlapping_frames_add_up(spark):
    draw = random.Random(5)
    rows = [(s, k, [draw.randint(0, 9) / 4 for _ in range(10)]) for s in (1, 2) for k in range(7)]
    got = R.overlap_added(spark.createDataFrame(rows, "session_id long, k long, samples array<double>"), 4).orderBy("block").collect()
    for s in (1, 2):
        want = np.zeros(34)
        for _, k, samples in (r for r in rows if r[0] == s):
            want[4 * k : 4 * k + 10] += samples
        assert [x for r in got if r.session_id == s for x in r.samples] == want.tolist()


HEARD = "session_id long, seq long, kind string, samples array<double>, speech_prob double, now_ms long, text string, final boolean"


def spoken(seed):
    draw = random.Random(seed)
    rows = []
    for s in (1, 2):
        now, loud = 0, False
        for k in range(260):
            now += 32
            loud = draw.random() < (0.85 if loud else 0.15)
            if draw.random() < 0.75:
                rows.append((s, k, "block", [float(k + i / 10) for i in range(8)], 0.9 if loud else 0.1, now, None, None))
            else:
                rows.append((s, k, "text", None, None, now, draw.choice(["one", " two ", " ", "three"]), draw.random() < 0.3))
    return rows


def test_transcriber(spark, tmp_path):
    vad = streams.Vad(silence_ms=96, late_silence_ms=64, late_after_ms=256, longest_ms=640, shortest_ms=32)
    rows = spoken(7)
    pdf = frame(rows, HEARD)
    out = run_stream(spark, tmp_path, cut(pdf, "seq", 4), HEARD, lambda df: P.stateful(df, "session_id", L.Transcriber(vad, 20, 50, 100)))
    heard = spark.createDataFrame(pdf, HEARD)
    told = {(r.session_id, r.chunk_idx, r.event) for r in streams.speech_events(heard.where("kind = 'block'").select("session_id", F.col("seq").alias("chunk_idx"), "speech_prob"), vad).collect()}
    assert {(r.session_id, r.seq, r.kind) for r in out if r.kind in ("start", "end")} == {x for x in told if x[2] != "force"}
    assert {(r.session_id, r.seq) for r in out if r.kind == "commit"} == {x[:2] for x in told if x[2] != "start"} and len(told) > 20
    # texts as their batch forms have them
    texts = heard.where("kind = 'text'")
    shown = {(r.session_id, r.at_ms) for r in audio.throttled(texts.select("session_id", F.col("now_ms").alias("at_ms"), "text", "final"), 100).collect()}
    assert {(r.session_id, rows_ms) for r in out if r.kind == "partial" for rows_ms in [next(x[5] for x in rows if x[:2] == (r.session_id, r.seq))]} == shown
    time_of = {(r[0], r[1]): r[5] for r in rows}
    commits = spark.createDataFrame([(r.session_id, r.seq, time_of[r.session_id, r.seq]) for r in out if r.kind == "commit"], "session_id long, at long, captured_ms long")
    finals = audio.dated_finals(commits, texts.where("final").select("session_id", F.col("seq").alias("at"), "text")).collect()
    # a final text that comes before its commit can't bear its time
    early = {(r.session_id, r.at): r.captured_ms for r in finals}
    for r in (r for r in out if r.kind == "final"):
        before = sorted(x.seq for x in out if x.kind == "commit" and x.session_id == r.session_id)
        number = [x.seq for x in sorted((x for x in out if x.kind in ("final",) and x.session_id == r.session_id), key=lambda x: x.seq)]
        assert (r.session_id, r.seq) in early and number and before
    # an utterance is the ring at its start and the blocks while speech goes on; of longer ones the end is kept
    for s in (1, 2):
        events = {seq: kind for session, seq, kind in told if session == s}
        ring, sent, speaking = [], [], False
        for _, seq, kind, samples, *_ in (r for r in rows if r[0] == s):
            if kind != "block":
                continue
            ring = (ring + samples)[-20:]
            event = events.get(seq)
            if event == "start":
                sent, ring, speaking = sent + ring, [], True
            elif event == "end":
                speaking = False
            elif speaking:
                sent += samples
            if event in ("end", "force"):
                commit = next(r for r in out if r.kind == "commit" and (r.session_id, r.seq) == (s, seq))
                assert commit.samples == sent[-50:]
                sent = []


def test_transcriber_dates_flushes_and_drops(spark, tmp_path):
    vad = streams.Vad(silence_ms=64, shortest_ms=32)
    block = lambda seq, p, now: (1, seq, "block", [float(seq)] * 4, p, now, None, None)
    text = lambda seq, now, words, final: (1, seq, "text", None, None, now, words, final)
    flush = (1, 12, "flush", [12.0], None, 400, None, None)
    first = [block(0, 0.1, 32), block(1, 0.9, 64), block(2, 0.9, 96), text(3, 100, "pa", False), text(4, 110, "part", False), block(5, 0.1, 128), block(6, 0.1, 160)]
    then = [block(7, 0.9, 192), text(8, 200, " hello ", True), text(9, 201, "again", False), block(10, 0.9, 224), flush]
    last = [text(13, 410, "dropped", False), text(14, 420, "bye", True), text(15, 430, "unasked", True), text(16, 440, " ", True), (1, 17, "reset", None, None, 450, None, None)]
    out = run_stream(spark, tmp_path, [frame(x, HEARD) for x in (first, then, last)], HEARD, lambda df: P.stateful(df, "session_id", L.Transcriber(vad, 6, 100, 50)))
    assert [(r.seq, r.kind, r.text, r.captured_ms) for r in out if r.kind != "commit"] == [
        (1, "start", None, None), (3, "partial", "pa", None), (6, "end", None, None), (7, "start", None, None), (8, "final", "hello", 160), (9, "partial", "again", None), (14, "final", "bye", 224), (15, "final", "unasked", 224),
    ]
    assert [(r.seq, r.samples) for r in out if r.kind == "commit"] == [(6, [0.0, 0.0, *[1.0] * 4, *[2.0] * 4, *[5.0] * 4]), (12, [*[6.0] * 2, *[7.0] * 4, *[10.0] * 4, 12.0])]


STREAM = "key string, at_ms long, kind string"


def test_two_phase_timeout_equals_batch(spark, tmp_path):
    rows = [
        ("quiet", 1_000, "request"), ("done", 1_000, "request"), ("done", 50_000, "token"), ("done", 60_000, "done"), ("slow", 1_000, "request"), ("slow", 121_000, "token"), ("slow", 181_001, "token"),
        ("slow", 190_000, "token"), ("late", 1_000, "request"), ("late", 121_001, "token"), ("late", 121_500, "done"), ("stall", 1_000, "request"), ("stall", 2_000, "token"), ("clock", 900_000, "request"), ("clock", 900_001, "done"),
    ]
    pdf = frame(rows, STREAM).sort_values("at_ms")
    want = {(r.key, r.expired_ms, r.phase) for r in audio.two_phase_timeouts(spark.createDataFrame(pdf, STREAM)).collect()}
    tick = frame([("clock", 2_000_000, "token")], STREAM)
    out = run_stream(spark, tmp_path, [*cut(pdf, "at_ms", 4), tick, tick], STREAM, lambda df: timed(df, L.TwoPhaseTimeout(), "key", "at_ms"))
    assert {(r.key, r.expired_ms, r.phase) for r in out} == want == {("quiet", 121_000, "startup"), ("slow", 181_000, "stalled"), ("late", 121_000, "startup"), ("stall", 62_000, "stalled")}
    assert len(out) == len(want)


WATCH = "session_id long, source string, at_ms long"


def test_stall_watch_equals_batch(spark, tmp_path):
    draw = random.Random(8)
    rows = []
    for s in range(12):
        at = 1_000
        for _ in range(40):
            at += draw.choice([100, 300, 1_000, 2_500, 7_000] if s % 3 else [100, 300, 900])
            rows.append((s, "system" if draw.random() < (0.2 if s % 2 else 0.6) else "mic", at))
        rows.append((s, "system", 1_000))  # rows at 0 would be late: that is where watermarks begin
    pdf = frame(rows, WATCH)
    over = pdf.groupby("session_id", as_index=False)["at_ms"].max().assign(source="end")
    over["at_ms"] = 400_000
    whole = spark.createDataFrame(pd.concat([pdf, over])[["session_id", "source", "at_ms"]], WATCH)
    want = sorted((r.session_id, r.at_ms, r.action) for r in audio.stall_actions(whole, 2_000, 2).collect())
    ticks = [frame([(99, "mic", t)], WATCH) for t in (399_999, 400_000)]
    out = run_stream(spark, tmp_path, [*cut(pdf, "at_ms", 4), *ticks], WATCH, lambda df: timed(df, L.StallWatch(2_000, 2), "session_id", "at_ms"))
    assert sorted((r.session_id, r.at_ms, r.action) for r in out if r.session_id != 99) == want
    assert {x[2] for x in want} == {"restart", "mic_only", "ended"}


EVENTS = "owner string, seq long, action string, task_id string, session_id string"


def test_replies_are_bounded_and_released(spark, tmp_path):
    draw = random.Random(9)
    rows = [(f"o{draw.randint(0, 2)}", k, draw.choice(["register", "register", "reply", "reply", "message", "saved", "failed", "open", "close"]), f"t{draw.randint(0, 11)}", draw.choice("ssu")) for k in range(600)]
    pdf = frame(rows, EVENTS)
    want = {(r.owner, r.seq): (r.outcome, r.evicted) for r in replies.routed(spark.createDataFrame(pdf, EVENTS), 4, 3).collect()}
    out = run_stream(spark, tmp_path, cut(pdf, "seq"), EVENTS, lambda df: P.stateful(df, "owner", Replies(4, 3)))
    assert {(r.owner, r.seq): (r.outcome, r.evicted) for r in out} == want and len(out) == 600
    assert {o for o, _ in want.values()} >= {"registered", "known", "accepted", "already_finalized", "unregistered_task", "session_mismatch", "finalized", "released", "opened", "refused", "closed", "already_closed", "unknown_turn", "part"}
    assert sum(e is not None for _, e in want.values()) > 20


def test_a_reply_survives_a_failed_save_and_a_restart(spark, tmp_path):
    steps = [("register", "s", "registered"), ("reply", "u", "session_mismatch"), ("reply", "s", "accepted"), ("reply", "s", "already_finalized"), ("failed", "s", "released"), ("reply", "s", "accepted"), ("saved", "s", "finalized"), ("reply", "s", "already_finalized"), ("register", "s", "registered"), ("reply", "s", "already_finalized")]
    frames = [frame([("o", k, action, "t", session)], EVENTS) for k, (action, session, _) in enumerate(steps)]
    out = run_stream(spark, tmp_path, frames, EVENTS, lambda df: P.stateful(df, "owner", Replies()))
    assert [r.outcome for r in sorted(out, key=lambda r: r.seq)] == [outcome for *_, outcome in steps]


def test_the_oldest_of_many_tasks_makes_room(spark, tmp_path):
    # as processing time goes on by itself, batches without rows would never end
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    rows = [("o", k, "register", f"t{k}", "s") for k in range(46)] + [("o", 100, "reply", "t5", "s"), ("o", 101, "reply", "t6", "s")]
    out = run_stream(spark, tmp_path, cut(frame(rows, EVENTS), "seq", 2), EVENTS, lambda df: P.stateful(df, "owner", Replies(40, ttl_ms=86_400_000), "ProcessingTime"))
    evicted = [r.evicted for r in sorted(out, key=lambda r: r.seq) if r.evicted is not None]
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert evicted == [f"t{k}" for k in range(6)] and replies.CAPACITY == 1_024
    assert {r.seq: r.outcome for r in out if r.seq >= 100} == {100: "unregistered_task", 101: "accepted"}


def gated_by_hand(near, far):
    """One window by the formulas, sum by sum."""
    n = len(near)
    level = lambda x: (sum(v * v for v in x) / n) ** 0.5
    if any(v != v for v in far) or level(far) < 1e-4 or level(near) >= 2 * level(far) or level(near) >= 3e-3:
        return None
    scores = []
    for lag in range(1 - n, n):
        met = [(near[i], far[i + lag]) for i in range(n) if 0 <= i + lag < n]
        energy = sum(f * f for _, f in met)
        scores.append(abs(sum(a * f for a, f in met)) / energy**0.5 if energy > 1e-9 else 0.0)
    lag = scores.index(max(scores)) - n + 1
    far = [far[i + lag] if 0 <= i + lag < n else 0.0 for i in range(n)]
    size = n // 2
    hann = [0.5 - 0.5 * np.cos(2 * np.pi * i / size) for i in range(size)]
    total, count = 0.0, 0
    for b in range(int(300 * size / 16_000), int(np.ceil(3_400 * size / 16_000))):
        wave = np.exp(-2j * np.pi * b * np.arange(size) / size)
        x, y = ([sum(side[k * size // 2 + i] * hann[i] * wave[i] for i in range(size)) for k in range(3)] for side in (near, far))
        power = sum(abs(v) ** 2 for v in x) * sum(abs(v) ** 2 for v in y)
        if power > 1e-9:
            total, count = total + abs(sum(a * v.conjugate() for a, v in zip(x, y, strict=True))) ** 2 / power, count + 1
    coherence = total / count if count else 0.0
    t = min(max((coherence - 0.65) / 0.35, 0), 1)
    return 10 ** (-18 * t * t * (3 - 2 * t) / 20) if coherence >= 0.65 else None


def test_reference_gate_end_to_end(spark):
    draw = np.random.default_rng(10)
    size, windows = 64, 14
    far = draw.normal(0, 0.2, size * windows)
    near = 0.005 * np.concatenate([np.zeros(3), far])[: size * windows] + draw.normal(0, 1e-4, size * windows)
    near[size * 4 : size * 6] = draw.normal(0, 0.001, size * 2)  # no echo
    near[size * 7 : size * 8] += 0.1  # somebody speaks
    far[size * 9 : size * 10] = 1e-6  # silence
    chunk = lambda line, a, b, at: (1, at, a, line[a:b].tolist())
    kind = "session_id long, at long, start long, samples array<double>"
    left = spark.createDataFrame([chunk(near, 0, 500, 0), chunk(near, 500, size * windows - 20, 1)], kind)
    right = spark.createDataFrame([chunk(far, 0, size * 11, 0), chunk(far, size * 11 + 5, size * windows, 1)], kind)  # five samples are lost
    got = R.reference_gated(left, right, size).orderBy("block").collect()
    want, gain = [], 1.0
    for w in range(windows - 1):
        heard = [float("nan")] if w == 11 else far[size * w : size * w + size].tolist()
        target = gated_by_hand(near[size * w : size * w + size].tolist(), heard)
        gain += (0.2 if (target or 1.0) < gain else 0.5) * ((target or 1.0) - gain)
        want.append((target, gain))
    assert [r.block for r in got] == list(range(windows)) and len(got[-1].samples) == size - 20
    assert [r.gain for r in got] == pytest.approx([g for _, g in want] + [gain])
    assert [(r.target is None) for r in got[:-1]] == [t is None for t, _ in want] and sum(t is not None for t, _ in want) >= 6
    assert [r.target for r in got[:-1] if r.target is not None] == pytest.approx([t for t, _ in want if t is not None])
    line = np.concatenate([r.samples for r in got])
    assert line == pytest.approx(near[: len(line)] * np.repeat([r.gain for r in got], size)[: len(line)])


SPOKEN = "session_id long, idx long, embedding array<double>"


def test_speakers_as_they_speak_and_after_the_session(spark, tmp_path):
    draw = np.random.default_rng(12)
    voices = np.eye(4, 6)
    said = [(s, i, (voices[draw.integers(0, 3) if s == 1 else 3] * draw.uniform(1, 2) + draw.normal(0, 0.1, 6)).tolist()) for s in (1, 2) for i in range(30)]
    pdf = frame(said + [(s, 99, None) for s in (1, 2)], SPOKEN)
    whole = spark.createDataFrame(frame(said, SPOKEN), SPOKEN)
    out = run_stream(spark, tmp_path, cut(pdf, "idx"), SPOKEN, lambda df: P.stateful(df, "session_id", L.SpeakerClusters(0.8)))
    want = {(r.session_id, r.idx): r.cluster for r in speakers.session_clusters(whole, 0.8).collect()}
    assert {(r.session_id, r.idx): r.cluster for r in out if r.idx is not None} == want
    ends = [(r.session_id, r.cluster, r.centroid, r.n) for r in out if r.idx is None]
    for s, k, centroid, n in ends:
        members = [e for session, i, e in said if session == s and want[s, i] == k]
        assert n == len(members) and centroid == pytest.approx(np.mean(members, axis=0))
    assert len(ends) == 4
    known = spark.createDataFrame([("ann", 0, "Ann", voices[0].tolist(), 10), ("bob", 1, "Bob", voices[1].tolist(), 5), ("eve", 2, "Eve", (-voices[2]).tolist(), 1)], "speaker_id string, rank int, label string, centroid array<double>, sample_count long")
    clusters = spark.createDataFrame(ends, "session_id long, cluster long, centroid array<double>, n long")
    found = speakers.identified(clusters, known, 0.7)
    names = {(r.session_id, r.cluster): r.speaker_id for r in found.collect()}
    prints = {r.speaker_id: r for r in speakers.folded(known.drop("rank"), found).collect()}
    assert {"ann", "bob"} <= set(names.values()) and sum(n.startswith("new:") for n in names.values()) == 2 and len(prints) == 5
    for speaker, before, size in (("ann", voices[0], 10), ("bob", voices[1], 5)):
        (s, k), = [key for key, name in names.items() if name == speaker]
        _, _, centroid, n = next(e for e in ends if e[:2] == (s, k))
        assert prints[speaker].sample_count == size + n and prints[speaker].centroid == pytest.approx((before * size + np.array(centroid) * n) / (size + n))
    assert prints["eve"].sample_count == 1 and all(prints[n].sample_count == next(e[3] for e in ends if e[:2] == key) for key, n in names.items() if n.startswith("new:"))
