"""Continuous operators give what their batch forms give."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from parley.functions import arrays as A
from parley.operators import streams
from parley.streaming import processors as P


def run_stream(spark, tmp_path, frames, schema, build):
    """Write each frame as one file, read them as a stream of one file a batch, and return the rows of the query."""
    P.use_rocksdb(spark)
    folder = tmp_path / "in"
    for i, pdf in enumerate(frames):
        spark.createDataFrame(pdf, schema).coalesce(1).write.mode("append").parquet(str(folder / f"b={i:03d}"))
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
    out = []
    query = build(rows).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return out


def test_segmenter_equals_fold(spark, tmp_path):
    draw = random.Random(3)
    rows = [(s, i, draw.choice([0.1, 0.9, 0.9, 0.2])) for s in range(3) for i in range(120)]
    vad = streams.Vad(silence_ms=96, late_silence_ms=64, late_after_ms=256, longest_ms=640, shortest_ms=64)
    schema = "session_id long, chunk_idx long, speech_prob double"
    pdf = pd.DataFrame(rows, columns=["session_id", "chunk_idx", "speech_prob"])
    batch = {tuple(r) for r in streams.speech_events(spark.createDataFrame(pdf, schema), vad).collect()}
    frames = [pdf[pdf.chunk_idx // 40 == k] for k in range(3)]
    live = run_stream(spark, tmp_path, frames, schema, lambda df: P.stateful(df, "session_id", P.Segmenter(vad)))
    assert {(r.session_id, r.chunk_idx, r.event) for r in live} == batch and batch


ROWS = "session_id long, kind string, source int, text string, captured_ms long, now_ms long, arrival long"
COLUMNS = [c.split()[0] for c in ROWS.split(", ")]


def ordered(df, wait, expected=(0, 1)):
    return P.stateful(df.withColumn("now", F.timestamp_millis("now_ms")).withWatermark("now", "0 seconds"), "session_id", P.Orderer(wait, expected), "EventTime")


def test_orderer_releases_in_time_and_marks_late(spark, tmp_path):
    first = pd.DataFrame([(1, "utterance", 0, " b ", 200, 200, 0), (1, "utterance", 1, "a", 100, 210, 1), (1, "progress", 1, None, 150, 220, 2), (1, "progress", 0, None, 150, 221, 3)], columns=COLUMNS)
    second = pd.DataFrame([(1, "utterance", 0, "c", 900, 5000, 4), (1, "utterance", 0, "d", 6000, 6000, 5), (1, "utterance", 0, " ", 1, 6000, 6), (1, "end", 0, None, 0, 6001, 7)], columns=COLUMNS)
    out = run_stream(spark, tmp_path, [first, second], ROWS, lambda df: ordered(df, 1000))
    assert [(r.text, r.late) for r in out] == [("a", False), ("b", True), ("c", True), ("d", False)]


def test_orderer_expects_the_sources_it_is_told_of(spark, tmp_path):
    rows = pd.DataFrame([(1, "utterance", 0, "x", 500, 500, 0), (1, "progress", 0, None, 600, 600, 1), (1, "utterance", 0, "y", 650, 660, 2)], columns=COLUMNS)
    alone = run_stream(spark, tmp_path / "a", [rows], ROWS, lambda df: ordered(df, 10_000, (0,)))
    assert [(r.text, r.late) for r in alone if r.text == "x"] == [("x", False)]
    none = run_stream(spark, tmp_path / "b", [rows], ROWS, lambda df: ordered(df, 10_000, ()))
    assert [(r.text, r.late) for r in none] == [("x", False), ("y", False)]


def test_orderer_releases_a_quiet_session_by_its_timer(spark, tmp_path):
    """Nothing more comes for session 1; time goes on by what comes for another."""
    first = pd.DataFrame([(1, "utterance", 0, "held", 1_000, 1_000, 0)], columns=COLUMNS)
    later = pd.DataFrame([(2, "progress", 0, None, 1, 60_000, 1)], columns=COLUMNS)
    out = run_stream(spark, tmp_path, [first, later, later.assign(now_ms=61_000, arrival=2)], ROWS, lambda df: ordered(df, 5_000))
    assert [(r.session_id, r.text, r.late) for r in out] == [(1, "held", True)]


def test_resampler_equals_one_shot(spark, tmp_path):
    draw = random.Random(6)
    chunks = [[draw.uniform(-1, 1) for _ in range(draw.randint(0, 30))] for _ in range(20)]
    schema = "session_id long, at long, samples array<double>"
    rows = pd.DataFrame([(s, i, c) for s in (1, 2) for i, c in enumerate(chunks)] + [(s, 99, None) for s in (1, 2)], columns=["session_id", "at", "samples"])
    frames = [rows[rows["at"] < 7], rows[(rows["at"] >= 7) & (rows["at"] < 15)], rows[rows["at"] >= 15]]
    for from_rate, to_rate in ((48_000, 16_000), (16_000, 44_100)):
        out = run_stream(spark, tmp_path / str(to_rate), frames, schema, lambda df: P.stateful(df, "session_id", P.Resampler(from_rate, to_rate)))  # noqa: B023
        whole = spark.createDataFrame([(sum(chunks, []),)], "s array<double>").select(A.resampled(F.col("s"), from_rate, to_rate).alias("r")).first()["r"]
        for s in (1, 2):
            got = [x for r in sorted((r for r in out if r.session_id == s), key=lambda r: r.at) for x in r.samples]
            assert got == pytest.approx(whole)


def test_terminal_events_once_across_batches(spark, tmp_path):
    schema = "task_id string, seq long, early string"
    columns = ["task_id", "seq", "early"]
    frames = [pd.DataFrame([("t", 1, "dropped"), ("t", 2, None)], columns=columns), pd.DataFrame([("t", 3, None), ("u", 4, None)], columns=columns)]
    out = run_stream(spark, tmp_path, frames, schema, lambda df: P.stateful(df, "task_id", P.FinalOnce()))
    assert {(r.seq, r.disposition) for r in out} == {(1, "dropped"), (2, "accepted"), (3, "already_finalized"), (4, "accepted")}


def test_turns(spark, tmp_path):
    schema = "turn_id string, seq long, action string, text string"
    rows = [("t", 1, "register", None), ("t", 2, "delta", "ab"), ("t", 3, "register", None), ("t", 4, "resume", None), ("t", 5, "reply", "abc"), ("t", 6, "delta", "x")]
    pdf = pd.DataFrame(rows, columns=["turn_id", "seq", "action", "text"])
    out = run_stream(spark, tmp_path, [pdf[:3], pdf[3:]], schema, lambda df: P.stateful(df, "turn_id", P.Turns()))
    assert [(r.seq, r.type, r.text) for r in out] == [
        (1, "start", ""), (2, "text-delta", "ab"), (3, "refused", ""), (4, "start", ""), (4, "text-start", ""), (4, "text-delta", "ab"), (5, "text-delta", "c"), (5, "text-end", ""), (5, "finish", ""),
    ]


def test_watchdog_equals_gaps(spark, tmp_path):
    schema = "session_id long, event_id long, at_ms long"
    pdf = pd.DataFrame([(1, 0, 1_000), (1, 1, 2_000), (1, 2, 90_000), (2, 3, 5_000), (2, 4, 95_000), (3, 5, 400_000)], columns=["session_id", "event_id", "at_ms"])
    gaps = {(r.session_id, r.expired_ms) for r in streams.idle_gaps(spark.createDataFrame(pdf, schema), 30_000).collect()}

    def build(df):
        return P.stateful(df.withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", "0 seconds"), "session_id", P.Watchdog(30_000), "EventTime")

    out = run_stream(spark, tmp_path, [pdf[:2], pdf[2:5], pdf[5:]], schema, build)
    assert gaps <= {(r.session_id, r.expired_ms) for r in out}


def test_bursts_close(spark, tmp_path):
    schema = "session_id long, event_id long, at_ms long"
    pdf = pd.DataFrame([(1, 0, 0), (1, 1, 100), (1, 2, 1_000), (1, 3, 600_000)], columns=["session_id", "event_id", "at_ms"])
    batch = streams.bursts(spark.createDataFrame(pdf, schema), 300).orderBy("burst").collect()
    out = run_stream(spark, tmp_path, [pdf[:3], pdf[3:]], schema, lambda df: P.burst_windows(df.withColumn("at", F.timestamp_millis("at_ms"))))
    assert sorted(r.n for r in out) == sorted(r.n for r in batch)[1:] == [1, 2]


@pytest.mark.parametrize("wait", [0, 500])
def test_batch_order_holds_what_is_not_settled(spark, wait):
    kind = "session_id long, kind string, source int, captured_ms long, now_ms long, arrival long"
    rows = spark.createDataFrame([(1, "utterance", 0, 500, 500, 0), (1, "progress", 1, 300, 600, 1), (1, "progress", 0, 350, 620, 2), (1, "utterance", 1, 700, 800, 3), (1, "progress", 1, 900, 2_000, 4)], kind)
    out = streams.settled(rows, wait).orderBy("arrival").collect()
    assert [r.settled_ms for r in out] == [0, 0, 300, 300, 350]
    assert [r.held for r in out] == ([False] * 5 if not wait else [True, False, False, True, False])
    assert streams.settled(rows, wait, ()).where("held or late").count() == 0
    found = {r.arrival: (r.released_by, r.late) for r in streams.released(rows, 500).collect()}
    assert found == {0: (4, True), 3: (4, True)}


def test_batch_release_drops_blanks_and_follows_a_clock_that_steps_back(spark):
    rows = [
        (1, "utterance", 0, "a", 500, 9_000, 0), (1, "utterance", 0, "  ", 100, 9_000, 1), (1, "utterance", 1, None, 100, 9_000, 2), (1, "utterance", 0, "b", 4_000, 2_000, 3),
        (1, "utterance", 1, "c", 7_500, 2_500, 4), (1, "utterance", 1, "d", 900, 2_600, 5), (1, "progress", 1, None, 0, 5_200, 6),
    ]
    found = {r.arrival: (r.released_by, r.late) for r in streams.released(spark.createDataFrame(rows, ROWS), 1_000).collect()}
    assert found == {0: (0, True), 3: (6, True), 4: (None, None), 5: (5, True)}
    assert {(r.n_released, r.n_late) for r in streams.late_counts(streams.released(spark.createDataFrame(rows, ROWS), 1_000)).collect()} == {(3, 3)}


def test_a_turn_of_many_deltas_is_joined_once(spark):
    """Texts of 50,000 deltas; what a resume replays is cut from the joined text."""
    n = 50_000
    rows = spark.range(n).selectExpr("'t' as turn_id", "id + 1 as seq", "case when id = 0 then 'register' when id = 30000 then 'resume' when id = 49998 then 'reply' else 'delta' end as action", "if(id = 49998, 'other', concat('d', id)) as text")
    out = streams.turn_outputs(rows).where("type in ('text-delta', 'finish')").where("seq in (30001, 49999)").orderBy("seq", "n").collect()
    said = "".join(f"d{i}" for i in range(1, 30_000))
    assert [(r.seq, r.type, r.text) for r in out] == [(30_001, "text-delta", said), (49_999, "text-delta", "\n\nother"), (49_999, "finish", "")]


def test_release_streams_sessions_and_is_worked_out_once(spark):
    """Sessions pass on over batches of three rows; an utterance without a time stays; no group of a session is made."""
    chance = random.Random(5)
    rows = [(i % 4, chance.choice(["utterance", "utterance", "progress"]), i % 2, chance.choice([None, *range(0, 4_000, 100)]), i * 40 - chance.choice([0, 0, 900]), i) for i in range(120)]
    want = {}
    for session in range(4):
        reached, waiting = {0: 0, 1: 0}, []
        for _, kind, source, captured, now, arrival in rows[session::4]:
            if kind == "progress":
                reached[source] = max(reached[source], captured or 0)
            else:
                waiting.append((captured, arrival))
                want[session, arrival] = (None, None)
            bound = max(*[min(reached.values())], now - 1_000)
            for at, first in [x for x in waiting if x[0] is not None and x[0] <= bound]:
                waiting.remove((at, first))
                want[session, first] = (arrival, at > min(reached.values()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        found = streams.with_late_counts(streams.released(spark.createDataFrame(rows, ROWS.replace("text string, ", "")), 1_000))
        got = found.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {(r.session_id, r.arrival): (r.released_by, r.late) for r in got} == want
    counts = {s: (sum(k[0] == s and v[0] is not None for k, v in want.items()), sum(k[0] == s and bool(v[1]) for k, v in want.items())) for s in range(4)}
    assert all((r.n_released, r.n_late) == counts[r.session_id] for r in got)
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("MapInArrow") == 1 and "FlatMapGroups" not in plan
