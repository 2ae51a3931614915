"""Operators on literal rows."""

import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley import schemas as S
from parley.functions import arrays as A
from parley.operators import catalogs, chats, insights, sessions, speakers, streams, transcripts, vocabulary
from parley.sources import audio
from parley.sources.sessions import demo_sessions, read_sessions, session_files
from parley.sources.store import SessionStore, SummaryIndex, save_stream

SF = "/root/testdata/sf0.001"


def segments(spark, lengths):
    return spark.createDataFrame([("s", i, "you", "x" * n) for i, n in enumerate(lengths)], "session_id string, seg_index long, source string, utterance string")


@pytest.mark.parametrize(("lengths", "end"), [([100] * 10, None), ([1000] * 10, 5)])
def test_next_block_end(spark, lengths, end):
    assert transcripts.next_block_end(segments(spark, lengths)).first()["block_end"] == end


def test_blocks_pack_one_after_the_other(spark):
    out = transcripts.packed_blocks(segments(spark, [1000] * 20)).orderBy("block").collect()
    assert [(r.start_index, r.end_index) for r in out] == [(0, 5), (5, 10), (10, 15), (15, 20)]


@pytest.mark.parametrize(("blocks", "want"), [([(0, 5), (5, 9), (20, 30)], (30, 2, 9)), ([(3, 8), (8, 12)], (12, 0, 0))])
def test_coverage(spark, blocks, want):
    rows = spark.createDataFrame([("s", k, a, b) for k, (a, b) in enumerate(blocks)], "session_id string, block long, start_index long, end_index long")
    out = transcripts.coverage(rows).first()
    assert (out.covered_to, out.used, out.contiguous_to) == want


def test_severity_and_no_signal(spark):
    rows = spark.createDataFrame([("RED", " no_signal. "), ("blue", "No Signal"), ("Orange", "signal")], "s string, m string")
    out = rows.select(transcripts.severity(F.col("s")).alias("s"), transcripts.is_no_signal(F.col("m")).alias("n")).collect()
    assert [tuple(r) for r in out] == [("red", True), ("green", True), ("orange", False)]


@pytest.mark.parametrize("most", [1, 2, 3, 5, 25])
@pytest.mark.parametrize("chars", [0, 10, 100, 1000])
def test_history_starts_with_user_and_alternates(spark, most, chars):
    rows = [("s", p, part, role, f"{role} {p} " + "x" * (p * 7 % 40)) for p in range(8) for part, role in enumerate(("user", "assistant")) if part == 0 or p % 3]
    out = chats.within_budget(spark.createDataFrame(rows, "session_id string, pos long, part int, role string, content string"), most, chars).orderBy("run").collect()
    roles = [r.role for r in out]
    assert roles == ["user", "assistant"] * (len(roles) // 2) + ["user"] * (len(roles) % 2)


def note(offset, message, id=None, producer=None, verdict=None):
    rating = None if verdict is None else (verdict, "2026", "library", False)
    return (offset, "green", message, None, id, producer, rating, False)


def test_insight_upsert(spark):
    kind = f"array<{S.INSIGHT}>"
    rows = spark.createDataFrame([([note(1, "a"), note(2, "b", "i2", "signals", "helpful")], [note(1, "a", "i1", "assistant", "dismissed"), note(9, "b", "i2", "assistant"), note(3, "c"), note(1, "a")])], f"old {kind}, new {kind}")
    out = rows.select(insights.upserted(F.col("old"), F.col("new")).alias("n")).first()["n"]
    assert [(n.id, n.message, n.producer, n.feedback.verdict if n.feedback else None) for n in out] == [("i1", "a", "assistant", "dismissed"), ("i2", "b", "signals", None), (None, "c", None, None)]


def test_repeats_compare_with_the_last_kept(spark):
    notes = [note(1, "a", "x"), note(2, "b", "x"), note(3, "a", "y"), note(4, "c", "y"), note(5, "c", "z")]
    out = spark.createDataFrame([(notes,)], f"n array<{S.INSIGHT}>").select(insights.without_repeats(F.col("n")).alias("n")).first()["n"]
    assert [n.offset_ms for n in out] == [1, 4]


def test_feedback_and_outcomes(spark):
    row = spark.createDataFrame([(note(1, "a", "i", "signals"), note(2, "b", "j", "assistant"))], f"s {S.INSIGHT}, a {S.INSIGHT}")
    for name, waits in (("s", True), ("a", False)):
        rated = insights.rated(F.col(name), F.lit("helpful"), F.lit("t1"), F.lit("live"), F.lit(True))
        settled = insights.settled(rated, F.struct(F.lit("helpful").alias("verdict"), F.lit("t1").alias("rated_at")))
        stale = insights.settled(rated, F.struct(F.lit("helpful").alias("verdict"), F.lit("t0").alias("rated_at")))
        gone = insights.rated(rated, F.lit(None).cast("string"), F.lit("t2"), F.lit("live"), F.lit(True))
        out = row.select(rated.alias("r"), settled.alias("s2"), stale.alias("s3"), gone.alias("g")).first()
        assert (out.r.feedback.publish_pending, out.s2.feedback.publish_pending, out.s3.feedback.publish_pending) == (waits, False, waits)
        assert out.g.feedback is None and out.g.feedback_withdraw_pending == waits
    label = lambda value, by: (value, "t", by, None, True)
    cases = [(None, label("good", "crm"), "recorded"), (label("good", "user"), label("bad", "crm"), "refused"), (label("good", "crm"), label("bad", "user"), "recorded"), (label("good", "crm"), label("good", "crm"), "unchanged"), (label("good", "crm"), None, "not_offered")]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], f"i int, a {S.LABEL}, b {S.LABEL}")
    assert [r.w for r in rows.select("i", insights.label_write(F.col("a"), F.col("b")).alias("w")).orderBy("i").collect()] == [w for *_, w in cases]


def test_split_then_merge_keeps_segments(spark):
    rows = demo_sessions(spark, SF)
    parts = sessions.split(rows, F.lit(2))
    whole = {r.session_id: r for r in rows.collect()}
    a = {r.session_id[:-2]: r for r in parts.where("session_id like '%-a'").collect()}
    b = {r.session_id[:-2]: r for r in parts.where("session_id like '%-b'").collect()}
    assert set(a) == set(b) == {k for k, r in whole.items() if len(r.segments) > 2}
    assert all(a[k].segments + b[k].segments == whole[k].segments and b[k].outcome is None and a[k].outcome == whole[k].outcome for k in a)
    pairs = parts.where("session_id like '%-b'").select(F.left("session_id", F.lit(7)).alias("k"), F.struct(*parts.columns).alias("first")).join(parts.where("session_id like '%-a'").select(F.left("session_id", F.lit(7)).alias("k"), F.struct(*parts.columns).alias("second")), "k")
    merged = sessions.merge(pairs.select(F.col("second").alias("first"), F.col("first").alias("second"))).collect()
    assert all(r.segments == whole[r.session_id[:7]].segments for r in merged)


def test_renaming_reaches_every_session(spark):
    seg = lambda speaker: ("you", "hi", speaker, None)
    rows = spark.createDataFrame([("s1", [seg("a"), seg("b")]), ("s2", [seg("a"), seg(None)]), ("s3", [seg("c")])], f"session_id string, segments array<{S.SEGMENT}>")
    out = sessions.renamed_speaker(rows, spark.createDataFrame([("a", "Ann"), ("zz", "No")], "speaker_id string, label string"))
    assert {r.session_id: [s.speaker_label for s in r.segments] for r in out.collect()} == {"s1": ["Ann", None], "s2": ["Ann", None], "s3": [None]}


def test_store_versions_reads_and_feed(spark, tmp_path):
    rows = demo_sessions(spark, SF)
    store = SessionStore(spark, f"file://{tmp_path}/store", S.SESSION, buckets=4)
    assert store.save(rows) == 1 and store.read().count() == rows.count()
    assert store.save(rows.limit(1).withColumn("title", F.lit("new"))) == 2
    changed = store.changes(after=1).collect()
    assert [r.kind for r in changed] == ["saved"] and store.get(changed[0].session_id).first()["title"] == "new"
    assert store.delete(spark.createDataFrame([(changed[0].session_id,), ("unknown",)], "session_id string")) == 3
    assert store.get(changed[0].session_id).count() == 0 and store.read().count() == rows.count() - 1
    assert store.delete(spark.createDataFrame([("unknown",)], "session_id string")) == 3
    assert store.save(rows.limit(1).withColumn("session_id", F.lit("../x"))) == 3
    assert store.library().count() == rows.count() - 1


@pytest.mark.parametrize("step", ["_stage", "_write", "_feed", "_publish"])
def test_store_goes_on_after_a_change_that_broke_off(spark, tmp_path, monkeypatch, step):
    rows = demo_sessions(spark, SF)
    store = SessionStore(spark, f"file://{tmp_path}/store", buckets=2)
    store.save(rows.limit(3))
    whole = getattr(SessionStore, step)

    def broken(self, *args):
        if step != "_publish":
            whole(self, *args)
        raise OSError("lost")

    monkeypatch.setattr(SessionStore, step, broken)
    with pytest.raises(OSError, match="lost"):
        store.save(rows.withColumn("title", F.lit("lost")))
    monkeypatch.setattr(SessionStore, step, whole)
    again = SessionStore(spark, f"file://{tmp_path}/store", buckets=2)
    assert again.version() == 1 and again.read().count() == 3 and again.changes().count() == 3
    assert again.save(rows.limit(4).withColumn("title", F.lit("new"))) == 2
    assert {r.title for r in again.read().collect()} >= {"new"} and "lost" not in {r.title for r in again.read().collect()}
    assert again.changes(after=1).count() == 4


def test_save_stream_keeps_the_last_and_saves_a_batch_once(spark, tmp_path):
    kind = "session_id string, title string, at long"
    spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("b", "x", 1)], kind).coalesce(1).write.parquet(f"{tmp_path}/in")
    store = SessionStore(spark, f"file://{tmp_path}/store", "session_id string, title string", buckets=2)
    rows = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
    for checkpoint in ("one", "two"):  # the second run has lost its checkpoint and sees batch 0 again
        query = save_stream(store, rows, f"{tmp_path}/{checkpoint}", "at")
        query.processAllAvailable()
        query.stop()
    assert store.version() == 1 and {r.session_id: r.title for r in store.read().collect()} == {"a": "new", "b": "x"}


def test_index_of_another_version_is_none(spark, tmp_path):
    kind = "session_id string, len long, modified_ms long"
    stats = spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], kind)
    summaries = spark.createDataFrame([("a", "A"), ("b", "B")], "session_id string, summary string")
    index = SummaryIndex(spark, f"file://{tmp_path}/index", "string")
    assert index.load().count() == 0
    index.save(index.refreshed(stats, summaries))
    assert {r.session_id: r.summary for r in index.refreshed(stats, summaries.where("session_id = 'zz'")).collect()} == {"a": "A", "b": "B"}
    assert SummaryIndex(spark, f"file://{tmp_path}/index", "string", format_version=99).load().count() == 0


def test_session_documents_with_defaults(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"session_id": "a", "ended_at": "2026", "segments": [], "future": 1, "insights": [{"offset_ms": 1, "message": "m", "severity": "red", "producer": "robot", "feedback": {"verdict": "meh"}}]}')
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.txt").write_text("{}")
    assert {r.session_id for r in session_files(spark, f"file://{tmp_path}").collect()} == {"a", "b"}
    out = read_sessions(spark, f"file://{tmp_path}").collect()
    assert len(out) == 1 and out[0].chat == [] and out[0].title_is_auto is False and out[0].relay_session_id == "a"
    assert out[0].insights[0].producer is None and out[0].insights[0].feedback is None and out[0].insights[0].feedback_withdraw_pending is False


def test_index_is_refreshed_where_files_changed(spark):
    kind = "session_id string, len long, modified_ms long"
    stats = spark.createDataFrame([("same", 1, 1), ("longer", 2, 1), ("later", 1, 2), ("new", 1, 1)], kind)
    index = spark.createDataFrame([("same", 1, 1, "old"), ("longer", 1, 1, "old"), ("later", 1, 1, "old"), ("gone", 1, 1, "old")], f"{kind}, summary string")
    assert {r.session_id: r.action for r in sessions.index_plan(stats, index).collect()} == {"same": "reuse", "longer": "refresh", "later": "refresh", "new": "add", "gone": "drop"}
    read = spark.createDataFrame([(s, "fresh") for s in ("longer", "later", "new")], "session_id string, summary string")
    assert {r.session_id: r.summary for r in sessions.refreshed_index(stats, index, read).collect()} == {"same": "old", "longer": "fresh", "later": "fresh", "new": "fresh"}


def by_runs(probabilities, vad):
    """Events from the runs of speech and silence: of each stretch the chunks up to the next cut or long enough silence."""
    speech = [p >= vad.threshold for p in probabilities]
    longest, late, shortest = vad.chunks(vad.longest_ms), vad.chunks(vad.late_after_ms), vad.chunks(vad.shortest_ms)
    allowed = lambda n: min(vad.chunks(vad.late_silence_ms), vad.chunks(vad.silence_ms)) if n >= late else vad.chunks(vad.silence_ms)
    out, first = [], None
    while True:
        if first is None:
            opening = next((i for i in range(out[-1][0] + 1 if out else 0, len(speech)) if speech[i]), None)
            if opening is None:
                return [x for x in out if x[1] != "faded"]
            out.append((opening, "start"))
            first = opening
        trailing = lambda i: next((n for n in range(i - first + 1) if speech[i - n]), i - first + 1)
        over = next((i for i in range(max(first, out[-1][0] + 1), len(speech)) if i - first + 1 >= longest or trailing(i) >= allowed(i - first + 1)), None)
        if over is None:
            return [x for x in out if x[1] != "faded"]
        if over - first + 1 >= longest:
            out.append((over, "force"))
            first = over + 1
        else:
            out.append((over, "end" if sum(speech[first : over + 1]) >= shortest else "faded"))
            first = None


@pytest.mark.parametrize("vad", [streams.Vad(), streams.Vad(silence_ms=96, late_silence_ms=64, late_after_ms=256, longest_ms=640)])
def test_speech_events(spark, vad):
    draw = np.random.default_rng(4)
    runs = [np.full(n, p) for n, p in zip(draw.integers(1, 40, 60), draw.choice([0.1, 0.9], 60), strict=True)]
    p = np.concatenate([*runs, np.full(1200, 0.9)])
    frames = spark.createDataFrame([("s", i, float(x)) for i, x in enumerate(p)], "session_id string, chunk_idx long, speech_prob double")
    out = streams.speech_events(frames, vad).orderBy("chunk_idx").collect()
    assert [(r.chunk_idx, r.event) for r in out] == by_runs(p, vad) and any(r.event == "force" for r in out)


@pytest.mark.parametrize(("pairs", "frame"), [([(1, 0), (1, 0)], 0), ([(1, 0), (1, 0), (0, 0)], 1), ([(1, 3), (0, 2)], 5), ([(1, 0)] * 9, 0), ([(1, 0)] * 10, 1)])
def test_frame_cursor(spark, pairs, frame):
    rows = spark.createDataFrame([(pairs,)], "t array<struct<token:int,duration:int>>")
    assert rows.select(streams.frame_cursor(F.col("t"), 0).alias("f")).first()["f"] == frame


def test_notes_lifecycle(spark):
    rows = [("s", 1, "pending", None), ("s", 2, "completed", "first"), ("s", 3, "pending", None), ("s", 4, "errored", None), ("t", 1, "completed", " ")]
    out = {r.session_id: (r.status, r.notes) for r in streams.notes_lifecycle(spark.createDataFrame(rows, "session_id string, seq long, status string, text string")).collect()}
    assert out == {"s": ("errored", "first"), "t": ("completed", None)}


def test_clusters_and_voiceprints(spark):
    vectors = [[1.0, 0.0, 0.0], [0.98, 0.02, 0.0], [0.0, 1.0, 0.0]]
    rows = spark.createDataFrame([("s", i, v) for i, v in enumerate(vectors)], "session_id string, idx long, embedding array<double>")
    assert [r.cluster for r in speakers.session_clusters(rows, 0.8).orderBy("idx").collect()] == [0, 0, 1]
    prints = spark.createDataFrame([("p0", 0, "Ann", [1.0, 0.0, 0.0]), ("p1", 1, "Twin", [1.0, 0.0, 0.0]), ("p2", 2, "Bob", [0.5, 0.5, 0.0])], "speaker_id string, rank long, label string, centroid array<double>")
    for at_once in (100, 1):
        out = {r.idx: (r.speaker_id, r.label) for r in speakers.best_prints(rows, prints, 0.6, at_once).collect()}
        assert out == {0: ("p0", "Ann"), 1: ("p0", "Ann"), 2: ("p2", None)}
    assert spark.createDataFrame([([0.0, 0.0], [2.0, 4.0])], "a array<double>, b array<double>").select(A.weighted_centroid(F.col("a"), F.lit(1), F.col("b"), F.lit(0)).alias("c")).first()["c"] == [1.0, 2.0]


def test_vocabulary(spark):
    texts = spark.createDataFrame([("a", "We use kubernetis, in new yourk!"), ("b", "KUBERNETIS cat New York"), ("c", "Kubernetes bat"), ("d", "nothing like it")], "key string, text string")
    terms = spark.createDataFrame([("Kubernetes", 0), ("New York", 1), ("car", 2)], "term string, rank int")
    out = {r.key: r.text for r in vocabulary.corrected(texts, terms).collect()}
    assert out == {"a": "We use Kubernetes, in New York!", "b": "KUBERNETES cat New York", "c": "Kubernetes bat", "d": "nothing like it"}


def test_model_files_and_catalogs(spark):
    files = [("r", "m-q8-00001-of-00002.gguf"), ("r", "m-q8-00002-of-00002.gguf"), ("r", "m-Q4_K_M.gguf"), ("r", "mmproj.gguf"), ("r", "../m-q4_k_m.gguf"), ("t", "b-00001-of-00001.gguf"), ("t", "a.bin")]
    out = {r.repo: list(r.shards) for r in catalogs.model_files(spark.createDataFrame(files, "repo string, path string")).collect()}
    assert out == {"r": ["m-Q4_K_M.gguf"], "t": ["b-00001-of-00001.gguf"]}
    left = spark.createDataFrame([("a", "{x} <b>y</b>"), ("b", "z"), ("d", "{n}")], "key string, text string")
    right = spark.createDataFrame([("a", "<b>q</b> {x}"), ("c", "z"), ("d", "{m}")], "key string, text string")
    assert {r.key: r.problem for r in catalogs.catalog_parity(left, right).collect()} == {"b": "missing right", "c": "missing left", "d": "other marks"}


def test_wav(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(2)
        f.setframerate(48_000)
        f.writeframes(np.repeat(np.arange(4_800, dtype="<i2"), 2).tobytes())
    (tmp_path / "b.wav").write_bytes(b"RIFFxxxx")
    rows = audio.wav_files(spark, f"file://{tmp_path}").collect()
    assert len(rows) == 1 and len(rows[0].samples) == 1_600 and rows[0].source_rate == 48_000
    assert rows[0].samples[10] == pytest.approx(30 / 32768)


@pytest.mark.parametrize("lag", [20, 32])
def test_best_lag_reaches_32_places(spark, lag):
    noise = np.random.default_rng(5).normal(size=200)
    rows = [("s", n, float(noise[n - lag]) if n >= lag else 0.0, float(noise[n])) for n in range(200)]
    out = streams.best_lag(spark.createDataFrame(rows, "session_id string, n long, near double, far double")).first()
    assert out.correlation > 0.9


@pytest.mark.parametrize("threshold", [0.86, 0.75, 0.97])
def test_the_index_of_marks_loses_no_match(spark, threshold):
    """All pairs of words of few letters, which nearly all meet, and of many."""
    from parley.functions.fuzzy import jaro_winkler

    draw = random.Random(11)
    word = lambda letters: "".join(draw.choice(letters) for _ in range(draw.randint(1, 11)))
    words = sorted({word(letters) for letters in ("ab", "etaoin", "abcdefghijklmnopqrstuvwxyzéß'") for _ in range(60)})
    terms = sorted({w[:k] + draw.choice("ez") + w[k + 1 :] for w in words for k in [draw.randint(0, len(w))]} | {word("etaoin") for _ in range(40)})
    got = vocabulary.matches(spark.createDataFrame([(w,) for w in words], "token string"), spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, rank int"), threshold)
    want = {}
    for w in words:
        if len(w) >= vocabulary.LEAST_CHARS and w not in terms:
            best = max(((jaro_winkler(w, t), -i) for i, t in enumerate(terms) if abs(len(w) - len(t)) <= 2), default=(0, 0))
            if best[0] >= threshold:
                want[w] = (terms[-best[1]], best[0])
    assert {r.token: (r.term, pytest.approx(r.score)) for r in got.collect()} == want and len(want) > 10


def test_nested_catalogs(spark):
    english = '{"a": {"b": "hi {{ name }}", "n_one": "{{count}} <b>x</b>", "n_other": "{{count}} {{x.y, number}}"}, "list": ["p", {"q": "r"}], "only": "e", "no": 3, "null": null}'
    polish = '{"a": {"b": "{{ other }}", "n_one": "<i>", "n_few": " "}, "list": ["p", {"q": "r"}], "more": {"deep": {"er": "z"}}}'
    rows = [("en", "app", english), ("pl", "app", polish), ("de", "app", english), ("en", "old", "{}"), ("pl", "new", '{"k": "v"}'), ("de", "old", "no json")]
    documents = spark.createDataFrame(rows, "locale string, namespace string, document string").withColumn("key", F.lit("x"))
    texts = {(r.locale, r.key): r.text for r in catalogs.nested_texts(documents.where("namespace = 'app'").select("locale", "document")).collect()}
    assert texts["en", "list.1.q"] == "r" and texts["en", "list.0"] == "p" and texts["pl", "more.deep.er"] == "z" and ("en", "no") not in texts and len(texts) == 6 + 6 + 6
    out = sorted(((r.locale, r.namespace, r.key, r.problem, r.detail) for r in catalogs.catalog_problems(documents).collect()), key=repr)
    assert out == sorted([
        ("pl", "app", "a.b", "placeholders", None), ("pl", "app", "a.n", "placeholders", None), ("pl", "app", "a.n", "tags", None), ("pl", "app", "a.n", "plural forms", "many, other"), ("pl", "app", "a.n_few", "empty", None),
        ("pl", "app", "more.deep.er", "extra", None), ("pl", "app", "only", "missing", None), ("pl", "old", None, "missing namespace", None), ("pl", "new", None, "namespace without source", None),
    ], key=repr)


def test_route_meets_tables_once(spark):
    """What makes the first answer of a task is not worked out from the joins again, which took a multiple of their memory."""
    rows = spark.createDataFrame([(f"00000000-0000-4000-8000-{i % 3:012d}", None, "s", "completed", "x", i) for i in range(9)] + [("no id", None, "s", "completed", "x", 9), (None, None, "s", "completed", "x", 10)], "task_id string, body_task_id string, session_id string, status string, reply_text string, seq long")
    tasks = rows.select("task_id", F.lit("s").alias("task_session")).where("seq < 2").distinct()
    out = streams.route(rows, rows.select("session_id").distinct(), tasks)
    got = {r.seq: r.disposition for r in out.collect()}
    assert got == {0: "accepted", 1: "accepted"} | {i: "unregistered_task" if i % 3 == 2 else "already_finalized" for i in range(2, 9)} | {9: "invalid_task_id", 10: "invalid_task_id"}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2


def test_catalogs_over_many_documents_are_read_once(spark):
    """A catalog dealt over documents; levels that end early, brackets and quotes inside texts, and what isn't JSON."""
    rows = [
        ("en", "n", '{"a": {"b": "x {{n}}", "c": ["[[[{", {"d": "\\\\"}]}}'), ("en", "n", '{"top": "\\"{{{", "one": {"k_one": " "}}'), ("en", "n", "[[[[[["), ("en", "n", None),
        ("fr", "n", '{"a": {"b": "x {{m}}"}}'), ("fr", "n", '{"top": " ", "e": {}, "f": []}'),
    ]
    documents = spark.createDataFrame(rows, "locale string, namespace string, document string")
    assert documents.agg(F.max(catalogs._depth(F.col("document")))).first()[0] == 4
    texts = catalogs.nested_texts(documents)
    assert sorted((r.key, r.text) for r in texts.where("locale = 'en'").collect()) == [("a.b", "x {{n}}"), ("a.c.0", "[[[{"), ("a.c.1.d", "\\"), ("one.k_one", " "), ("top", '"{{{')]
    found = catalogs.catalog_problems(documents)
    got = sorted((r.locale, r.key, r.problem) for r in found.collect())
    assert got == sorted([("fr", "a.b", "placeholders"), ("fr", "a.c.0", "missing"), ("fr", "a.c.1.d", "missing"), ("fr", "one.k", "missing"), ("fr", "top", "empty")])
    plan = catalogs.nested_texts(documents)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_words_to_match_are_dealt_over_all_partitions(spark):
    """Words are few bytes, so adaptive execution put all of them into one task, however much work they are."""
    tokens = spark.createDataFrame([("platfrom",), ("schédule",), ("databse",)], "token string")
    terms = spark.createDataFrame([("platform", "a"), ("schédules", "b"), ("database", "c")], "term string, rank string")
    found = vocabulary.matches(tokens, terms)
    assert {r.token: r.term for r in found.collect()} == {"platfrom": "platform", "schédule": "schédules", "databse": "database"}
    assert "RepartitionByExpression" in found._jdf.queryExecution().optimizedPlan().toString()
