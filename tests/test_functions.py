"""Functions on literal rows and sweeps."""

import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parley.functions import arrays as A
from parley.functions import budget, fuzzy, signal, times
from parley.functions import text as T


def value(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {v}" for k, v in zip(values, [kinds(x) for x in values.values()], strict=True)))
    return frame.select(column.alias("v")).first()["v"]


def kinds(x):
    return {str: "string", int: "long", float: "double", list: "array<double>"}[type(x)]


@pytest.mark.parametrize(
    ("text", "title"),
    [
        ("\n\n#  Heading \nrest", "Heading"), ("## **Bold _title_**", "Bold _title"), ("#\n##\n", None), ("  two   words  ", "two words"),
        ("a" * 90, "a" * 80 + "…"), ("word " * 30, ("word " * 16).strip() + "…"), ("é" * 85, "é" * 80 + "…"), ("x " + "y" * 100, "x " + "y" * 78 + "…"),
    ],
)
def test_title(spark, text, title):
    assert value(spark, T.first_title_line(F.col("t")), t=text) == title


def test_text(spark):
    assert value(spark, T.trim_ws(F.col("t")), t="\u00a0\t x \u2003") == "x"
    assert value(spark, T.excerpt(F.col("t")), t="ab " * 80) == ("ab " * 53).strip() + "…"
    assert value(spark, T.excerpt(F.col("t")), t="a" * 161) == "a" * 160 + "…"
    assert value(spark, T.clamp(F.col("t"), 5), t="  abc  def ") == "abc"
    assert value(spark, T.strip_markers(F.col("t")), t="a<<<<b>>>c") == "a<bc"
    assert value(spark, T.tail_chars(F.col("t"), 3), t="a😀bc") == "😀bc"
    assert [value(spark, T.is_session_id(F.col("t")), t=x) for x in ("ok-1", "", "a/b", "a\\b", "..", "a..b")] == [True, False, False, False, False, False]
    assert [value(spark, T.is_safe_path(F.col("t")), t=x) for x in ("a/b.gguf", "/a", "a//b", "../a", "c:/a", "a/./b")] == [True, False, False, False, False, False]
    assert [value(spark, T.continuation(F.lit("abc"), F.col("t")), t=x) for x in ("abc", "abcd", "x")] == ["", "d", "\n\nx"]
    assert [value(spark, T.locale_of(F.col("t")), t=x) for x in ("pl-PL", "en_US", "de")] == ["pl", "en", "en"]
    assert [value(spark, T.line_kind(F.col("t")), t=x) for x in ("- [x] a", "* a", "# a", "### a", "", "a")] == ["checkbox", "bullet", "h1", "h3", "blank", "paragraph"]
    assert value(spark, T.without_shard_suffix(F.col("t")), t="w-00001-of-00004") == "w"
    assert value(spark, F.concat_ws("|", T.words_and_gaps(F.col("t"))), t="it's  é1, ok") == "it's|  |é1|, |ok"


def test_session_title_falls_back(spark):
    people = F.array(F.lit("a"), F.lit("b"))
    none, nobody = F.lit(None).cast("string"), F.array().cast("array<string>")
    assert value(spark, T.session_title(none, people, F.col("t")), t="2026-05-25T10:00:00Z") == "a, b (2026-05-25)"
    assert value(spark, T.session_title(none, nobody, F.col("t")), t="2026-05-25T10:00:00Z") == "2026-05-25"
    assert value(spark, T.session_title(F.lit("# N"), people, F.col("t")), t="x") == "N"


def test_times(spark):
    assert [value(spark, times.offset_text(F.col("n")), n=x) for x in (134_000, 3_723_000, 0)] == ["02:14", "1:02:03", "00:00"]
    assert [value(spark, times.epoch_ms(F.col("t")), t=x) for x in ("1970-01-01T00:00:01Z", "1969-01-01T00:00:00Z", "1970-01-01T01:00:00.5+01:00", "later")] == [1000, 0, 500, None]
    assert value(spark, times.delta_ms(F.lit("x"), F.col("t")), t="1970-01-01T00:00:01Z") == 0
    assert [value(spark, times.backoff_seconds(F.col("n")), n=k) for k in range(7)] == [2, 4, 8, 16, 32, 60, 60]


def test_arrays(spark):
    assert value(spark, A.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 0.0]) == 1
    assert value(spark, A.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 0.0]) == 0
    assert value(spark, A.cosine(F.col("a"), F.col("b")), a=[1.0], b=[1.0, 0.0]) == 0
    assert value(spark, A.mixed(F.col("a"), F.col("b")), a=[100.0, 30000.0, -30000.0], b=[10.0, 30000.0, -30000.0]) == [110, 32767, -32768]
    assert value(spark, A.shifted(F.col("a"), 1), a=[1.0, 2.0, 3.0]) == [0.0, 1.0, 2.0]
    assert value(spark, A.downmixed(F.col("a"), 2), a=[1.0, 3.0, 5.0, 7.0, 9.0]) == [2.0, 6.0]
    assert value(spark, A.finite(F.col("a")), a=[math.nan, math.inf, 1.0]) == [0.0, 0.0, 1.0]
    assert value(spark, A.to_pcm(F.col("a")), a=[1.5, -1.0, 0.5]) == [32767, -32767, 16383]
    assert value(spark, A.argmax(F.col("a")), a=[1.0, 5.0, 5.0]) == 1
    assert value(spark, A.rms(F.col("a")), a=[3.0, 4.0]) == pytest.approx(math.sqrt(12.5))
    for hz in (0.0, 440.0, 1000.0, 8000.0):
        assert value(spark, A.mel_to_hz(A.hz_to_mel(F.col("h"))), h=hz) == pytest.approx(hz)


def test_budget_sweep(spark):
    draw = random.Random(1)
    words = ["żółw", "call", "about", "prices", "tomorrow"]
    text = " ".join(draw.choice(words) + draw.choice(["", ".", "\n", "\n\n"]) for _ in range(400))
    budgets = [-5, *range(0, 2000, 37), len(text), len(text) + 1]
    rows = spark.createDataFrame([(text, n) for n in budgets] + [(None, 5), ("", 0), ("x" * 500, 200)], "t string, n int")
    for r in rows.select("t", "n", budget.within_budget(F.col("t"), F.col("n")).alias("b")).collect():
        if r.t is None:
            assert r.b.text is None
            continue
        assert len(r.b.text) <= max(r.n, 0) and r.b.cut == (len(r.t) > max(r.n, 0)) and (r.b.cut or r.b.text == r.t)
        if r.b.cut and r.n > 150:
            front, back = re.split(r"\n…\[transcript truncated, \d+ characters omitted\]…\n", r.b.text)
            missing = int(re.search(r"truncated, (\d+) ", r.b.text)[1])
            assert r.t.startswith(front) and r.t.endswith(back) and missing == len(r.t) - len(front) - len(back)
            assert len(front) <= 0.6 * r.n
            if r.t is text and front and back:
                assert not (text[len(front)].isalnum() and text[len(front) - 1].isalnum()) and not (back[0].isalnum() and text[-len(back) - 1].isalnum())


def test_jaro_winkler():
    assert fuzzy.jaro("martha", "marhta") == pytest.approx(0.944444, abs=1e-6)
    assert fuzzy.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert fuzzy.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.813333, abs=1e-6)
    assert fuzzy.jaro("", "a") == 0 and fuzzy.jaro("abc", "xyz") == 0 and fuzzy.jaro_winkler("same", "same") == 1


def test_signal():
    second = np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000)
    mel = signal.log_mel(second)
    assert mel.shape == (100, 128) and np.allclose(mel.mean(0), 0, atol=1e-6) and np.allclose(mel.std(0, ddof=1), 1, atol=0.05)
    assert signal.filterbank().shape == (128, 257) and (signal.filterbank() >= 0).all()
    noise = np.random.default_rng(0).normal(size=2048)
    assert signal.coherence(noise, noise) > 0.99 and signal.coherence(noise, np.random.default_rng(1).normal(size=2048)) < 0.8
    assert signal.best_lag(np.roll(noise[:512], 20), noise[:512]) == 20
    assert pd.isna(signal.coherence(noise[:4], noise[:4])) is False


def test_stored_insights_leave_out_what_means_nothing(spark):
    """Fields are left out one by one, whatever stands behind them and whatever texts hold."""
    import json

    from parley import schemas as S
    from parley.functions import encoding

    rating = ("helpful", None, "live", False)
    notes = [
        (5, "red", 'a ","producer":null,"feedback_withdraw_pending":false', None, "x", None, rating, False), (6, None, "m", 2, None, "signals", None, True), (7, "red", "", 0, None, None, None, None),
    ]
    rows = spark.createDataFrame([("s1", None, notes), ("s2", "t", []), ("s3", "t", None)], f"session_id string, title string, insights array<{S.INSIGHT}>")
    got = [json.loads(r[0], object_pairs_hook=dict) for r in rows.select(encoding.session_json(rows)).collect()]
    assert got[0] == {"session_id": "s1", "title": None, "insights": [
        {"offset_ms": 5, "severity": "red", "message": notes[0][2], "segment_index": None, "id": "x", "feedback": {"verdict": "helpful", "rated_at": None, "surface": "live", "publish_pending": False}},
        {"offset_ms": 6, "severity": None, "message": "m", "segment_index": 2, "producer": "signals", "feedback_withdraw_pending": True}, {"offset_ms": 7, "severity": "red", "message": "", "segment_index": 0},
    ]}
    assert got[1] == {"session_id": "s2", "title": "t", "insights": []} and got[2]["insights"] is None
