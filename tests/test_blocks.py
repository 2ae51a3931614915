"""Silence skipping and liveness of the far side."""

from __future__ import annotations

from parley.operators import streams


def test_skips_after_a_silent_run(spark):
    silent = [False, True, True, True, True, False, True, True, True, None, True]
    rows = spark.createDataFrame([(s, i, x) for s in (1, 2) for i, x in enumerate(silent)], "session_id long, at long, silent boolean")
    got = [(r.session_id, r.at) for r in streams.skipped_blocks(rows, 2).orderBy("session_id", "at").collect() if r.skipped]
    want, count = [], 0
    for i, x in enumerate(silent):
        count = count + 1 if x else 0
        want += [i] if count > 2 else []
    assert got == [(s, i) for s in (1, 2) for i in want]


def test_far_side_is_alive_within_the_time(spark):
    rows = spark.createDataFrame([(1, "near", 0), (1, "far", 100), (1, "near", 100), (1, "near", 500), (1, "near", 501), (2, "near", 120)], "session_id long, source string, at_ms long")
    assert sorted((r.session_id, r.at_ms, r.far_alive) for r in streams.far_alive(rows).collect()) == [(1, 0, False), (1, 100, True), (1, 500, True), (1, 501, False), (2, 120, False)]
