"""Continuous forms of the stateful operators, for ``transformWithStateInPandas`` keyed by session or task.

State lives in the RocksDB store (``use_rocksdb``) and survives restarts with the checkpoint. Rows of a micro-batch are
taken in their order number, not as they arrive.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parley.operators.streams import TOLD, Stretch, Vad, after_chunk

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _in_order(rows: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(by, kind="stable")


class Orderer(StatefulProcessor):
    """Utterances of the expected sources in event time, by rows (kind utterance, progress or end; source; text; captured_ms;
    now_ms; arrival). Progress tells how far a source is, utterances don't. Each row releases what is held up to what all
    expected sources have passed, or up to the deadline; what the deadline alone releases is late. A timer in event time
    (of ``now_ms`` as watermark) releases it on a session that has fallen quiet. ``end`` drains."""

    OUTPUT = "session_id long, source int, text string, captured_ms long, late boolean"

    def __init__(self, max_wait_ms: int, expected: tuple[int, ...] = (0, 1)) -> None:
        self.max_wait_ms, self.expected = max_wait_ms, expected

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "captured_ms long, arrival long, source int, text string")
        self.passed = handle.getMapState("passed", "source int", "captured_ms long")

    def _settled(self) -> int:
        known = {key[0]: value[0] for key, value in self.passed.iterator()}
        return min((known.get(s, 0) for s in self.expected), default=(1 << 63) - 1)

    def _split(self, held: list[tuple], now_ms: int) -> tuple[list[tuple], list[tuple]]:
        """What a moment releases, marked late or not, and what stays."""
        settled = self._settled()
        ready = [x for x in held if x[0] <= max(settled, now_ms - self.max_wait_ms)]
        return [(x, x[0] > settled) for x in ready], held[len(ready) :]

    def _keep(self, held: list[tuple]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held:
            self.held.put(held)
            self.handle.registerTimer(held[0][0] + self.max_wait_ms)
        else:
            self.held.clear()

    @staticmethod
    def _told(key: Any, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            texts = pd.Series([x[3] for x, _ in out], dtype=object)
            yield pd.DataFrame({"session_id": key[0], "source": [x[2] for x, _ in out], "text": texts, "captured_ms": [x[0] for x, _ in out], "late": [late for _, late in out]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = sorted(tuple(x) for x in self.held.get())
        out: list[tuple] = []
        for row in _in_order(rows, "arrival").itertuples(index=False):
            if row.kind == "end":
                out += [(x, False) for x in held]
                held = []
                continue
            source, text = int(row.source), (row.text or "").strip()
            if row.kind == "progress":
                before = self.passed.getValue((source,))[0] if self.passed.containsKey((source,)) else 0
                self.passed.updateValue((source,), (max(before, int(row.captured_ms)),))
            elif text:
                held = sorted([*held, (int(row.captured_ms), int(row.arrival), source, text)])
            released, held = self._split(held, int(row.now_ms))
            out += released
        self._keep(held)
        yield from self._told(key, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        released, held = self._split(sorted(tuple(x) for x in self.held.get()), expiredTimerInfo.getExpiryTimeInMs())
        self._keep(held)
        yield from self._told(key, released)

    def close(self) -> None:
        pass


class Segmenter(StatefulProcessor):
    """Speech events of frames (chunk_idx, speech_prob), by the rules of ``after_chunk``."""

    OUTPUT = "session_id long, chunk_idx long, event string"

    def __init__(self, vad: Vad) -> None:
        self.vad = vad

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "at long, first long, spoken long, heard long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, *places = self.state.get() if self.state.exists() else (0, -1, -1, -1)
        stretch, out = Stretch(*places), []
        for chunk, probability in _in_order(rows, "chunk_idx")[["chunk_idx", "speech_prob"]].itertuples(index=False):
            does, stretch = after_chunk(self.vad, stretch, at, bool(probability >= self.vad.threshold), lambda condition, a, b: a if condition else b)
            out += [(int(chunk), TOLD[does])] if does in TOLD else []
            at += 1
        self.state.update((at, *stretch))
        yield pd.DataFrame({"session_id": key[0], "chunk_idx": [c for c, _ in out], "event": [e for _, e in out]})

    def close(self) -> None:
        pass


class Resampler(StatefulProcessor):
    """Linear resampling of a stream of chunks (at, samples): the values of all chunks together are those of the joined
    samples at once. A row whose samples are null ends the stream and gives the rest."""

    OUTPUT = "session_id long, at long, samples array<double>"

    def __init__(self, from_rate: int, to_rate: int) -> None:
        self.from_rate, self.to_rate = from_rate, to_rate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "given long, taken long, rest array<double>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        given, taken, rest = self.state.get() if self.state.exists() else (0, 0, [])
        known = np.asarray(rest, dtype=np.float64)  # samples from the place ``taken`` on
        out = []
        for at, samples in _in_order(rows, "at")[["at", "samples"]].itertuples(index=False):
            last = samples is None
            known = known if last else np.concatenate([known, np.asarray(samples, dtype=np.float64)])
            total = taken + len(known)
            # values whose right neighbour is known; at the end all of them, the last sample standing for what is missing
            count = -(-total * self.to_rate // self.from_rate) if last else -(-max(total - 1, 0) * self.to_rate // self.from_rate)
            place = np.arange(given, max(count, given)) * self.from_rate
            left, share = place // self.to_rate - taken, place % self.to_rate / self.to_rate
            a, b = known[np.minimum(left, len(known) - 1)] if len(place) else known[:0], known[np.minimum(left + 1, len(known) - 1)] if len(place) else known[:0]
            out.append((int(at), (a + (b - a) * share).tolist()))
            given = max(count, given)
            drop = min(max(given * self.from_rate // self.to_rate - taken, 0), max(len(known) - 1, 0))
            known, taken = known[drop:], taken + drop
        self.state.update((given, taken, known.tolist()))
        yield pd.DataFrame({"session_id": key[0], "at": [a for a, _ in out], "samples": [s for _, s in out]})

    def close(self) -> None:
        pass


class FinalOnce(StatefulProcessor):
    """Exactly-once terminal events of tasks: of the rows (seq, early) that passed the stateless checks (``early`` null) the
    first is accepted, across batches and restarts; later ones were already finalized."""

    OUTPUT = "task_id string, seq long, disposition string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", "done boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        done = self.done.exists()
        out = []
        for row in _in_order(rows, "seq").itertuples(index=False):
            if row.early is not None and not pd.isna(row.early):
                out.append((int(row.seq), row.early))
            else:
                out.append((int(row.seq), "already_finalized" if done else "accepted"))
                done = True
        if done:
            self.done.update((True,))
        yield pd.DataFrame({"task_id": key[0], "seq": [s for s, _ in out], "disposition": [d for _, d in out]})

    def close(self) -> None:
        pass


class Watchdog(StatefulProcessor):
    """Event-time timeout of each key: a row for every gap of more than ``limit_ms``; the watermark drives the timers."""

    OUTPUT = "session_id long, expired_ms long"

    def __init__(self, limit_ms: int) -> None:
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at_ms long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for at in _in_order(rows, "at_ms")["at_ms"].astype("int64"):
            if last is not None and at - last > self.limit_ms:
                out.append(last + self.limit_ms)
            last = int(at) if last is None else max(last, int(at))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.limit_ms)
        self.last.update((last,))
        yield pd.DataFrame({"session_id": key[0], "expired_ms": out}).astype({"expired_ms": "int64"})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame({"session_id": [key[0]], "expired_ms": [last + self.limit_ms]})

    def close(self) -> None:
        pass


class Turns(StatefulProcessor):
    """Chat turns: a turn is registered once, takes deltas while open, replays its text on resume, and ends exactly once by a
    reply, a cancellation or an error. Rows: seq, action (register, delta, cancel, resume, reply, error), text."""

    OUTPUT = "turn_id string, seq long, type string, text string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "status string, text string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        status, text = self.state.get() if self.state.exists() else ("new", "")
        out: list[tuple[int, str, str]] = []
        for row in _in_order(rows, "seq").itertuples(index=False):
            seq, part = int(row.seq), row.text or ""
            if row.action == "register":
                out.append((seq, "start" if status == "new" else "refused", ""))
                status = "open" if status == "new" else status
            elif row.action == "resume" and status != "new":
                out += [(seq, "start", ""), (seq, "text-start", ""), (seq, "text-delta", text)]
            elif status != "open":
                continue
            elif row.action == "delta":
                text += part
                out.append((seq, "text-delta", part))
            elif row.action == "cancel":
                status = "closed"
                out.append((seq, "finish", ""))
            elif row.action == "reply":
                rest = part[len(text) :] if part.startswith(text) else "\n\n" + part
                out += [(seq, "text-delta", rest)] if rest else []
                out += [(seq, "text-end", ""), (seq, "finish", "")]
                status, text = "closed", text + rest
            elif row.action == "error":
                out += [(seq, "error", part), (seq, "finish", "")]
                status = "closed"
        self.state.update((status, text))
        yield pd.DataFrame({"turn_id": key[0], "seq": [s for s, _, _ in out], "type": [t for _, t, _ in out], "text": [x for _, _, x in out]})

    def close(self) -> None:
        pass


def stateful(rows: DataFrame, key: str, processor: StatefulProcessor, time_mode: str = "None") -> DataFrame:
    return rows.groupBy(key).transformWithStateInPandas(processor, processor.OUTPUT, "Append", time_mode)


def burst_windows(rows: DataFrame, gap: str = "300 milliseconds", late: str = "1 minute") -> DataFrame:
    """Bursts of each session (session_id, at timestamp) by session windows; closed ones only."""
    windows = rows.withWatermark("at", late).groupBy("session_id", F.session_window("at", gap).alias("w"))
    return windows.agg(F.count(F.lit(1)).alias("n")).select("session_id", "w.start", "w.end", "n")


def coalesced_deltas(rows: DataFrame, width: str = "80 milliseconds", late: str = "1 minute") -> DataFrame:
    """Text of each stream (key, at timestamp, seq, delta) in tumbling windows."""
    text: Column = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "delta"))), lambda d: d["delta"]), "")
    return rows.withWatermark("at", late).groupBy("key", F.window("at", width).alias("w")).agg(text.alias("text")).select("key", "w.start", "text")


def seen_once(rows: DataFrame, within: str = "1 hour") -> DataFrame:
    """Replay guard: rows (message_id, at timestamp) whose message wasn't seen within the time."""
    return rows.withWatermark("at", within).dropDuplicatesWithinWatermark(["message_id"])
