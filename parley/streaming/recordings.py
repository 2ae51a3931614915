"""Continuous forms of ``operators.recordings`` and of the watches over a recording, for ``transformWithStateInPandas``.

State is what a stream still owes: unread samples, the rest of a block, waiting sides of a mix, an open utterance. Rows of a
micro-batch are taken in their order (``at`` or ``seq``), so batches of any size and restarts give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parley.operators.recordings import BLOCK, LEAD, RATE, SHIFT
from parley.operators.speakers import SAME_SPEAKER, Clusters
from parley.operators.streams import BEGINS, CUT, ENDS, TOLD, Stretch, Vad, after_chunk
from parley.streaming.processors import _in_order

#: Samples that a near side waits for the far side, time after which a quiet far side isn't waited for, most unread samples.
WAIT = 8_000
QUIET_MS = 400
UNREAD = 64_000
PREROLL = 3_200
#: Samples of the longest utterance that is kept whole.
LONGEST = 30 * RATE


def _numbers(samples: Any) -> np.ndarray:
    return np.zeros(0) if samples is None else np.array([np.nan if x is None else x for x in samples], dtype=np.float64)


def _listed(samples: np.ndarray) -> list[float | None]:
    gaps = np.isnan(samples)
    return np.where(gaps, None, samples).tolist() if gaps.any() else samples.tolist()


def _retimed(handle: StatefulProcessorHandle, at_ms: int | None) -> None:
    """At most one timer stands."""
    for timer in list(handle.listTimers()):
        handle.deleteTimer(timer)
    if at_ms is not None:
        handle.registerTimer(int(at_ms))


class Side:
    """Unread stretches of one side: where each starts, and its samples. They don't overlap; ``end`` is where the last one ends."""

    def __init__(self, stretches: dict[int, np.ndarray], end: int | None) -> None:
        self.stretches, self.end = stretches, end

    def add(self, start: int, samples: np.ndarray, read: int | None) -> None:
        """Takes what is beyond the end, and not read yet. A gap of more than ``UNREAD`` gives up what is before it, and of
        twice as much in all, gaps included, the last ``UNREAD`` stay."""
        stop = start + len(samples)
        begin = max(start, start if self.end is None else self.end, start if read is None else read)
        if begin >= stop:
            return
        if self.end is not None and begin - self.end > UNREAD:
            self.stretches.clear()
        self.stretches[begin] = samples[begin - start :]
        self.end = stop
        if stop - min(self.stretches) > 2 * UNREAD:
            self.forget(stop - UNREAD)

    def forget(self, below: int) -> None:
        for start in sorted(self.stretches):
            samples = self.stretches[start]
            if start < below:
                del self.stretches[start]
                if start + len(samples) > below:
                    self.stretches[below] = samples[below - start :]

    def read(self, start: int, stop: int) -> np.ndarray:
        out = np.full(stop - start, np.nan)
        for at, samples in self.stretches.items():
            low, high = max(at, start), min(at + len(samples), stop)
            if low < high:
                out[low - start : high - start] = samples[low - at : high - at]
        return out


class Aligner(StatefulProcessor):
    """Blocks of ``size`` samples of two sides on one timeline, from chunks (at, far, start, samples, now_ms).

    The first near chunk starts the line. A block is told when both sides have reached its end, or the far side is more than
    ``wait`` samples behind, or nothing has come for ``quiet_ms`` (a timer in event time). What a side hasn't got by then is
    null; what comes for a told block is stale. A row without samples ends the session and gives the rest."""

    OUTPUT = "session_id long, block long, near array<double>, far array<double>"

    def __init__(self, size: int = SHIFT, wait: int = WAIT, quiet_ms: int = QUIET_MS) -> None:
        self.size, self.wait, self.quiet_ms = size, wait, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "far boolean, start long", "samples array<double>")
        self.line = handle.getValueState("line", "origin long, read long, near_end long, far_end long")

    def _load(self) -> None:
        self.origin, self.done, *ends = self.line.get() if self.line.exists() else (None, None, None, None)
        held: tuple[dict, dict] = ({}, {})
        for (far, start), (samples,) in self.parts.iterator():
            held[far][int(start)] = _numbers(samples)
        self.near, self.far = (Side(stretches, end) for stretches, end in zip(held, ends, strict=True))

    def _save(self, now_ms: int | None) -> None:
        self.line.update((self.origin, self.done, self.near.end, self.far.end))
        self.parts.clear()
        for far, side in ((False, self.near), (True, self.far)):
            for start, samples in side.stretches.items():
                self.parts.updateValue((far, start), (_listed(samples),))
        waits = now_ms is not None and self.origin is not None and self.near.end - self.done >= self.size
        _retimed(self.handle, now_ms + self.quiet_ms if waits else None)

    def _blocks(self, end: bool = False, wait: bool = True) -> list[tuple]:
        if self.origin is None:
            return []
        to = self.near.end
        if wait and not end and (self.far.end is None or self.far.end < to):
            to = max(to - self.wait, self.done if self.far.end is None else self.far.end)
        length = max(to - self.done, 0)
        length -= 0 if end else length % self.size
        near, far = (side.read(self.done, self.done + length) for side in (self.near, self.far))
        first = (self.done - self.origin) // self.size
        out = [(first + i // self.size, _listed(near[i : i + self.size]), _listed(far[i : i + self.size])) for i in range(0, length, self.size)]
        self.done += length
        self.near.forget(self.done)
        self.far.forget(self.done)
        return out

    @staticmethod
    def _told(key: Any, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame({"session_id": key[0], **{name: [x[i] for x in out] for i, name in enumerate(("block", "near", "far"))}})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._load()
        out: list[tuple] = []
        now_ms = None
        for row in _in_order(rows, "at").itertuples(index=False):
            now_ms = int(row.now_ms)
            if row.samples is None:
                out += self._blocks(end=True)
                continue
            start, samples = int(row.start), _numbers(row.samples)
            if not row.far and self.origin is None:
                self.origin = self.done = start
                self.far.forget(start)
            (self.far if row.far else self.near).add(start, samples, self.done)
            if self.origin is not None:
                self.near.end = self.origin if self.near.end is None else self.near.end
            out += self._blocks()
        self._save(now_ms)
        yield from self._told(key, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._load()
        out = self._blocks(wait=False)
        self._save(None)
        yield from self._told(key, out)

    def close(self) -> None:
        pass


class Reblocker(StatefulProcessor):
    """Full blocks of ``size`` samples of chunks (at, samples), and with each the ring of the last ``ring`` samples up to its end:
    what is put before speech that starts there. State is the rest of a block and the ring; a rest makes no block."""

    OUTPUT = "session_id long, block long, samples array<double>, ring array<double>"

    def __init__(self, size: int = BLOCK, ring: int = PREROLL) -> None:
        self.size, self.ring = size, ring

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "blocks long, rest array<double>, ring array<double>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        blocks, *arrays = self.state.get() if self.state.exists() else (0, [], [])
        rest, ring = map(_numbers, arrays)
        joined = np.concatenate([rest, *map(_numbers, _in_order(rows, "at")["samples"])])
        count = len(joined) // self.size
        line = np.concatenate([ring, joined[: count * self.size]])
        ends = len(ring) + self.size * np.arange(1, count + 1)
        self.state.update((blocks + count, joined[count * self.size :].tolist(), line[max(len(line) - self.ring, 0) :].tolist()))
        if count:
            yield pd.DataFrame({
                "session_id": key[0], "block": np.arange(blocks, blocks + count), "samples": joined[: count * self.size].reshape(count, self.size).tolist(),
                "ring": [line[max(end - self.ring, 0) : end].tolist() for end in ends],
            })

    def close(self) -> None:
        pass


class Mixer(StatefulProcessor):
    """What each push (at, source, samples) lets out of a mix, by the places that ``mixed_places`` states."""

    OUTPUT = "session_id long, at long, samples array<int>"

    def __init__(self, sources: int = 2, lead: int = LEAD) -> None:
        self.sources, self.lead = sources, lead if sources > 1 else 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "source int", "samples array<int>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [np.zeros(0, dtype=np.int64) for _ in range(self.sources)]
        for (source,), (samples,) in self.waiting.iterator():
            held[source] = np.array(samples, dtype=np.int64)
        out = []
        for row in _in_order(rows, "at").itertuples(index=False):
            if not 0 <= row.source < self.sources:
                continue
            held[row.source] = np.concatenate([held[row.source], np.asarray(row.samples, dtype=np.int64)])
            sizes = [len(x) for x in held]
            n = max(min(sizes), max(sizes) - self.lead)
            mix = np.zeros(n, dtype=np.int64)
            for x in held:
                mix[: len(x)] += x[:n]
            held = [x[n:] for x in held]
            out.append((int(row.at), np.clip(mix, -32768, 32767).tolist()))
        for source, samples in enumerate(held):
            self.waiting.updateValue((source,), (samples.tolist(),))
        yield pd.DataFrame({"session_id": key[0], "at": [a for a, _ in out], "samples": [x for _, x in out]})

    def close(self) -> None:
        pass


class Transcriber(StatefulProcessor):
    """Speech of a recording sent to a recogniser, and what comes back, by rows (seq, kind, samples, speech_prob, now_ms, text, final).

    Kind ``block`` brings a full block, its probability of speech and the time of its capture. Speech begins with the ring of
    the last ``ring`` samples; an utterance keeps its last ``longest`` samples, and is committed where speech ends or is cut. The
    n-th final text answers the n-th commit and bears its time; blank ones use up theirs. Partial texts are shown
    ``every_ms`` apart at least; a final text lets the next one through. ``flush`` brings the rest of a block, commits what is open, and drops partial texts until the next block. ``reset`` commits and
    forgets the speech heard. Commits that wait for their text and open samples are list state, so a batch appends to them."""

    OUTPUT = "session_id long, seq long, kind string, text string, captured_ms long, samples array<double>"

    def __init__(self, vad: Vad, ring: int = PREROLL, longest: int = LONGEST, every_ms: int = 500) -> None:
        self.vad, self.ring_size, self.longest, self.every_ms = vad, ring, longest, every_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.speech = handle.getValueState("speech", "at long, first long, spoken long, heard long")
        self.ring = handle.getValueState("ring", "samples array<double>")
        self.open = handle.getListState("open", "samples array<double>")
        self.commits = handle.getListState("commits", "captured_ms long")
        self.shown = handle.getValueState("shown", "at_ms long, flushed boolean, captured_ms long")

    def _send(self, samples: np.ndarray) -> None:
        if len(samples):
            self.open.appendValue((samples.tolist(),))
            self.size += len(samples)
            if self.size > 2 * self.longest:
                self._kept()

    def _kept(self) -> np.ndarray:
        """The last samples of the open utterance, as many as are kept; the rest leaves the state."""
        whole = np.concatenate([np.zeros(0), *(np.asarray(x[0]) for x in self.open.get())])[-self.longest :]
        self.open.put([(whole.tolist(),)])
        self.size = len(whole)
        return whole

    def _commit(self, seq: int) -> None:
        if self.size:
            self.out.append((seq, "commit", None, self.captured, self._kept().tolist()))
            self.open.clear()
            self.size = 0
            self.commits.appendValue((self.captured,))

    def _block(self, seq: int, samples: np.ndarray, speech: bool) -> None:
        self.held = np.concatenate([self.held, samples])[-self.ring_size :]
        does, self.stretch = after_chunk(self.vad, self.stretch, self.at, speech, lambda condition, a, b: a if condition else b)
        self.at += 1
        if does in (BEGINS, ENDS):
            self.out.append((seq, TOLD[does], None, None, None))
        if does == BEGINS:
            self._send(self.held)
            self.held = self.held[:0]
        elif does == CUT or (does != ENDS and self.stretch.first >= 0):
            self._send(samples)
        if does in (ENDS, CUT):
            self._commit(seq)

    def _text(self, row: Any) -> None:
        text = (row.text or "").strip()
        if row.final:
            waiting = [x[0] for x in self.commits.get()]
            if waiting:
                self.commits.put([(x,) for x in waiting[1:]]) if waiting[1:] else self.commits.clear()
            self.last = None
            if text:
                self.out.append((int(row.seq), "final", text, waiting[0] if waiting else self.captured, None))
        elif text and not self.flushed and (self.last is None or row.now_ms - self.last >= self.every_ms):
            self.last = int(row.now_ms)
            self.out.append((int(row.seq), "partial", text, None, None))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.at, *places = self.speech.get() if self.speech.exists() else (0, -1, -1, -1)
        self.stretch = Stretch(*places)
        self.held = _numbers(self.ring.get()[0] if self.ring.exists() else None)
        self.size = sum(len(x[0]) for x in self.open.get())
        self.last, self.flushed, self.captured = self.shown.get() if self.shown.exists() else (None, False, 0)
        self.out: list[tuple] = []
        for row in _in_order(rows, "seq").itertuples(index=False):
            seq = int(row.seq)
            if row.kind == "block":
                self.captured, self.flushed = int(row.now_ms), False
                self._block(seq, _numbers(row.samples), row.speech_prob >= self.vad.threshold)
            elif row.kind == "text":
                self._text(row)
            elif row.kind == "flush":
                if self.stretch.first >= 0:
                    self._send(_numbers(row.samples))
                self._commit(seq)
                self.flushed = True
            elif row.kind == "reset":
                self._commit(seq)
                self.at, self.stretch, self.held = 0, Stretch(-1, -1, -1), self.held[:0]
        self.speech.update((self.at, *map(int, self.stretch)))
        self.ring.update((self.held.tolist(),))
        self.shown.update((self.last, self.flushed, self.captured))
        if self.out:
            frame = pd.DataFrame(self.out, columns=["seq", "kind", "text", "captured_ms", "samples"])
            frame.insert(0, "session_id", key[0])
            yield frame.astype({"captured_ms": "Int64", "text": object})

    def close(self) -> None:
        pass


class TwoPhaseTimeout(StatefulProcessor):
    """When a stream of rows (at_ms, kind: request, token or done) timed out, and in which phase: ``first_ms`` after its request
    without a token (startup), or ``idle_ms`` after its last one (stalled). Done and timed out are ends: nothing follows."""

    OUTPUT = "key string, expired_ms long, phase string"

    def __init__(self, first_ms: int = 120_000, idle_ms: int = 60_000) -> None:
        self.first_ms, self.idle_ms = first_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "due_ms long, phase string")  # phase over: an end

    def _end(self, key: Any, due: int, phase: str) -> pd.DataFrame:
        self.state.update((due, "over"))
        return pd.DataFrame({"key": [key[0]], "expired_ms": [due], "phase": [phase]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due, phase = self.state.get() if self.state.exists() else (None, "startup")
        for row in _in_order(rows, "at_ms").itertuples(index=False):
            at = int(row.at_ms)
            if phase == "over":
                break
            if due is not None and at > due:
                yield self._end(key, due, phase)
                phase = "over"
            elif row.kind == "done":
                phase = "over"
            elif row.kind == "token":
                due, phase = at + self.idle_ms, "stalled"
            else:
                due, phase = at + self.first_ms, "startup"
        self.state.update((due, phase))
        _retimed(self.handle, None if phase == "over" else due)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due, phase = self.state.get()
        if phase != "over":
            yield self._end(key, due, phase)

    def close(self) -> None:
        pass


class StallWatch(StatefulProcessor):
    """What a watch over the system's audio does, for chunks (source system or mic, at_ms), by the rules of ``stall_actions``: the
    timer is the next restart, the verdict after the last one, or the end of a session that is down to its microphone."""

    OUTPUT = "session_id long, at_ms long, action string"

    def __init__(self, limit_ms: int, restarts: int) -> None:
        self.limit_ms, self.restarts = limit_ms, restarts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "waits_ms long, heard_ms long, tries int, phase string")

    def _due(self) -> int | None:
        start = {"watch": self.waits, "mic_only": self.heard, "ended": None}[self.phase]
        return None if start is None else start + self.limit_ms

    def _pass(self, now_ms: int, also_now: bool) -> None:
        """Everything that is due before a moment, or at it."""
        while (due := self._due()) is not None and (due < now_ms or also_now and due == now_ms):
            if self.phase == "mic_only":
                self.phase = "ended"
            elif self.tries < self.restarts:
                self.tries, self.waits = self.tries + 1, due
            else:
                self.phase = "ended" if due - self.heard >= self.limit_ms else "mic_only"
            self.out.append((due, "restart" if self.phase == "watch" else self.phase))

    def _load(self) -> None:
        self.waits, self.heard, self.tries, self.phase = self.state.get() if self.state.exists() else (None, None, 0, "watch")
        self.out: list[tuple[int, str]] = []

    def _told(self, key: Any) -> Iterator[pd.DataFrame]:
        self.state.update((self.waits, self.heard, self.tries, self.phase))
        _retimed(self.handle, self._due())
        if self.out:
            yield pd.DataFrame({"session_id": key[0], "at_ms": [a for a, _ in self.out], "action": [x for _, x in self.out]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._load()
        for row in _in_order(rows, "at_ms").itertuples(index=False):
            at = int(row.at_ms)
            self._pass(at, also_now=row.source == "system")
            if self.phase != "ended":
                self.heard = at
            if row.source == "system" and self.phase == "watch":
                self.waits, self.tries = at, 0
            self._pass(at, also_now=True)
        yield from self._told(key)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._load()
        self._pass(expiredTimerInfo.getExpiryTimeInMs(), also_now=True)
        yield from self._told(key)

    def close(self) -> None:
        pass


class SpeakerClusters(StatefulProcessor):
    """Speakers of a session as they speak, by rows (idx, embedding), with the rules of ``session_clusters``: each embedding is told
    with its cluster at once. A row without embedding ends the session and gives its clusters: centroid and size, to be
    identified and folded into the stored voiceprints (``identified``, ``folded``)."""

    OUTPUT = "session_id long, idx long, cluster long, centroid array<double>, n long"

    def __init__(self, threshold: float = SAME_SPEAKER) -> None:
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("clusters", "cluster long", "total array<double>, n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [(np.array(total), n) for _, (total, n) in sorted(self.state.iterator(), key=lambda e: e[0][0])]
        clusters = Clusters(self.threshold, [total for total, _ in held], [n for _, n in held])
        out: list[tuple] = []
        changed = set()
        for idx, embedding in _in_order(rows, "idx")[["idx", "embedding"]].itertuples(index=False):
            if embedding is None:
                out += [(None, k, (total / n).tolist(), n) for k, (total, n) in enumerate(zip(clusters.sums, clusters.counts, strict=True))]
                self.state.clear()
                clusters, changed = Clusters(self.threshold), set()
            else:
                cluster = clusters.add(_numbers(embedding))
                changed.add(cluster)
                out.append((int(idx), cluster, None, None))
        for k in changed:
            self.state.updateValue((k,), (clusters.sums[k].tolist(), clusters.counts[k]))
        frame = pd.DataFrame(out, columns=["idx", "cluster", "centroid", "n"]).astype({"idx": "Int64", "n": "Int64", "centroid": object})
        frame.insert(0, "session_id", key[0])
        yield frame

    def close(self) -> None:
        pass
