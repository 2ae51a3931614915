"""The continuous form of ``operators.replies``: what an owner remembers is state, and survives restarts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parley.operators.replies import CAPACITY, RETIRED, SCHEMA, InMemory, Registry, outcomes


class Stored:
    """A bounded memory in map state, entries by id with their places. A batch loads them at once, as there are only so many,
    and writes back those that it changed."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, value: str, capacity: int | None, ttl_ms: int | None = None) -> None:
        self.capacity = capacity
        self.state = handle.getMapState(name, "id string", ", ".join(filter(None, ["place long", value])), ttl_ms)

    def load(self) -> InMemory:
        self.before = {name: tuple(value) for (name,), value in self.state.iterator()}
        self.memory = InMemory(self.capacity)
        self.memory.entries = {name: value[1:] for name, value in sorted(self.before.items(), key=lambda e: e[1][0])}
        return self.memory

    def save(self) -> None:
        """An entry keeps its place while places rise along the order; one that has left and come back gets a new one."""
        top = max((value[0] for value in self.before.values()), default=0)
        last = 0
        for name, value in self.memory.entries.items():
            old = self.before.pop(name, None)
            if old is not None and old[0] > last and last <= top:
                place = old[0]
            else:
                place = top = max(top, last) + 1
            last = place
            if (place, *value) != old:
                self.state.updateValue((name,), (place, *value))
        for name in self.before:
            self.state.removeKey((name,))


class Replies(StatefulProcessor):
    """Outcomes of rows (seq, action, task_id, session_id) of each owner, by the rules of ``Registry``. With ``ttl_ms``, which takes
    the time mode ProcessingTime, finalized tasks and retired turns are also forgotten after that time."""

    OUTPUT = SCHEMA

    def __init__(self, capacity: int = CAPACITY, retired: int = RETIRED, ttl_ms: int | None = None) -> None:
        self.capacity, self.retired, self.ttl_ms = capacity, retired, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memories = (
            Stored(handle, "pending", "session_id string, reserved boolean", self.capacity), Stored(handle, "finalized", "", self.capacity, self.ttl_ms),
            Stored(handle, "turns", "", None), Stored(handle, "retired", "", self.retired, self.ttl_ms),
        )

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        registry = Registry(*(memory.load() for memory in self.memories))
        out = pd.DataFrame(outcomes(registry, pd.concat(list(rows))), columns=["seq", "outcome", "evicted"])
        for memory in self.memories:
            memory.save()
        out.insert(0, "owner", key[0])
        yield out.astype({"evicted": object})

    def close(self) -> None:
        pass
