"""Replies to tasks of an owner (a device or a user): each task is answered once, and what is remembered is bounded.

A task is pending from its registration until its answer is saved. The first answer reserves it; if saving fails it is
released, and the next answer may reserve it again. Of pending tasks the oldest make room beyond a capacity, and so do
finalized ones. Parts of a message go to an open turn of the same id; a closed turn is retired and takes none any more.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame

CAPACITY = 1_024
RETIRED = 256

SCHEMA = "owner string, seq long, outcome string, evicted string"


class Memory(Protocol):
    """Entries by id, in the order of their arrival; beyond its capacity the oldest goes."""

    def get(self, name: str) -> tuple | None: ...

    def add(self, name: str, *value: Any) -> str | None:
        """Adds an entry, or leaves the one that is there as it is; gives the id that made room."""

    def change(self, name: str, *value: Any) -> None:
        """Changes an entry where it stands."""

    def drop(self, name: str) -> bool: ...


class InMemory:
    """A ``Memory`` of one pass over an owner's rows."""

    def __init__(self, capacity: int | None) -> None:
        self.capacity, self.entries = capacity, {}

    def get(self, name: str) -> tuple | None:
        return self.entries.get(name)

    def add(self, name: str, *value: Any) -> str | None:
        self.entries.setdefault(name, value)
        if self.capacity is None or len(self.entries) <= self.capacity:
            return None
        oldest = next(iter(self.entries))
        del self.entries[oldest]
        return oldest

    def change(self, name: str, *value: Any) -> None:
        self.entries[name] = value

    def drop(self, name: str) -> bool:
        return self.entries.pop(name, None) is not None


class Registry:
    """What an owner remembers: pending tasks (session, reserved), finalized tasks, open turns, retired turns."""

    def __init__(self, pending: Memory, finalized: Memory, turns: Memory, retired: Memory) -> None:
        self.pending, self.finalized, self.turns, self.retired = pending, finalized, turns, retired

    def _answer(self, task: str, session: str) -> str:
        known = self.pending.get(task)
        if self.finalized.get(task) is not None:
            return "already_finalized"
        if known is None:
            return "unregistered_task"
        if known[0] != session:
            return "session_mismatch"
        if known[1]:
            return "already_finalized"
        self.pending.change(task, session, True)
        return "accepted"

    def after(self, action: str, task: str, session: str) -> tuple[str, str | None]:
        """Outcome of a row, and the task that was evicted for it."""
        if action == "register":
            if self.pending.get(task) is not None:
                return "known", None
            return "registered", self.pending.add(task, session, False)
        if action == "saved":
            self.pending.drop(task)
            return "finalized", self.finalized.add(task)
        if action == "failed":
            known = self.pending.get(task)
            if known is not None:
                self.pending.change(task, known[0], False)
            return "released", None
        if action == "open":
            if self.retired.get(task) is not None or self.turns.get(task) is not None:
                return "refused", None
            return "opened", self.turns.add(task)
        if action == "close":
            if self.turns.drop(task):
                return "closed", self.retired.add(task)
            return ("already_closed" if self.retired.get(task) is not None else "unknown_turn"), None
        if action == "message" and self.turns.get(task) is not None:
            return "part", None
        if action == "message" and self.retired.get(task) is not None:
            return "already_finalized", None
        return self._answer(task, session), None


def outcomes(registry: Registry, rows: pd.DataFrame) -> Iterator[tuple[int, str, str | None]]:
    for row in rows.sort_values("seq", kind="stable").itertuples(index=False):
        yield int(row.seq), *registry.after(row.action, row.task_id, row.session_id)


def routed(events: DataFrame, capacity: int = CAPACITY, retired: int = RETIRED) -> DataFrame:
    """Outcomes (owner, seq, outcome, evicted) of all rows (owner, seq, action, task_id, session_id) of each owner at once. Actions:
    register, reply, message, saved, failed, open and close (of a turn). An owner's rows are one group, taken in order."""

    def owner(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        registry = Registry(InMemory(capacity), InMemory(capacity), InMemory(None), InMemory(retired))
        out = pd.DataFrame(outcomes(registry, rows), columns=["seq", "outcome", "evicted"])
        out.insert(0, "owner", key[0])
        return out.astype({"evicted": object})

    return events.groupBy("owner").applyInPandas(owner, SCHEMA)
