"""Join of token sets in a prefix tree.

Sets are sequences in one global order of tokens. The tree's nodes carry runs of tokens that several sets share; a
probe walks it level by level, adds the overlap of each run once for all sets below, and drops a subtree as soon as
what is left on both sides can't reach the overlap that its smallest set needs.
"""

from __future__ import annotations

import numpy as np


def least_overlap(sizes: np.ndarray, size: int, percent: int) -> np.ndarray:
    """Least intersection with which two sets reach ``percent`` of their union."""
    return -(-percent * (sizes + size) // (100 + percent))


class Tree:
    """Sets stored as paths. ``tokens`` of a set are its members that other sets may share, ``size`` its whole size."""

    def __init__(self, tokens: list[np.ndarray], sizes: np.ndarray) -> None:
        self.sizes = sizes
        order = sorted(range(len(tokens)), key=lambda i: tokens[i].astype(">u4").tobytes())
        starts = np.cumsum([0] + [len(tokens[i]) for i in order])
        self.flat = np.concatenate([tokens[i] for i in order]) if order else np.zeros(0, dtype=np.int64)
        shared = [0] * len(order)  # tokens shared with the set before
        for k in range(1, len(order)):
            a, b = tokens[order[k - 1]], tokens[order[k]]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            shared[k] = int(differ[0]) if len(differ) else n
        first: list[int] = []
        end: list[int] = []
        parent: list[int] = []
        ends_at: list[int] = [0] * len(order)
        path: list[tuple[int, int]] = []  # (node, depth at its end), from the top
        for k, i in enumerate(order):
            depth, base = len(tokens[i]), int(starts[k])
            popped = None
            while path and path[-1][1] > shared[k]:
                popped = path.pop()
            top = path[-1][1] if path else 0
            if popped is not None and top < shared[k]:  # split the node at the shared depth
                node = popped[0]
                cut = first[node] + shared[k] - top
                first.append(first[node])
                end.append(cut)
                parent.append(parent[node])
                first[node], parent[node] = cut, len(first) - 1
                path.append((len(first) - 1, shared[k]))
                top = shared[k]
            if depth > top or not path:
                first.append(base + top)
                end.append(base + depth)
                parent.append(path[-1][0] if path else -1)
                path.append((len(first) - 1, depth))
            ends_at[k] = path[-1][0]
        self.first, self.end, self.parent = np.array(first, dtype=np.int64), np.array(end, dtype=np.int64), np.array(parent, dtype=np.int64)
        n = len(first)
        self.smallest = np.full(n, np.iinfo(np.int64).max)  # size of the smallest set at or below a node
        self.rest = np.zeros(n, dtype=np.int64)  # most tokens after a node's run
        self.sets: list[list[int]] = [[] for _ in range(n)]
        for k, i in enumerate(order):
            node, rest = ends_at[k], 0
            self.sets[node].append(i)
            while node >= 0:
                self.smallest[node] = min(self.smallest[node], sizes[i])
                self.rest[node] = max(self.rest[node], rest)
                rest += end[node] - first[node]
                node = parent[node]
        children: list[list[int]] = [[] for _ in range(n)]
        for node, above in enumerate(parent):
            if above >= 0:
                children[above].append(node)
        self.roots = np.array([k for k in range(n) if parent[k] < 0], dtype=np.int64)
        self.children = [np.array(c, dtype=np.int64) for c in children]

    def linked(self, tokens: np.ndarray, size: int, percent: int, member: np.ndarray) -> list[int]:
        """Sets whose similarity with the probe reaches ``percent``; ``member`` marks the probe's tokens."""
        out: list[int] = []
        nodes, overlap = self.roots, np.zeros(len(self.roots), dtype=np.int64)
        while len(nodes):
            lengths = self.end[nodes] - self.first[nodes]
            offsets = np.cumsum(lengths) - lengths
            at = np.arange(lengths.sum()) + np.repeat(self.first[nodes] - offsets, lengths)
            sums = np.concatenate([[0], np.cumsum(member[self.flat[at]])])
            overlap = overlap + sums[offsets + lengths] - sums[offsets]
            last = np.where(lengths > 0, self.flat[np.maximum(self.end[nodes] - 1, 0)], -1) if len(self.flat) else np.full(len(nodes), -1)
            left = np.minimum(self.rest[nodes], len(tokens) - np.searchsorted(tokens, last, side="right"))
            alive = overlap + left >= least_overlap(self.smallest[nodes], size, percent)
            nodes, overlap = nodes[alive], overlap[alive]
            below, carried = [], []
            for node, common in zip(nodes.tolist(), overlap.tolist(), strict=True):
                for i in self.sets[node]:
                    if 100 * common >= percent * (int(self.sizes[i]) + size - common):
                        out.append(i)
                if len(self.children[node]):
                    below.append(self.children[node])
                    carried.append(np.full(len(self.children[node]), common))
            nodes = np.concatenate(below) if below else np.zeros(0, dtype=np.int64)
            overlap = np.concatenate(carried) if carried else overlap[:0]
        return out
