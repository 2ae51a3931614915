"""Benchmark decontamination with a generalised suffix automaton.

The words of the normalised test items (A-Z lowered, runs of ASCII letters, digits and non-ASCII code points) make one
suffix automaton in which no path crosses items. Training words are streamed through it; the automaton's state holds
the longest piece of an item that ends at the word. A match of ``WINDOW`` words, or of a whole shorter item, hits those
words. ``cleaned`` cuts the hit spans out of a text, and drops the document when the hit words cover too much of it.

Items are bundled into blocks of about ``BLOCK_WORDS`` words; a task builds each block's automaton, of bounded size, and
the driver passes it on as bytes in a broadcast of its own. The documents are streamed once through all of them and the
hit runs united, so the benchmark, not the corpus, has to fit a task's memory.

Defined cases: null or empty texts and items have no words and match nothing; repeated items count each; repeated rows
get the same answer each; of pieces that end at one word all count, whatever their lengths; a very long text is one list of
words; a null item_id is left out of the list of ids but hits; other columns are ignored; an empty
benchmark hits nothing, an empty table of documents gives no rows.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.tables import small_batches

WINDOW = 10
BLOCK_WORDS = 200_000
#: About this many bytes of an item to a word, for the number of blocks only.
WORD_BYTES = 6
#: A document whose hit words are more than this share of its words is dropped; otherwise the spans are cut out.
COVERAGE_LIMIT = 0.5
#: Of UTF-8 with A-Z lowered: the runs of code points outside 00-2F, 3A-60 and 7B-7F.
WORD = re.compile(rb"[0-9a-z\x80-\xFF]+")


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


class Automaton:
    """Suffix automaton of several word sequences, with the items behind each match that counts."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.word_id: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        coded = [(name, [self.word_id.setdefault(w, len(self.word_id)) for w in words]) for name, words in items]
        for _, words in coded:
            last = 0
            for word in words:
                last = self._extend(last, word)
        #: Of a state: items of which its match of ``window`` words is a window.
        self.items_at: dict[int, set[str | None]] = {}
        #: Of a state: (length, items) of each item shorter than a window that ends there, own or inherited by links.
        self.short_at: dict[int, list[tuple[int, set[str | None]]]] = {}
        #: The state on the chain of links whose shortest-to-longest range holds ``window``, or -1.
        self.full = [-1] * len(self.next)
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for state in order:
            parent = self.link[state]
            if self.length[parent] >= window:
                self.full[state] = self.full[parent]
            elif self.length[state] >= window:
                self.full[state] = state
        for name, words in coded:
            state = 0
            for i, word in enumerate(words):
                state = self.next[state][word]
                if i + 1 >= window:
                    self.items_at.setdefault(self.full[state], set()).add(name)
            if 0 < len(words) < window:
                own = self.short_at.setdefault(state, [])
                same = next((names for n, names in own if n == len(words)), None)
                if same is None:
                    own.append((len(words), {name}))
                else:
                    same.add(name)
        for state in order:
            if above := self.short_at.get(self.link[state]):
                self.short_at[state] = self.short_at.get(state, []) + above

    def _copy(self, state: int, length: int) -> int:
        self.next.append(dict(self.next[state]))
        self.link.append(self.link[state])
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """The state of the piece ``length[state] + 1`` words long that leads to ``target``, split off if need be."""
        if self.length[target] == self.length[state] + 1:
            return target
        clone = self._copy(target, self.length[state] + 1)
        self.link[target] = clone
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word, self.next[last][word])
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        new, state = len(self.next) - 1, last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        self.link[new] = 0 if state < 0 else self._split(state, word, self.next[state][word])
        return new

    def runs(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Maximal runs (first word, end) of hit words, and the items hit."""
        step, link, length, full, short_at, window = self.next, self.link, self.length, self.full, self.short_at, self.window
        spans: list[tuple[int, int]] = []
        items: set[str | None] = set()
        state = size = 0
        ids = self.word_id.get
        for i, word in enumerate(map(ids, words)):
            if word is None:
                state = size = 0
                continue
            while (to := step[state].get(word)) is None and state:
                state = link[state]
                size = length[state]
            if to is None:
                size = 0
                continue
            state, size = to, size + 1
            if size >= window:
                spans.append((i + 1 - window, i + 1))
                items |= self.items_at[full[state]]
            if state in short_at:
                for n, names in short_at[state]:
                    if n <= size:
                        spans.append((i + 1 - n, i + 1))
                        items |= names
        return united(spans), items


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as maximal runs."""
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((first, end))
    return out


def automata(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> list[Broadcast]:
    """One broadcast automaton for each block of items, as bytes. Items are dealt into blocks of about ``block_words`` words by
    a hash of the text, and each block is built by one task."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    words = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(words / WORD_BYTES / block_words))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(pdf["item_id"], pdf["text"], strict=True), key=lambda r: (r[0] is None or r[0] != r[0], str(r[0]), r[1]))
        automaton = Automaton([(None if pd.isna(name) else name, WORD.findall(normalised(text))) for name, text in rows], window)
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "body": [zlib.compress(pickle.dumps(automaton, protocol=5), 1)]})

    built = items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks))).groupBy("block").applyInPandas(build, "block long, body binary")
    return [spark.sparkContext.broadcast(bytes(r["body"])) for r in built.orderBy("block").toLocalIterator()]


def unpacked(blocks: list[Broadcast]) -> list[Automaton]:
    """The automata of broadcasts made here; a worker unpacks them once for all its batches."""
    return [pickle.loads(zlib.decompress(block.value)) for block in blocks]  # noqa: S301


HIT = "n_words long, runs array<struct<first:long,end:long>>, items array<string>"


def found_in(words: list[bytes], automata: list[Automaton]) -> tuple[list[tuple[int, int]], set[str | None]]:
    """Maximal runs of hit words and the items hit, by all automata."""
    parts = [automaton.runs(words) for automaton in automata]
    return united([run for runs, _ in parts for run in runs]), {item for _, items in parts for item in items}


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id and a column ``hit`` of every row of ``docs``: n_words, the maximal runs of hit words, and the sorted ids of the items hit."""
    small_batches(docs.sparkSession)
    blocks = automata(benchmark, window, block_words)

    @F.pandas_udf(HIT)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = unpacked(blocks)
        for series in batches:
            rows = []
            for text in series:
                words = WORD.findall(normalised(text))
                runs, items = found_in(words, own)
                rows.append((len(words), [{"first": a, "end": b} for a, b in runs], sorted(x for x in items if x is not None)))
            yield pd.DataFrame(rows, columns=["n_words", "runs", "items"])

    return docs.select("doc_id", found("text").alias("hit"))


def hit_words() -> Column:
    return F.aggregate("hit.runs", F.lit(0).cast("long"), lambda total, run: total + run["end"] - run["first"])


def report(hit: DataFrame) -> DataFrame:
    """One row for each document: counts, digest of item ids, and whether any word is hit."""
    items = F.col("hit.items")
    out = hit.select("doc_id", "hit.n_words", hit_words().alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def cut(text: str | None, runs: list[tuple[int, int]]) -> str | None:
    """The text without its hit runs, from the first letter of a run's first word to the end of its last word."""
    if text is None or not runs:
        return text
    data = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in WORD.finditer(data.lower())]
    out, done = [], 0
    for first, end in runs:
        out.append(data[done : at[first][0]])
        done = at[end - 1][1]
    return b"".join([*out, data[done:]]).decode("utf-8", "surrogatepass")


def cleaned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE_LIMIT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with hit spans cut out of the texts (``n_chars`` follows); documents mostly made of hits are dropped.
    One pass: only texts go to Python, and only changed ones come back."""
    small_batches(docs.sparkSession)
    blocks = automata(benchmark, window, block_words)

    @F.pandas_udf("dropped boolean, text string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = unpacked(blocks)
        for series in batches:
            rows: list[tuple[bool, str | None]] = []
            for text in series:
                words = WORD.findall(normalised(text))
                runs, _ = found_in(words, own)
                hit = sum(end - first for first, end in runs)
                dropped = hit > coverage * len(words)
                rows.append((dropped, cut(text, runs) if hit and not dropped else None))
            yield pd.DataFrame(rows, columns=["dropped", "text"])

    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("doc"), clean.asNondeterministic()("text").alias("clean"))  # no clash with the documents' names; one evaluation, as the filter stays above it
    touched = F.col("clean.text").isNotNull()
    new = {"text": F.coalesce("clean.text", "doc.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(touched, F.length("clean.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))
    return rows.where("not clean.dropped").select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return report(hits(docs.select("doc_id", "text"), benchmark))
