"""Language-model scores by stupid backoff, from count tables of all n-grams of the corpus.

Words are those of the lowered (A-Z) whole texts. The tables hold the counts of all n-grams up to ``ORDER`` and of the
empty n-gram (all words), partitioned by hash; every document's n-grams are joined to them and summed per document. A
document is scored by the rest of the corpus: its own counts are taken off. With c for counts so reduced, the score of
word w after history h of n-1 words is

    c(hw) / c(h)              if c(hw) > 0
    BACKOFF * score after h without its first word    otherwise

and at the empty history a word not seen elsewhere counts ``UNSEEN``. ``score`` is the sum of natural logarithms.

Counts are exact up to collisions of 64-bit hashes. Defined cases: null and empty texts have no words and score 0;
repeated rows and copies count as other documents; a null doc_id is a document like any other; a corpus of one document
has every word unseen; n-grams that count alike are told apart by their hash alone; a very long text is worked on whole,
in arrays of about 60 times its bytes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from parley.llm import hash_tables as H
from parley.llm import words as W

ORDER = 3
BACKOFF = 0.4
UNSEEN = 0.5
_EMPTY = np.uint64(0x1BADB002_5EEDF00D)
#: Larger than elsewhere: the more text a chunk holds, the less room its sorted hashes take.
CHUNK_BYTES = 6 << 20
#: About this many bytes of text to a word, for the number of buckets only.
WORD_BYTES = 6

RESULT = "n_words long, n_backoffs long, score double, mean_score double"


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Text number of each word, and for n = 1 to ``order`` the hashes of n-grams with the place of their first word."""
    text: list[np.ndarray] = []
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(order)]
    words = 0
    for a, b in W.slices(texts):
        hashes, owner, _, _ = W.hashed_words(texts[a:b])
        for n in range(order):
            gram, at = W.ngrams(hashes, owner, n + 1)
            found[n].append((gram, at + words))
        text.append(owner + a)
        words += len(hashes)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *text]), [(np.concatenate([none.astype(np.uint64), *(g for g, _ in f)]), np.concatenate([none, *(at for _, at in f)])) for f in found]


def distinct(text: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of all orders with their counts; the empty n-gram counts the words."""
    hashes, counts = np.unique(np.concatenate([g for g, _ in found]), return_counts=True)
    at = int(np.searchsorted(hashes, _EMPTY))
    return np.insert(hashes, at, _EMPTY), np.insert(counts, at, len(text))


def elsewhere(text: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]], n_texts: int, totals: np.ndarray) -> tuple[int, list[np.ndarray]]:
    """Words of the corpus, and for each order the occurrences of its n-grams outside their own documents."""
    every = np.concatenate([g for g, _ in found])
    order = np.argsort(every).astype(np.int32)  # a chunk has fewer than 2**31 n-grams
    every = every[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = every[1:] != every[:-1]
    empty = int(np.searchsorted(every[new], _EMPTY))
    del every
    words, totals = int(totals[empty]), np.delete(totals, empty)
    run = np.cumsum(new, dtype=np.int32) - np.int32(1)
    whose = run.astype(np.int64) * n_texts + np.concatenate([text[at] for _, at in found])[order]
    within = np.argsort(whose, kind="stable").astype(np.int32)  # almost sorted: only documents within one n-gram are not
    whose = whose[within]
    first = np.ones(len(within), dtype=bool)
    first[1:] = whose[1:] != whose[:-1]
    del whose
    own = np.diff(np.append(np.flatnonzero(first), len(within))).astype(np.int32)
    rest = np.empty(len(order), dtype=np.int64)
    rest[order[within]] = totals[run[within]] - own[np.cumsum(first, dtype=np.int32) - 1]
    return words, np.split(rest, np.cumsum([len(g) for g, _ in found])[:-1])


def scored(texts: list[bytes], order: int, backoff: float, totals: np.ndarray) -> pd.DataFrame:
    text, found = grams(texts, order)
    n = len(texts)
    words = np.bincount(text, minlength=n)
    everywhere, counts = elsewhere(text, found, n, totals)
    first = (np.cumsum(words) - words)[text]
    available = np.minimum(np.arange(len(text)) - first + 1, order)
    used = np.ones(len(text), dtype=np.int64)
    log = np.log(np.maximum(counts[0], UNSEEN) / np.maximum(everywhere - words, 1)[text])
    history = counts[0]
    for size in range(2, order + 1):
        at, count = found[size - 1][1], counts[size - 1]
        seen = count > 0
        last = at[seen] + size - 1
        log[last] = np.log(count[seen] / history[at[seen]])
        used[last] = size
        history = np.zeros(len(text), dtype=np.int64)
        history[at] = count
    log += (available - used) * math.log(backoff)
    total = np.bincount(text, weights=log, minlength=n)
    return pd.DataFrame({"n_words": words, "n_backoffs": np.bincount(text, weights=available - used, minlength=n).astype(np.int64), "score": total, "mean_score": total / np.maximum(words, 1)})


def scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, chunk_bytes: int = CHUNK_BYTES, bucket_hashes: int = H.BUCKET_HASHES) -> DataFrame:
    """doc_id, words, levels backed off, score and score per word of every row of ``docs``."""
    size = H.text_bytes(docs)
    chunks = max(1, math.ceil(size / chunk_bytes))
    buckets = max(1, math.ceil(size / WORD_BYTES * order / bucket_hashes))
    dealt = H.bundles(docs, chunks)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        _, texts = H.unbundled(pdf["body"])
        known, counts = distinct(*grams([t.lower() for t in texts], order))
        return H.blocks(int(pdf["chunk"].iloc[0]), known, counts, buckets)

    def join(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        ids, texts = H.unbundled(pdf["body"])
        out = scored([t.lower() for t in texts], order, backoff, H.answered(answers))
        out.insert(0, "doc_id", pd.array(ids, dtype="Int64"))
        return out

    answers = H.totals(dealt.groupBy("chunk").applyInPandas(ask, H.BLOCKS))
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(join, f"doc_id {kind}, {RESULT}")
