"""Toxicity: a factorization machine over hashed terms.

Terms of a text (A-Z lowered, ASCII punctuation as blanks) are its words and their first 3 to 7 bytes, hashed into
``BUCKETS`` buckets; one more term stands for the text's length class. With x = log(1 + count) a text's logit is

    b + sum w_i x_i + sum over i<j of <v_i, v_j> x_i x_j

so pairs of terms (an insult with a group, an insult with a length class) count beyond what each adds alone. The
machine is trained on at most ``TRAIN_ROWS`` labelled rows, those with the smallest hash of doc_id, on the buckets whose
chi-square in them is ``TELLING`` or more. Texts are scored whole, in one pass without a shuffle. Labels,
language, source and doc_id are never inputs of a score.

Defined cases: null and empty texts have the empty term set and get a score from b and the length class; repeated rows
score alike; a null doc_id counts as held out (the CRC of no bytes is 0) and is never trained on; without labelled
rows, or with one class only, every score is 0; a score of exactly 0.5 counts as toxic; a very long text is worked on whole,
in arrays of about 100 times its bytes; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm import words as W
from parley.llm.tables import small_batches

BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
PREFIXES = (3, 4, 5, 6, 7)
LENGTHS = 24
TRAIN_ROWS = 8_000
#: Least chi-square of a term that is learned: about one bucket in a million has it by chance.
TELLING = 24.0
FACTORS = 8
EPOCHS = 40
BATCH = 256
RATE = 0.01
TOXIC_WEIGHT = 2.0
L2_LINEAR, L2_FACTORS = 1e-4, 1e-3

_PLAIN = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def prepared(text: str | None) -> bytes:
    return W.encoded(text, lower=True).translate(_PLAIN)


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, bucket and count of each distinct bucket of each text; length class of each text."""
    data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    hashes, text, first, end = W.hashed_words(texts)
    sums, down = W.prefix_sums(data)
    found, owner = [hashes], [text]
    for n in PREFIXES:
        long = np.flatnonzero(end - first > n)
        found.append(W.mix((sums[first[long] + n] - sums[first[long]]) * down[first[long]] + np.uint64(n)))
        owner.append(text[long])
    bucket = np.concatenate(found) >> np.uint64(64 - BUCKET_BITS)
    keys, counts = np.unique(np.concatenate(owner).astype(np.uint64) << np.uint64(BUCKET_BITS) | bucket, return_counts=True)
    lengths = np.minimum(np.log2(np.bincount(text, minlength=len(texts)) + 1), LENGTHS - 1).astype(np.int64)
    return (keys >> np.uint64(BUCKET_BITS)).astype(np.int64), (keys & np.uint64(BUCKETS - 1)).astype(np.int64), counts, lengths


@dataclass
class Machine:
    """A trained machine: ``column`` maps a bucket to its row of w and v, or -1; length classes have the last rows."""

    column: np.ndarray = field(default_factory=lambda: np.full(BUCKETS, -1, dtype=np.int32))
    bias: float = -np.inf
    linear: np.ndarray = field(default_factory=lambda: np.zeros(LENGTHS))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((LENGTHS, FACTORS)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        n = len(texts)
        if not np.isfinite(self.bias):
            return np.zeros(n)
        text, bucket, count, length = terms(texts)
        column = self.column[bucket]
        known = column >= 0
        owner = np.concatenate([text[known], np.arange(n)])
        column = np.concatenate([column[known], len(self.linear) - LENGTHS + length])
        x = np.concatenate([np.log1p(count[known]), np.ones(n)])
        total = np.bincount(owner, weights=self.linear[column] * x, minlength=n) + self.bias
        for k in range(FACTORS):
            part = self.factors[column, k] * x
            total += 0.5 * (np.bincount(owner, weights=part, minlength=n) ** 2 - np.bincount(owner, weights=part**2, minlength=n))
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def telling(toxic: np.ndarray, rows: np.ndarray, n_toxic: int, n: int) -> np.ndarray:
    """The buckets whose chi-square is ``TELLING`` or more, the largest first, from the numbers of toxic and of all training
    rows that hold each. They are as many as the training rows support."""
    share = n_toxic / n
    expected = rows * share
    chi = (toxic - expected) ** 2 / np.maximum(expected * (1 - share) * (1 - rows / n), 1e-9)
    chosen = np.argsort(-chi, kind="stable")
    return chosen[chi[chosen] >= TELLING]


def train(rows: list[tuple[np.ndarray, np.ndarray, int, int]], chosen: np.ndarray, seed: int = 7) -> Machine:
    """``rows``: chosen buckets, counts, length class and label of each training text."""
    label = np.array([r[3] for r in rows], dtype=np.float64)
    if not rows or label.min() == label.max():
        return Machine()
    column = np.full(BUCKETS, -1, dtype=np.int32)
    column[chosen] = np.arange(len(chosen))
    width = len(chosen) + LENGTHS
    # the terms of each row, and its length class as the last of them; only these are held, not a column for every bucket
    terms_of = [np.append(column[r[0].astype(np.int64)], len(chosen) + r[2]) for r in rows]
    values_of = [np.append(np.log1p(r[1]), 1.0) for r in rows]
    random = np.random.default_rng(seed)
    weight = np.where(label == 1, TOXIC_WEIGHT, 1.0)
    at: list[np.ndarray] = [np.full(1, -2.0), np.zeros(width), random.normal(0, 0.02, (width, FACTORS))]
    mean, square = [np.zeros_like(a) for a in at], [np.zeros_like(a) for a in at]
    order, step = np.arange(len(rows)), 0
    for _ in range(EPOCHS):
        random.shuffle(order)
        for begin in range(0, len(order), BATCH):
            chunk = order[begin : begin + BATCH]
            bias, linear, factors = at
            term, x = np.concatenate([terms_of[i] for i in chunk]), np.concatenate([values_of[i] for i in chunk])
            begins = np.cumsum([0] + [len(terms_of[i]) for i in chunk])[:-1]
            row = np.repeat(np.arange(len(chunk)), np.diff(np.append(begins, len(term))))
            part = factors[term] * x[:, None]
            summed = np.add.reduceat(part, begins)
            logit = bias + np.add.reduceat(linear[term] * x, begins) + 0.5 * ((summed**2).sum(1) - np.add.reduceat((part**2).sum(1), begins))
            miss = (1 / (1 + np.exp(-np.clip(logit, -35, 35))) - label[chunk]) * weight[chunk] / len(chunk)
            pull = miss[row] * x
            pairs = pull[:, None] * (summed[row] - part)
            slopes = [miss.sum(keepdims=True), np.bincount(term, pull, width) + L2_LINEAR * linear, np.stack([np.bincount(term, pairs[:, k], width) for k in range(FACTORS)], axis=1) + L2_FACTORS * factors]
            step += 1
            for i, slope in enumerate(slopes):  # Adam
                mean[i] = 0.9 * mean[i] + 0.1 * slope
                square[i] = 0.999 * square[i] + 0.001 * slope**2
                at[i] = at[i] - RATE * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
    return Machine(column, float(at[0][0]), at[1], at[2])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _rows_with(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of one task: the numbers of toxic and of all rows that hold each bucket; row -1 counts the rows."""
    toxic, rows = np.zeros(BUCKETS + 1, dtype=np.int64), np.zeros(BUCKETS + 1, dtype=np.int64)
    for pdf in batches:
        texts, label = [prepared(t) for t in pdf["text"]], pdf["toxic"].to_numpy()
        for a, b in W.slices(texts):
            text, bucket, _, _ = terms(texts[a:b])
            rows[:-1] += np.bincount(bucket, minlength=BUCKETS)
            toxic[:-1] += np.bincount(bucket[label[a:b][text] == 1], minlength=BUCKETS)
        rows[-1] += len(pdf)
        toxic[-1] += int((label == 1).sum())
    full = np.flatnonzero(rows)
    yield pd.DataFrame({"bucket": np.where(full == BUCKETS, -1, full), "toxic": toxic[full], "n": rows[full]})


def _features(chosen: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = np.zeros(BUCKETS, dtype=bool)
        wanted[chosen] = True
        for pdf in batches:
            texts = [prepared(t) for t in pdf["text"]]
            for a, b in W.slices(texts):
                text, bucket, count, length = terms(texts[a:b])
                text, bucket, count = text[wanted[bucket]], bucket[wanted[bucket]], count[wanted[bucket]]
                cuts = np.searchsorted(text, np.arange(b - a + 1))
                packed = [(bucket[i:j].astype("<u4").tobytes(), count[i:j].astype("<u4").tobytes()) for i, j in zip(cuts, cuts[1:], strict=False)]
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[a:b].reset_index(drop=True), "toxic": pdf["toxic"].iloc[a:b].to_numpy(), "buckets": [p[0] for p in packed], "counts": [p[1] for p in packed], "length": length})

    return run


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Machine:
    """Train on at most ``limit`` labelled rows that aren't held out; a doc_id labelled twice counts as toxic if it ever is."""
    small_batches(docs.sparkSession)
    usable = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    sample = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # ``limit`` rows of two numbers
    toxic, held = np.zeros(BUCKETS + 1, dtype=np.int64), np.zeros(BUCKETS + 1, dtype=np.int64)
    counts = rows.mapInPandas(_rows_with, "bucket long, toxic long, n long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    for r in counts.toLocalIterator():  # BUCKETS rows at most
        toxic[r["bucket"]], held[r["bucket"]] = r["toxic"], r["n"]
    if not 0 < toxic[-1] < held[-1]:
        return Machine()
    chosen = telling(toxic[:-1], held[:-1], int(toxic[-1]), int(held[-1]))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInPandas(_features(chosen), f"doc_id {kind}, toxic int, buckets binary, counts binary, length int")
    one = found.groupBy("doc_id").agg(F.max(F.struct("buckets", "counts", "length", "toxic")).alias("row")).orderBy("doc_id").select("row.*").collect()  # ``limit`` rows at most
    return train([(np.frombuffer(r["buckets"], "<u4"), np.frombuffer(r["counts"], "<u4"), r["length"], r["toxic"]) for r in one], chosen)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [prepared(t) for t in pdf["text"]]
            for a, b in W.slices(texts):
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[a:b].reset_index(drop=True), "score": shared.value.score(texts[a:b])})

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that the machine doesn't predict toxic. Only texts go to Python, only scores come back."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @F.pandas_udf("double")
    def score_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            texts = [prepared(t) for t in series]
            parts = [shared.value.score(texts[a:b]) for a, b in W.slices(texts)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.where(score_of("text") < 0.5)
