"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Words and word pairs of every whole text are hashed into ``BUCKETS`` buckets. The raw multinomial counts all rows of
the corpus; the target multinomial counts all trusted rows, those labelled as good text, but for one in ``HELD_BACK``. A
document's score is the mean over its n-grams of log(target share / raw share). All trusted rows held back from the target
(of several texts of a doc_id the least score) give the threshold, a lower fence of their scores, which takes their exact
quartiles; every document is compared with it, so its verdict is the same at every run. Labels meet documents by doc_id in a
shuffle, once with the texts and once with the scores; only bucket counts and bin counts reach the driver.

Defined cases: a null or empty text has no words, score 0 and fails the base rule; repeated rows get the same answer
each; a null doc_id is scored and is never trusted; an empty corpus gives no rows; without trusted rows the score is
0 and only the base rule decides; a score equal to the threshold is kept; a very long text is worked on whole, in arrays
of about 60 times its bytes; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm import words as W
from parley.llm.tables import small_batches, stored

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
#: One trusted row in HELD_BACK sets the threshold; the others make the target.
HELD_BACK = 4
FENCE = 3.0
SMOOTHING = 1.0
#: Bins of one pass that looks for a quantile.
BINS = 4096

BASE_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = b" \t\n\v\f\r"


def _per_text(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Number of set flags in each of the texts that begin at ``starts``."""
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[np.append(starts[1:], len(flags))] - sums[starts]


def repeated_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    found = 0
    for line in text.split(b"\n"):
        if line in seen:
            found += 1
        elif line.strip(_BLANK):
            seen.add(line)
    return found


def base_columns(texts: list[bytes], hashes: np.ndarray, text: np.ndarray) -> dict[str, np.ndarray]:
    """The columns of ``BASE_SCHEMA`` for texts whose words have been hashed."""
    data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    grams, at = W.ngrams(hashes, text, 8)
    with np.errstate(over="ignore"):
        _, group, times = np.unique(W.mix(grams + text[at].astype(np.uint64) * W.ODD), return_inverse=True, return_counts=True)
    cover = np.zeros(len(hashes) + 8, dtype=np.int64)
    again = at[times[group] > 1]
    np.add.at(cover, again, 1)
    np.add.at(cover, again + 8, -1)
    covered = np.cumsum(cover)[: len(hashes)] > 0
    n = len(texts)
    return {
        "n_words": np.bincount(text, minlength=n),
        "word_chars": _per_text(((data & 0xC0) != 0x80) & ~W._SPACE[data], starts),
        "n_symbols": _per_text(_SYMBOL[data], starts),
        "n_dup_lines": np.array([repeated_lines(t) for t in texts], dtype=np.int64),
        "n_repeat_words": np.bincount(text[covered], minlength=n),
    }


def features(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of each word and each pair of neighbouring words."""
    one, at_one = W.ngrams(hashes, text, 1)
    two, at_two = W.ngrams(hashes, text, 2)
    shift = np.uint64(64 - BUCKET_BITS)
    return (np.concatenate([one, two]) >> shift).astype(np.int64), np.concatenate([text[at_one], text[at_two]])


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bucket counts of one task: at most BUCKETS rows leave it, however many texts it reads."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for pdf in batches:
        texts = [W.encoded(t) for t in pdf["text"]]
        for a, b in W.slices(texts):
            hashes, text, _, _ = W.hashed_words(texts[a:b])
            counts += np.bincount(features(hashes, text)[0], minlength=BUCKETS)
    full = np.flatnonzero(counts)
    yield pd.DataFrame({"bucket": full, "n": counts[full]})


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log(target share / raw share) of each bucket, both shares smoothed towards the raw one."""
    if not target.sum() or not raw.sum():
        return np.zeros(BUCKETS)
    q = (raw + SMOOTHING) / (raw + SMOOTHING).sum()
    p = (target + SMOOTHING * BUCKETS * q) / (target.sum() + SMOOTHING * BUCKETS)
    return np.log(p / q)


def scores(texts: list[bytes], hashes: np.ndarray, text: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    bucket, owner = features(hashes, text)
    total = np.bincount(owner, weights=ratios[bucket], minlength=len(texts))
    return total / np.maximum(np.bincount(owner, minlength=len(texts)), 1)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """All doc_ids labelled as good text, each once."""
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()


def _among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows with one of the ids, of which there can be as many as documents: never broadcast, and texts are not sorted."""
    return rows.where("doc_id is not null").join(ids.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi")


def _bucket_counts(texts: DataFrame) -> np.ndarray:
    counts = np.zeros(BUCKETS)
    for row in texts.select("text").mapInPandas(_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        counts[row["bucket"]] = row["n"]
    return counts


def fit(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """Log ratios of the buckets: a pass over all rows of the corpus, and one over the trusted ones."""
    return log_ratios(_bucket_counts(docs), _bucket_counts(_among(docs.select("doc_id", "text"), trusted)))


def score(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, the base columns and ``score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [W.encoded(t) for t in pdf["text"]]
            for a, b in W.slices(texts):
                hashes, text, _, _ = W.hashed_words(texts[a:b])
                columns = base_columns(texts[a:b], hashes, text) | {"score": scores(texts[a:b], hashes, text, shared.value)}
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[a:b].reset_index(drop=True)} | columns)

    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, {BASE_SCHEMA}, score double")


def held_back() -> Column:
    """Trusted rows that do not count in the target, so that their scores are like those of unseen good text."""
    return F.pmod(F.xxhash64("doc_id", F.lit("held back")), F.lit(HELD_BACK)) == 0


def at_rank(values: DataFrame, column: str, rank: int) -> float:
    """The value at a place (from 0) of a column of numbers in order: bins are counted until the one that holds it has one value."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    inside = F.lit(True)
    while low < high:
        width = (high - low) / BINS
        bin_of = F.least(F.floor((F.col(column) - low) / width), F.lit(BINS - 1)) if width > 0 else (F.col(column) > low).cast("int")
        rows = values.where(inside).groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy("bin").collect()
        for row in rows:  # BINS at most, in order of their values
            if rank < row["n"]:
                low, high = row["low"], row["high"]
                break
            rank -= row["n"]
        inside = F.col(column).between(low, high)
    return low


def quantile(values: DataFrame, column: str, n: int, share: float) -> float:
    """The exact quantile of ``n`` values, linear between two places."""
    place = share * (n - 1)
    first, part = int(place), place - int(place)
    below = at_rank(values, column, first)
    return below if not part else below + part * (at_rank(values, column, first + 1) - below)


def threshold_of(scored: DataFrame, held: DataFrame) -> float:
    """Lower fence of the scores of the trusted rows held back: first quartile less FENCE interquartile ranges."""
    rows = _among(scored.where("n_words >= 20").select("doc_id", "score"), held)
    of_ids = stored(rows.groupBy("doc_id").agg(F.min("score").alias("score")), "held-back-scores")  # one for each id, however often it comes
    n = of_ids.count()
    if not n:
        return -float("inf")
    low, high = quantile(of_ids, "score", n, 0.25), quantile(of_ids, "score", n, 0.75)
    return low - FENCE * (high - low)


def judged(scored: DataFrame, threshold: float) -> DataFrame:
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Base columns, score and verdict of every row of ``docs``."""
    small_batches(docs.sparkSession)
    trusted = trusted_ids(labels)
    scored = stored(score(docs, fit(docs, trusted.where(~held_back()))), "quality-scores")
    return judged(scored, threshold_of(scored, trusted.where(held_back())))
