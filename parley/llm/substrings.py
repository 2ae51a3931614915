"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` bytes that a document with a smaller doc_id also holds.

The steps, over whole texts as UTF-8 bytes:

1. Texts that are equal are one class (128-bit MD5); all but the smallest doc_id's are removed whole.
2. Anchors: in every window of ``LENGTH`` bytes the ``GRAM``-byte piece with the least hash. Equal windows have equal
   anchors, so strings of LENGTH bytes in two texts share an anchor; exact counts (``hash_tables``) say which anchors
   more than one text holds. All other windows occur in one text only.
3. A shared anchor sends its context, the LENGTH - GRAM bytes before it and the LENGTH bytes from it on, which hold all
   windows around it. Equal contexts of one chunk of documents are sent once, for the smallest doc_id.
   An anchor of more than ``HOT_CONTEXTS`` contexts, each chunk's different ones counted, sends each of those windows as a
   context of its own instead.
4. Contexts meet by anchor, windows of a hot anchor by their own hash, so that no anchor is one task's. Their suffixes
   are sorted by hash-compared mergesort (``suffix_sort``); equal contexts give everything to the smallest doc_id. Of
   what is left, the suffixes that start the windows are sorted, and equal windows go to the smallest doc_id. Equality
   is verified on the bytes.
5. The answers go back to the chunk, where the texts lie, and covered bytes are joined to runs.

The texts are shuffled once, as compressed bundles, and that shuffle is read by steps 2, 3 and 5. A task works through
its chunk ``SLICE`` bytes at a time, also within one text, so a text of many MB takes its own size in memory and eight
times that for the mask of its bytes. Nothing is capped: a hot anchor sends each chunk's distinct windows. Defined
cases: null and empty texts have no bytes and lose none, as do texts shorter than LENGTH; a repeated row keeps what the
first one keeps (its doc_id isn't smaller); a null doc_id comes after all others; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import hash_tables as H
from parley.llm import words as W
from parley.llm.suffix_sort import Bytes, equal_runs, repeated
from parley.llm.tables import stored

LENGTH = 50
GRAM = 30
BEFORE = LENGTH - GRAM
#: Context bytes, then how many of them before the anchor and from the anchor on are in the text.
ROW = BEFORE + LENGTH + 2
ALL = np.uint32((1 << (BEFORE + 1)) - 1)
#: Smaller than elsewhere: contexts of all shared anchors of a chunk take up to seven times its size.
CHUNK_BYTES = 2 << 20
BUCKET_HASHES = 1_000_000
#: Bytes whose anchors, and contexts whose rows, are made at a time.
SLICE = 1 << 18
ROWS_AT_ONCE = 1 << 15
BUCKET_CONTEXTS = 100_000
SORTED_AT_ONCE = 8_000
#: An anchor of more contexts than this is compared window by window; one context takes 3.6 KB while it is sorted.
HOT_CONTEXTS = 12_000
#: About this many bytes to an anchor, for numbers of buckets only.
ANCHOR_BYTES = (BEFORE + 2) // 2
LAST = np.iinfo(np.int64).max

SENT = "key long, chunk long, bucket long, body binary, docs binary"


def _zip(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(array).tobytes())


def _unzip(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=kind)


class Chunk:
    """Texts of a chunk joined by one byte, and where each begins and ends."""

    def __init__(self, texts: list[bytes]) -> None:
        self.data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.cumsum(lengths + 1) - lengths - 1
        self.ends = self.starts + lengths

    def owner(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, side="right") - 1


def _least(grams: np.ndarray) -> np.ndarray:
    """Place of the least hash among each BEFORE + 1 neighbours, found by doubling; the low bits of a hash tell its place."""
    low = np.uint64(127)
    least = (grams & ~low) | (np.arange(len(grams), dtype=np.uint64) & low)
    span = 1
    while span * 2 <= BEFORE + 1:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = BEFORE + 1 - span
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    windows = np.arange(len(least))
    return windows + ((least - windows.astype(np.uint64)) & low).astype(np.int64)


def anchors(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the anchors of all windows that lie within one text."""
    hashes, places = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    last = -1  # the last place taken; a window of the next slice can have it again
    for begin in range(0, len(chunk.data) - LENGTH + 1, SLICE):
        data = chunk.data[begin : begin + SLICE + LENGTH - 1]
        sums, down = W.prefix_sums(data)
        grams = W.mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1])
        place = _least(grams)
        window = np.arange(begin, begin + len(place))
        within = window + LENGTH <= chunk.ends[chunk.owner(window)]
        chosen = np.zeros(len(grams), dtype=bool)
        chosen[place[within]] = True
        chosen[: max(0, last + 1 - begin)] = False
        at = np.flatnonzero(chosen)
        hashes.append(grams[at])
        places.append(at + begin)
        last = int(places[-1][-1]) if len(at) else last
    return np.concatenate(hashes), np.concatenate(places)


def fill_contexts(rows: np.ndarray, chunk: Chunk, place: np.ndarray) -> None:
    """Rows of ``ROW`` bytes for anchors; bytes outside their text are 0."""
    padded = np.concatenate([np.zeros(BEFORE, np.uint8), chunk.data, np.zeros(LENGTH, np.uint8)])
    around = np.lib.stride_tricks.sliding_window_view(padded, BEFORE + LENGTH)
    column = np.arange(BEFORE + LENGTH, dtype=np.int16)
    for i in range(0, len(place), ROWS_AT_ONCE):
        at = place[i : i + ROWS_AT_ONCE]
        text = chunk.owner(at)
        before, after = np.minimum(at - chunk.starts[text], BEFORE).astype(np.int16), np.minimum(chunk.ends[text] - at, LENGTH).astype(np.int16)
        part = rows[i : i + ROWS_AT_ONCE]
        part[:, :-2] = around[at]
        part[:, :-2] *= (column >= BEFORE - before[:, None]) & (column < BEFORE + after[:, None])
        part[:, -2], part[:, -1] = before, after


def windows_around(chunk: Chunk, place: np.ndarray) -> np.ndarray:
    """Distinct first bytes of the windows around anchors that lie within one text."""
    out = [np.zeros(0, dtype=np.int64)]
    for o in range(BEFORE + 1):
        at = place - o
        text = chunk.owner(place)
        out.append(at[(at >= chunk.starts[text]) & (at + LENGTH <= chunk.ends[text])])
    return np.unique(np.concatenate(out))


def fill_windows(rows: np.ndarray, chunk: Chunk, place: np.ndarray) -> None:
    """Rows of single windows: contexts with nothing before the anchor."""
    rows[:, :BEFORE], rows[:, -2], rows[:, -1] = 0, 0, LENGTH
    if len(place):
        rows[:, BEFORE : BEFORE + LENGTH] = np.lib.stride_tricks.sliding_window_view(chunk.data, LENGTH)[place]


def row_hashes(rows: np.ndarray) -> np.ndarray:
    """One hash for each row of bytes, eight bytes at a time."""
    out = np.full(len(rows), rows.shape[1], dtype=np.uint64)
    for i in range(0, len(rows), ROWS_AT_ONCE):
        part, h = rows[i : i + ROWS_AT_ONCE], out[i : i + ROWS_AT_ONCE]
        for k in range(0, rows.shape[1], 8):
            eight = np.zeros((len(part), 8), dtype=np.uint8)
            eight[:, : min(8, rows.shape[1] - k)] = part[:, k : k + 8]
            h[:] = W.mix(h * W.ODD + eight.view("<u8").ravel())
    return out


def _represented(bodies: pd.Series, chosen: pd.DataFrame) -> tuple[list[bytes], list[bytes], np.ndarray]:
    """Node, text and doc_id (null as LAST) of the rows of a chunk that represent a class, each class once, by node."""
    wanted = {bytes(n): (LAST if pd.isna(i) else int(i)) for i, n in zip(chosen["doc_id"], chosen["node"], strict=True)}
    found: dict[bytes, bytes] = {}
    for doc_id, data in zip(*H.unbundled(bodies), strict=True):
        if len(data) >= LENGTH:
            node = hashlib.md5(data, usedforsecurity=False).digest()
            if node not in found and wanted.get(node) == (LAST if doc_id is None else doc_id):
                found[node] = data
    nodes = sorted(found)
    return nodes, [found[n] for n in nodes], np.array([wanted[n] for n in nodes], dtype=np.int64)


def context_hashes(chunk: Chunk, place: np.ndarray) -> np.ndarray:
    """Hashes of the contexts of anchors (in order), without their rows."""
    out = np.empty(len(place), dtype=np.uint64)
    for i in range(0, len(place), ROWS_AT_ONCE):
        at = place[i : i + ROWS_AT_ONCE]
        text = chunk.owner(at)
        start, stop = np.maximum(at - BEFORE, chunk.starts[text]), np.minimum(at + LENGTH, chunk.ends[text])
        low = int(start.min())
        sums, down = W.prefix_sums(chunk.data[low : int(stop.max())])
        sides = ((at - start) * 256 + stop - at).astype(np.uint64)
        out[i : i + ROWS_AT_ONCE] = W.mix((sums[stop - low] - sums[start - low]) * down[start - low] ^ sides * W.ODD)
    return out


def _asked(hashes: np.ndarray, text: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct anchor hashes of a chunk, and how many different contexts of each it has to send; 2 at least for an anchor
    of several texts, so that over all chunks a sum of 1 tells an anchor of one text."""
    order = np.lexsort((context, hashes))
    hashes, text, context = hashes[order], text[order], context[order]
    first = np.flatnonzero(np.diff(hashes, prepend=hashes[0] + np.uint64(1)) != 0)
    other = np.ones(len(order), dtype=np.int64)
    other[1:] = (hashes[1:] != hashes[:-1]) | (context[1:] != context[:-1])
    several = np.maximum.reduceat(text, first) != np.minimum.reduceat(text, first)
    return hashes[first], np.maximum(np.add.reduceat(other, first), 1 + several)


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each distinct row, and the number of the distinct row for each row; by hash, verified by bytes."""
    _, first, number = np.unique(row_hashes(rows), return_index=True, return_inverse=True)
    pieces = (slice(i, i + ROWS_AT_ONCE) for i in range(0, len(rows), ROWS_AT_ONCE))
    if not all(np.array_equal(rows[piece], rows[first[number[piece]]]) for piece in pieces):
        _, first, number = np.unique(np.ascontiguousarray(rows).view(f"V{ROW}").ravel(), return_index=True, return_inverse=True)
    return first, number


def _sent(chunk: int, nodes: list[bytes], texts: list[bytes], ids: np.ndarray, totals: np.ndarray, buckets: int, hot_contexts: int) -> pd.DataFrame:
    """Distinct contexts of the shared anchors by bucket, and one row that keeps for each text which contexts it holds."""
    joined = Chunk(texts)
    grams, place = anchors(joined)
    times = totals[np.searchsorted(np.unique(grams), grams)]
    hot = windows_around(joined, place[times > hot_contexts])
    keep = (times > 1) & (times <= hot_contexts)
    grams, place = grams[keep], place[keep]
    rows = np.empty((len(place) + len(hot), ROW), dtype=np.uint8)
    fill_contexts(rows[: len(place)], joined, place)
    fill_windows(rows[len(place) :], joined, hot)
    route, place = np.concatenate([grams, row_hashes(rows[len(place) :])]), np.concatenate([place, hot])
    owner = joined.owner(place)
    representative, context = _distinct(rows)
    smallest = np.full(len(representative), LAST)
    np.minimum.at(smallest, context, ids[owner])
    bucket = ((route[representative] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    number = np.empty(len(order), dtype=np.int32)
    number[order] = np.arange(len(order))
    cuts = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order))
    out = [(int(bucket[order[i]]), chunk, int(bucket[order[i]]), _zip(rows[representative[order[i:j]]]), _zip(smallest[order[i:j]])) for i, j in zip(cuts, cuts[1:], strict=False)]
    decided = np.where(rows[:, -2] > 0, -1, -2)  # a smaller document of this chunk has the whole context (-1), or its one window (-2)
    mine = np.where(ids[owner] > smallest[context], decided, number[context]).astype(np.int32)
    by_text = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(texts)).astype(np.int32)
    local = np.concatenate([counts.view(np.uint8), ids.view(np.uint8), np.frombuffer(b"".join(nodes), np.uint8)])
    within = place - joined.starts[owner]
    out.append((-1 - chunk, chunk, -1, _zip(np.concatenate([within[by_text].astype(np.int32), mine[by_text]])), _zip(local)))
    return pd.DataFrame(out, columns=["key", "chunk", "bucket", "body", "docs"])


def _runs(text: Bytes, starts: np.ndarray, group: np.ndarray, limit: int, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each string its number among the distinct ones of its group, and the smallest document of each. Only strings whose hash isn't alone are sorted."""
    several = repeated(text, starts, group, limit)
    alone, again = np.flatnonzero(~several), np.flatnonzero(several)
    number, smallest = np.empty(len(starts), dtype=np.int64), [docs[alone]]
    number[alone] = np.arange(len(alone))
    if len(again):
        again = again[np.argsort(group[again], kind="stable")]
        order, new = equal_runs(text, starts[again], group[again], limit)
        number[again[order]] = len(alone) + np.cumsum(new) - 1
        smallest.append(np.minimum.reduceat(docs[again[order]], np.flatnonzero(new)))
    return number, np.concatenate(smallest)


def shared_windows(rows: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each context a mask of its windows that a smaller document holds: bit o for the window o bytes before the anchor."""
    text = Bytes(np.concatenate([rows.ravel(), np.zeros(ROW, np.uint8)]))
    at = np.arange(len(rows)) * ROW
    anchor = text.hashes(at + BEFORE, GRAM)
    kind, smallest = _runs(text, at, anchor, ROW, docs)
    first = np.empty(len(smallest), dtype=np.int64)
    first[kind[::-1]] = np.arange(len(rows))[::-1]
    mask = np.zeros(len(first), dtype=np.uint32)
    _, where, times = np.unique(anchor[first], return_inverse=True, return_counts=True)
    compared = np.flatnonzero(times[where] > 1)  # distinct contexts whose anchor has others
    if len(compared) and rows[first[compared], -2].any():  # single windows are equal as contexts or not at all
        before, after = rows[first[compared], -2].astype(np.int64), rows[first[compared], -1].astype(np.int64)
        offset = np.arange(BEFORE + 1)
        who, o = np.nonzero((offset <= before[:, None]) & (LENGTH - offset <= after[:, None]))
        who = compared[who]
        run, first_doc = _runs(text, first[who] * ROW + BEFORE - o, anchor[first[who]], LENGTH, smallest[who])
        taken = first_doc[run] < smallest[who]
        np.bitwise_or.at(mask, who[taken], np.uint32(1) << o[taken].astype(np.uint32))
    whole = np.where(rows[:, -2] > 0, ALL, np.uint32(1))
    return np.where(docs > smallest[kind], whole, mask[kind])


def _met(pdf: pd.DataFrame) -> pd.DataFrame:
    """Answers of one bucket of contexts; a chunk's own row passes."""
    if pdf["key"].iloc[0] < 0:
        return pdf
    parts = [_unzip(x, np.uint8).reshape(-1, ROW) for x in pdf["body"]]
    rows, docs = np.concatenate(parts), np.concatenate([_unzip(x, np.int64) for x in pdf["docs"]])
    anchor = row_hashes(rows[:, BEFORE : BEFORE + GRAM])
    order = np.argsort(anchor, kind="stable")
    begins = np.flatnonzero(np.diff(anchor[order], prepend=anchor[order[0]] + np.uint64(1)) != 0)
    masks = np.zeros(len(rows), dtype=np.uint32)
    start = 0
    for end in [*begins[1:].tolist(), len(rows)]:  # whole anchors, about SORTED_AT_ONCE contexts at a time
        if end - start >= SORTED_AT_ONCE or end == len(rows):
            piece = order[start:end]
            masks[piece] = shared_windows(rows[piece], docs[piece])
            start = end
    cuts = np.cumsum([0] + [len(p) for p in parts])
    return pdf.assign(body=[_zip(masks[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], docs=None)


def covered(length: int, place: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which bytes of a text the marked windows around its anchors cover."""
    edge = np.zeros(length + LENGTH + 1, dtype=np.int64)
    whole = mask == ALL
    np.add.at(edge, np.maximum(place[whole] - BEFORE, 0), 1)
    np.add.at(edge, np.minimum(place[whole] + LENGTH, length), -1)
    place, mask = place[~whole & (mask > 0)], mask[~whole & (mask > 0)]
    for o in range(BEFORE + 1):
        start = place[(mask >> np.uint32(o)) & np.uint32(1) == 1] - o
        np.add.at(edge, start, 1)
        np.add.at(edge, start + LENGTH, -1)
    return np.cumsum(edge)[:length] > 0


def _spans(bodies: pd.Series, side: pd.DataFrame) -> Iterator[tuple[int | None, bytes, np.ndarray]]:
    """doc_id and UTF-8 bytes of each row of a chunk with a mask of the bytes to remove."""
    local = side[side["key"] < 0]
    parts = [_unzip(x, np.uint32) for x in side[side["key"] >= 0].sort_values("bucket")["body"]]
    masks = np.concatenate([*parts, np.array([1, ALL], dtype=np.uint32)])  # the last two, at -2 and -1, for what the chunk decided
    held: dict[tuple[bytes, int], tuple[np.ndarray, np.ndarray]] = {}
    if len(local):
        head = _unzip(local["docs"].iloc[0], np.uint8).tobytes()
        n = len(head) // 28
        counts, ids, nodes = np.frombuffer(head, np.int32, n), np.frombuffer(head, np.int64, n, 4 * n), head[12 * n :]
        place, context = np.split(_unzip(local["body"].iloc[0], np.int32), 2)
        cuts = np.cumsum([0, *counts.tolist()])
        held = {(nodes[16 * i : 16 * i + 16], int(ids[i])): (place[cuts[i] : cuts[i + 1]], context[cuts[i] : cuts[i + 1]]) for i in range(n)}
    for doc_id, data in zip(*H.unbundled(bodies), strict=True):
        gone = np.zeros(len(data), dtype=bool)
        if len(data) >= LENGTH:
            own = hashlib.md5(data, usedforsecurity=False).digest(), LAST if doc_id is None else doc_id
            if own in held:
                place, context = held[own]
                gone = covered(len(data), place.astype(np.int64), masks[context])
            else:
                gone[:] = True  # a smaller document has the same text
        yield doc_id, data, gone


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removed(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, bucket_hashes: int = BUCKET_HASHES, bucket_contexts: int = BUCKET_CONTEXTS, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """doc_id, bytes, bytes and runs removed, and SHA-256 of what is kept, of every row of ``docs``."""
    total = H.text_bytes(docs)
    chunks = max(1, math.ceil(total / chunk_bytes))
    hash_buckets = max(1, math.ceil(total / ANCHOR_BYTES / bucket_hashes))
    context_buckets = max(1, math.ceil(total / ANCHOR_BYTES / bucket_contexts))
    node = F.unhex(F.md5(F.col("text").cast("binary")))
    dealt = H.bundles(docs, chunks, node)
    long = docs.where(F.octet_length("text") >= LENGTH).select("doc_id", node.alias("node"))
    classes = stored(long.groupBy("node").agg(F.min("doc_id").alias("doc_id")), "text-classes")
    chosen = classes.withColumn("chunk", H.chunk_of(classes["doc_id"], chunks, classes["node"]))
    kind = docs.schema["doc_id"].dataType.simpleString()
    blank = pd.DataFrame({"key": [], "chunk": [], "bucket": [], "body": [], "docs": []}, dtype=object)

    def ask(pdf: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        _, texts, _ = _represented(pdf["body"], chosen)
        joined = Chunk(texts)
        grams, place = anchors(joined)
        if not len(grams):
            return H.no_blocks()
        return H.blocks(int(pdf["chunk"].iloc[0]), *_asked(grams, joined.owner(place), context_hashes(joined, place)), hash_buckets)

    def send(pdf: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        nodes, texts, ids = _represented(pdf["body"], side[side["node"].notna()])
        if not texts:
            return blank
        return _sent(int(pdf["chunk"].iloc[0]), nodes, texts, ids, H.answered(side[side["node"].isna()]), context_buckets, hot_contexts)

    def finish(pdf: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        ids, rows = [], []
        for doc_id, data, gone in _spans(pdf["body"], side):
            runs = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            ids.append(doc_id)
            rows.append((len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
        out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
        out.insert(0, "doc_id", pd.array(ids, dtype="Int64"))
        return out

    null = F.lit(None)
    answers = H.totals(dealt.groupBy("chunk").cogroup(chosen.groupBy("chunk")).applyInPandas(ask, H.BLOCKS))
    known = chosen.select("chunk", "doc_id", "node", null.cast("long").alias("bucket"), null.cast("binary").alias("totals"))
    side = known.unionByName(answers.select("chunk", null.cast(kind).alias("doc_id"), null.cast("binary").alias("node"), "bucket", "totals"))
    sent = dealt.groupBy("chunk").cogroup(side.groupBy("chunk")).applyInPandas(send, SENT)
    met = sent.groupBy("key").applyInPandas(_met, SENT)
    return dealt.groupBy("chunk").cogroup(met.groupBy("chunk")).applyInPandas(finish, f"doc_id {kind}, {RESULT}")
