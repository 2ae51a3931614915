"""Count tables of 64-bit hashes, partitioned by hash, and their join back to the documents that asked.

Documents are dealt into chunks of about ``CHUNK_BYTES`` of text by a hash of doc_id, bundles by doc_id and text, so that
null and repeated doc_ids don't gather. A chunk sums its own hashes
first, so a hash leaves it once however often it occurs. Hashes go to range partitions ("buckets") of the hash space as
sorted, delta-coded blocks; a bucket adds up its blocks and answers every block with the totals of its hashes, in the
block's order. The chunk's documents are then met with the answers: the shuffle of texts by chunk is planned once and
read again. Chunks and buckets grow in number with the input and stay alike in size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20
BUCKET_HASHES = 1_500_000

BLOCKS = "chunk long, bucket long, hashes binary, counts binary"
ANSWERS = "chunk long, bucket long, totals binary"


def chunk_of(doc_id: Column, chunks: int, *more: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit("chunk"), *more), F.lit(chunks))


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def _bundled(ids: pa.Array, texts: pa.Array) -> bytes:
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    null = pc.is_null(ids).to_numpy(zero_copy_only=False).astype(np.int64)
    known = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    head = np.array([len(texts)], dtype=np.int64).tobytes() + known.tobytes() + null.tobytes() + lengths.tobytes()
    packer = zstandard.ZstdCompressor(level=3).compressobj()
    parts = [packer.compress(head)]
    parts += [packer.compress(text.as_buffer()) for text in texts if text.is_valid and len(text.as_buffer())]
    return b"".join([*parts, packer.flush()])


def bundles(docs: DataFrame, chunks: int, content: Column | None = None) -> DataFrame:
    """chunk and body: the documents (doc_id, text) that a task has for a chunk, compressed together before they are shuffled.

    Documents are dealt by doc_id and ``content``, a value of the text alone (by default the text). Texts stay in Arrow's
    buffers, as Spark's larger batches are wanted here: more text of a chunk together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk = batch["chunk"].to_numpy()
            order = np.argsort(chunk, kind="stable")
            cuts = np.append(np.flatnonzero(np.diff(chunk[order], prepend=-1)), len(order))
            for i, j in zip(cuts, cuts[1:], strict=False):
                rows = pa.array(order[i:j])
                body = _bundled(batch["doc_id"].take(rows), batch["text"].take(rows))
                yield pa.record_batch([pa.array([int(chunk[order[i]])], pa.int64()), pa.array([body], pa.binary())], names=["chunk", "body"])

    chunk = chunk_of(docs["doc_id"], chunks, docs["text"] if content is None else content)
    return docs.select("doc_id", docs["text"].cast("binary").alias("text"), chunk.alias("chunk")).mapInArrow(run, "chunk long, body binary")


def unbundled(bodies: pd.Series) -> tuple[list[int | None], list[bytes]]:
    """doc_ids and texts of a chunk, by doc_id (nulls last), then text, however they arrived."""
    rows: list[tuple[bool, int, bytes]] = []
    for body in bodies:
        data = zstandard.ZstdDecompressor().decompressobj().decompress(body)
        n = int.from_bytes(data[:8], "little")
        ids, null, lengths = np.frombuffer(data, np.int64, 3 * n, 8).reshape(3, n)
        at = 8 + 24 * n
        for doc_id, is_null, length in zip(ids.tolist(), null.tolist(), lengths.tolist(), strict=True):
            rows.append((bool(is_null), doc_id, data[at : at + length]))
            at += length
    rows.sort()
    return [None if is_null else doc_id for is_null, doc_id, _ in rows], [text for _, _, text in rows]


def in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows in an order that doesn't depend on how they arrived: by doc_id (nulls last), then text."""
    ids = pdf["doc_id"].isna()
    return pdf.assign(_null=ids, _text=pdf["text"].fillna("")).sort_values(["_null", "doc_id", "_text"], kind="stable").drop(columns=["_null", "_text"]).reset_index(drop=True)


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers, byte plane by byte plane, compressed; the first byte tells how many planes."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _from_planes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), dtype=np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel()


def pack(hashes: np.ndarray) -> bytes:
    """Sorted hashes: the first whole; of the steps between them the low bytes, which are random, as they are, and the rest compressed."""
    steps = np.diff(hashes)
    low = max(0, (int(np.median(steps)).bit_length() - 1) // 8) if len(steps) else 0
    raw = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :low]).tobytes()
    return bytes([low]) + hashes[:1].tobytes() + len(raw).to_bytes(8, "little") + raw + _planes(steps >> np.uint64(8 * low))


def unpack(data: bytes) -> np.ndarray:
    low, size = data[0], int.from_bytes(data[9:17], "little")
    high = _from_planes(data[17 + size :])
    steps = np.zeros((len(high), 8), dtype=np.uint8)
    steps[:, :low] = np.frombuffer(data, dtype=np.uint8, offset=17, count=size).reshape(len(high), low)
    out = np.empty(len(high) + 1, dtype=np.uint64)
    out[0] = np.frombuffer(data, dtype=np.uint64, offset=1, count=1)[0]
    out[1:] = steps.view("<u8").ravel() | high << np.uint64(8 * low)
    return np.cumsum(out, dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    return _planes(counts)


def unpack_counts(data: bytes) -> np.ndarray:
    return _from_planes(data).astype(np.int64)


def blocks(chunk: int, hashes: np.ndarray, counts: np.ndarray, buckets: int) -> pd.DataFrame:
    """One row for each bucket that the sorted distinct ``hashes`` of a chunk reach."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    ranges = list(zip(cuts, cuts[1:], strict=False))
    return pd.DataFrame({"chunk": chunk, "bucket": bucket[cuts[:-1]], "hashes": [pack(hashes[a:b]) for a, b in ranges], "counts": [pack_counts(counts[a:b]) for a, b in ranges]})


def no_blocks() -> pd.DataFrame:
    return pd.DataFrame({"chunk": [], "bucket": [], "hashes": [], "counts": []}, dtype=object)


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    parts = [unpack(x) for x in pdf["hashes"]]
    hashes, counts = np.concatenate(parts), np.concatenate([unpack_counts(x) for x in pdf["counts"]])
    order = np.argsort(hashes)
    new = np.diff(hashes[order], prepend=hashes[order[0]] + np.uint64(1)) != 0
    starts = np.flatnonzero(new)
    totals = np.empty(len(hashes), dtype=np.int64)
    totals[order] = np.add.reduceat(counts[order], starts)[np.cumsum(new) - 1]
    cuts = np.cumsum([0] + [len(p) for p in parts])
    return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "totals": [pack_counts(totals[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]})


def totals(asked: DataFrame) -> DataFrame:
    """For each block asked, the sums over all blocks of the counts of its hashes."""
    return asked.groupBy("bucket").applyInPandas(_answer, ANSWERS)


def answered(answers: pd.DataFrame) -> np.ndarray:
    """Totals of a chunk's sorted distinct hashes, from all its answers."""
    parts = [unpack_counts(x) for x in answers.sort_values("bucket")["totals"]]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
