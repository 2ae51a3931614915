"""Line dedup: lines that several documents hold stay in the one with the smallest doc_id only.

A text is split at ``\\n``. The key of a line is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lowered; keys of
at least ``LEAST`` code points count. The steps:

1. Each document gives a row for each of its different keys: the key's 128-bit hash, the document and the places of its
   lines. Rows are stored in the shared folder.
2. Rows are range-partitioned and sorted by hash, document and place. A range is streamed batch by batch: the first row
   of a hash tells the smallest document, rows of later documents are dropped lines. Ranges are cut by document as well
   as by hash, so a line of a third of all documents fills several ranges instead of one.
3. A hash whose rows begin in an earlier range has its first document there. So a range tells the first documents of its
   first and last hash, and leaves open the first rows of its first hash, until those few rows are met.
4. The dropped places of a document become a compressed bitmap of the lines it keeps. Texts take no part in the steps
   above; ``deduplicated`` and ``line_digests`` meet them with the bitmaps at last.

A document is known by its doc_id and the MD5 of its text, and so are the bitmaps: equal rows have one bitmap. Keys are
known by their 128-bit hashes (BLAKE2b) and not compared again.

Defined cases: a null text is empty, one empty line; a null doc_id counts as greater than all others and equal to other
nulls; rows that share a doc_id are one document, so none of them loses a line to another of them, and equal lines of the
smallest document all stay; texts of any length take memory in proportion to themselves; an empty table gives no rows;
other columns are ignored, or, in ``deduplicated``, returned as they are.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.tables import stored

LEAST = 10
BLANKS = b" \t\n\x0b\x0c\r"
LAST = np.iinfo(np.int64).max

#: A key's hash, its document, and the places of its lines among all lines of the document.
LINES = "high long, low long, id long, content binary, n_lines int, places array<int>"
#: What a streamed range tells of a row.
DROPPED, OPEN, EDGE = 0, 1, 2

_LINES = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("id", pa.int64()), ("content", pa.binary()), ("n_lines", pa.int32()), ("places", pa.list_(pa.int32()))])
_TOLD = _LINES.append(pa.field("kind", pa.int32()))


def _identified(docs: DataFrame) -> tuple[Column, Column, Column]:
    """Bytes of the text, doc_id with null as the last one, and the text's MD5."""
    data = F.coalesce(docs["text"], F.lit("")).cast("binary")
    return data.alias("data"), F.coalesce(docs["doc_id"].cast("long"), F.lit(int(LAST))).alias("id"), F.unhex(F.md5(data)).alias("content")


def key_places(data: bytes) -> tuple[int, dict[bytes, list[int]]]:
    """Number of lines, and the places of each key that counts."""
    lines = data.split(b"\n")
    found: dict[bytes, list[int]] = {}
    for place, line in enumerate(lines):
        key = line.strip(BLANKS)
        if len(key) >= LEAST and (key.isascii() or len(key.decode("utf-8", "replace")) >= LEAST):
            found.setdefault(key.lower(), []).append(place)
    return len(lines), found


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for data, doc_id, content in zip(batch["data"], batch["id"].to_pylist(), batch["content"].to_pylist(), strict=True):
            n_lines, found = key_places(data.as_py())
            rows += [(hashlib.blake2b(key, digest_size=16).digest(), doc_id, content, n_lines, places) for key, places in found.items()]
        if rows:
            hashes, *rest = zip(*rows, strict=True)
            high, low = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2).T
            yield pa.record_batch([pa.array(high), pa.array(low), *(pa.array(x, f.type) for x, f in zip(rest, list(_LINES)[2:], strict=True))], schema=_LINES)


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams one sorted range; only the hash and the first document of the last row are carried from batch to batch."""
    before: tuple[int, int, int] | None = None  # hash and first document of the hash that the last batch ended with
    head: tuple[int, int] | None = None  # the first hash of the range
    for batch in batches:
        if not batch.num_rows:
            continue
        high, low, ids = (batch[c].to_numpy() for c in ("high", "low", "id"))
        new = np.ones(len(ids), dtype=bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        new[0] = before is None or before[:2] != (high[0], low[0])
        run = np.cumsum(new) - 1
        firsts = ids[new]
        first = np.where(run < 0, before[2] if before else 0, firsts[np.maximum(run, 0)] if len(firsts) else 0)
        if head is None:
            head = int(high[0]), int(low[0])
            yield _edge(*head, int(first[0]))
        dropped = ids != first
        opened = ~dropped & (high == head[0]) & (low == head[1])
        kind = np.where(dropped, DROPPED, OPEN).astype(np.int32)
        chosen = np.flatnonzero(dropped | opened)
        if len(chosen):
            part = batch.take(pa.array(chosen))
            yield pa.record_batch([*part.columns, pa.array(kind[chosen])], schema=_TOLD)
        before = int(high[-1]), int(low[-1]), int(first[-1])
    if before:
        yield _edge(*before)


def _edge(high: int, low: int, first: int) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x], f.type) for x, f in zip((high, low, first, b"", 0, [], EDGE), _TOLD, strict=True)], schema=_TOLD)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, bitmaps = [], []
        for n_lines, places in zip(batch["n_lines"].to_pylist(), batch["gone"], strict=True):
            keep = np.ones(n_lines, dtype=bool)
            keep[places.values.to_numpy()] = False
            counts.append(int(n_lines - keep.sum()))
            bitmaps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.record_batch([batch["id"], batch["content"], batch["n_lines"], pa.array(counts, pa.int64()), pa.array(bitmaps, pa.binary())], names=["id", "content", "n_lines", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """id, content, n_lines, n_dropped and keep, a compressed bitmap of the lines that stay, of each document that loses any."""
    lines = stored(docs.select(*_identified(docs)).mapInArrow(_keys, LINES), "lines")
    by = ["high", "low", "id", "content"]
    told = stored(lines.repartitionByRange(*by).sortWithinPartitions(*by, "places").mapInArrow(_told, f"{LINES}, kind int"), "line-places")
    first = told.where(F.col("kind") == EDGE).groupBy("high", "low").agg(F.min("id").alias("first"))
    late = told.where(F.col("kind") == OPEN).join(first, ["high", "low"]).where("first < id")
    columns = ["id", "content", "n_lines", "places"]
    gone = told.where(F.col("kind") == DROPPED).select(columns).unionByName(late.select(columns))
    whole = gone.groupBy("id", "content", "n_lines").agg(F.flatten(F.collect_set("places")).alias("gone"))
    return whole.mapInArrow(_packed, "id long, content binary, n_lines int, n_dropped long, keep binary")


def kept_lines(data: bytes, keep: bytes) -> bytes:
    lines = data.split(b"\n")
    stays = np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8), count=len(lines))
    return b"\n".join([line for line, stay in zip(lines, stays.tolist(), strict=True) if stay])


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [kept_lines(data.as_py(), keep.as_py()) if keep.is_valid else data.as_py() for data, keep in zip(batch["data"], batch["keep"], strict=True)]
        yield pa.record_batch([batch["row"], pa.array(kept, pa.binary()), batch["n_dropped"]], names=["row", "kept", "n_dropped"])


def _met(docs: DataFrame, row: Column, kind: str) -> DataFrame:
    """``row``, kept bytes and number of dropped lines of each document."""
    met = docs.select(row.alias("row"), *_identified(docs)).join(keep_bitmaps(docs).drop("n_lines"), ["id", "content"], "left")
    return met.select("row", "data", "keep", "n_dropped").mapInArrow(_rebuilt, f"row {kind}, kept binary, n_dropped long")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents with the lines that they keep; all other columns as they are. A null text stays null."""
    out = _met(docs, F.struct(*[docs[c] for c in docs.columns]), docs.schema.simpleString())
    text = F.when(F.col("row.text").isNotNull(), F.col("kept").cast("string"))
    return out.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def line_digests(docs: DataFrame) -> DataFrame:
    """doc_id, lines before dropping, dropped lines, and SHA-256 of what is kept, of every row."""
    n_lines = F.octet_length("text") - F.octet_length(F.regexp_replace("text", "\n", "")) + 1
    row = F.struct("doc_id", F.coalesce(n_lines, F.lit(1)).cast("long").alias("n_lines"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = _met(docs, row, f"struct<doc_id:{kind},n_lines:bigint>")
    return out.select("row.doc_id", "row.n_lines", F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
places AS (SELECT r, id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS l FROM docs),
keyed AS (SELECT r, id, i, l, translate(regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM places),
firsts AS (SELECT k, min(id) AS first FROM keyed WHERE length(k) >= {LEAST} GROUP BY k),
judged AS (SELECT r, i, l, coalesce(first < id, false) AS gone FROM keyed LEFT JOIN firsts ON keyed.k = firsts.k),
kept AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '') AS t FROM judged GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(t) AS kept_sha256 FROM docs JOIN kept USING (r)
"""
