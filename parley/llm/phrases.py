"""Phrase collocation mining: which sequences of two to five words occur together more often than their parts do.

Texts have A-Z lowered, are split into pieces at ``.,;:!?`` and ``\\x0A-\\x0D``, and those into words at blanks and tabs.
Everything is counted for each lang. A phrase of at least ``LEAST`` occurrences only has parts of at least as many. The steps:

1. Texts become chunks of about ``CHUNK_BYTES``: the chunk's words with their counts, and its text as numbers of those
   words (0 between pieces). Chunks are stored in the shared folder; texts aren't read again, and never shuffled.
2. Counts of all words by ``groupBy``; words of at least LEAST occurrences get dense ids, numbered within ``BLOCKS`` blocks
   of the dictionary. A chunk's words are joined to it: no task holds the dictionary, only its chunk's share. Pieces
   break at all other words.
3. At each place of a chunk the next ``LONGEST`` ids are packed into a binary key of fixed width, a byte or more an id,
   zeros beyond the end of a piece. Keys are radix-sorted, equal ones added up, and cut into ranges of the key space,
   whose bounds come from the keys of a few chunks; bounds only decide how even ranges are.
4. A range radix-sorts its keys once more. Sequences of 2, 3, 4 and 5 words are runs of equal prefixes, so one pass over
   the sorted keys counts all of them. Runs at either end of a range can go on in the next one, and are told whatever
   their count; a ``groupBy`` adds them up. A key leaves a chunk once however often it occurs there, so the most
   frequent sequence is one row of each chunk.
5. Candidates are cut after each word and joined with the counts of both parts; scores are exact decimals.

Defined cases: a null text has no words; null lang and ``und`` are one lang; doc_id isn't read, so null and repeated ones
don't matter; repeated rows count each; ties of cuts go to the shortest first part, ties of rank to the larger count,
then to the phrase that comes first by its UTF-8 bytes; a text of any length is cut into words ``SLICE`` bytes at a time
and takes eight bytes a word; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.tables import stored

LEAST = 100
SHORTEST, LONGEST = 2, 5
TOP = 2_000
NO_LANG = "und"
#: Text of a chunk, and of what is cut into words at once.
CHUNK_BYTES = 8 << 20
SLICE = 1 << 20
#: Keys of a range.
RANGE_KEYS = 1_500_000
#: Chunks whose keys are looked at for bounds, and keys of them for each range.
SAMPLED_CHUNKS = 16
SAMPLED_KEYS = 40
BLOCKS = 1_024
SALTS = 8

_BREAK = b"\xff"  # no byte of UTF-8
_AS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d", _BREAK * 10)
_ENDS = (b" ", b"\t", _BREAK)
_CHUNKS = pa.schema([("chunk", pa.string()), ("lang", pa.string()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())), ("n", pa.int64()), ("places", pa.binary())])


def _zip(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(array).tobytes())


def _unzip(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=kind)


def _slices(data: bytes) -> Iterator[bytes]:
    """Pieces of about ``SLICE`` bytes that end behind a word."""
    start = 0
    while start < len(data):
        stop = start + SLICE
        if stop < len(data):
            stop = min((at for at in (data.find(end, stop) for end in _ENDS) if at >= 0), default=len(data))
        yield data[start:stop]
        start = stop


class Chunk:
    """Texts of one lang as numbers of words: 0 between pieces, else 1 more than the word's place in ``words``."""

    def __init__(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__  # a new word gets the next number
        self.number[_BREAK]  # noqa: B018
        self.places = [np.zeros(1, dtype=np.uint32)]
        self.size = 0

    def add(self, text: bytes) -> None:
        for part in _slices(text.lower().translate(_AS)):
            words = part.replace(_BREAK, b" \xff ").split()
            self.places.append(np.fromiter(map(self.number.__getitem__, words), dtype=np.uint32, count=len(words)))
        self.places.append(self.places[0])
        self.size += len(text)

    def row(self, lang: str) -> dict:
        places = np.concatenate(self.places)
        counts = np.bincount(places, minlength=len(self.number))[1:]
        return {"chunk": uuid.uuid4().hex, "lang": lang, "words": list(self.number)[1:], "counts": counts.tolist(), "n": int(counts.sum()), "places": _zip(places)}


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_: defaultdict[str, Chunk] = defaultdict(Chunk)
    told = lambda rows: pa.RecordBatch.from_pylist(rows, schema=_CHUNKS)
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
            open_[lang].add(text.as_py())
            if open_[lang].size >= CHUNK_BYTES:
                yield told([open_.pop(lang).row(lang)])
            elif sum(chunk.size for chunk in open_.values()) >= 4 * CHUNK_BYTES:  # very many langs
                yield told([chunk.row(name) for name, chunk in open_.items()])
                open_.clear()
    if open_:
        yield told([chunk.row(name) for name, chunk in open_.items()])


def chunks(docs: DataFrame) -> DataFrame:
    """chunk, lang, words and their counts, n (all of them), places: the texts as stored numbers of words."""
    texts = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.col("text").cast("binary").alias("text")).where("length(text) > 0")
    return stored(texts.mapInArrow(_chunked, "chunk string, lang string, words array<binary>, counts array<long>, n long, places binary"), "phrase-chunks")


def dictionary(cut: DataFrame) -> DataFrame:
    """lang, word, f and a dense id from 1 of the words that occur ``LEAST`` times in their lang."""
    words = cut.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", F.col("w.words").alias("word"), F.col("w.counts").alias("f"))
    frequent = words.groupBy("lang", "word").agg(F.sum("f").alias("f")).where(F.col("f") >= LEAST)
    block = F.pmod(F.xxhash64("lang", "word"), F.lit(BLOCKS)).cast("int")
    numbered = stored(frequent.withColumn("block", block).withColumn("rank", F.row_number().over(Window.partitionBy("block").orderBy("lang", "word"))), "phrase-words")
    sizes = {row["block"]: row["count"] for row in numbered.groupBy("block").count().collect()}  # BLOCKS rows at most
    before = np.cumsum([0] + [sizes.get(b, 0) for b in range(BLOCKS)]).tolist()
    starts = F.array(*[F.lit(b).cast("long") for b in before[:-1]])
    return numbered.select("lang", "word", "f", (F.element_at(starts, F.col("block") + 1) + F.col("rank")).alias("id"))


def _translated(cut: DataFrame, known: DataFrame) -> DataFrame:
    """of (a chunk), place of a word in the chunk's words, id."""
    own = cut.select(F.col("chunk").alias("of"), "lang", F.posexplode("words").alias("at", "word"))
    return own.join(known.select("lang", "word", "id"), ["lang", "word"]).select("of", "at", "id")


def packed(places: np.ndarray, width: int) -> np.ndarray:
    """Keys of the next LONGEST ids at each place, as bytes, big-endian; places with fewer than SHORTEST are left out."""
    wide = np.concatenate([places, np.zeros(LONGEST - 1, dtype=places.dtype)])
    at = np.flatnonzero((wide[: len(places)] != 0) & (wide[1 : len(places) + 1] != 0))
    keys = np.zeros((len(at), LONGEST * width), dtype=np.uint8)
    going = np.ones(len(at), dtype=bool)
    for k in range(LONGEST):
        ids = wide[at + k]
        going &= ids != 0
        ids = np.where(going, ids, 0)
        for b in range(width):
            keys[:, k * width + b] = ids >> (8 * (width - 1 - b)) & 0xFF
    return keys


def radix_order(keys: np.ndarray) -> np.ndarray:
    """Order of fixed-width binary keys: stable passes from the last digit of 16 bits to the first."""
    odd = keys.shape[1] % 2
    order = np.arange(len(keys), dtype=np.int64)
    for k in range(keys.shape[1] - 2, -1 - odd, -2):
        digit = keys[:, k + 1].astype(np.uint16)
        if k >= 0:
            digit |= keys[:, k].astype(np.uint16) << 8
        order = order[np.argsort(digit[order], kind="stable")]  # of 16-bit numbers, numpy's stable sort is a radix sort
    return order


def _new(keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), dtype=bool)
    out[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    return out


def _added_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their counts."""
    order = radix_order(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(_new(keys))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _chunk_keys(places: bytes, words: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = _unzip(places, "<u4")
    ids = np.zeros(int(numbers.max(initial=0)) + 1, dtype=np.uint32)
    ids[words["at"].to_numpy(dtype=np.int64) + 1] = words["id"].to_numpy(dtype=np.uint32)
    keys = packed(ids[numbers], width)
    return _added_up(keys, np.ones(len(keys), dtype=np.int64))


def _planes(keys: np.ndarray) -> bytes:
    return _zip(keys.T)


def prefix_counts(keys: np.ndarray, counts: np.ndarray, width: int, least: int) -> list[tuple[bytes, int]]:
    """Prefixes of 2 to 5 ids of a range that occur ``least`` times in it, and those at its ends; keys are in order."""
    out = []
    for m in range(SHORTEST, LONGEST + 1):
        long = np.flatnonzero(keys[:, (m - 1) * width : m * width].any(axis=1))
        if not len(long):
            continue
        first = np.flatnonzero(_new(keys[long, : m * width]))
        total = np.add.reduceat(counts[long], first)
        told = total >= least
        told[[0, -1]] = True
        rows = keys[long[first[told]], : m * width]
        out += zip((row.tobytes() for row in rows), total[told].tolist(), strict=True)
    return out


def sequence_counts(cut: DataFrame, known: DataFrame, ids: int, places: int) -> DataFrame:
    """key (big-endian ids of ``width`` bytes) and f of every sequence of 2 to 5 words that occurs LEAST times."""
    width = max(1, (ids.bit_length() + 7) // 8)
    n_ranges = max(1, -(-places // RANGE_KEYS))
    n_chunks = cut.count()
    told = max(1, -(-SAMPLED_KEYS * n_ranges // min(SAMPLED_CHUNKS, max(n_chunks, 1))))

    def sampled(_: tuple, text: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        keys, _counts = _chunk_keys(text["places"].iloc[0], words, width) if len(text) else (np.zeros((0, 1), np.uint8), None)
        at = np.linspace(0, len(keys) - 1, min(told, len(keys))).astype(np.int64)
        return pd.DataFrame({"key": [keys[i].tobytes() for i in at]}, dtype=object)

    few = cut.where(F.pmod(F.xxhash64("chunk"), F.lit(-(-max(n_chunks, 1) // SAMPLED_CHUNKS))) == 0) if n_ranges > 1 else cut.limit(0)
    looked = few.select("chunk", "places").groupBy("chunk").cogroup(_translated(few, known).groupBy("of")).applyInPandas(sampled, "key binary")
    seen = sorted(bytes(row["key"]) for row in looked.collect()) if n_ranges > 1 else []  # about SAMPLED_KEYS for each range
    bounds = np.array(sorted({seen[len(seen) * i // n_ranges] for i in range(1, n_ranges)} if seen else set()), dtype=f"S{LONGEST * width}")

    def send(_: tuple, text: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"range": [], "keys": [], "counts": []}, dtype=object)
        if not len(text):
            return none
        keys, counts = _chunk_keys(text["places"].iloc[0], words, width)
        if not len(keys):
            return none
        cuts = [0, *np.searchsorted(np.ascontiguousarray(keys).view(bounds.dtype).ravel(), bounds).tolist(), len(keys)]
        rows = [(i, _planes(keys[a:b]), _zip(counts[a:b].astype("<u4"))) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
        return pd.DataFrame(rows, columns=["range", "keys", "counts"])

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.concatenate([_unzip(x, "<u4").astype(np.int64) for x in pdf["counts"]])
        keys = np.concatenate([_unzip(x, "u1").reshape(LONGEST * width, -1).T for x in pdf["keys"]])
        return pd.DataFrame(prefix_counts(*_added_up(keys, counts), width, LEAST), columns=["key", "f"])

    sent = cut.select("chunk", "places").groupBy("chunk").cogroup(_translated(cut, known).groupBy("of")).applyInPandas(send, "range int, keys binary, counts binary")
    runs = sent.groupBy("range").applyInPandas(count, "key binary, f long")
    return runs.groupBy("key").agg(F.sum("f").alias("f")).where(F.col("f") >= LEAST)


def _met(asking: DataFrame, of: Column, known: DataFrame, on: str) -> DataFrame:
    """Rows joined with a table of one row for each value of ``on``; rows of a frequent value are spread by ``of``."""
    spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return asking.withColumn("salt", F.pmod(F.xxhash64(of), F.lit(SALTS)).cast("int")).join(spread, [on, "salt"]).drop("salt")


def _scored(found: DataFrame, every: DataFrame, width: int) -> DataFrame:
    """key, a, l, r, n and score of the candidates (key, a, n), by their lowest-scoring cut; ``every`` has key and f of all parts."""
    bytes_, size = F.octet_length("key"), F.lit(width)
    cuts = found.select("key", "a", "n", F.explode(F.sequence(F.lit(1), (bytes_ / width).cast("int") - 1)).alias("k"))
    cuts = cuts.select("key", "a", "n", "k", F.substring("key", F.lit(1), F.col("k") * size).alias("head"), F.substring("key", F.col("k") * size + 1, bytes_).alias("rest"))
    heads = _met(cuts, F.col("rest"), every.select(F.col("key").alias("head"), F.col("f").alias("l")), "head")
    both = _met(heads, F.col("head"), every.select(F.col("key").alias("rest"), F.col("f").alias("r")), "rest")
    exact = {c: F.col(c).cast("decimal(18,0)") for c in "anlr"}
    above = F.lit(1000).cast("decimal(4,0)") * (exact["a"] * exact["n"])  # products of counts below 10 ** 17 fit 38 digits
    score = F.call_function("div", above, exact["l"] * exact["r"])
    return both.withColumn("score", score).groupBy("key").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("cut")).select("key", "cut.*")


def _free(found: DataFrame, width: int) -> DataFrame:
    """Candidates without a longer one that has their words and their count. As counts only fall from a sequence to a longer
    one, a sequence of one word more tells it."""
    size = F.octet_length("key")
    inside = F.explode(F.array(F.substring("key", F.lit(1), size - width), F.substring("key", F.lit(width + 1), size)))
    longer = found.where(size > SHORTEST * width).select("a", inside.alias("key")).groupBy("key").agg(F.max("a").alias("most"))
    return found.join(longer, "key", "left").where("most is null or most < a").drop("most")


def _in_words(found: DataFrame, known: DataFrame, width: int) -> DataFrame:
    """key and phrase of the candidates."""
    each = found.select("key", F.posexplode(F.sequence(F.lit(1), F.octet_length("key"), F.lit(width))).alias("at", "byte"))
    id_ = F.conv(F.hex(F.substring("key", F.col("byte"), F.lit(width))), 16, 10).cast("long")
    words = _met(each.select("key", "at", id_.alias("id")), F.col("key"), known.select("id", "word"), "id")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("word").cast("string").alias("word")))), lambda w: w["word"]), " ")
    return words.groupBy("key").agg(joined.alias("phrase"))


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best ``top`` phrases of each lang."""
    cut = chunks(docs)
    sizes = cut.groupBy("lang").agg(F.sum("n").alias("n"))
    known = stored(dictionary(cut), "phrase-dictionary")
    ids, places = known.agg(F.count(F.lit(1)), F.sum("f")).first()
    width = max(1, (ids.bit_length() + 7) // 8)
    counted = stored(sequence_counts(cut, known, ids, places or 0), "phrase-counts")
    as_key = lambda c: F.unhex(F.lpad(F.hex(c), 2 * width, "0"))
    every = counted.unionByName(known.select(as_key(F.col("id")).alias("key"), "f"))
    first = _met(counted.select("key", F.col("f").alias("a"), F.substring("key", F.lit(1), F.lit(width)).alias("word")), F.col("key"), known.select(as_key(F.col("id")).alias("word"), "lang"), "word")
    found = first.join(sizes, "lang").select("key", "lang", "a", "n")
    scored = _scored(_free(found, width), every, width)
    named = scored.join(_in_words(scored, known, width), "key").join(found.select("key", "lang"), "key")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    spread = named.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(BLOCKS)))
    few = spread.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = rf"""
WITH docs AS (SELECT coalesce(lang, '{NO_LANG}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+')) AS p FROM docs),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM pieces),
sizes AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM words GROUP BY lang),
starts AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM words),
grams AS (SELECT lang, ws[i:i + m - 1] AS g FROM starts, range(1, {LONGEST + 1}) t(m) WHERE i + m - 1 <= len(ws)),
counts AS (SELECT lang, g, count(*)::HUGEINT AS f FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}),
found AS (SELECT lang, g, f AS a FROM counts WHERE len(g) >= {SHORTEST}),
inside AS (SELECT lang, g[i:i + m - 1] AS g, a FROM (SELECT *, unnest(range(1, len(g) + 1)) AS i FROM found), range({SHORTEST}, {LONGEST}) t(m) WHERE m < len(g) AND i + m - 1 <= len(g)),
longer AS (SELECT lang, g, max(a) AS most FROM inside GROUP BY ALL),
free AS (SELECT lang, g, a FROM found LEFT JOIN longer USING (lang, g) WHERE most IS NULL OR most < a),
cuts AS (SELECT lang, g, a, k, g[1:k] AS head, g[k + 1:len(g)] AS rest FROM (SELECT *, unnest(range(1, len(g))) AS k FROM free)),
scored AS (SELECT c.lang, c.g, a, k, h.f AS l, r.f AS r, n, (1000 * a * n) // (h.f * r.f) AS score FROM cuts c
  JOIN counts h ON h.lang = c.lang AND h.g = head JOIN counts r ON r.lang = c.lang AND r.g = rest JOIN sizes s ON s.lang = c.lang),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
ranked AS (SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM least)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= {TOP}
"""
