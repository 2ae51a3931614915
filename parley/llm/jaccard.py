"""N-gram Jaccard join: all links between documents whose shingle sets are alike, by prefix filter and prefix tree.

A document's set holds its distinct 4-word shingles (A-Z lowered); two documents link when 100 * intersection >= 85 *
union. The steps, each over all documents:

1. Equal sets are one class, known by a 128-bit fingerprint; one document represents it.
2. Exact counts of classes that hold each shingle (``hash_tables``) give the global order: rarest first, then by hash.
   A linked set must share one of its first |x| - ceil(0.85 |x|) + 1 shingles with its partner. Shingles of one class
   only can't be shared, so a class with that many of them is done, without a row leaving its task.
3. The other classes send their shared shingles once. Those that meet at a prefix shingle form clusters, and clusters
   are cut into blocks of about ``BLOCK_SETS`` sets of similar size. Each pair of blocks that meet at a prefix shingle,
   and whose sizes can reach the threshold, is one task: a prefix tree of one block, probed by the sets of the other.
4. A task sends no pairs: links that join its own groups first (fewer than its sets), and the number of links of each
   class. Components of those links are the components of all links.

Nothing is capped or sampled: every pair of classes that can link meets in one task. Shingles are compared by 64-bit
hashes. Defined cases: null, empty and wordless texts have empty sets, link with nothing and are their own component;
repeated rows are documents with equal sets; a null doc_id takes part, and a component of null ids only has a null id;
shingles that as many classes hold are ordered by hash; a pair at exactly the threshold links; a very long text is worked
on whole, in arrays of about 40 times its bytes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm import hash_tables as H
from parley.llm import words as W
from parley.llm.components import components
from parley.llm.tables import small_batches, stored
from parley.llm.trie import Tree

SHINGLE = 4
PERCENT = 85
BLOCK_SETS = 400
SALTS = 64
#: About this many bytes of text to a shingle, for the number of buckets only.
SHINGLE_BYTES = 6


def shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes with their text numbers, sorted by text, then hash."""
    words, text, _, _ = W.hashed_words(texts)
    hashes, at = W.ngrams(words, text, size)
    owner = text[at]
    counts = np.bincount(text, minlength=len(texts))
    if ((counts > 0) & (counts < size)).any():
        short, whose = [hashes], [owner]
        for n in range(1, size):
            grams, first = W.ngrams(words, text, n)
            whole = counts[text[first]] == n
            short.append(grams[whole])
            whose.append(text[first][whole])
        hashes, owner = np.concatenate(short), np.concatenate(whose)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], owner[new]


def prints(hashes: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """128-bit fingerprints of the non-empty sets that begin at ``starts``."""
    with np.errstate(over="ignore"):
        one, two = np.add.reduceat(W.mix(hashes), starts), np.add.reduceat(W.mix(hashes ^ np.uint64(0xD1B54A32D192ED03)), starts)
    return [a.tobytes() + b.tobytes() for a, b in zip(one, two, strict=True)]


def _sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes | None]]:
    """Hashes sorted by text, where each text's set begins, its size and its fingerprint (none for an empty set)."""
    hashes, owner = shingles(texts, size)
    sizes = np.bincount(owner, minlength=len(texts))
    starts = np.cumsum(sizes) - sizes
    full = np.flatnonzero(sizes)
    out: list[bytes | None] = [None] * len(texts)
    if len(full):
        for i, fingerprint in zip(full, prints(hashes, starts[full]), strict=True):
            out[i] = fingerprint
    return hashes, starts, sizes, out


def classes(docs: DataFrame, size: int) -> DataFrame:
    """The columns of ``docs`` without the text, n_shingles and the class ``node`` (null for empty sets) of every row."""
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [W.encoded(t, lower=True) for t in pdf["text"]]
            for a, b in W.slices(texts):
                _, _, sizes, nodes = _sets(texts[a:b], size)
                yield pdf[keep].iloc[a:b].reset_index(drop=True).assign(n_shingles=sizes, node=nodes)

    kept = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.mapInPandas(run, f"{kept}, n_shingles long, node binary")


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def _represented(pdf: pd.DataFrame, chosen: pd.DataFrame, size: int) -> tuple[list[np.ndarray], list[bytes]]:
    """Sets and nodes of the rows of a chunk that represent a class, each class once, by node."""
    pdf = pdf.assign(text=pdf["text"].fillna(""))
    texts = [W.encoded(t, lower=True) for t in pdf["text"]]
    ids = [None if pd.isna(x) else int(x) for x in pdf["doc_id"]]
    wanted = {(None if pd.isna(i) else int(i), bytes(n)) for i, n in zip(chosen["doc_id"], chosen["node"], strict=True)}
    found: dict[bytes, np.ndarray] = {}
    for a, b in W.slices(texts):
        hashes, starts, sizes, nodes = _sets(texts[a:b], size)
        for i, (doc_id, node) in enumerate(zip(ids[a:b], nodes, strict=True)):
            if node is not None and node not in found and (doc_id, node) in wanted:
                found[node] = hashes[starts[i] : starts[i] + sizes[i]]
    order = sorted(found)
    return [found[n] for n in order], order


def candidates(docs: DataFrame, representatives: DataFrame, size: int, percent: int, chunk_bytes: int, bucket_hashes: int) -> DataFrame:
    """node, n, prefix (shared shingles among the first) and tokens (all shared shingles, rarest first) of the classes left after the prefix filter."""
    total = H.text_bytes(docs)
    chunks = max(1, math.ceil(total / chunk_bytes))
    buckets = max(1, math.ceil(total / SHINGLE_BYTES / bucket_hashes))
    dealt = docs.select("doc_id", "text").withColumn("chunk", H.chunk_of(docs["doc_id"], chunks))
    chosen = representatives.select("doc_id", "node").withColumn("chunk", H.chunk_of(representatives["doc_id"], chunks))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def ask(pdf: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        sets, _ = _represented(pdf, chosen, size) if len(pdf) else ([], [])
        if not sets:
            return H.no_blocks()
        hashes, counts = np.unique(np.concatenate(sets), return_counts=True)
        return H.blocks(int(pdf["chunk"].iloc[0]), hashes, counts, buckets)

    def keep(pdf: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"node": [], "n": [], "prefix": [], "tokens": []}, dtype=object)
        answers = side[side["node"].isna()]
        if not len(pdf) or not len(answers):
            return empty
        sets, nodes = _represented(pdf, side[side["node"].notna()], size)
        every = np.concatenate(sets)
        order = np.argsort(every)
        new = np.ones(len(order), dtype=bool)
        new[1:] = np.diff(every[order]) != 0
        held = np.empty(len(every), dtype=np.int64)
        held[order] = H.answered(answers)[np.cumsum(new) - 1]
        cuts = np.cumsum([0] + [len(s) for s in sets])
        rows = []
        for node, hashes, held_by in zip(nodes, sets, np.split(held, cuts[1:-1]), strict=True):
            alone = int((held_by == 1).sum())
            reach = prefix_length(len(hashes), percent)
            if alone < reach:
                tokens = hashes[np.lexsort((hashes, held_by))][alone:]
                rows.append((node, len(hashes), tokens[: reach - alone].view(np.int64), tokens.tobytes()))
        return pd.DataFrame(rows, columns=empty.columns) if rows else empty

    asked = dealt.groupBy("chunk").cogroup(chosen.groupBy("chunk")).applyInPandas(ask, H.BLOCKS)
    answers = H.totals(asked)
    side = chosen.select("chunk", "doc_id", "node", F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("totals")).unionByName(
        answers.select("chunk", F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("binary").alias("node"), "bucket", "totals")
    )
    return dealt.groupBy("chunk").cogroup(side.groupBy("chunk")).applyInPandas(keep, "node binary, n long, prefix array<long>, tokens binary")


def meetings(prefixes: DataFrame) -> DataFrame:
    """Links (a, b) that connect all nodes which share a prefix token; fewer than rows. A hot token is met in salted parts first."""
    part = Window.partitionBy("token", "salt")
    rows = prefixes.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS))).withColumn("leader", F.min("node").over(part))
    leaders = rows.select("token", "leader").distinct()
    tops = leaders.withColumn("top", F.min("leader").over(Window.partitionBy("token")))
    inner = rows.where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    return inner.unionByName(tops.where("leader != top").select(F.col("top").alias("a"), F.col("leader").alias("b"))).distinct()


def _joined(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "node"], kind="stable").drop_duplicates(["side", "node"])
        tokens = [np.frombuffer(x, dtype=np.uint64) for x in pdf["tokens"]]
        every, local, held_by = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
        rank = np.empty(len(every), dtype=np.int64)
        rank[np.lexsort((every, held_by))] = np.arange(len(every))  # one order for the task: rarest first
        cuts = np.cumsum([0] + [len(t) for t in tokens])
        paths = [np.sort(rank[local[a:b]]) for a, b in zip(cuts, cuts[1:], strict=False)]
        sizes, weight = pdf["n"].to_numpy(), pdf["weight"].to_numpy()
        nodes = [bytes(x) for x in pdf["node"]]
        left = np.flatnonzero(pdf["side"].to_numpy() == 0)
        right = np.flatnonzero(pdf["side"].to_numpy() == 1)
        inner = not len(right)
        probes = left if inner else right
        tree = Tree([paths[i] for i in left], sizes[left])
        member = np.zeros(len(every), dtype=np.int64)
        links = np.zeros(len(pdf), dtype=np.int64)
        above = list(range(len(pdf)))

        def root(x: int) -> int:
            while above[x] != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        forest = []
        for probe in probes.tolist():
            member[paths[probe]] = 1
            for hit in tree.linked(paths[probe], int(sizes[probe]), percent, member):
                other = int(left[hit])
                if other == probe or inner and other > probe:
                    continue
                links[probe] += weight[other]
                links[other] += weight[probe]
                x, y = root(probe), root(other)
                if x != y:
                    above[max(x, y)] = min(x, y)
                    forest.append((nodes[other], nodes[probe], 0))
            member[paths[probe]] = 0
        rows = forest + [(nodes[i], None, int(links[i])) for i in np.flatnonzero(links)]
        return pd.DataFrame(rows, columns=["a", "b", "links"])

    return run


def linked_classes(found: DataFrame, sizes: DataFrame, percent: int, block_sets: int) -> DataFrame:
    """Links (a, b, 0) that span the components, and (a, null, links) with parts of each class's number of links."""
    prefixes = found.select("node", F.explode("prefix").alias("token"))
    clusters = components(meetings(prefixes))
    band = F.floor(F.log("n") / math.log(100 / percent)).cast("int")
    members = found.join(clusters, "node").join(sizes.select("node", F.col("copies").alias("weight")), "node")
    members = stored(members.select("node", "n", "weight", "tokens", "prefix", F.col("label").alias("cluster"), band.alias("band")), "sets")
    counts = members.groupBy("cluster", "band").agg(F.count(F.lit(1)).alias("sets"))
    whole = counts.groupBy("cluster").agg(F.sum("sets").alias("all_sets"))
    small = whole.where(F.col("all_sets") <= block_sets).select("cluster")
    # Small clusters: bundled into tasks of about block_sets sets; sets of other clusters in the bundle share no prefix.
    bundles = max(1, math.ceil((whole.where(F.col("all_sets") <= block_sets).agg(F.sum("all_sets")).first()[0] or 0) / block_sets))
    bundled = members.join(small, "cluster", "left_semi").select(F.concat(F.lit("bundle "), F.pmod(F.xxhash64("cluster"), F.lit(bundles))).alias("task"), F.lit(0).alias("side"), "node", "n", "weight", "tokens")
    # Large clusters: blocks by size band and hash, met pairwise where they share a prefix token.
    large = whole.where(F.col("all_sets") > block_sets).select("cluster").join(counts, "cluster").select("cluster", "band", F.ceil(F.col("sets") / block_sets).alias("blocks"))
    slot = F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks"))
    block = F.concat_ws(" ", F.hex("cluster"), F.format_string("%05d", "band"), slot)
    dealt = stored(members.join(large, ["cluster", "band"]).withColumn("block", block), "blocks")
    at = dealt.select("block", "band", F.explode("prefix").alias("token")).distinct()
    other = at.select("token", F.col("block").alias("block2"), F.col("band").alias("band2"))
    pairs = at.join(other, "token").where("block <= block2 and abs(band - band2) <= 1").select("block", "block2").distinct()
    sides = pairs.select(F.concat_ws("/", "block", "block2").alias("task"), F.posexplode(F.array_distinct(F.array("block", "block2"))).alias("side", "block"))
    met = sides.join(dealt, "block").select("task", "side", "node", "n", "weight", "tokens")
    return bundled.unionByName(met).groupBy("task").applyInPandas(_joined(percent), "a binary, b binary, links long")


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, block_sets: int = BLOCK_SETS, chunk_bytes: int = H.CHUNK_BYTES, bucket_hashes: int = H.BUCKET_HASHES) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links, the class ``node`` and the component's ``label`` (null for an empty
    set) of every row of ``docs``, and its column ``row`` if it has one."""
    rows = stored(classes(docs.select("doc_id", "text", *[c for c in docs.columns if c == "row"]), size), "shingle-classes")
    sizes = stored(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")), "class-sizes")
    found = stored(candidates(docs, sizes, size, percent, chunk_bytes, bucket_hashes), "candidates")
    links = stored(linked_classes(found, sizes, percent, block_sets), "class-links")
    labels = components(links.where("b is not null").select("a", "b"))
    partners = links.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    known = sizes.join(labels, "node", "left").join(partners, "node", "left").select("node", "doc_id", "copies", F.coalesce("label", "node").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
    smallest = known.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_class = stored(known.join(smallest, "label").select("node", "label", "component_id", (F.col("links") + F.col("copies") - 1).alias("links")), "class-components")
    out = rows.join(of_class, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), "node", "label", *[c for c in rows.columns if c == "row"])


def without_copies(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, less all but one of each component: the smallest doc_id stays (null after all
    others; of several texts under it, and of repeated rows, one). Rows with empty sets stay."""
    row = F.unhex(F.md5(F.concat_ws("\n", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text").cast("binary")))
    found = jaccard_components(docs.select("doc_id", "text", row.alias("row")), size, percent)
    choice = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row"))
    stays = found.where("node is not null").groupBy("label").agg(choice.alias("first")).select(F.col("first.row").alias("stays"), F.lit(True).alias("once"))
    alone = found.where("node is null").select(F.col("row").alias("stays"), F.lit(False).alias("once")).distinct()
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("doc"), row.alias("row"))  # no clash with the documents' names
    rows = rows.join(stays.unionByName(alone), F.col("row") == F.col("stays"))
    number = F.row_number().over(Window.partitionBy("row").orderBy("once"))
    return rows.withColumn("number", number).where("number = 1 or not once").select("doc.*")
