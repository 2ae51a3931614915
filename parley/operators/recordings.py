"""Samples of recordings as blocks: cut anew, laid on one timeline, mixed.

Chunks (session_id, at, samples) have places on the line of their session. Where chunks meet blocks they are cut at the
blocks' edges, so pieces of arrays are shuffled by (session_id, block), never single samples, and a long session is as
many groups as it has blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.signal import gate_targets
from parley.operators.audio import gate_gains

RATE = 16_000
BLOCK = 512
SHIFT = 128
#: Samples by which one source may be ahead of the other in a mix.
LEAD = 3_200

def _zero() -> Column:
    return F.lit(0).cast("long")


def _before(by: str = "at") -> Window:
    return Window.partitionBy("session_id").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)


def joined_up(chunks: DataFrame) -> DataFrame:
    """Chunks with ``start``, where each begins if all of its session are laid end to end."""
    return chunks.withColumn("start", F.coalesce(F.sum(F.size("samples").cast("long")).over(_before()), _zero()))


def pieces(placed: DataFrame, size: int, *keys: str) -> DataFrame:
    """What of each chunk (session_id, start from 0 on, samples) lies in which block: the keys, block, at (its place there) and samples."""
    end = F.col("start") + F.size("samples")
    blocks = F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((end - 1) / size)))
    cut = placed.where(F.size("samples") > 0).select("session_id", *keys, "start", "samples", end.alias("end"), blocks.alias("block"))
    low, high = F.greatest("start", F.col("block") * size), F.least("end", (F.col("block") + 1) * size)
    part = F.slice("samples", (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
    return cut.select("session_id", *keys, "block", (low - F.col("block") * size).cast("int").alias("at"), part.alias("samples"))


def laid(parts: DataFrame, fill: Column, *keys: str) -> DataFrame:
    """The pieces of each block as one array ``samples``; places up to the last piece that none covers hold ``fill``."""
    ordered = F.array_sort(F.collect_list(F.struct("at", "samples")))
    kind = parts.schema["samples"].dataType
    whole = F.aggregate(ordered, F.array().cast(kind), lambda done, p: F.concat(done, F.array_repeat(fill, p["at"] - F.size(done)).cast(kind), p["samples"]))
    return parts.groupBy("session_id", *keys, "block").agg(whole.alias("samples"))


def padded(samples: Column, n: Column, fill: Column) -> Column:
    """The first ``n`` samples; where there are fewer, ``fill`` after them."""
    return F.concat(F.slice(samples, F.lit(1), n), F.array_repeat(fill, F.greatest(n - F.size(samples), F.lit(0))))


def reblocked(chunks: DataFrame, size: int = BLOCK) -> DataFrame:
    """Full blocks (session_id, block, samples) of ``size`` samples, whatever the chunks' lengths; a rest makes none."""
    return laid(pieces(joined_up(chunks), size), F.lit(None)).where(F.size("samples") == size)


def _summed(arrays: Column, n: int, kind: str) -> Column:
    """Arrays of ``n`` numbers added up place by place, in the order of a sorted list of structs (…, samples)."""
    zero = F.array_repeat(F.lit(0).cast(kind), n)
    return F.aggregate(arrays, zero, lambda done, p: F.zip_with(done, p["samples"], lambda a, b: a + b))


def overlap_added(frames: DataFrame, shift: int = SHIFT) -> DataFrame:
    """Blocks (session_id, block, samples) of ``shift`` samples of frames (session_id, k, samples), each laid ``shift`` after the
    one before and added up. The last block of a session is as long as its longest piece."""
    cut = pieces(frames.select("session_id", "k", (F.col("k") * shift).cast("long").alias("start"), "samples"), shift, "k")
    long = F.max(F.size("samples")).alias("n")
    both = cut.groupBy("session_id", "block").agg(F.array_sort(F.collect_list(F.struct("k", "samples"))).alias("parts"), long)
    even = F.transform("parts", lambda p: F.struct(padded(p["samples"], F.lit(shift), F.lit(0.0)).alias("samples")))
    return both.select("session_id", "block", F.slice(_summed(even, shift, "double"), F.lit(1), F.col("n")).alias("samples"))


def _on_timeline(chunks: DataFrame, origins: DataFrame) -> DataFrame:
    """Chunks (session_id, at, start, samples) from the session's origin on, each from where the chunks before it have
    reached: what they hold already isn't taken again."""
    reached = F.max(F.col("start") + F.size("samples")).over(_before())
    rows = chunks.withColumn("reached", reached).join(origins, "session_id")
    rows = rows.withColumn("from", F.greatest("start", F.coalesce("reached", "start"), "origin"))
    fresh = rows.where(F.col("from") < F.col("start") + F.size("samples"))
    return fresh.select("session_id", (F.col("from") - F.col("origin")).alias("start"), F.slice("samples", (F.col("from") - F.col("start") + 1).cast("int"), F.size("samples")).alias("samples"))


def aligned_samples(near: DataFrame, far: DataFrame, size: int = SHIFT) -> DataFrame:
    """Blocks (session_id, block, near, far) of two sides (chunks session_id, at, start, samples) on one timeline: from the start
    of the first near chunk to the end of the last one. Samples that a side hasn't got are null; the last block can be
    shorter; far samples before the first near one are stale."""
    spans = near.groupBy("session_id").agg(F.min_by("start", "at").alias("origin"), F.max(F.col("start") + F.size("samples")).alias("last"))
    origins = spans.select("session_id", "origin")
    length = F.col("last") - F.col("origin")
    blocks = spans.where(length > 0).select("session_id", F.explode(F.sequence(_zero(), F.floor((length - 1) / size))).alias("block"), length.alias("length"))
    blocks = blocks.withColumn("n", F.least(F.lit(size), F.col("length") - F.col("block") * size).cast("int"))
    none = F.lit(None).cast("double")
    sides = {name: laid(pieces(_on_timeline(side, origins), size), none).withColumnRenamed("samples", name) for name, side in (("near", near), ("far", far))}
    joined = blocks.join(sides["near"], ["session_id", "block"], "left").join(sides["far"], ["session_id", "block"], "left")
    empty = F.array().cast("array<double>")
    return joined.select("session_id", "block", *[padded(F.coalesce(name, empty), F.col("n"), none).alias(name) for name in sides])


def _ahead(rows: DataFrame, lead: int) -> DataFrame:
    """How far source 0 is ahead of source 1 after each push (column ``n``, negative for source 1): the sum of the pushes so far,
    held between -lead and lead after each.

    A push maps what was ahead before it, d, to min(high, max(low, d + sum)), and pushes one after the other are such a map
    again. So maps are composed by doubling: each row takes in the row 1, 2, 4 … places before, all in one partitioning."""
    w = Window.partitionBy("session_id").orderBy("at")
    most = rows.groupBy("session_id").count().agg(F.max("count")).first()[0] or 0
    maps = rows.withColumns({"sum": F.col("n"), "low": F.lit(-lead).cast("long"), "high": F.lit(lead).cast("long")})

    def held(value: Column) -> Column:
        return F.least(F.greatest(value + F.col("sum"), F.col("low")), F.col("high"))

    for k in range(max(most - 1, 0).bit_length()):
        maps = maps.withColumns({f"{name}_": F.lag(name, 1 << k).over(w) for name in ("sum", "low", "high")})
        maps = maps.withColumns({"sum": F.col("sum") + F.coalesce("sum_", _zero()), **{name: F.when(F.col(f"{name}_").isNull(), F.col(name)).otherwise(held(F.col(f"{name}_"))) for name in ("low", "high")}})
    return maps.withColumn("ahead", held(_zero())).drop("sum", "low", "high", "sum_", "low_", "high_")


def _of_two(pushes: DataFrame, lead: int) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy("at")
    signed = pushes.withColumn("n", F.when(F.col("source") == 0, F.col("size")).otherwise(-F.col("size")))
    rows = _ahead(signed, lead).withColumn("was", F.coalesce(F.lag("ahead").over(w), _zero()))
    own = F.when(F.col("source") == 0, F.greatest("was", _zero())).otherwise(F.greatest(-F.col("was"), _zero()))
    other = F.abs("was") - own
    # what was waiting and what came, less what waits now; pairs of samples go out as one
    given = F.abs("was") + F.col("size") - F.abs("ahead") - F.least(other, "size")
    rows = rows.withColumns({"own": own, "given": given})
    out_from = F.coalesce(F.sum("given").over(_before()), _zero())
    return rows.select("session_id", "at", "source", (out_from + F.col("own")).alias("start"), out_from.alias("out_from"), F.col("given").alias("n"))


def _of_many(pushes: DataFrame, sources: int, lead: int) -> DataFrame:
    """The same for more sources: a source's next sample goes to where its last one ended or, if that has gone out, to the
    end of what has; out goes what all sources have reached, and what the first one has reached less the lead."""

    def session(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at", kind="stable")
        ends, gone, out = [0] * sources, 0, []
        for source, size in zip(pdf["source"], pdf["size"], strict=True):
            start = max(ends[source], gone)
            ends[source] = start + size
            now = max(gone, min(ends), max(ends) - lead)
            out.append((start, gone, now - gone))
            gone = now
        return pd.concat([pdf[["session_id", "at", "source"]].reset_index(drop=True), pd.DataFrame(out, columns=["start", "out_from", "n"])], axis=1)

    kind = pushes.schema["session_id"].dataType.simpleString()
    return pushes.groupBy("session_id").applyInPandas(session, f"session_id {kind}, at long, source int, start long, out_from long, n long")


def mixed_places(pushes: DataFrame, sources: int = 2, lead: int = LEAD) -> DataFrame:
    """Where the samples of each push (session_id, at, source from 0, size) lie in the mix (``start``), and what the push lets out:
    ``n`` samples from ``out_from`` on. Out goes what all sources have; where one has nothing, what another is ahead by more
    than ``lead``. A single source goes out as it comes. Pushes of unknown sources are left out."""
    rows = pushes.select("session_id", F.col("at").cast("long").alias("at"), F.col("source").cast("int").alias("source"), F.col("size").cast("long").alias("size")).where(F.col("source").between(0, sources - 1))
    if sources == 1:
        start = F.coalesce(F.sum("size").over(_before()), _zero())
        return rows.select("session_id", "at", "source", start.alias("start"), start.alias("out_from"), F.col("size").alias("n"))
    return _of_two(rows, lead) if sources == 2 else _of_many(rows, sources, lead)


def mixed_blocks(pushes: DataFrame, sources: int = 2, lead: int = LEAD, size: int = BLOCK) -> DataFrame:
    """What pushes (session_id, at, source, samples: array of int) let out, as blocks (session_id, block, samples): sums of the
    sources, clipped to 16 bits; the last block can be shorter."""
    places = mixed_places(pushes.select("session_id", "at", "source", F.size("samples").alias("size")), sources, lead)
    out = places.groupBy("session_id").agg(F.max(F.col("out_from") + F.col("n")).alias("length"))
    placed = pushes.select("session_id", F.col("at").cast("long").alias("at"), F.transform("samples", lambda x: x.cast("int")).alias("samples")).join(places.select("session_id", "at", "source", "start"), ["session_id", "at"])
    zero = F.lit(0).cast("int")
    tracks = laid(pieces(placed, size, "source"), zero, "source").select("session_id", "block", "source", padded(F.col("samples"), F.lit(size), zero).alias("samples"))
    both = tracks.groupBy("session_id", "block").agg(_summed(F.array_sort(F.collect_list(F.struct("source", "samples"))), size, "int").alias("samples"))
    n = F.least(F.lit(size), F.col("length") - F.col("block") * size).cast("int")
    clipped = F.transform("samples", lambda x: F.least(F.greatest(x, F.lit(-32768)), F.lit(32767)))
    return both.join(out, "session_id").where(n > 0).select("session_id", "block", F.slice(clipped, F.lit(1), n).alias("samples"))


def trailing(array: Column, most: int) -> Column:
    """The last ``most`` values."""
    return F.slice(array, F.greatest(F.size(array) - most + 1, F.lit(1)), F.lit(most))


def _targets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        near, far = (np.array([[np.nan if x is None else x for x in side] for side in pdf[name]], dtype=np.float64).reshape(len(pdf), -1) for name in ("near", "far"))
        targets = gate_targets(near, far) if len(pdf) else np.zeros(0)
        yield pd.DataFrame({"session_id": pdf["session_id"], "at": pdf["at"], "target": targets})


def reference_gated(near: DataFrame, far: DataFrame, size: int = BLOCK) -> DataFrame:
    """The near side (chunks of both session_id, at, start, samples) with the far side's echo turned down: blocks (session_id,
    block, target, gain, samples) of ``size`` samples. Both sides are laid on one timeline; windows are judged in Arrow batches,
    whatever session they are of; only the gain, a number for each window, follows the windows of its session in order. The
    rest at the end has the last gain."""
    blocks = aligned_samples(near, far, size).withColumnRenamed("block", "at")
    kind = near.schema["session_id"].dataType.simpleString()
    targets = blocks.where(F.size("near") == size).select("session_id", "at", "near", "far").mapInPandas(_targets, f"session_id {kind}, at long, target double")
    gains = gate_gains(targets)
    told = blocks.select("session_id", "at", "near").join(targets, ["session_id", "at"], "left").join(gains, ["session_id", "at"], "left")
    so_far = Window.partitionBy("session_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gain = F.coalesce(F.last("gain", ignorenulls=True).over(so_far), F.lit(1.0))
    return told.withColumn("gain", gain).select("session_id", F.col("at").alias("block"), "target", "gain", F.transform("near", lambda x: x * F.col("gain")).alias("samples"))
