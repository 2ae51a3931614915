"""Sharding by fixed virtual slots.

Every record is hashed into one of ``SLOTS`` virtual slots, bytes and rows are summed per slot, and a small stored
table maps slots to shards. Rebalancing writes a new version of that table: slots leave shards that are over the mean,
smallest ones first, and go to the lightest shards; everything else stays where it is. Records never move between
slots. Only per-slot sums (``SLOTS`` rows) reach the driver; the map that is broadcast has ``SLOTS`` rows.

Defined cases: a null text has no bytes (size 8) and CRC 0; a null doc_id is hashed with its text's CRC like any
other; repeated rows share a slot and get different places; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm.tables import new_folder, stored

SLOTS = 4096
ROW_BYTES = 8


def digest(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of every row; no text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def slot_totals(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot that has rows."""
    totals = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    return {r["virtual_slot"]: (r["bytes"], r["n"]) for r in totals.collect()}


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 0: equal ranges of slots, made without a look at the data."""
    return [slot * shards // slots for slot in range(slots)]


def rebalanced(shard_of: list[int], size_of: dict[int, int], shards: int) -> list[int]:
    """A map edited so that shards hold near equal bytes; slots of removed shards and excess slots are the ones to move."""
    mean = sum(size_of.values()) / max(shards, 1)
    out, load = list(shard_of), [0] * shards
    moving = []
    for slot in sorted(range(len(out)), key=lambda s: (-size_of.get(s, 0), s)):
        size = size_of.get(slot, 0)
        if out[slot] < shards and load[out[slot]] + size <= mean:
            load[out[slot]] += size
        else:
            moving.append(slot)
    lightest = [(load[k], k) for k in range(shards)]
    heapq.heapify(lightest)
    for slot in moving:  # largest first
        total, shard = heapq.heappop(lightest)
        out[slot] = shard
        heapq.heappush(lightest, (total + size_of.get(slot, 0), shard))
    return out


class SlotMaps:
    """Versions of the slot-to-shard map, each a table ``version=N`` below one folder; a folder can be opened again."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def latest(self) -> tuple[int, list[int]] | None:
        """Number and shards by slot of the last version; none in an empty folder."""
        try:
            rows = self.spark.read.option("basePath", self.path).parquet(self.path)
        except AnalysisException:
            return None
        last = rows.agg(F.max("version")).first()[0]
        held = {r["virtual_slot"]: r["shard"] for r in rows.where(F.col("version") == last).select("virtual_slot", "shard").collect()}  # a row for each slot
        return int(last), [held[slot] for slot in range(len(held))]

    def write(self, version: int, shard_of: list[int], rows_of: dict[int, int]) -> None:
        """``first_place``: place within its shard of the first row of the slot."""
        places, begin = [0] * len(shard_of), [0] * (max(shard_of) + 1)
        for slot, shard in enumerate(shard_of):
            places[slot] = begin[shard]
            begin[shard] += rows_of.get(slot, 0)
        entries = json.dumps([{"shard": s, "first_place": p} for s, p in zip(shard_of, places, strict=True)])
        parsed = F.from_json(F.lit(entries), "array<struct<shard:int,first_place:long>>")
        table = self.spark.range(1).select(F.posexplode(parsed).alias("virtual_slot", "entry")).select("virtual_slot", "entry.shard", "entry.first_place")
        table.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/version={version}")

    def read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version={version}")


def placed(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Shard and gapless place of every row: the slot's first place in its shard plus the row's place in the slot."""
    rank: Column = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return rows.withColumn("rank", rank).join(F.broadcast(slot_map), "virtual_slot").withColumn("slot", F.col("first_place") + F.col("rank") - 1).drop("rank", "first_place")


def shard(docs: DataFrame, shards: int = 24, slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """Every row's shard under the ``bytes`` law, by a new version of the map in ``folder``: its last version, edited to the
    measured bytes, so that most slots stay where they were. In a folder without one (by default a new one) version 0 is
    written first. A map keeps its number of slots."""
    spark = docs.sparkSession
    maps = SlotMaps(spark, folder or new_folder(spark, "slot-map"))
    known = maps.latest() if folder else None
    slots = len(known[1]) if known else slots
    rows = stored(digest(docs, slots), "slot-digest")
    totals = slot_totals(rows)
    rows_of = {slot: n for slot, (_, n) in totals.items()}
    version, before = known or (0, first_map(shards, slots))
    if not known:
        maps.write(0, before, rows_of)
    maps.write(version + 1, rebalanced(before, {slot: size for slot, (size, _) in totals.items()}, shards), rows_of)
    out = placed(rows, maps.read(version + 1))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
