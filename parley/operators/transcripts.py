"""Operators over ordered transcript segments (session_id, seg_index, source, utterance)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from parley.functions import text as T

#: Characters that a block of segments aims at, and those that a segment costs besides its text.
BLOCK_CHARS = 5000
SEGMENT_OVERHEAD = 8


def in_session() -> WindowSpec:
    return Window.partitionBy("session_id").orderBy("seg_index")


def speaker_line(source: Column, utterance: Column) -> Column:
    return F.concat(F.when(source == "you", "user: ").otherwise("others: "), utterance)


def rendered(segments: DataFrame) -> DataFrame:
    """One transcript for each session, a line for each segment in order."""
    line = F.struct("seg_index", speaker_line(F.col("source"), F.col("utterance")).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda s: s["line"])
    return segments.groupBy("session_id").agg(F.array_join(lines, "\n").alias("transcript"))


def room_transcript(segments: DataFrame) -> DataFrame:
    """The transcript for questions about a call: trimmed texts without fence markers, by You or the Room."""
    line = F.concat(F.when(F.col("source") == "you", "You: ").otherwise("Room: "), T.strip_markers(T.trim_ws(F.col("utterance"))))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seg_index", line.alias("line")))), lambda s: s["line"])
    return segments.groupBy("session_id").agg(F.array_join(lines, "\n").alias("transcript"))


def with_run_edges(segments: DataFrame) -> DataFrame:
    """Adds whether a segment begins and ends a run of one source."""
    before, after = F.lag("source").over(in_session()), F.lead("source").over(in_session())
    return segments.withColumns({"first_in_run": ~F.col("source").eqNullSafe(before), "last_in_run": ~F.col("source").eqNullSafe(after)})


def coalesced_runs(segments: DataFrame) -> DataFrame:
    """Neighbouring segments of one source as one, texts joined by a space."""
    runs = with_run_edges(segments).withColumn("run", F.sum(F.col("first_in_run").cast("long")).over(in_session()))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("seg_index", "utterance"))), lambda s: s["utterance"])
    grouped = runs.groupBy("session_id", "run", "source").agg(F.min("seg_index").alias("first_index"), F.count(F.lit(1)).alias("n"), F.array_join(texts, " ").alias("utterance"))
    return grouped


def speakers(segments: DataFrame, speaker: str, label: str) -> DataFrame:
    """Distinct speakers of each session with their first place and first label."""
    labelled = F.min_by(F.when(F.col(label).isNotNull(), F.col(label)), F.when(F.col(label).isNotNull(), F.col("seg_index")))
    return segments.groupBy("session_id", speaker).agg(F.min("seg_index").alias("first_index"), F.count(F.lit(1)).alias("n"), labelled.alias("first_label"))


def cost(utterance: Column) -> Column:
    return F.length(utterance) + SEGMENT_OVERHEAD


def next_block_end(segments: DataFrame, target: int = BLOCK_CHARS, covered: str | None = None) -> DataFrame:
    """End (exclusive) of the first block after the covered segments whose cost reaches the target; null if none does."""
    left = segments if covered is None else segments.where(F.col("seg_index") >= F.col(covered))
    running = F.sum(cost(F.col("utterance"))).over(in_session())
    reached = left.withColumn("running", running)
    return reached.groupBy("session_id").agg(F.min(F.when(F.col("running") >= target, F.col("seg_index") + 1)).alias("block_end"))


def packed_blocks(segments: DataFrame, target: int = BLOCK_CHARS) -> DataFrame:
    """Full blocks of each session, packed greedily; a rest below the target makes none."""
    rows = F.array_sort(F.collect_list(F.struct("seg_index", cost(F.col("utterance")).cast("long").alias("cost"))))
    blocks = "array<struct<start_index:long,end_index:long,chars:long>>"
    start = F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("chars"), F.array().cast(blocks).alias("done"))

    def step(state: Column, row: Column) -> Column:
        chars, end = state["chars"] + row["cost"], row["seg_index"] + 1
        block = F.array(F.struct(state["start"].alias("start_index"), end.alias("end_index"), chars.alias("chars")))
        full = chars >= target
        return F.struct(
            F.when(full, end).otherwise(state["start"]).alias("start"),
            F.when(full, F.lit(0).cast("long")).otherwise(chars).alias("chars"),
            F.when(full, F.concat(state["done"], block)).otherwise(state["done"]).alias("done"),
        )

    folded = segments.groupBy("session_id").agg(F.aggregate(rows, start, step)["done"].alias("done"))
    return folded.select("session_id", F.posexplode("done").alias("block", "b")).select("session_id", F.col("block").cast("long").alias("block"), "b.start_index", "b.end_index", "b.chars")


def coverage(blocks: DataFrame) -> DataFrame:
    """Of ordered blocks (session_id, block, start_index, end_index): covered_to, and how many leading blocks touch without a gap and how far they reach."""
    before = Window.partitionBy("session_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end_index").over(before), F.lit(0).cast("long"))
    so_far = Window.partitionBy("session_id").orderBy("block")
    rows = blocks.withColumn("reach", reach).withColumn("broken", (F.col("start_index") > F.col("reach")).cast("int"))
    rows = rows.withColumn("broken", F.max("broken").over(so_far))
    used = F.col("broken") == 0
    return rows.groupBy("session_id").agg(
        F.max("end_index").alias("covered_to"),
        F.count_if(used).alias("used"),
        F.coalesce(F.max(F.when(used, F.col("end_index"))), F.lit(0).cast("long")).alias("contiguous_to"),
    )


def newest(rows: DataFrame, key: str, most: int, *order: str) -> DataFrame:
    """The last ``most`` rows of each key in an order of columns, with their rank from the newest."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most)


def severity(value: Column) -> Column:
    """Lowered; anything but red and orange is green."""
    low = F.lower(value)
    return F.when(low.isin("red", "orange", "green"), low).otherwise("green")


def is_no_signal(message: Column) -> Column:
    """Whether a message says that there is nothing to say; underscores and full stops don't count."""
    bare = F.lower(F.regexp_replace(T.trim_ws(message), "[_.]", ""))
    return bare.isin("no signal", "nosignal")
