"""The driver tables as sessions, segments, chat messages and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.text import is_blank, trim_ws


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that aren't blank."""
    return table(spark, sf_dir, "conversations").where(~is_blank(F.col("text")))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, seg_index, source, utterance: user turns are ours, assistant turns the others', system turns none."""
    spoken = turns(spark, sf_dir).where("role <> 'system'")
    return spoken.select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("seg_index"),
        F.when(F.col("role") == "user", "you").otherwise("others").alias("source"),
        trim_ws(F.col("text")).alias("utterance"),
    )


def dense_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments numbered from 0 without gaps."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("session_id").orderBy("seg_index")) - 1
    return segments(spark, sf_dir).withColumn("seg_index", place.cast("long"))


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, session_id, pos, role, status, content, parent_message_id: an assistant turn answers the turn before it."""
    rows = table(spark, sf_dir, "conversations")
    name = F.concat_ws("-", F.col("conv_id"), F.col("turn"))
    parent = F.when(F.col("role") == "assistant", F.concat_ws("-", F.col("conv_id"), F.col("turn") - 1))
    status = F.when(F.col("turn") % 5 == 4, "errored").otherwise("completed")
    return rows.select(name.alias("id"), F.col("conv_id").alias("session_id"), F.col("turn").alias("pos"), "role", status.alias("status"), F.col("text").alias("content"), parent.alias("parent_message_id"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the time as milliseconds and the user as session."""
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("session_id"), at.alias("at_ms"), "event_type", "value", "props")
