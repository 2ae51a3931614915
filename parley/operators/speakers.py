"""Speakers by embeddings: clusters within a session, voiceprints across sessions, renaming."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions import arrays as A

SAME_SPEAKER = 0.75
NAMING_CONFIDENCE = 0.85
#: Voiceprints compared with in one broadcast; more are met block by block.
PRINTS_AT_ONCE = 2_000


class Clusters:
    """Vectors gathered one by one: each joins the first most alike centroid from the threshold on, else begins a cluster."""

    def __init__(self, threshold: float, sums: list[np.ndarray] | None = None, counts: list[int] | None = None) -> None:
        self.threshold, self.sums, self.counts = threshold, sums or [], counts or []

    def add(self, vector: np.ndarray) -> int:
        best, best_score = -1, self.threshold
        for k, (total, n) in enumerate(zip(self.sums, self.counts, strict=True)):
            centroid = total / n
            norms = np.linalg.norm(centroid) * np.linalg.norm(vector)
            score = float(centroid @ vector / norms) if norms and len(centroid) == len(vector) else 0.0
            if score >= self.threshold and (best < 0 or score > best_score):
                best, best_score = k, score
        if best < 0:
            best = len(self.sums)
            self.sums.append(np.zeros_like(vector))
            self.counts.append(0)
        self.sums[best] = self.sums[best] + vector
        self.counts[best] += 1
        return best


def leaders(vectors: list[np.ndarray], threshold: float) -> list[int]:
    """Cluster of each vector in order."""
    clusters = Clusters(threshold)
    return [clusters.add(vector) for vector in vectors]


def session_clusters(embeddings: DataFrame, threshold: float = SAME_SPEAKER) -> DataFrame:
    """session_id, idx and cluster of the embeddings of each session, taken in order of idx."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", kind="stable")
        clusters = leaders([np.asarray(v, dtype=np.float64) for v in pdf["embedding"]], threshold)
        return pd.DataFrame({"session_id": pdf["session_id"], "idx": pdf["idx"], "cluster": clusters})

    kind = embeddings.schema["session_id"].dataType.simpleString()
    return embeddings.select("session_id", "idx", "embedding").groupBy("session_id").applyInPandas(run, f"session_id {kind}, idx long, cluster long")


def centroids(embeddings: DataFrame, *keys: str) -> DataFrame:
    """Mean vector and count for each key, element by element."""
    parts = embeddings.select(*keys, F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count(F.lit(1)).alias("n"))
    vector = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"])
    return means.groupBy(*keys).agg(vector.alias("centroid"), F.max("n").alias("n"))


def best_prints(embeddings: DataFrame, prints: DataFrame, threshold: float = SAME_SPEAKER, at_once: int = PRINTS_AT_ONCE) -> DataFrame:
    """idx, speaker_id, score and label (from NAMING_CONFIDENCE on) of the most alike voiceprint (speaker_id, rank, label,
    centroid), the smaller rank on ties; none below the threshold. Blocks of prints are broadcast one after the other."""
    blocks = -(-prints.count() // at_once)
    packed = prints.withColumn("block", F.pmod(F.xxhash64("speaker_id"), F.lit(max(blocks, 1))))
    best = None
    for block in range(blocks):
        held = packed.where(F.col("block") == block).agg(F.array_sort(F.collect_list(F.struct("rank", "speaker_id", "label", "centroid"))).alias("held"))
        scored = F.transform("held", lambda p: F.struct((-A.cosine(F.col("embedding"), p["centroid"])).alias("minus"), p["rank"].alias("rank"), p["speaker_id"].alias("speaker_id"), p["label"].alias("label")))
        found = embeddings.select("idx", "embedding").join(F.broadcast(held), F.lit(True)).select("idx", F.array_min(scored).alias("b"))
        best = found if best is None else best.unionByName(found)
    if best is None:
        return embeddings.select("idx", F.lit(None).cast("string").alias("speaker_id"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("label")).limit(0)
    top = best.groupBy("idx").agg(F.min("b").alias("b")) if blocks > 1 else best
    score = -F.col("b.minus")
    return top.where(score >= threshold).select("idx", "b.speaker_id", score.alias("score"), F.when(score >= NAMING_CONFIDENCE, F.col("b.label")).alias("label"))


def updated_prints(prints: DataFrame, added: DataFrame) -> DataFrame:
    """Voiceprints after new sessions (speaker_id, mean, n): centroids weighted by sample counts; new speakers appended."""
    both = prints.join(added, "speaker_id", "full")
    centroid = F.when(F.col("mean").isNull(), F.col("centroid")).when(F.col("centroid").isNull(), F.col("mean")).otherwise(A.weighted_centroid(F.col("centroid"), F.col("sample_count"), F.col("mean"), F.col("n")))
    count = F.coalesce("sample_count", F.lit(0)) + F.when(F.col("mean").isNull(), 0).otherwise(F.greatest("n", F.lit(1)))
    return both.select("speaker_id", "label", centroid.alias("centroid"), count.cast("long").alias("sample_count"))


def identified(clusters: DataFrame, prints: DataFrame, threshold: float = SAME_SPEAKER) -> DataFrame:
    """The clusters of sessions (session_id, cluster, centroid, n) with the speaker_id and label of their most alike voiceprint;
    a cluster that is like none is a new speaker, named by its session and number."""
    named = clusters.withColumn("idx", F.concat_ws(":", "session_id", "cluster"))
    found = best_prints(named.select("idx", F.col("centroid").alias("embedding")), prints, threshold).select("idx", "speaker_id", "label")
    return named.join(found, "idx", "left").withColumn("speaker_id", F.coalesce("speaker_id", F.concat(F.lit("new:"), "idx"))).drop("idx")


def folded(prints: DataFrame, identified_clusters: DataFrame) -> DataFrame:
    """Voiceprints after the sessions of identified clusters: one merge adds each speaker's clusters, weighted by their sizes."""
    parts = identified_clusters.select("speaker_id", "n", F.posexplode("centroid").alias("pos", "x"))
    sums = parts.groupBy("speaker_id", "pos").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"), F.sum("n").alias("n"))
    vector = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"])
    return updated_prints(prints, sums.groupBy("speaker_id").agg(vector.alias("mean"), F.max("n").alias("n")))


def relabelled(segments: DataFrame, assigned: DataFrame) -> DataFrame:
    """Segments (session_id, seg_index, ...) with the speakers assigned to their places; others stay."""
    new = assigned.select("session_id", F.col("idx").alias("seg_index"), F.col("speaker_id").alias("_id"), F.col("label").alias("_label"))
    out = segments.join(new, ["session_id", "seg_index"], "left")
    label = F.when(F.col("_id").isNull(), F.col("speaker_label")).otherwise(F.col("_label"))
    return out.withColumn("speaker_label", label).withColumn("speaker_id", F.coalesce("_id", "speaker_id")).drop("_id", "_label")
