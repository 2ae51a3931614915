"""A stored table of sessions in versions: a change is written under a name of its own, then published by one small file.

Readers see published changes only. A job that breaks off, at whatever step, leaves the last version as it was, and what
it wrote is never read: the next change has another name. Sessions are dealt into buckets by a hash of their id, so a
point read touches one bucket and a change rewrites the buckets it touches. One writer at a time.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley import schemas as S
from parley.functions.text import is_session_id
from parley.operators.sessions import refreshed_index, summarised

BUCKETS = 64


def bucket_of(session_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(session_id), F.lit(buckets)).cast("int")


class SessionStore:
    PLACES = "version long, bucket int, change string"
    CHANGES = "change string, session_id string, kind string"

    def __init__(self, spark: SparkSession, path: str, schema: str = S.SESSION, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.schema, self.buckets = spark, path.rstrip("/"), schema, buckets

    def _table(self, name: str, schema: str) -> DataFrame:
        """A part of the store; empty before anything is written."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _places(self) -> DataFrame:
        return self._table("places", self.PLACES)

    def version(self) -> int:
        return self._places().agg(F.max("version")).first()[0] or 0

    def published(self, change: str) -> bool:
        return bool(self._places().where(F.col("change") == change).limit(1).count())

    def _written(self, buckets: list[int] | None = None) -> dict[int, str]:
        """The change that wrote each bucket last; BUCKETS entries at most."""
        rows = self._places() if buckets is None else self._places().where(F.col("bucket").isin(buckets))
        return {r["bucket"]: r["change"] for r in rows.groupBy("bucket").agg(F.max_by("change", "version").alias("change")).collect()}

    def _load(self, written: dict[int, str]) -> DataFrame:
        parts = [self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{change}/bucket={b}") for b, change in sorted(written.items())]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._load(self._written())

    def get(self, session_id: str) -> DataFrame:
        """The session, or no row; one bucket is read."""
        bucket = self.spark.range(1).select(bucket_of(F.lit(session_id), self.buckets).alias("b")).first()["b"]
        return self._load(self._written([bucket])).where(F.col("session_id") == session_id)

    def _stage(self, changed: DataFrame, gone: DataFrame, change: str) -> tuple[DataFrame, DataFrame]:
        """What is asked, computed once, whatever it is computed from."""
        folder = f"{self.path}/staged/{change}"
        changed.write.mode("overwrite").parquet(f"{folder}/changed")
        gone.write.mode("overwrite").parquet(f"{folder}/gone")
        return self.spark.read.schema(self.schema).parquet(f"{folder}/changed"), self.spark.read.schema("session_id string").parquet(f"{folder}/gone")

    def _write(self, changed: DataFrame, touched: DataFrame, buckets: list[int], change: str) -> None:
        kept = self._load(self._written(buckets)).join(touched, "session_id", "left_anti")
        rows = kept.unionByName(changed).withColumn("bucket", bucket_of(F.col("session_id"), self.buckets))
        folder = f"{self.path}/data/{change}"
        rows.repartition(len(buckets), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        full = {r["bucket"] for r in self._table(f"data/{change}", f"{self.schema}, bucket int").select("bucket").distinct().collect()}
        for bucket in set(buckets) - full:
            self.spark.createDataFrame([], self.schema).write.parquet(f"{folder}/bucket={bucket}")

    def _feed(self, changed: DataFrame, gone: DataFrame, change: str) -> None:
        removed = gone.join(changed, "session_id", "left_anti").select("session_id", F.lit("removed").alias("kind"))
        feed = changed.select("session_id", F.lit("saved").alias("kind")).unionByName(removed)
        feed.select(F.lit(change).alias("change"), "session_id", "kind").write.mode("append").parquet(f"{self.path}/changes")

    def _publish(self, version: int, buckets: list[int], change: str) -> None:
        rows = self.spark.range(1).select(F.lit(version).cast("long").alias("version"), F.explode(F.array(*map(F.lit, buckets))).alias("bucket"), F.lit(change).alias("change"))
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/places")

    def _commit(self, changed: DataFrame, gone: DataFrame, change: str | None = None) -> int:
        """Write the buckets that ``changed`` rows and ``gone`` ids touch; ids of both are replaced or removed."""
        change = change or uuid.uuid4().hex
        changed, gone = self._stage(changed, gone, change)
        touched = changed.select("session_id").unionByName(gone.select("session_id")).distinct()
        buckets = [r["b"] for r in touched.select(bucket_of(F.col("session_id"), self.buckets).alias("b")).distinct().collect()]
        version = self.version()
        if not buckets:
            return version
        self._write(changed, touched, buckets, change)
        self._feed(changed, gone, change)
        self._publish(version + 1, buckets, change)
        return version + 1

    def save(self, sessions: DataFrame, change: str | None = None) -> int:
        """Insert or replace sessions; rows with ids that could leave a folder are refused. A change of a given name is made once."""
        if change is not None and self.published(change):
            return self.version()
        return self._commit(sessions.where(is_session_id(F.col("session_id"))), self.spark.createDataFrame([], "session_id string"), change)

    def delete(self, ids: DataFrame) -> int:
        """Remove sessions; unknown ids are no error and no change."""
        known = ids.select("session_id").join(self.read().select("session_id"), "session_id", "left_semi").distinct()
        return self._commit(self.spark.createDataFrame([], self.schema), known)

    def changes(self, after: int = 0) -> DataFrame:
        """Change feed of published versions: version, session_id and kind (saved or removed)."""
        made = self._places().select("version", "change").distinct().where(F.col("version") > after)
        feed = self._table("changes", self.CHANGES).distinct()  # a change that was begun twice has its rows twice
        return feed.join(F.broadcast(made), "change").select("version", "session_id", "kind")

    def library(self) -> DataFrame:
        return summarised(self.read())


class SummaryIndex:
    """Summaries of session files, kept beside them with the length and time of the file each was made of, and the version of
    the format. An index of another version, or one that can't be read, is as if there were none."""

    def __init__(self, spark: SparkSession, path: str, summary: str, format_version: int = S.INDEX_VERSION) -> None:
        self.spark, self.path, self.format_version = spark, path.rstrip("/"), format_version
        self.schema = f"{S.FILE_STAT}, summary {summary}"

    def load(self) -> DataFrame:
        try:
            rows = self.spark.read.schema(f"format int, {self.schema}").parquet(self.path)
        except AnalysisException:
            rows = self.spark.createDataFrame([], f"format int, {self.schema}")
        return rows.where(F.col("format") == self.format_version).drop("format")

    def save(self, rows: DataFrame) -> None:
        names = ["session_id", "len", "modified_ms", "summary"]
        rows.select(F.lit(self.format_version).alias("format"), *names).write.mode("overwrite").parquet(self.path)

    def refreshed(self, stats: DataFrame, summaries: DataFrame) -> DataFrame:
        """The index for the files as they are now (session_id, len, modified_ms), with summaries (session_id, summary) for those that changed."""
        return refreshed_index(stats, self.load(), summaries)


def save_stream(store: SessionStore, rows: DataFrame, checkpoint: str, order: str, name: str = "stream"):
    """A streaming query that saves each micro-batch of sessions as one change. The row that comes last by the column ``order``
    counts; a batch that is run again after a failure is not saved twice."""

    def save(batch: DataFrame, number: int) -> None:
        fields = [c for c in batch.columns if c != order]
        last = batch.groupBy("session_id").agg(F.max_by(F.struct(*fields), order).alias("last")).select("last.*")
        store.save(last, f"{name}-{number}")

    return rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).start()
