"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every version of every text is addressed by the SHA-256 of its content. The ledger is a stored table of the
(blob, rules version) pairs that have been scanned; a run scans each unseen pair once, however many versions hold the
blob, stores the findings, then the ledger entries, and joins findings back to every version. Findings of a run that
broke off before its ledger entries were written don't count, as findings are read by the batches in the ledger.

A finding's place comes from the lengths of the pieces between matches: ``split`` and ``regexp_extract_all`` walk the
same leftmost non-overlapping matches, so running sums of their lengths give code point offsets.

Defined cases: a null text is the empty blob; repeated rows share a blob and get the same answer each; a null doc_id
keeps its row; an empty table gives no rows; other columns are ignored. Spans are per kind, so kinds may overlap.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm.tables import new_folder

RULES_VERSION = "1"
#: Fresh blobs up to this many are broadcast (64 bytes each) to filter the texts before they are shuffled.
FEW_BLOBS = 10_000


def either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


# Keywords and patterns of the base rules, in the order in which kinds are listed.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = "(" + "|".join(map(either_case, KEYWORDS)) + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: Kind, pattern, group whose length counts, its least length. Runs of one character class are maximal, so for access and hex the least length can be in the pattern; a failing assignment is walked over.
RULES = (
    ("assign", ASSIGN, 2, 6),
    ("access", "AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
)
KINDS = [kind for kind, *_ in RULES]


def _lengths(strings: Column) -> Column:
    return F.transform(strings, lambda s: F.length(s))


def _walk(text: Column, kind: str, pattern: str, group: int) -> Column:
    """The matches of one rule: piece before the match, match and counted group, as lengths."""
    regex = F.lit(pattern)
    found = F.arrays_zip(
        _lengths(F.split(text, pattern, -1)).alias("gap"),
        _lengths(F.regexp_extract_all(text, regex, F.lit(0))).alias("size"),
        _lengths(F.regexp_extract_all(text, regex, F.lit(group))).alias("counted"),
    )
    return F.struct(F.lit(kind).alias("kind"), F.when(text.rlike(pattern), found).alias("found"))


def spans(blobs: DataFrame) -> DataFrame:
    """blob, kind, start, end of all findings in the texts of ``blobs`` (blob, text)."""
    walks = F.array(*[_walk(F.col("text"), kind, pattern, group) for kind, pattern, group, _ in RULES])
    walked = blobs.select("blob", F.explode(walks).alias("walk")).where("walk.found is not null")
    rows = walked.select("blob", "walk.kind", F.posexplode("walk.found").alias("at", "m"))
    through = Window.partitionBy("blob", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("m.gap") + F.coalesce("m.size", F.lit(0))).over(through)
    placed = rows.select("blob", "kind", "m", (end - F.col("m.size")).alias("start"), end.alias("end"))
    long_enough = reduce(lambda a, b: a | b, [(F.col("kind") == kind) & (F.col("m.counted") >= least) for kind, _, _, least in RULES])
    return placed.where(F.col("m.size").isNotNull() & long_enough).select("blob", "kind", "start", "end")


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


class BlobLedger:
    """Stored tables below one folder: ``ledger`` (blob, rules, batch) and ``findings`` (blob, kind, start, end, by batch)."""

    LEDGER = "blob string, rules string, batch string"
    FINDINGS = "blob string, kind string, start long, end long, batch string"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        spark.createDataFrame([], self.LEDGER).write.mode("append").parquet(f"{path}/ledger")
        spark.createDataFrame([], self.FINDINGS).write.mode("append").parquet(f"{path}/findings")

    def ledger(self) -> DataFrame:
        return self.spark.read.schema(self.LEDGER).parquet(f"{self.path}/ledger")

    def findings(self, rules: str = RULES_VERSION) -> DataFrame:
        batches = self.ledger().where(F.col("rules") == rules).select("batch").distinct()
        return self.spark.read.schema(self.FINDINGS).parquet(f"{self.path}/findings").join(batches, "batch", "left_semi").drop("batch")

    def scan(self, versions: DataFrame, rules: str = RULES_VERSION) -> DataFrame:
        """Scan the unseen blobs of ``versions`` (doc_id, text); returns doc_id and blob of every version."""
        batch = uuid.uuid4().hex
        rows = versions.select("doc_id", "text").select("doc_id", "text", blob_of(F.col("text")).alias("blob"))
        rows.select("doc_id", "blob").write.parquet(f"{self.path}/versions/batch={batch}")
        ids = self.spark.read.parquet(f"{self.path}/versions/batch={batch}")
        fresh = ids.select("blob").distinct().join(self.ledger().where(F.col("rules") == rules), "blob", "left_anti")
        fresh.write.parquet(f"{self.path}/fresh/batch={batch}")
        fresh = self.spark.read.parquet(f"{self.path}/fresh/batch={batch}")
        few = fresh.count() <= FEW_BLOBS
        texts = rows.join(F.broadcast(fresh), "blob", "left_semi") if few else rows
        blobs = texts.groupBy("blob").agg(F.coalesce(F.first("text", ignorenulls=True), F.lit("")).alias("text"))  # copies meet in the map tasks
        blobs = blobs if few else blobs.join(fresh, "blob", "left_semi")
        spans(blobs).withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{self.path}/findings")
        fresh.select("blob", F.lit(rules).alias("rules"), F.lit(batch).alias("batch")).write.mode("append").parquet(f"{self.path}/ledger")
        return ids


def digests(findings: DataFrame) -> DataFrame:
    """One row for each blob with findings: counts by kind, and all spans by start, then kind as listed."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    rows = findings.select("blob", "kind", F.struct("start", rank.alias("rank"), "end", "kind").alias("span"))
    grouped = rows.groupBy("blob").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS], F.array_sort(F.collect_list("span")).alias("spans"))
    text = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return grouped.withColumn("spans", F.array_join(text, ","))


def findings_by_version(ids: DataFrame, findings: DataFrame) -> DataFrame:
    """The digest of each version's blob, joined back to all versions."""
    out = ids.join(digests(findings), "blob", "left")
    spans_text = F.coalesce("spans", F.lit(""))
    counts = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(spans_text, 256).alias("base_sha256"), spans_text.alias("spans"), "blob")


def secrets(docs: DataFrame) -> DataFrame:
    """All versions in ``docs`` against a new ledger."""
    ledger = BlobLedger(docs.sparkSession, new_folder(docs.sparkSession, "blob-ledger"))
    return findings_by_version(ledger.scan(docs), ledger.findings())


def _oracle_walk(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    regex = "'" + pattern.replace("'", "''") + "'"
    return f"""
  SELECT text, '{kind}' AS kind, {rank} AS rank, {least} AS least, unnest(string_split_regex(text, {regex})) AS gap,
    unnest(regexp_extract_all(text, {regex}, 0)) AS hit, unnest(regexp_extract_all(text, {regex}, {group})) AS counted,
    generate_subscripts(string_split_regex(text, {regex}), 1) AS i FROM blobs"""


_ORACLE_WALKS = " UNION ALL ".join([_oracle_walk("assign", 1, ASSIGN, 2, 6), _oracle_walk("access", 2, "AKIA[A-Z0-9]+", 0, 20), _oracle_walk("hex", 3, "[0-9a-f]+", 0, 24)])

ORACLE_SQL = f"""
WITH blobs AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents),
m AS ({_ORACLE_WALKS}),
placed AS (SELECT *, sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY text, kind ORDER BY i) AS ends FROM m),
found AS (
  SELECT text, kind, rank, ends - length(hit) AS starts, kind || ':' || CAST(ends - length(hit) AS BIGINT) || ':' || CAST(ends AS BIGINT) AS span
  FROM placed WHERE hit IS NOT NULL AND length(counted) >= least),
grouped AS (
  SELECT text, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
    count(*) FILTER (WHERE kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY starts, rank) AS spans FROM found GROUP BY text)
SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
  CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(coalesce(d.text, '')) AS blob
FROM documents d LEFT JOIN grouped g ON g.text = coalesce(d.text, '')
"""
