"""Queries over vectors as samples of recordings: every value of every vector is a sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import audio
from parley.operators import recordings as R
from parley.plans.vectors import SQL_EMB, _embeddings

SIZE = 24
RING = 100
LEAD = 100
MIX = 40


def _total(samples: str | Column) -> Column:
    return F.round(F.aggregate(samples, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0))), 6)


def _weighted(samples: str | Column) -> Column:
    """The sum of samples times their places, from 1: it changes if samples change their order."""
    column = F.col(samples) if isinstance(samples, str) else samples
    return _total(F.transform(column, lambda x, i: x * (i + 1)))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in tens as a session; each vector is two chunks, the first of 24 to 64 samples."""
    rows = _embeddings(spark, sf_dir)
    cut = (F.col("vec_id") % 5 * 10 + 24).cast("int")
    parts = F.posexplode(F.array(F.slice("embedding", 1, cut), F.slice("embedding", cut + 1, F.lit(64)))).alias("part", "samples")
    return rows.select(F.floor(F.col("vec_id") / 10).alias("session_id"), "vec_id", parts).select("session_id", (F.col("vec_id") * 2 + F.col("part")).alias("at"), "samples")


def reblocked_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reblocked(_chunks(spark, sf_dir), SIZE).select("session_id", "block", _total("samples").alias("total"), _weighted("samples").alias("weighted"))


def preroll_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audio.with_preroll(_chunks(spark, sf_dir), RING)
    return rows.select("session_id", "at", F.size("preroll").cast("long").alias("n"), _total("preroll").alias("total"), _weighted("preroll").alias("weighted"))


def overlap_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in tens as frames of 64 samples, each 16 after the one before."""
    frames = _embeddings(spark, sf_dir).select(F.floor(F.col("vec_id") / 10).alias("session_id"), (F.col("vec_id") % 10).alias("k"), F.col("embedding").alias("samples"))
    rows = R.overlap_added(frames, 16).select("session_id", "block", F.posexplode("samples").alias("i", "x"))
    return rows.select("session_id", (F.col("block") * 16 + F.col("i")).alias("pos"), F.round("x", 6).alias("x"))


def aligned_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in fifties as a session, even ones near and odd ones far; their places overlap here and leave gaps there."""
    place = F.floor(F.col("vec_id") / 2)
    start = place * 70 - F.col("vec_id") % 5 * 12 + F.floor(F.col("vec_id") / 14) * 30
    rows = _embeddings(spark, sf_dir).select(F.floor(F.col("vec_id") / 50).alias("session_id"), F.col("vec_id").alias("at"), start.alias("start"), F.col("embedding").alias("samples"))
    blocks = R.aligned_samples(rows.where("at % 2 = 0"), rows.where("at % 2 = 1"))
    told = [x for side in ("near", "far") for x in (F.size(F.array_compact(side)).cast("long").alias(f"{side}_n"), _total(side).alias(f"{side}_total"), _weighted(side).alias(f"{side}_weighted"))]
    return blocks.select("session_id", "block", F.size("near").cast("long").alias("n"), *told)


def endpoint_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in fifties as pushes of two sources, one of which pauses, loud enough to be clipped."""
    source = F.when(F.col("at") % 30 < 20, F.col("at") % 2).otherwise(0)
    rows = _chunks(spark, sf_dir).select(F.floor(F.col("at") / 100).alias("session_id"), "at", source.alias("source"), F.transform("samples", lambda x: F.round(x * 150_000).cast("int")).alias("samples"))
    return R.mixed_blocks(rows, 2, LEAD, MIX).select("session_id", "block", F.size("samples").cast("long").alias("n"), _total("samples").alias("total"), _weighted("samples").alias("weighted"))


def gated_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in hundreds as a far side; the near side is a faint echo of it a few samples later in even sessions, and other
    vectors in odd ones. Without SQL: a test compares the gate with loops over its formulas."""
    rows = _embeddings(spark, sf_dir).select(F.floor(F.col("vec_id") / 100).alias("session_id"), F.col("vec_id").alias("at"), (F.col("vec_id") % 100 * 64).alias("start"), F.col("embedding").alias("samples"))
    echo = F.when(F.col("session_id") % 2 == 0, F.transform("samples", lambda x: x * 0.01)).otherwise(F.transform(F.reverse("samples"), lambda x: x * 0.01))
    near = rows.withColumns({"start": F.col("start") + F.when(F.col("session_id") % 2 == 0, 7).otherwise(0), "samples": echo})
    gated = R.reference_gated(near, rows)
    return gated.select("session_id", "block", F.round("target", 6).alias("target"), F.round("gain", 6).alias("gain"), F.size("samples").cast("long").alias("n"), _total("samples").alias("total"))


_PARTS = f"""(SELECT vec_id // 10 AS session_id, vec_id * 2 AS "at", v[1:vec_id % 5 * 10 + 24] AS samples FROM {SQL_EMB} UNION ALL SELECT vec_id // 10, vec_id * 2 + 1, v[vec_id % 5 * 10 + 25:64] FROM {SQL_EMB})"""
_CELLS = f"""(SELECT session_id, "at", start + i - 1 AS pos, samples[i] AS x FROM (SELECT *, unnest(range(1, len(samples) + 1)) AS i FROM
  (SELECT *, coalesce(sum(len(samples)) OVER (PARTITION BY session_id ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM {_PARTS})))"""

SQL = {
    "reblocked_samples": f"""WITH c AS (SELECT *, CAST(pos // {SIZE} AS BIGINT) AS block, pos % {SIZE} + 1 AS i FROM {_CELLS})
SELECT session_id, block, round(sum(x), 6) AS total, round(sum(x * i), 6) AS weighted FROM c GROUP BY session_id, block HAVING count(*) = {SIZE}""",
    "preroll_ring": f"""WITH c AS (SELECT * FROM {_CELLS}), e AS (SELECT session_id, "at", sum(len(samples)) OVER (PARTITION BY session_id ORDER BY "at") - 1 AS last FROM {_PARTS})
SELECT e.session_id, e."at", count(*) AS n, round(sum(x), 6) AS total, round(sum(x * (pos - greatest(last - {RING}, -1))), 6) AS weighted
FROM e JOIN c ON c.session_id = e.session_id AND c.pos <= e.last AND c.pos > e.last - {RING} GROUP BY e.session_id, e.at""",
    "overlap_add": f"SELECT session_id, pos, round(sum(x), 6) AS x FROM (SELECT vec_id // 10 AS session_id, vec_id % 10 * 16 + i - 1 AS pos, v[i] AS x FROM {SQL_EMB}, range(1, 65) r(i)) GROUP BY session_id, pos",
    "aligned_samples": f"""WITH r AS (SELECT vec_id // 50 AS session_id, vec_id % 2 AS far, vec_id AS "at", vec_id // 2 * 70 - vec_id % 5 * 12 + vec_id // 14 * 30 AS start, v FROM {SQL_EMB}),
o AS (SELECT session_id, arg_min(start, "at") AS origin, max(start) + 64 AS last FROM r WHERE far = 0 GROUP BY session_id),
k AS (SELECT *, max(start + 64) OVER (PARTITION BY session_id, far ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM r),
c AS (SELECT session_id, far, start + i - 1 - origin AS pos, v[i] AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM k) JOIN o USING (session_id) WHERE start + i - 1 >= greatest(origin, coalesce(reached, start)) AND start + i - 1 < last),
b AS (SELECT session_id, pos // 128 AS block, pos, pos % 128 + 1 AS i FROM (SELECT session_id, unnest(range(0, last - origin)) AS pos FROM o))
SELECT b.session_id, block, count(*) AS n, count(n.x) AS near_n, round(coalesce(sum(n.x), 0), 6) AS near_total, round(coalesce(sum(n.x * i), 0), 6) AS near_weighted,
  count(f.x) AS far_n, round(coalesce(sum(f.x), 0), 6) AS far_total, round(coalesce(sum(f.x * i), 0), 6) AS far_weighted
FROM b LEFT JOIN c n ON n.session_id = b.session_id AND n.pos = b.pos AND n.far = 0 LEFT JOIN c f ON f.session_id = b.session_id AND f.pos = b.pos AND f.far = 1 GROUP BY b.session_id, block""",
    "endpoint_mix": f"""WITH RECURSIVE r AS (SELECT "at" // 100 AS session_id, "at", CASE WHEN "at" % 30 < 20 THEN "at" % 2 ELSE 0 END AS source, samples, len(samples) AS n FROM {_PARTS}),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY "at") AS k FROM r),
f(session_id, k, start, gone, a, b) AS (SELECT session_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM k WHERE k = 1
  UNION ALL SELECT session_id, k, start, greatest(gone, least(a, b), greatest(a, b) - {LEAD}), a, b FROM (
    SELECT session_id, k, start, gone, CASE WHEN source = 0 THEN start + n ELSE a END AS a, CASE WHEN source = 1 THEN start + n ELSE b END AS b FROM (
      SELECT k.session_id, k.k, source, n, f.gone, f.a, f.b, greatest(f.gone, CASE WHEN source = 0 THEN f.a ELSE f.b END) AS start FROM f JOIN k ON k.session_id = f.session_id AND k.k = f.k + 1))),
g AS (SELECT session_id, max(gone) AS length FROM f GROUP BY session_id),
c AS (SELECT session_id, start + i - 1 AS pos, CAST(round(samples[i] * 150000) AS INTEGER) AS x FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM k JOIN f USING (session_id, k))),
m AS (SELECT session_id, pos, least(greatest(sum(x), -32768), 32767) AS x FROM c JOIN g USING (session_id) WHERE pos < length GROUP BY session_id, pos)
SELECT session_id, pos // {MIX} AS block, count(*) AS n, CAST(sum(x) AS DOUBLE) AS total, CAST(sum(x * (pos % {MIX} + 1)) AS DOUBLE) AS weighted FROM m GROUP BY ALL""",
}

QUERIES = (reblocked_samples, preroll_ring, overlap_add, aligned_samples, endpoint_mix, gated_recordings)
