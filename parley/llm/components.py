"""Connected components of a table of links, by alternating star contractions.

Each round replaces links (a, b) by links to smaller neighbours, first from larger neighbours (large star), then among
smaller ones (small star), until every node is linked to the smallest of its component. Rounds are written to the
shared folder. A node with very many links is spread over ``SALTS`` groups in each join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.tables import stored

SALTS = 16


def _salt(col: Column) -> Column:
    return F.pmod(F.xxhash64(col, F.lit("salt")), F.lit(SALTS))


def _met(links: DataFrame, least: DataFrame) -> DataFrame:
    """Links (u, v) with u's value ``m`` from a table with one row for each u."""
    spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return links.withColumn("salt", _salt(F.col("v"))).join(spread, ["u", "salt"]).drop("salt")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _ordered(_met(both.where("v > u"), least).select(F.col("m").alias("a"), F.col("v").alias("b")))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _met(down, least).select(F.col("m").alias("a"), F.col("v").alias("b"))
    return _ordered(moved.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))))


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
    return row["n"], row["sum"]


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the smallest node of its component) of every node of the links (a, b)."""
    now = stored(_ordered(links), "links")
    before, mark = None, _mark(now)
    while mark != before:
        now = stored(_small_star(_large_star(now)), "links")
        before, mark = mark, _mark(now)
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    return now.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(roots)
