"""Filter interaction audit: what five filters remove, in every order in which they can be applied.

A document fails A with under 200 words, B if 100 times its distinct words are fewer than 50 times its words, C if more
than 3 % of its code points are ``A-Z``, D if it holds one of ``#$%&*|``, and E if a smaller doc_id has the same text. The
failures of a document are a mask of five bits. A to D follow from the text in one pass of native expressions, E from
the smallest doc_id of each text, which a ``groupBy`` of the texts finds; a text is known there by its SHA-256, so that
texts aren't shuffled. Documents are added up to at most 32 cells for each part (a value of ``lang``), and all orders and
steps follow from the cells, however many documents there are.

Rows with the same text, part and labels are added up before they meet: a text that a third of all rows hold is a row of
each task. Labels are met by doc_id and one of ``SALTS`` parts of the texts, so that a doc_id of very many rows, or none,
doesn't gather in one task. They meet sorted, and pass through no driver.

Defined cases: a null text is empty, and fails A only (no word of none is distinct or not) besides E; a null lang is the
part ``''``; a null doc_id counts as greater than all others, and equal to other nulls, so it fails E next to the same text
under any id and has no labels; repeated rows count each, and don't fail E against each other; of several labels of a
doc_id, one that says 1 suffices; null labels say nothing. A very long text takes memory in proportion to its words. An
empty table gives no rows, as it has no part; other columns are ignored.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.tables import stored

FILTERS = "ABCDE"
LEAST_WORDS = 200
#: Per cent.
LEAST_DISTINCT = 50
MOST_UPPER = 3
SALTS = 8

_SPACES = r"[\x20\x09-\x0D]+"
_STEPS = "array<struct<filter_order:string,step:int,bit:int,before:int>>"


def _bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def text_failures(text: Column) -> Column:
    """Bits of A to D of a text that isn't null."""
    words = F.array_remove(F.split(text, _SPACES), "")
    upper = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    failed = {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        "C": 100 * upper.cast("long") > MOST_UPPER * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }
    return sum((F.when(is_failed, _bit(name)).otherwise(0) for name, is_failed in failed.items()), F.lit(0))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """content, part, mask of A to D, labels and doc_id of each row, with the salt by which labels were met."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("content"), text_failures(text).alias("mask"))
    says = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id")
    known = says.agg(F.max(F.expr("quality <=> 1")).alias("good"), F.max(F.expr("toxic <=> 1")).alias("toxic"))
    # Spark's estimate of the size leaves the salts out, so by itself it would broadcast SALTS times what it allows
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    met = rows.withColumn("salt", F.pmod(F.xxhash64("content"), F.lit(SALTS)).cast("int")).join(known, ["doc_id", "salt"], "left")
    return met.fillna(False, ["good", "toxic"])


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by part and failed filters."""
    like = ["content", "part", "mask", "good", "toxic"]
    rows = _labelled(docs, labels).groupBy(*like, "doc_id", "salt").agg(F.count(F.lit(1)).alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n")).alias("least")
    sorts = stored(rows.groupBy(*like).agg(least, F.sum("n").alias("n")), "filter-masks")
    own = F.struct("least.none", "least.doc_id")
    first = sorts.groupBy("content").agg(F.min(own).alias("first"))
    found = sorts.join(first, "content").withColumn("fresh", F.when(own.eqNullSafe(F.col("first")), F.col("least.n")).otherwise(0))
    split = F.explode(F.array(F.struct("mask", F.col("fresh").alias("n")), F.struct((F.col("mask") + _bit("E")).alias("mask"), (F.col("n") - F.col("fresh")).alias("n"))))
    each = found.select("part", "good", "toxic", split.alias("cell")).select("part", "cell.*", "good", "toxic").where("n > 0")
    labelled = [F.sum(F.when(F.col(name), F.col("n")).otherwise(0)).alias(name) for name in ("good", "toxic")]
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), *labelled)


def _steps() -> list[dict]:
    """Each step of each order, with the bit of its filter and those of the filters before it."""
    orders = ["".join(order) for order in permutations(FILTERS)]
    return [{"filter_order": order, "step": k + 1, "bit": _bit(name), "before": sum(map(_bit, order[:k]))} for order in orders for k, name in enumerate(order)]


def _total(chosen: str, value: str) -> Column:
    """Sum of a value over the cells of a part of which ``chosen`` holds."""
    return F.expr(f"aggregate(filter(cells, c -> {chosen}), 0L, (sum, c) -> sum + {value})")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each step of each order keeps and removes in each part, and what its filter shares with the others."""
    parts = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    steps = F.from_json(F.lit(json.dumps(_steps())), _STEPS)
    here, fails = "(c.mask & before) = 0 and (c.mask & bit) != 0", "(c.mask & bit) != 0"
    orders = len(list(permutations(FILTERS)))
    return parts.select("part", "cells", F.inline(steps)).select(
        "part", "filter_order", "step",
        _total("(c.mask & (before | bit)) = 0", "c.n").alias("kept"),
        _total(here, "c.n").alias("removed"),
        _total(f"{fails} and (c.mask & before) != 0", "c.n").alias("redundant"),
        _total("c.mask = bit", "c.n").alias("unique_fails"),
        _total(here, "c.good").alias("good_lost"),
        _total(here, "c.toxic").alias("toxic_lost"),
        # of k filters that a document fails, each comes first in one of k orders
        _total(fails, f"c.n * ({orders} div bit_count(c.mask))").alias("shapley"),
    )


ORACLE_SQL = rf"""
WITH named(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order FROM named a, named b, named c, named d, named e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
places AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
steps AS (SELECT filter_order, step, bit, coalesce(sum(bit) OVER (PARTITION BY filter_order ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS before
  FROM places JOIN named ON name = filter_order[step]),
docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
said AS (SELECT doc_id, coalesce(max(quality) FILTER (quality = 1), 0) AS good, coalesce(max(toxic) FILTER (toxic = 1), 0) AS toxic FROM labels GROUP BY doc_id),
masks AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  (len(ws) < {LEAST_WORDS})::INT + 2 * (100 * len(list_distinct(ws)) < {LEAST_DISTINCT} * len(ws))::INT
  + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MOST_UPPER} * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
  + 16 * (coalesce(doc_id, 9223372036854775807) > min(coalesce(doc_id, 9223372036854775807)) OVER (PARTITION BY t))::INT AS mask
  FROM docs LEFT JOIN said USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY ALL),
found AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS removed, coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails, coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM found
"""
