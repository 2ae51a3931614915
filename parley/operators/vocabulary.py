"""Vocabulary correction: tokens and phrases that nearly are a term become that term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.functions.fuzzy import BOOST, BOOST_CHARS, jaro_winkler_of

THRESHOLD = 0.86
LEAST_CHARS = 4
LENGTH_GAP = 2


#: Letters from rare to frequent; all other characters are rarer. Any order gives the same matches, this one fewer meetings.
RARE_FIRST = "zqxjkvbpygfwmucldrhsnioate"
SALTS = 4


def _marks(word: str) -> Column:
    """A word's characters, each with how many times it has come up, rare ones first: a set that two words share as much of as
    they have characters in common. A mark is a number, rank and code point, as sets of numbers are far faster to compare."""
    chars = F.split(F.col(word), "")
    rank = lambda c, i: F.instr(F.lit(RARE_FIRST), c) - 32 * F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda d: d == c))
    return F.array_sort(F.transform(chars, lambda c, i: rank(c, i).cast("long") * (1 << 21) + F.ascii(c)))


def _needed(a: Column, b: Column, threshold: float) -> Column:
    """How many characters words of ``a`` and ``b`` characters must have in common at least. With the largest boost a score of
    ``threshold`` takes a similarity of (threshold - boost) / (1 - boost), and that is at most (m / a + m / b + 1) / 3 for m matches."""
    boost = BOOST_CHARS * BOOST
    least = max(3 * (threshold - boost) / (1 - boost) - 1, 0)
    return F.greatest(F.ceil(F.lit(least) * a * b / (a + b) - 1e-9), F.lit(1))


def _met_by(size: Column, threshold: float) -> Column:
    """How many of a word's marks, from the rarest on, reach one that any word of a comparable length and enough common
    characters has among its own."""
    fewest = F.array_min(F.transform(F.sequence(F.greatest(size - LENGTH_GAP, F.lit(1)), size + LENGTH_GAP), lambda b: _needed(size, b, threshold)))
    return (F.greatest(size - fewest, F.lit(0)) + 1).cast("int")


def _most(threshold: float) -> Column:
    """Whether a pair can score ``threshold``, by the characters in common and the first ones that are equal."""
    a, b = F.col("size_a"), F.col("size_b")
    common = F.size(F.array_intersect("marks_a", "marks_b")).cast("double")
    jaro = (common / a + common / b + 1) / 3
    prefix = F.lit(0)
    for k in range(1, BOOST_CHARS + 1):
        prefix = F.when(F.left("low_token", F.lit(k)) == F.left("low", F.lit(k)), k).otherwise(prefix)
    return (common >= _needed(a, b, threshold)) & (jaro + prefix * BOOST * (1 - jaro) >= threshold - 1e-9)


def matches(tokens: DataFrame, terms: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """token, term and score of the best term for each distinct token; none for tokens that are a term or too short.
    Terms (term, rank) with the smaller rank win ties.

    Words are met by an index of marks (a character and its how-manieth time): of two words that can score the threshold,
    each has among its rarest marks, as many as ``_met_by`` tells, one of the other's. A pair counts at the first mark that it shares, so
    it is scored once, and only if its characters allow the threshold (the filter stays above a score that isn't
    deterministic to Spark). Frequent marks are spread over ``SALTS`` parts of the tokens. Words are few bytes and much work, so they are
    dealt over all shuffle partitions, which adaptive execution would otherwise merge into one task."""
    low = terms.select("term", "rank", F.lower("term").alias("low"))
    words = tokens.select("token").distinct().withColumn("low_token", F.lower("token")).where(F.length("low_token") >= LEAST_CHARS)
    unknown = words.join(low.select(F.col("low").alias("low_token")).distinct(), "low_token", "left_anti")
    unknown = unknown.repartition(int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")), "low_token")

    def indexed(rows: DataFrame, word: str, side: str, salt: Column) -> DataFrame:
        sized = rows.withColumns({f"size_{side}": F.length(word), f"marks_{side}": _marks(word)})
        first = F.slice(f"marks_{side}", F.lit(1), _met_by(F.col(f"size_{side}"), threshold))
        return sized.withColumns({f"first_{side}": first, "salt": salt}).withColumn("mark", F.explode(f"first_{side}"))

    near = indexed(unknown, "low_token", "a", F.pmod(F.xxhash64("low_token"), F.lit(SALTS)).cast("int"))
    known = indexed(low.where(F.length("low") > 0), "low", "b", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = near.join(known, ["mark", "salt"]).where(F.abs(F.col("size_a") - F.col("size_b")) <= LENGTH_GAP)
    able = met.where((F.col("mark") == F.element_at(F.array_intersect("first_a", "first_b"), 1)) & _most(threshold))
    scored = able.withColumn("score", jaro_winkler_of.asNondeterministic()("low_token", "low")).where(F.col("score") >= threshold)
    best = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("score"), "rank"))
    return scored.withColumn("n", best).where("n = 1").select("token", "term", "score")


def spans(texts: DataFrame, longest: int) -> DataFrame:
    """Runs of up to ``longest`` words of each text: key, at (place of the first piece), pieces, span and token."""
    pieces = texts.select("key", T.words_and_gaps(F.col("text")).alias("pieces"))
    word = F.rlike(F.col("piece"), F.lit(r"[\p{L}\p{N}']"))
    placed = pieces.select("key", "pieces", F.posexplode("pieces").alias("at", "piece")).where(word)
    sized = placed.withColumn("words", F.explode(F.sequence(F.lit(1), F.lit(longest)))).withColumn("n", F.col("words") * 2 - 1)
    whole = sized.where(F.col("at") + F.col("n") <= F.size("pieces"))
    inside = F.slice("pieces", F.col("at") + 1, F.col("n"))
    gaps = F.filter(inside, lambda _, i: i % 2 == 1)
    kept = whole.withColumn("inside", inside).where(F.forall(gaps, lambda g: T.is_blank(g)))
    return kept.select("key", "at", "n", "words", F.array_join(F.transform(F.filter("inside", lambda _, i: i % 2 == 0), lambda p: p), " ").alias("token"))


def corrected(texts: DataFrame, terms: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """key and text with tokens replaced by their best term, longer phrases first, in the casing found."""
    counted = terms.withColumn("words", F.size(F.split("term", r"\s+")))
    longest = counted.agg(F.max("words")).first()[0] or 1
    found = spans(texts, longest)
    pairs = matches_by_words(found, counted, longest, threshold)
    hits = found.join(pairs, ["token", "words"]).select("key", "at", "n", T.cased_like(F.col("term"), F.col("token")).alias("new"))
    edits = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "at", "n", "new")))
    edited = hits.groupBy("key").agg(edits.alias("edits"))

    def place(done: Column, edit: Column) -> Column:
        clash = F.exists(done, lambda d: (d["at"] < edit["at"] + edit["n"]) & (edit["at"] < d["at"] + d["n"]))
        return F.when(clash, done).otherwise(F.concat(done, F.array(edit)))

    none = F.filter("edits", lambda _: F.lit(False))
    chosen = texts.select("key", T.words_and_gaps(F.col("text")).alias("pieces"), "text").join(edited, "key", "left").withColumn("edits", F.aggregate("edits", none, place))

    def piece(p: Column, i: Column) -> Column:
        here = F.filter("edits", lambda e: (e["at"] <= i) & (i < e["at"] + e["n"]))
        first = F.try_element_at(here, F.lit(1))
        return F.when(F.size(here) == 0, p).when(first["at"] == i, first["new"]).otherwise("")

    return chosen.select("key", F.when(F.col("edits").isNull(), F.col("text")).otherwise(F.array_join(F.transform("pieces", piece), "")).alias("text"))


def matches_by_words(found: DataFrame, terms: DataFrame, longest: int, threshold: float) -> DataFrame:
    """Best terms for tokens of one number of words each: phrases meet phrases."""
    out = None
    for words in range(1, longest + 1):
        part = matches(found.where(F.col("words") == words), terms.where(F.col("words") == words), threshold).withColumn("words", F.lit(words))
        out = part if out is None else out.unionByName(part)
    return out
