"""Mixing sources to target weights by soft membership, with DataFrame functions only.

A naive Bayes classifier over hashed words is fitted on at most ``TRAIN_ROWS`` rows of the labelled table (those with
the smallest hash of doc_id); a labelled document's domain is its language. It gives every document a posterior over
domains, from the whole text; log-likelihoods of texts of any length are divided by ``TEMPERATURE``, as words that follow each
other aren't independent, so posteriors stay soft.

Document rates r >= ``least`` (0, or more where no document may be lost) minimise the weighted squares of

    sum over documents of r * tokens * posterior[k]  -  target[k]

by projected gradient descent. A step needs the K sums over all documents and nothing else, so each step is one
aggregation over a stored table of (tokens, posterior); a document's rate is a fold of the K-vectors of past steps.
Only K and K x K sums, and the classifier's buckets, reach the driver.

Targets are given as weights of domains, or follow token shares to the power ``ALPHA``. The token budget is the least
at which no domain's target is below what it has, so documents are repeated rather than dropped. A rate becomes whole
copies by a hash of the document: ``floor(rate + u)``.

Defined cases: a null or empty text has no tokens and the prior as posterior; repeated rows are counted each; a null
doc_id is mixed like any other; rows without a language aren't trained on; without labelled rows every rate is 1 (or
``least``, if more); of equal posteriors the first domain by name is the likeliest; a very long text is exploded into
words like any other; an empty table gives no rows; other columns are kept by ``mixed`` and ignored elsewhere.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.tables import stored

TRAIN_ROWS = 5_000
BUCKETS = 4096
#: Ten words of a text count as one.
TEMPERATURE = 10.0
SMOOTHING = 0.5
ALPHA = 0.7
#: Descent ends when all totals are within TOLERANCE of their targets, or when they move no more, as a bound on rates holds
#: them; else after STEPS passes over the stored posteriors. What was reached is told beside each target.
STEPS = 40
TOLERANCE = 1e-3


def _words(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


class Classifier:
    """Log-likelihoods of each bucket and log priors, for domains in sorted order."""

    def __init__(self, counts: dict[tuple[int, str], int], rows: dict[str, int]) -> None:
        self.domains = sorted(rows)
        self.priors = [math.log(rows[d] / sum(rows.values())) for d in self.domains]
        totals = {d: SMOOTHING * BUCKETS for d in self.domains}
        for (_, domain), n in counts.items():
            totals[domain] += n
        self.table = [[math.log((counts.get((b, d), 0) + SMOOTHING) / totals[d]) for d in self.domains] for b in range(BUCKETS)]


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Classifier:
    sample = labels.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", "text", F.col("lang").alias("domain")).where("domain is not null").join(F.broadcast(sample), "doc_id", "left_semi")
    per_bucket = rows.select("domain", F.explode(_words(F.col("text"))).alias("word")).groupBy(_bucket(F.col("word")).alias("bucket"), "domain").agg(F.count(F.lit(1)).alias("n"))
    counts = {(r["bucket"], r["domain"]): r["n"] for r in per_bucket.collect()}
    return Classifier(counts, {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()})


def memberships(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, fingerprint of the text, tokens and posterior of every row."""
    spark = docs.sparkSession
    k = len(model.domains)
    entries = F.lit(str(model.table)).cast("string")
    table = spark.range(1).select(F.posexplode(F.from_json(entries, "array<array<double>>")).alias("bucket", "loglik"))
    table = table.select("bucket", *[F.col("loglik")[i].alias(f"l{i}") for i in range(k)])
    numbered = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    rows = numbered.select("row", "doc_id", F.xxhash64("text").alias("print"), F.explode(_words(F.col("text"))).alias("word"))
    hit = rows.select("row", "doc_id", "print", (F.col("word") != "").cast("int").alias("one"), _bucket(F.col("word")).alias("bucket")).join(F.broadcast(table), "bucket")
    sums = hit.groupBy("row", "doc_id", "print").agg(F.sum("one").cast("double").alias("tokens"), *[F.sum(F.col(f"l{i}") * F.col("one")).alias(f"s{i}") for i in range(k)])
    logits = [F.col(f"s{i}") / TEMPERATURE + model.priors[i] for i in range(k)]
    scaled = sums.select("doc_id", "print", "tokens", F.array(*logits).alias("logits")).withColumn("top", F.array_max("logits"))
    raised = scaled.withColumn("raised", F.transform("logits", lambda x: F.exp(x - F.col("top"))))
    total = F.aggregate("raised", F.lit(0.0), lambda a, x: a + x)
    return raised.withColumn("total", total).select("doc_id", "print", "tokens", F.transform("raised", lambda x: x / F.col("total")).alias("posterior"))


def rate_of(k: int, moves: list[list[float]], least: float) -> Column:
    """The rate after the given steps: start at 1 (or ``least``), move against the gradient, project."""
    start = F.lit(max(1.0, least))
    if not moves:
        return start
    steps = F.from_json(F.lit(str(moves)), "array<array<double>>")

    def step(rate: Column, move: Column) -> Column:
        slope = F.lit(0.0)
        for i in range(k):
            slope = slope + F.col("posterior")[i] * move[i]
        return F.greatest(F.lit(least), rate - slope)

    return F.aggregate(steps, start, step)


def fitted_rates(members: DataFrame, domains: list[str], weights: dict[str, float] | None = None, least: float = 0.0) -> tuple[Column, list[float], list[float]]:
    """The rate as a column of ``members``, the targets, and the expected domain totals at the end."""
    k = len(domains)
    share = [F.col("posterior")[i] for i in range(k)]
    tokens = F.col("tokens")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    first = members.agg(*[F.sum(tokens * share[i]).alias(f"t{i}") for i in range(k)], *[F.sum(tokens * share[i] * share[j]).alias(f"m{i}_{j}") for i, j in pairs]).first()
    have = np.array([first[f"t{i}"] or 0.0 for i in range(k)])
    if not have.sum():
        return F.lit(max(1.0, least)), [0.0] * k, [0.0] * k
    want = np.array([weights.get(d, 0.0) for d in domains]) if weights else have**ALPHA
    want = want / want.sum()
    target = want * max(have[want > 0] / want[want > 0])
    gram = np.zeros((k, k))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = first[f"m{i}_{j}"]
    scale = 1 / np.maximum(np.diag(gram), 1e-12)
    root = np.sqrt(scale)
    pace = 1 / np.linalg.eigvalsh(root[:, None] * gram * root[None, :])[-1]
    moves: list[list[float]] = []
    total = have * max(1.0, least)
    for _ in range(STEPS):
        miss = total - target
        if np.all(np.abs(miss) <= TOLERANCE * np.maximum(target, 1e-9)):
            break
        moves.append([float(x) for x in pace * scale * miss])
        rate = rate_of(k, moves, least)
        now = members.agg(*[F.sum(rate * tokens * share[i]).alias(f"t{i}") for i in range(k)]).first()
        before, total = total, np.array([now[f"t{i}"] for i in range(k)])
        if np.all(np.abs(total - before) <= 1e-6 * np.maximum(target, 1e-9)):
            break  # the bound on rates holds the rest
    return rate_of(k, moves, least), [float(x) for x in target], [float(x) for x in total]


def copies_of(rate: Column) -> Column:
    """Whole copies whose expectation is the rate."""
    u = F.pmod(F.xxhash64("doc_id", "print", F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + u).cast("long")


def rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, least: float = 0.0) -> DataFrame:
    """doc_id, print, tokens, likeliest domain and its posterior, rate and copies of every row of ``docs``, and of that domain the
    target and the expected total of tokens that the rates reach."""
    model = fit(docs, labels)
    if not model.domains:
        blank = docs.select("doc_id", F.xxhash64("text").alias("print"), F.size(F.filter(_words(F.col("text")), lambda w: w != "")).cast("long").alias("tokens"))
        return blank.select("*", F.lit(None).cast("string").alias("domain"), F.lit(None).cast("double").alias("membership"), F.lit(max(1.0, least)).alias("rate"), F.lit(max(1, math.ceil(least))).cast("long").alias("copies"), F.lit(None).cast("double").alias("target"), F.lit(None).cast("double").alias("reached"))
    members = stored(memberships(docs, model), "memberships")
    rate, target, reached = fitted_rates(members, model.domains, weights, least)
    top = F.array_max("posterior")
    place = F.array_position("posterior", top).cast("int")
    of_domain = lambda values: F.element_at(F.array(*map(F.lit, values)), place)
    out = members.select("doc_id", "print", F.col("tokens").cast("long").alias("tokens"), of_domain(model.domains).alias("domain"), top.alias("membership"), rate.alias("rate"), of_domain(target).alias("target"), of_domain(reached).alias("reached"))
    return out.select("doc_id", "print", "tokens", "domain", "membership", "rate", copies_of(F.col("rate")).alias("copies"), "target", "reached")


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, least: float = 1.0) -> DataFrame:
    """The rows of ``docs``, all columns, each as many times as its copies; with ``least`` 1 no document is lost."""
    chosen = rates(docs, labels, weights, least).groupBy("doc_id", "print").agg(F.max("copies").alias("copies"))
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("doc"))  # no clash with the documents' names
    joined = rows.join(chosen, F.col("doc.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("doc.text") == F.col("print")))
    return joined.select("doc", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("doc.*")
