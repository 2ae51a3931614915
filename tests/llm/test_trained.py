"""Trained operators: held-out accuracy, fit of targets, and rows with every hard case."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from brute import empty_frame, hard_frame, hard_rows, prose

from parley.llm import mixing, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(documents, labels):
    rows = toxicity.toxicity(documents, labels).join(labels, "doc_id").toPandas()
    assert all(rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id])
    held = rows[rows.held_out]
    rank, toxic = held.score.rank(), held.toxic == 1
    auc = (rank[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / toxic.sum() / (~toxic).sum()
    assert auc > 0.85 and (held.predicted[~toxic]).mean() < 0.03 and rows.score.between(0, 1).all()


def test_held_out_recall_on_the_larger_table(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    rows = toxicity.toxicity(documents, labels).join(labels, "doc_id").where("held_out").toPandas()
    toxic = rows.toxic == 1
    assert rows.predicted[toxic].mean() >= 0.9 and rows.predicted[~toxic].mean() <= 0.01 and toxic.sum() > 80


def test_pairs_of_terms_count():
    """Insult and group together are toxic, either alone isn't: no additive weights can tell."""
    draw = np.random.default_rng(0)
    texts, label = [], []
    for i in range(600):
        insult, group = i % 2, i // 2 % 2
        words = prose(i, 12).split(" ") + ["insultword"] * insult + ["groupword"] * group
        draw.shuffle(words)
        texts.append(toxicity.prepared(" ".join(words)))
        label.append(insult & group)
    text, bucket, count, length = toxicity.terms(texts)
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    toxic = np.bincount(bucket[np.array(label)[text] == 1], minlength=toxicity.BUCKETS)
    chosen = toxicity.telling(toxic, np.bincount(bucket, minlength=toxicity.BUCKETS), sum(label), len(texts))
    mask = np.isin(bucket, chosen)
    rows = [(bucket[a:b][mask[a:b]], count[a:b][mask[a:b]], int(n), y) for a, b, n, y in zip(cuts, cuts[1:], length, label, strict=False)]
    machine = toxicity.train(rows, chosen)
    predicted = machine.score(texts) >= 0.5
    assert (predicted == np.array(label, dtype=bool)).mean() > 0.97
    assert np.abs(machine.factors).max() > 0.1


def test_toxicity_hard_rows_and_no_labels(spark):
    docs = hard_frame(spark)
    labels = labels_of(spark, [(i, 1, i % 2) for i in range(1, 17)] + [(None, 1, 1), (3, 0, None), (1, 1, 1), (1, 1, 0)])
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == len(hard_rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    nothing = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert all(r.score == 0 and r.predicted == 0 for r in nothing)
    assert toxicity.toxicity(empty_frame(spark), labels).count() == 0
    assert toxicity.without_toxic(docs, labels.limit(0)).count() == len(hard_rows()) and toxicity.without_toxic(docs, labels).columns == docs.columns


def test_labels_language_source_and_id_are_no_inputs(spark, documents, labels):
    machine = toxicity.fit(documents, labels)
    moved = documents.selectExpr("doc_id + 5 as doc_id", "text", "'zz' as lang", "'zz' as source", "n_chars")
    a = {r.doc_id: r.text for r in documents.limit(50).collect()}
    b = {r.doc_id - 5: r.text for r in moved.limit(50).collect()}
    assert list(machine.score([toxicity.prepared(a[i]) for i in sorted(a)])) == list(machine.score([toxicity.prepared(b[i]) for i in sorted(a)]))


def test_mixing_meets_targets(spark, documents, labels):
    model = mixing.fit(documents, labels)
    members = mixing.memberships(documents, model).cache()
    weights = {"en": 0.4, "fr": 0.3, "de": 0.2, "es": 0.1}
    rate, target, total = mixing.fitted_rates(members, model.domains, weights)
    assert np.allclose(total, target, rtol=2e-3)
    rows = members.select("tokens", "posterior", rate.alias("rate")).toPandas()
    expected = (np.stack(rows.posterior) * (rows.tokens * rows.rate).to_numpy()[:, None]).sum(0)
    assert np.allclose(expected, target, rtol=2e-3) and (rows.rate >= 0).all()
    assert np.allclose(np.stack(rows.posterior).sum(1), 1)
    named = mixing.rates(documents, labels).join(documents.select("doc_id", "lang", "n_chars"), "doc_id").where("n_chars > 100").toPandas()
    assert (named.domain == named.lang).mean() > 0.97


def plain_descent(posterior, tokens, want, least):
    """Projected gradient descent on the documents' rates, one array for each quantity."""
    have = (posterior * tokens[:, None]).sum(0)
    target = want / want.sum() * max((have / (want / want.sum()))[want > 0])
    gram = (posterior * tokens[:, None]).T @ posterior
    scale = 1 / np.diag(gram)
    pace = 1 / np.linalg.eigvalsh(np.sqrt(scale)[:, None] * gram * np.sqrt(scale))[-1]
    rate = np.full(len(tokens), max(1.0, least))
    total = (posterior * (tokens * rate)[:, None]).sum(0)
    for _ in range(mixing.STEPS):
        if np.all(np.abs(total - target) <= mixing.TOLERANCE * target):
            break
        rate = np.maximum(least, rate - posterior @ (pace * scale * (total - target)))
        before, total = total, (posterior * (tokens * rate)[:, None]).sum(0)
        if np.all(np.abs(total - before) <= 1e-6 * target):
            break
    return rate, target, total


def test_mixing_matches_plain_descent(spark):
    """The fold over steps gives what numpy gives, also where rates hit the bound."""
    draw = np.random.default_rng(3)
    posterior = draw.dirichlet([0.4, 0.4, 0.4], 200)
    tokens = draw.integers(1, 500, 200).astype(float)
    members = spark.createDataFrame([(i, i, float(t), [float(x) for x in p]) for i, (t, p) in enumerate(zip(tokens, posterior, strict=True))], "doc_id long, print long, tokens double, posterior array<double>").cache()
    for least, weights in ((0.0, {"a": 0.9, "b": 0.05, "c": 0.05}), (1.0, {"a": 0.5, "b": 0.3, "c": 0.2})):
        rate, target, total = mixing.fitted_rates(members, ["a", "b", "c"], weights, least)
        got = np.array([r.rate for r in members.select("doc_id", rate.alias("rate")).orderBy("doc_id").collect()])
        want, aim, reached = plain_descent(posterior, tokens, np.array(list(weights.values())), least)
        assert np.allclose(got, want) and np.allclose(target, aim) and np.allclose(total, reached) and got.min() >= least


def test_mixing_hard_rows(spark):
    docs = hard_frame(spark)
    labels = labels_of(spark, [(i, 1, 0) for i in range(1, 17)] + [(None, 1, 1), (1, 1, 1)])
    out = mixing.rates(docs, labels).collect()
    assert len(out) == len(hard_rows()) and all(r.rate >= 0 and r.copies >= 0 for r in out)
    assert sum(r.tokens for r in out) == sum(len((t or "").split()) for _, t in hard_rows())
    mixed = mixing.mixed(docs, labels)
    assert mixed.columns == docs.columns
    count = lambda rows: {x: sum(1 for y in rows if y == x) for x in rows}
    before, after = count([(r.doc_id, r.text) for r in docs.collect()]), count([(r.doc_id, r.text) for r in mixed.collect()])
    assert set(after) == set(before) and all(after[k] >= before[k] for k in before)
    blank = mixing.rates(docs, labels.limit(0)).collect()
    assert len(blank) == len(hard_rows()) and all(r.rate == 1 for r in blank)
    assert mixing.rates(empty_frame(spark), labels).count() == 0 and mixing.mixed(empty_frame(spark), labels).count() == 0
