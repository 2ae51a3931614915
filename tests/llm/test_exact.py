"""Operators with an exact contract against plain Python, on rows with every hard case."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import backoff_scores, base_quality, benchmark_hits, components, empty_frame, hard_frame, hard_rows, ordered, prose, removed_bytes, secret_spans, shingles

from parley.llm import decontaminate, hash_tables, jaccard, language_model, licenses, quality, secrets, sharding, substrings, words
from parley.llm import components as graph
from parley.llm.suffix_sort import Bytes, equal_runs, sorted_suffixes
from parley.llm.trie import Tree

ITEMS = [(1, prose(3, 40)), (2, "one TWO three"), (3, None), (None, prose(1, 14)), (22, prose(3, 40)), (4, "")]


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality_base_columns_and_verdict(spark):
    labels = labels_of(spark, [(i, 1, 0) for i in range(1, 17)] + [(None, 1, 0), (1, None, None)])
    rows = quality.quality(hard_frame(spark), labels).collect()
    assert ordered((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == ordered((i, *base_quality(t)) for i, t in hard_rows())
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) for r in rows)
    assert quality.quality(empty_frame(spark), labels).count() == 0
    assert quality.quality(hard_frame(spark), labels.limit(0)).where("not base_failed and not kept").count() == 0


def test_quality_trusts_every_good_row(spark):
    """No bound on trusted rows: before, 20,000 made the target and the threshold."""
    labels = spark.range(25_000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    assert quality.trusted_ids(labels.unionByName(labels)).count() == 25_000
    docs = spark.range(25_000).selectExpr("id as doc_id", "'one two' as text")
    assert quality._bucket_counts(quality._among(docs, quality.trusted_ids(labels))).sum() == 75_000


def test_quantiles_are_exact(spark):
    for values in ([3.0], [1.0, 1.0, 2.0], [0.0, -0.0, 5e-324, 1e-323], [-1e300, 0.0, 1e-9, 2e-9, 1e300], [random.Random(3).gauss(0, 1) for _ in range(500)]):
        rows = spark.createDataFrame([(x,) for x in values], "x double")
        for share in (0.25, 0.75):
            assert math.isclose(quality.quantile(rows, "x", len(values), share), np.quantile(values, share), rel_tol=1e-12)


def test_quality_scores_and_threshold_by_brute_force(spark):
    """Counts, ratios, means and the fence from plain dictionaries over the same hashed words and pairs."""
    docs = hard_rows() + [(i, prose(i % 7, 60) if i % 3 else prose(i, 60)) for i in range(100, 160)]
    labels = [(i, 1, 0) for i in range(100, 150)]
    got = quality.quality(hard_frame(spark, docs), labels_of(spark, labels)).collect()
    back = {r.doc_id for r in labels_of(spark, labels).where(quality.held_back()).collect()}

    def buckets(text):
        hashes, owner, _, _ = words.hashed_words([(text or "").encode()])
        return quality.features(hashes, owner)[0].tolist()

    raw, target = Counter(), Counter()
    for i, text in docs:
        raw.update(buckets(text))
        if i is not None and 100 <= i < 150 and i not in back:
            target.update(buckets(text))
    n, whole, trusted = quality.BUCKETS, sum(raw.values()), sum(target.values())

    def score(text):
        found = buckets(text)
        q = {b: (raw[b] + 1) / (whole + n) for b in found}
        return sum(math.log((target[b] + n * q[b]) / (trusted + n) / q[b]) for b in found) / max(len(found), 1)

    want = [(i, score(t)) for i, t in docs]
    held = [s for (i, t), (_, s) in zip(docs, want, strict=True) if i in back and len((t or "").split()) >= 20]
    low, high = np.quantile(held, [0.25, 0.75])
    fence = low - 3 * (high - low)
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert np.allclose([s for _, s in order((r.doc_id, r.score) for r in got)], [s for _, s in order(want)])
    assert all(r.kept == (not r.base_failed and r.score >= fence) for r in got if abs(r.score - fence) > 1e-9) and len(held) > 5


def test_secrets(spark):
    out = secrets.secrets(hard_frame(spark)).collect()
    assert ordered((r.doc_id, r.spans) for r in out) == ordered((i, secret_spans(t)) for i, t in hard_rows())
    assert sum(r.n_assign + r.n_access + r.n_hex for r in out) == sum(len(secret_spans(t).split(",")) for _, t in hard_rows() if secret_spans(t))
    assert secrets.secrets(empty_frame(spark)).count() == 0


def test_secret_ledger_scans_only_unseen_pairs(spark, tmp_path, monkeypatch):
    ledger = secrets.BlobLedger(spark, f"file://{tmp_path}/ledger")
    old = hard_frame(spark, hard_rows()[:10])
    ledger.scan(old)
    seen = ledger.ledger().count()
    assert seen == len({t or "" for _, t in hard_rows()[:10]})
    monkeypatch.setattr(secrets, "FEW_BLOBS", 0)  # the way for many fresh blobs
    ids = ledger.scan(hard_frame(spark))
    assert ledger.ledger().count() == len({t or "" for _, t in hard_rows()}) and ledger.ledger().select("blob").distinct().count() == ledger.ledger().count()
    out = secrets.findings_by_version(ids, ledger.findings())
    assert ordered((r.doc_id, r.spans) for r in out.collect()) == ordered((i, secret_spans(t)) for i, t in hard_rows())
    before = ledger.findings().count()
    ledger.scan(hard_frame(spark))
    assert ledger.findings().count() == before
    ledger.scan(old, rules="2")  # other rules: everything is unseen again
    assert ledger.ledger().where("rules = '2'").count() == seen


def test_secret_patterns_at_random(spark):
    draw = random.Random(5)
    parts = ["token", "TOKEN", "secret", "api_key", "apikey", "passwd", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGHIJ0123456789", "deadbeef", "0123456789abcdef", "é", "\n", "ſecret", "x"]
    rows = [(i, "".join(draw.choice(parts) for _ in range(draw.randint(1, 40)))) for i in range(400)]
    out = secrets.secrets(hard_frame(spark, rows)).collect()
    assert ordered((r.doc_id, r.spans) for r in out) == ordered((i, secret_spans(t)) for i, t in rows)


@pytest.mark.parametrize("chunk_bytes", [1 << 22, 2_000])
def test_backoff_scores(spark, chunk_bytes):
    out = language_model.scores(hard_frame(spark), chunk_bytes=chunk_bytes, bucket_hashes=3_000).collect()
    want = ordered(backoff_scores(hard_rows()))
    got = ordered((r.doc_id, r.n_words, r.score) for r in out)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want])
    assert language_model.scores(empty_frame(spark)).count() == 0


def near_rows(seed, groups, copies):
    draw = random.Random(seed)
    rows = []
    for g in range(groups):
        words = prose(seed * 100 + g, 60).split(" ")
        for _ in range(copies):
            changed = list(words)
            for _ in range(draw.randint(0, 4)):
                changed[draw.randrange(60)] = prose(draw.random(), 1)
            rows.append((len(rows), " ".join(changed)))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("block_sets", [400, 5])
def test_jaccard_components_and_links(spark, block_sets):
    rows = hard_rows() + [(i + 1000, t) for i, t in near_rows(9, 4, 25)]
    out = jaccard.jaccard_components(hard_frame(spark, rows), block_sets=block_sets, chunk_bytes=4_000, bucket_hashes=2_000).collect()
    assert ordered((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in out) == ordered(components(rows))
    assert sum(r.n_links > 0 for r in out) > 20


def test_jaccard_empty_and_one_of_each_group(spark):
    assert jaccard.jaccard_components(empty_frame(spark)).count() == 0
    assert jaccard.without_copies(empty_frame(spark)).count() == 0
    rows = hard_rows()
    kept = jaccard.without_copies(hard_frame(spark))
    assert kept.columns == hard_frame(spark).columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sum(not (t or "").strip() for _, t in got) == sum(not (t or "").strip() for _, t in rows)
    sets = [(i, shingles(t)) for i, t in got if (t or "").strip()]
    assert all(a is b or 100 * len(a[1] & b[1]) < 85 * len(a[1] | b[1]) for a in sets for b in sets)
    # Every row is kept or linked with one that is, of no larger doc_id.
    for i, t in rows:
        s = shingles(t)
        if s:
            assert any(100 * len(s & k) >= 85 * len(s | k) and (i is None or (j is not None and j <= i)) for j, k in sets)


def test_tree_finds_what_pairs_find():
    draw = random.Random(2)
    sets = [np.array(sorted(draw.sample(range(60), draw.randint(1, 30)))) for _ in range(120)]
    sets += [np.array(sorted(set(s.tolist()) ^ {draw.randrange(60)})) for s in sets[:60]]
    sets = [s for s in sets if len(s)]
    sizes = np.array([len(s) + draw.randint(0, 2) for s in sets])
    tree = Tree(sets, sizes)
    member = np.zeros(60, dtype=np.int64)
    for i, s in enumerate(sets):
        member[s] = 1
        both = [len(np.intersect1d(s, t)) for t in sets]
        want = [j for j, b in enumerate(both) if 100 * b >= 85 * (sizes[i] + sizes[j] - b)]
        assert sorted(tree.linked(s, int(sizes[i]), 85, member)) == want
        member[s] = 0


def test_components_of_paths_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    out = graph.components(spark.createDataFrame(links, "a long, b long"))
    label = {r.node: r.label for r in out.collect()}
    assert all(label[i] == 0 for i in range(41)) and all(label[100 + i] == 100 for i in range(60)) and {label[200], label[201], label[202]} == {200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sharding_by_brute_force_and_a_map_opened_again(spark, tmp_path):
    """Places follow from the stored map and each slot's rows; the next version moves few slots."""
    rows = hard_rows() + [(i, prose(i, i % 90)) for i in range(100, 500)]
    folder = f"file://{tmp_path}/map"
    out = sharding.shard(hard_frame(spark, rows), shards=6, slots=64, folder=folder).collect()
    maps = sharding.SlotMaps(spark, folder)
    version, shard_of = maps.latest()
    size_of, rows_of = {}, {}
    for r in out:
        size_of[r.virtual_slot] = size_of.get(r.virtual_slot, 0) + r["size"]
        rows_of.setdefault(r.virtual_slot, []).append((r.doc_id is not None, r.doc_id or 0, r.text_crc32, r["size"]))
    assert version == 1 and shard_of == sharding.rebalanced(sharding.first_map(6, 64), size_of, 6)
    want = []
    for shard in range(6):
        ranked = [row for slot in range(64) if shard_of[slot] == shard for row in sorted(rows_of.get(slot, []))]
        want += [(shard, place, *row) for place, row in enumerate(ranked)]
    assert sorted((r.shard, r.slot, r.doc_id is not None, r.doc_id or 0, r.text_crc32, r["size"]) for r in out) == sorted(want)
    more = sharding.shard(hard_frame(spark, [*rows, *[(i, prose(i, 20)) for i in range(600, 640)]]), shards=6, slots=64, folder=folder).collect()
    version, after = maps.latest()
    assert version == 2 and sum(a != b for a, b in zip(shard_of, after, strict=True)) < 16 and len(more) == len(rows) + 40
    grown = sharding.rebalanced(after, {s: 1 for s in range(64)}, 7)
    assert {grown[s] for s in range(64) if grown[s] != after[s]} <= set(range(7)) and 6 in grown


def test_texts_of_megabytes(spark):
    """Two texts of over two million characters that differ at their end, and a short one."""
    long = prose(8, 300_000)
    rows = [(1, long), (2, long + " and more"), (3, "short"), (None, None)]
    docs = hard_frame(spark, rows)
    n = len(long.split(" "))
    got = {r.doc_id: r for r in quality.quality(docs, labels_of(spark, [(1, 1, 0)])).collect()}
    assert (got[1].n_words, got[2].n_words, got[1].word_chars) == (n, n + 2, len(long) - n + 1)
    got = {r.doc_id: r for r in language_model.scores(docs).collect()}
    assert (got[1].n_words, got[1].n_backoffs, got[2].n_words) == (n, 0, n + 2) and got[2].n_backoffs > 0
    got = {r.doc_id: r for r in jaccard.jaccard_components(docs).collect()}
    assert (got[1].component_id, got[2].component_id, got[3].component_id, got[1].n_links) == (1, 1, 3, 1)
    passage = " ".join(long.split(" ")[200_000:200_040])
    got = {r.doc_id: r for r in decontaminate.decontamination(docs, spark.createDataFrame([(7, passage)], "item_id long, text string")).collect()}
    assert got[1].n_hit >= 40 and got[1].n_items == 1 and got[3].n_hit == 0
    assert len(licenses.licenses(docs).collect()) == 4


def test_sharding_is_even_gapless_and_stable(spark):
    rows = hard_rows() + [(i, prose(i, i % 90)) for i in range(100, 600)]
    out = sharding.shard(hard_frame(spark, rows)).collect()
    assert ordered((r.doc_id, r["size"], r.text_crc32) for r in out) == ordered((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    by_shard = {}
    for r in out:
        by_shard.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by_shard.values())
    sizes = [sum(r["size"] for r in by_shard.get(k, [])) for k in range(24)]
    largest = max(len((t or "").encode()) for _, t in rows) + 8
    assert max(sizes) - min(sizes) <= largest
    assert sharding.shard(empty_frame(spark)).count() == 0


def test_rebalancing_moves_little_and_fills_new_shards():
    sizes = {s: 100 + s % 7 for s in range(4096)}
    one = sharding.rebalanced(sharding.first_map(24), sizes, 24)
    two = sharding.rebalanced(one, sizes, 25)
    moved = [s for s in range(4096) if one[s] != two[s]]
    assert len(moved) < 4096 / 25 * 1.5 and sum(two[s] == 24 for s in moved) > len(moved) * 0.7
    load = [sum(sizes[s] for s in range(4096) if two[s] == k) for k in range(25)]
    assert max(load) - min(load) <= max(sizes.values())


@pytest.mark.parametrize("block_words", [200_000, 20])
def test_decontamination(spark, block_words):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 as runs")
    hit = decontaminate.hits(hard_frame(spark), benchmark, block_words=block_words)
    out = decontaminate.report(hit).collect()
    assert ordered(tuple(r) for r in out) == ordered(benchmark_hits(hard_rows(), ITEMS))
    assert sum(r.contaminated for r in out) >= 5
    none = decontaminate.report(decontaminate.hits(hard_frame(spark), benchmark.limit(0))).collect()
    assert not any(r.contaminated for r in none) and len(none) == len(hard_rows())
    assert decontaminate.decontamination(empty_frame(spark), benchmark).count() == 0


def test_cleaned_texts_lose_their_spans_only(spark):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = hard_frame(spark)
    out = decontaminate.cleaned(docs, benchmark)
    assert out.columns == docs.columns
    assert not any(r.contaminated for r in decontaminate.decontamination(out, benchmark).collect())
    texts = [(r.doc_id, r.text) for r in out.collect()]
    dirty = {i: (h, n) for i, n, h, *_ in benchmark_hits(hard_rows(), ITEMS)}
    assert all((i, t) in texts for i, t in hard_rows() if i is not None and i not in (4, 12) and dirty[i][0] == 0)
    assert all(r.n_chars == len(r.text) for r in out.where("text is not null").collect())


def ruled(seed, texts, rules):
    """Few texts with very many contexts of one piece, some of them shared."""
    draw = random.Random(seed)
    shared = [prose(1_000 + k, 8) for k in range(5)]
    return [(i, "".join("-" * 30 + (draw.choice(shared) if draw.random() < 0.2 else prose(seed * 10_000 + i * rules + k, 6)) for k in range(rules))) for i in range(texts)]


@pytest.mark.parametrize("hot_contexts", [40, 12_000])
def test_an_anchor_of_many_contexts_in_few_texts(spark, hot_contexts):
    rows = ruled(3, 8, 60)
    out = substrings.removed(hard_frame(spark, rows), chunk_bytes=8_000, bucket_hashes=2_000, bucket_contexts=500, hot_contexts=hot_contexts).collect()
    assert ordered((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == ordered(removed_bytes(rows))


def test_contexts_of_anchors_are_counted():
    texts = [t.encode() for _, t in ruled(5, 4, 50)] + [b"", b"short", (prose(1, 300) + "-" * 200).encode() * 2]
    chunk = substrings.Chunk(texts)
    grams, place = substrings.anchors(chunk)
    rows = np.empty((len(place), substrings.ROW), dtype=np.uint8)
    substrings.fill_contexts(rows, chunk, place)
    contexts = {}
    for gram, row, text in zip(grams.tolist(), rows, chunk.owner(place).tolist(), strict=True):
        contexts.setdefault(gram, ([], []))[0].append(row.tobytes())
        contexts[gram][1].append(text)
    want = {gram: max(len(set(rows)), min(len(set(owners)), 2)) for gram, (rows, owners) in contexts.items()}
    hashes, counts = substrings._asked(grams, chunk.owner(place), substrings.context_hashes(chunk, place))
    assert dict(zip(hashes.tolist(), counts.tolist(), strict=True)) == want and max(want.values()) > 20


@pytest.mark.parametrize(("chunk_bytes", "hot_contexts"), [(1 << 22, 12_000), (3_000, 12_000), (3_000, 3)])
def test_substring_dedup(spark, chunk_bytes, hot_contexts):
    rule = "-" * 60
    rows = hard_rows() + [(i + 1000, t) for i, t in near_rows(4, 3, 12)] + [(2000 + i, prose(i, 9) + rule + prose(-i, 9)) for i in range(30)]
    out = substrings.removed(hard_frame(spark, rows), chunk_bytes=chunk_bytes, bucket_hashes=2_000, bucket_contexts=500, hot_contexts=hot_contexts).collect()
    assert ordered(tuple(r) for r in out) == ordered(removed_bytes(rows))
    assert substrings.removed(empty_frame(spark)).count() == 0


def test_substring_dedup_of_a_text_of_megabytes(spark):
    long = prose(8, 300_000)
    rows = [(1, long), (2, "intro<" + long[500_000:1_500_000] + ">outro"), (3, long[:60])]
    out = {r.doc_id: r for r in substrings.removed(hard_frame(spark, rows, extra=False)).collect()}
    assert (out[1].n_bytes, out[1].n_removed) == (len(long.encode()), 0)
    assert (out[2].n_spans, out[2].n_bytes - out[2].n_removed) == (1, len("intro<>outro"))
    assert out[3].n_removed == out[3].n_bytes


def test_anchors_do_not_depend_on_slices(monkeypatch):
    texts = [prose(1, 900).encode(), b"-" * 700, b"", prose(2, 3).encode(), (prose(3, 40) * 3).encode()]
    chunk = substrings.Chunk(texts)
    whole = substrings.anchors(chunk)
    monkeypatch.setattr(substrings, "SLICE", 256)
    assert all(np.array_equal(a, b) for a, b in zip(substrings.anchors(chunk), whole, strict=True))
    rows = np.empty((len(whole[1]), substrings.ROW), dtype=np.uint8)
    substrings.fill_contexts(rows, chunk, whole[1])
    for row, at in zip(rows, whole[1].tolist(), strict=True):
        text = int(chunk.owner(np.array([at]))[0])
        start, before, after = at - int(chunk.starts[text]), int(row[-2]), int(row[-1])
        assert row[substrings.BEFORE - before : substrings.BEFORE + after].tobytes() == texts[text][start - before : start + after]


def test_suffixes_sort_like_bytes_also_when_hashes_collide(monkeypatch):
    draw = np.random.default_rng(1)
    data = draw.integers(97, 99, 4_000).astype(np.uint8)
    text = Bytes(np.concatenate([data, np.zeros(64, np.uint8)]))
    starts = draw.integers(0, 3_900, 700)
    group = np.sort(draw.integers(0, 5, 700))
    order = sorted_suffixes(text, starts, group, 20)
    keys = [(g, text.data[s : s + 20].tobytes()) for g, s in zip(group, starts, strict=True)]
    assert [keys[i] for i in order] == sorted(keys)
    monkeypatch.setattr(Bytes, "hashes", lambda self, start, length: np.zeros(len(start), dtype=np.uint64))
    order, new = equal_runs(text, starts, group, 20)
    assert [keys[i] for i in order] == sorted(keys) and new.sum() == len(set(keys))


def test_packed_blocks_round_trip():
    draw = np.random.default_rng(0)
    for n in (1, 2, 3, 1000):
        for top in (10, 1 << 20, 1 << 63):
            hashes = np.unique(draw.integers(0, top, n, dtype=np.uint64))
            assert np.array_equal(hash_tables.unpack(hash_tables.pack(hashes)), hashes)
            counts = draw.integers(0, 1 << 40, n)
            assert np.array_equal(hash_tables.unpack_counts(hash_tables.pack_counts(counts)), counts)


def test_licenses(spark):
    rows = [
        (1, "intro\nReleased under the MIT License.\nmore"), (2, "Licensed under the Apache License, Version 2.0.\nThis work is licensed under the GNU General Public License, version 3."),
        (3, None), (4, ""), (5, "a driver's licence is needed to drive"), (5, "a driver's licence is needed to drive"), (6, "This work is licensed under the GNU Lesser General Public License, version 3."), (7, "Licensed under CC BY-NC 4.0."),
        (8, "x " * 5_000 + "\nlicensed under the   apache license, version 2.0"), (9, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software\nand associated documentation files, to deal in the Software without restriction."),
    ]
    out = {r.doc_id: r for r in licenses.licenses(hard_frame(spark, rows)).collect()}
    assert {i: out[i].licenses for i in out} == {1: "MIT", 2: "Apache-2.0,GPL-3.0", 3: "", 4: "", 5: "", 6: "LGPL-3.0", 7: "CC-BY-NC-4.0", 8: "Apache-2.0", 9: "MIT-grant"}
    assert out[1].spans == "MIT:6:36" and out[1].n_exact == 1
    assert licenses.licenses(empty_frame(spark)).count() == 0


def test_license_ranking_prefers_the_template_that_saves_most():
    scanner = licenses.Scanner()
    for name, text in licenses.TEMPLATES.items():
        ranking = scanner.ranking(text)
        assert dict((n, share) for share, n in ranking)[name] >= ranking[0][0] - 0.05  # templates that hold this one save about as much
        assert [(f.license, f.changed) for f in scanner.scan(text)[1]] == [(name, 0)]


def test_license_notice_inside_a_long_line():
    """Neither what else stands in the line nor its length hides a notice, whole or with a tenth of its words changed."""
    scanner = licenses.Scanner()
    before, after = "the user may read under the line of this work " * 40, " and the rest of the version is in the same line" * 40
    for name, text in licenses.TEMPLATES.items():
        for around in (60, 200, 1_000):
            block = before[-around:] + text + after[:around]
            found = [f for f in scanner.scan(block)[1] if f.license == name]
            assert [(block[f.start : f.end], f.changed) for f in found] == [(re.sub(r"\W+$", "", text), 0)], (name, around)
        words = text.split(" ")
        able = [i for i in range(4, len(words), 7) if not re.search(r"\d", words[i])][: len(scanner.words[name]) // 12]
        if able:
            changed = " ".join("changedword" if i in able else w for i, w in enumerate(words))
            got = scanner.scan(before[-1_000:] + changed + after[:1_000])[1]
            # a license of its own that is left unchanged inside counts where the rest has too many changes
            assert [f.license for f in got] in ([name], ["Apache-2.0"]), name
    assert {f.license for f in scanner.scan("x " + licenses.TEMPLATES["GPL-3.0-header-short"].replace("version 3", "version 9"))[1]} == set()
    assert [f.license for f in scanner.scan("Code is released under MIT. SPDX-License-Identifier: MIT")[1]] == ["MIT-short", "SPDX-MIT"]
    every = before + (after + " ").join(licenses.TEMPLATES.values()) + after
    assert {f.license for f in scanner.scan(every)[1]} == set(licenses.TEMPLATES)
    assert len(scanner.scan(" ".join(["Released under the MIT License."] * 300))[1]) == 300


def test_bundles_spread_rows_of_one_doc_id(spark):
    rows = [(i, prose(k, 20)) for i in (None, 7) for k in range(200)]
    out = hash_tables.bundles(hard_frame(spark, rows, extra=False), 8).toPandas()
    held = out.groupby("chunk")["body"].apply(lambda bodies: len(hash_tables.unbundled(bodies)[1]))
    assert len(held) == 8 and held.max() < 100 and held.sum() == 400
