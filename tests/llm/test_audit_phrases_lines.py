"""Filter audit, phrase mining and line dedup against plain Python, on rows with every hard case."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import WORD, empty_frame, hard_frame, hard_rows, low, ordered, prose

from parley.llm import filter_audit, line_dedup, phrases

LAST = 1 << 62


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").selectExpr("*", "'x' as text", "'x' as mask")


def audited(rows, labels):
    """rows: doc_id, text, lang; the audit by applying every order to every document."""
    first = {}
    for i, text, _ in rows:
        first[text or ""] = min(first.get(text or "", LAST), LAST if i is None else i)
    fails = []
    for i, text, lang in rows:
        text = text or ""
        words = WORD.findall(text)
        own = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": (LAST if i is None else i) > first[text],
        }
        said = [x for x in labels if i is not None and x[0] == i]
        fails.append((lang or "", {k for k, v in own.items() if v}, any(q == 1 for _, q, _ in said), any(t == 1 for _, _, t in said)))
    out = {}
    for part in {f[0] for f in fails}:
        total = Counter()
        for order in itertools.permutations("ABCDE"):
            left = [f for f in fails if f[0] == part]
            for step, name in enumerate(order, 1):
                gone, left_now = [f for f in left if name in f[1]], [f for f in left if name not in f[1]]
                total[name] += len(gone)
                before = set(order[: step - 1])
                redundant = sum(f[0] == part and name in f[1] and bool(before & f[1]) for f in fails)
                out[part, "".join(order), step] = [len(left_now), len(gone), redundant, sum(f[0] == part and f[1] == {name} for f in fails), sum(f[2] for f in gone), sum(f[3] for f in gone)]
                left = left_now
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def test_filter_audit_never_broadcasts_labels(spark):
    """Spark's estimate of the salted labels lacks the salts, so it would broadcast them from an input of some GB on."""
    met = filter_audit._labelled(hard_frame(spark), labels_of(spark, [(i, 1, 0) for i in range(1, 17)]))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_filter_audit(spark):
    shout = "WORD other " * 110
    texts = hard_rows() + [(20, shout), (21, shout), (21, shout), (None, shout), (22, prose(8, 300)), (None, prose(9, 250)), (None, prose(9, 250)), (23, "x # y"), (1, shout), (24, "É" * 97 + "ABC"), (25, "É" * 96 + "ABCD")]
    docs = hard_frame(spark, texts)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    labels = [(1, 1, 0), (1, 0, 1), (5, 1, None), (20, 1, 1), (21, 0, 1), (22, 1, 0), (None, 1, 1), (99, 1, 1), (7, None, None)]
    got = filter_audit.audit(docs, labels_of(spark, labels)).collect()
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got} == audited(rows, labels)
    assert len(got) == 3 * 600 and filter_audit.audit(empty_frame(spark), labels_of(spark, labels)).count() == 0
    assert sum(r.good_lost + r.toxic_lost for r in filter_audit.audit(docs, labels_of(spark, labels).limit(0)).collect()) == 0


def test_filter_audit_of_one_text_under_very_many_ids(spark):
    docs = spark.range(40_000).selectExpr("if(id % 3 = 0, null, id) as doc_id", "'copy' as text", "if(id % 2 = 0, 'en', null) as lang")
    rows = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(docs, labels_of(spark, [(1, 1, 1), (2, 1, 0)])).collect()}
    assert rows["en", "EABCD", 1].removed + rows["", "EABCD", 1].removed == 39_999
    assert rows["en", "EABCD", 1].good_lost == 1 and rows["", "EABCD", 1].kept == 1


def mined(rows, least=100, top=2_000):
    pieces = defaultdict(list)
    for text, lang in rows:
        pieces[lang or "und"] += [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low(text))]
    out = []
    for lang, lists in pieces.items():
        n = sum(map(len, lists))
        f = Counter(tuple(ws[i : i + m]) for ws in lists for m in range(1, 6) for i in range(len(ws) - m + 1))
        found = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        inside = {g[i : i + m] for g, a in found.items() for m in range(2, len(g)) for i in range(len(g) - m + 1) if 100 * a >= 100 * f[g[i : i + m]]}
        rows_ = []
        for g, a in found.items():
            if g not in inside:
                score, k = min((1000 * a * n // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
                rows_.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(rows_)[:top])]
    return sorted(out)


def spoken(seed, n):
    draw = random.Random(seed)
    words = ["The", "cat", "SAT", "on", "mat", "é\x01", "a", "a\x0bb", "New", "York", "city", "z" * 40, "rare%d"]
    rows = []
    for i in range(n):
        said = " ".join((draw.choice(words[:6]) if draw.random() < 0.7 else draw.choice(words)) + draw.choice([*[""] * 7, ".", ",", "\n", "\t"]) for _ in range(draw.randint(0, 40)))
        rows.append((said.replace("rare%d", f"rare{i}") + (" new York city hall" if i % 3 == 0 else ""), draw.choice(["en", "fr", None, "und"])))
    return rows


@pytest.mark.parametrize("range_keys", [1_500_000, 700])
def test_phrases(spark, monkeypatch, range_keys):
    monkeypatch.setattr(phrases, "RANGE_KEYS", range_keys)
    rows = spoken(1, 3_000) + [(None, "en"), ("", "fr"), ("  \t . ,,", None), ("x y. " * 3_000, "de"), ("only here", "it")]
    docs = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "cast(null as long) as doc_id", "'x' as chunk", "'x' as words", "'x' as n", "1 as key", "1 as id")
    got = phrases.collocations(docs).collect()
    want = mined(rows)
    assert sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == want and len(want) > 50
    assert {r.lang for r in got} == {"en", "fr", "und", "de"}


def test_phrases_rank_by_count_and_bytes_where_scores_tie(spark):
    rows = [("b é. b a. B \x01.", "en")] * 120 + [("y z.", "en")] * 150
    got = phrases.collocations(spark.createDataFrame(rows, "text string, lang string"), top=3).orderBy("rank").collect()
    assert [(r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got] == mined(rows, top=3)
    assert phrases.collocations(empty_frame(spark)).count() == 0


def test_phrase_counts_over_ranges(spark):
    """However sorted keys are cut into ranges, told prefixes add up to the counts of all frequent sequences."""
    draw = np.random.default_rng(3)
    for width in (1, 3):
        ids = np.where(draw.random(20_000) < 0.1, 0, draw.geometric(0.3, 20_000)).astype(np.uint32)
        keys = phrases.packed(ids, width)
        keys, counts = phrases._added_up(keys, np.ones(len(keys), dtype=np.int64))
        assert [k.tobytes() for k in keys] == sorted({k.tobytes() for k in keys})
        cuts = sorted({0, len(keys), *draw.integers(0, len(keys), 30).tolist()})
        total = Counter()
        for a, b in itertools.pairwise(cuts):
            for key, f in phrases.prefix_counts(keys[a:b], counts[a:b], width, 50):
                total[key] += f
        runs = [list(g) for k, g in itertools.groupby(ids.tolist(), lambda x: x != 0) if k]
        want = Counter(b"".join(x.to_bytes(width, "big") for x in run[i : i + m]) for run in runs for m in range(2, 6) for i in range(len(run) - m + 1))
        assert {k: f for k, f in total.items() if f >= 50} == {k: f for k, f in want.items() if f >= 50}


def test_a_long_text_is_cut_into_words_by_slices(monkeypatch):
    text = prose(5, 3_000).replace("an", ". ").encode()
    whole, sliced = phrases.Chunk(), phrases.Chunk()
    whole.add(text)
    monkeypatch.setattr(phrases, "SLICE", 13)
    sliced.add(text)
    a, b = whole.row("en"), sliced.row("en")
    assert all(a[k] == b[k] for k in ("words", "counts", "n")) and np.array_equal(phrases._unzip(a["places"], "<u4"), phrases._unzip(b["places"], "<u4"))


def deduplicated(rows):
    blank = " \t\n\x0b\x0c\r"
    first = {}
    keys = [[low(line.strip(blank)) for line in (t or "").split("\n")] for _, t in rows]
    for (i, _), own in zip(rows, keys, strict=True):
        for key in own:
            first[key] = min(first.get(key, LAST), LAST if i is None else i)
    out = []
    for (i, t), own in zip(rows, keys, strict=True):
        lines = (t or "").split("\n")
        kept = [line for line, key in zip(lines, own, strict=True) if len(key) < 10 or first[key] == (LAST if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def lined(seed, n):
    draw = random.Random(seed)
    pool = [prose(k, 3) for k in range(40)] + ["ééééééééé", "éééééééééé", "  Shared LINE of all\t", "shared line of all", "ten chars!", "nine char"]
    rows = [(draw.choice([None, *range(60)]), "\n".join(["Shared line of ALL\r"] + [draw.choice(pool) for _ in range(draw.randint(0, 9))])) for _ in range(n)]
    return rows + rows[:20]


def test_line_dedup(spark):
    rows = hard_rows() + lined(4, 300) + [(70, "\n" * 50_000 + "a very long text\n" * 5_000), (71, "a very long text\n" * 20 + "\n"), (None, "null has it last\n"), (72, "NULL has it last")]
    got = line_dedup.line_digests(hard_frame(spark, rows)).collect()
    assert ordered((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == ordered(deduplicated(rows))
    assert line_dedup.line_digests(empty_frame(spark)).count() == 0


def test_line_dedup_keeps_other_columns(spark):
    docs = hard_frame(spark, hard_rows() + lined(5, 60)).selectExpr("*", "'x' as data", "'x' as keep", "'x' as content", "'x' as id", "'x' as n_dropped")
    out = line_dedup.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("text is null").count() == docs.where("text is null").count()
    texts = ordered((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in out.collect())
    assert texts == ordered((i, h) for i, _, _, h in deduplicated([(r.doc_id, r.text) for r in docs.collect()]))


def test_a_line_of_all_documents_fills_several_ranges(spark):
    rows = [(i, f"the line that is everywhere\nmine alone: {i:06d}") for i in range(4_000)] + [(None, "the line that is everywhere")] * 500
    got = line_dedup.line_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert ordered((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == ordered(deduplicated(rows))


def test_ranges_agree_on_first_documents_wherever_they_are_cut():
    import pyarrow as pa

    draw = random.Random(2)
    rows = sorted((draw.randint(0, 6), draw.randint(0, 2), draw.randint(0, 9)) for _ in range(400))
    first = {}
    for h, l, i in rows:
        first.setdefault((h, l), i)
    for _ in range(40):
        cuts = sorted(draw.randint(0, 400) for _ in range(draw.randint(0, 7)))
        told = []
        for a, b in zip([0, *cuts], [*cuts, 400], strict=True):
            sizes = [x for x in range(a, b, draw.randint(1, 30))]
            batches = [rows[x:y] for x, y in zip(sizes, [*sizes[1:], b], strict=True)]
            frames = [pa.record_batch([pa.array([r[0] for r in p]), pa.array([r[1] for r in p]), pa.array([r[2] for r in p]), pa.array([b""] * len(p)), pa.array([1] * len(p), pa.int32()), pa.array([[0]] * len(p), pa.list_(pa.int32()))], schema=line_dedup._LINES) for p in batches]
            told += [tuple(r.values()) for batch in line_dedup._told(iter(frames)) for r in batch.to_pylist()]
        least = {}
        for h, l, i, *_, kind in told:
            if kind == line_dedup.EDGE:
                least[h, l] = min(least.get((h, l), LAST), i)
        gone = [(h, l, i) for h, l, i, *_, kind in told if kind == line_dedup.DROPPED or kind == line_dedup.OPEN and least[h, l] < i]
        assert sorted(gone) == [r for r in rows if first[r[:2]] < r[2]]
