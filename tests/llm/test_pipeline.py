"""The pipeline's stages, each against its own input, and the guard that lets the rest work without it."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

from brute import BENCH_WORD, benchmark_hits, components, hard_frame, shingles

import corpus_pipeline
from parley.llm import toxicity
from parley.llm.tables import table

SF = "/root/testdata/sf0.001"
REPO = Path(__file__).parent.parent.parent


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_one_after_the_other(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"file://{tmp_path}/{k}"
        stage(spark, docs, SF).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        old, new = rows_of(before), [(r.doc_id, getattr(r, "text", None)) for r in docs.select("doc_id", *[c for c in ("text",) if c in docs.columns]).collect()]
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.toxicity(before, table(spark, SF, "labels")).where("predicted = 1").collect()}
            assert sorted(new) == sorted(x for x in old if x[0] not in bad) and bad
        elif name == "jaccard":
            want = {i for i, n, c, _ in components(old) if i == c or not n}
            assert sorted(i for i, _ in new) == sorted(want) and len(new) < len(old)
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
            hits = {i: (n, h) for i, n, h, *_ in benchmark_hits(old, items)}
            assert sorted(i for i, _ in new) == sorted(i for i, (n, h) in hits.items() if h <= n / 2)
            for i, t in new:
                assert len(BENCH_WORD.findall(t.lower())) == hits[i][0] - hits[i][1]
                assert hits[i][1] or (i, t) in old
            assert any(h for _, h in hits.values())
        elif name == "mixing":
            assert {x for x in new} == set(old) and len(new) > len(old)
        else:
            assert sorted(r.doc_id for r in docs.collect()) == sorted(i for i, _ in old)
            assert {r.shard for r in docs.collect()} == set(range(24))
        assert docs.columns == columns or name == "sharding"


def test_run_equals_stages(spark):
    """Row by row what the stages give one after the other in memory."""
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    key = lambda r: tuple((x is None, x or 0) for x in (r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.slot))
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, docs.collect()))


def test_rest_works_without_the_subpackage(tmp_path):
    """A copy of the repository without these folders still imports and lists the other queries."""
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q), q; assert e.oracle_sql()"
    copy = tmp_path / "repo"
    subprocess.run(["cp", "-r", str(REPO), str(copy)], check=True)
    subprocess.run(["rm", "-rf", str(copy / "parley/llm"), str(copy / "corpus_pipeline.py"), str(copy / "tests/llm")], check=True)
    subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)})


def test_near_copies_from_80_percent_of_five_words_on(spark):
    """Pairs alike by 0.80 to 0.85 are copies for the stage, those below aren't."""
    word = lambda k, n: [f"w{k}x{i}" for i in range(n)]
    first = word(1, 94)
    replaced = [*first[:30], "one", *first[31:60], "two", *first[61:]]
    rows = [
        (1, " ".join(first)), (2, " ".join(replaced)), (3, " ".join(word(2, 100))), (4, " ".join(word(2, 100) + word(3, 20))),
        (5, " ".join(word(4, 100))), (6, " ".join(word(4, 100) + word(5, 26))),
    ]
    sets = [shingles(t, 5) for _, t in rows]
    alike = [round(len(a & b) / len(a | b), 3) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert alike == [0.8, 0.828, 0.787]
    kept = corpus_pipeline.without_near_copies(spark, hard_frame(spark, rows), SF)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6]
