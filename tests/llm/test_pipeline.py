"""The pipeline, stage by stage, against plain versions."""

import re
from collections import defaultdict

import corpus_pipeline
from sqlgauge.llm import simhash, work
from tests.conftest import DATA
from tests.llm.conftest import ODD
from tests.llm.test_dedup import classes, plain_text, slow_fingerprint
from tests.llm.test_texts import slow_findings


def test_stages(spark, table):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity",
        "exact_dedup",
        "simhash_near_dedup",
        "benchmark_decontamination",
        "packing",
    ]
    docs = table("documents")
    columns = docs.columns
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(work.written(stage(spark, kept[-1], DATA), name))
    assert all(d.columns == columns for d in kept[:-1])
    texts = [{r.doc_id: r.text for r in d.collect()} for d in kept[:-1]]

    first = {}
    for i in sorted(texts[1]):
        first.setdefault(plain_text(texts[1][i]), i)
    assert set(texts[2]) == set(first.values())

    ids = sorted(texts[2])
    near = classes([slow_fingerprint(texts[2][i]) for i in ids], ids)
    assert set(texts[3]) == set(near.values())

    items = [(r.item_id, r.text) for r in table("benchmark").collect()]
    vocabulary = set(re.findall(r"\w+", " ".join(t for _, t in items).lower()))
    clean = set()
    for i, text in texts[3].items():
        known = sum(w in vocabulary for w in re.findall(r"\w+", text.lower()))
        n, hit, _ = slow_findings(text, items) if known >= 13 else (1, 0, [])
        if not (hit and 20 * hit >= n):
            clean.add(i)
    assert set(texts[4]) == clean

    lengths = defaultdict(int)
    for r in kept[-1].collect():
        lengths[r.doc_id] += r.length
    assert set(lengths) == clean


def test_run_gives_the_rows_of_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, DATA)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert rows.count() > 0


def test_stages_of_odd_rows(spark, docs):
    """Null, empty and very long texts, ties, repeated rows, a row without id, clashing columns."""
    rows = docs(ODD + [(20 + i, f"plain words of row {i} stand here alone {'abcdefghij'[i] * 5}") for i in range(10)])
    kept = [rows]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(work.written(stage(spark, kept[-1], DATA), name))
    assert all(d.columns == rows.columns for d in kept[:-1])
    after = [sorted(((r.doc_id, r.text) for r in d.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")) for d in kept[:-1]]
    for before, later in zip(after, after[1:]):
        assert set(later) <= set(before)

    first = {}
    for i, text in after[1]:
        first.setdefault(plain_text(text), (i, text))
    assert after[2] == sorted(first.values(), key=lambda r: (r[0] is None, r[0] or 0))

    ids = [i for i, _ in after[2]]
    near = classes([slow_fingerprint(t) for _, t in after[2]], ids)
    assert {i for i, _ in after[3]} == set(near.values())
    assert after[4] == after[3]

    lengths, sizes = defaultdict(int), {}
    for r in kept[-1].collect():
        lengths[r.doc_id] += r.length
        sizes[r.doc_id] = r.doc_tokens
    assert lengths == sizes and set(lengths) == {i for i, _ in after[4]}


def test_stages_of_an_empty_table(spark, docs):
    rows = docs([])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, rows, DATA)
        assert found.columns == rows.columns and found.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, rows, DATA).count() == 0


def test_near_stage_does_not_broadcast_replicas(spark, docs, monkeypatch):
    plans = []
    tied = simhash.components

    def seen(links):
        plans.append(links._jdf.queryExecution().executedPlan().toString())
        return tied(links)

    monkeypatch.setattr(simhash, "components", seen)
    rows = docs([(i, f"text {i % 20} of these documents") for i in range(60)])
    assert dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, rows, "").count() <= 20
    (plan,) = plans
    assert "SortMergeJoin [anchor" in plan and "Inner, BuildRight" not in plan
