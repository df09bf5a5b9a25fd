"""Exact and near duplicates against plain versions."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import xxhash

from pyspark.sql import functions as F

from sqlgauge.llm import components, digest_runs, simhash, work
from tests.llm.conftest import ODD


def plain_text(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_row_numbers_do_not_hang_on_the_cores_alive(spark, docs):
    rows = docs([(i, f"text {i}") for i in range(3000)])
    before = spark.conf.get(work.SPLITS, None)
    try:
        spark.conf.unset(work.SPLITS)
        work.numbered(rows, "n")
        assert int(spark.conf.get(work.SPLITS)) == spark.sparkContext.defaultParallelism
        spark.conf.set(work.SPLITS, "2")
        known = work.numbered(rows, "n").select("n", "doc_id")
        assert spark.conf.get(work.SPLITS) == "2"
        assert known.join(work.numbered(rows, "n").select("n", F.col("doc_id").alias("again")), "n").where("doc_id = again").count() == 3000
    finally:
        spark.conf.set(work.SPLITS, before) if before else spark.conf.unset(work.SPLITS)


def test_exact_groups_of_odd_rows(docs):
    found = digest_runs.exact_groups(docs(ODD)).collect()
    groups = defaultdict(list)
    for i, t in ODD:
        groups[hashlib.sha256(plain_text(t).encode()).hexdigest()].append(i)
    assert len(found) == len(ODD)
    for row in found:
        ids = groups[row.digest.hex()]
        assert row.group_size == len(ids)
        assert row.keep_id == min(i for i in ids if i is not None)
    for digest in groups:
        assert sum(r.kept for r in found if r.digest.hex() == digest) == 1
    assert {r.doc_id for r in found if r.kept} == {1, 3, 4, 6, 7, 8}


def test_levels_of_the_merge_tree(docs):
    given = [(i, "hot") for i in range(900)] + [(10_000 + i, f"text {i % 40}") for i in range(400)] + ODD[:6]
    levels = [level.collect() for level in digest_runs.merge_tree(digest_runs.records(docs(given)))]
    assert len(levels) == digest_runs.ROUNDS + 1 and len(levels[0]) == len(given)
    for level, (before, after) in enumerate(zip(levels, levels[1:])):
        place = digest_runs.FAN_IN**level
        rest = lambda run: (run % place, run // (place * digest_runs.FAN_IN))  # noqa: E731, B023
        members = defaultdict(list)
        for r in before:
            members[rest(r.run), r.digest].append(r)
        # a round changes one digit, after which a digest of that family of runs is in one run, once
        assert sorted(members) == sorted((rest(r.run), r.digest) for r in after)
        for r in after:
            met = members[rest(r.run), r.digest]
            assert r.n == sum(m.n for m in met) and r.first == min(m.first for m in met)
    texts = {hashlib.sha256(plain_text(t).encode()).hexdigest() for _, t in given}
    assert sorted(r.digest.hex() for r in levels[-1]) == sorted(texts)


def test_a_round_is_one_exchange_by_run_and_one_sort_by_digest(spark, docs):
    rows = work.written(digest_runs.records(docs([(i, f"text {i % 7}") for i in range(50)])), "digests")
    plan = digest_runs.merged(rows)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(run#\d+, \d+\)", plan)) == plan.count("Exchange") == digest_runs.ROUNDS
    assert len(re.findall(r"Sort \[run#\d+ ASC NULLS FIRST, digest#\d+ ASC", plan)) == digest_runs.ROUNDS
    assert "HashAggregate" not in plan and "Python" not in plan


def test_exact_groups_without_ids_keep_one_row(docs):
    found = digest_runs.exact_groups(docs([(None, "a"), (None, "a"), (None, "b")])).collect()
    assert sorted((r.keep_id, r.group_size) for r in found) == [(None, 1), (None, 2), (None, 2)]
    assert sum(r.kept for r in found) == 2


def test_drop_exact_keeps_all_columns(docs):
    rows = docs(ODD)
    kept = digest_runs.drop_exact(rows)
    assert kept.columns == rows.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 6, 7, 8]


def test_a_hot_text_reaches_the_rounds_once_per_task(docs):
    rows = [(i, "same") for i in range(3000)] + [(i, f"t{i % 7}") for i in range(3000, 6000)]
    found = digest_runs.exact_groups(docs(rows, 8)).where("kept").collect()
    assert sorted((r.keep_id, r.group_size) for r in found)[0] == (0, 3000)
    assert len(found) == 8


def test_empty_tables(docs):
    assert digest_runs.exact_groups(docs([])).count() == 0
    assert simhash.near_groups(docs([])).count() == 0
    assert simhash.drop_near(docs([])).count() == 0


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def classes(fingerprints, ids):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fingerprints[i] ^ fingerprints[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    members = defaultdict(list)
    for i in range(len(ids)):
        members[root(i)].append(ids[i])
    return {ids[i]: min(members[root(i)]) for i in range(len(ids))}


def test_fingerprints_of_odd_texts():
    for _, text in ODD[:6] + ODD[8:]:
        assert simhash.fingerprint_of((text or "").encode()) == slow_fingerprint(text)


def test_fingerprint_of_a_long_text_is_not_cut(monkeypatch):
    text = " ".join(f"w{i}" for i in range(3000))
    monkeypatch.setattr(simhash, "_CHUNK", 100)
    assert simhash.fingerprint_of(text.encode()) == slow_fingerprint(text)
    assert simhash.fingerprint_of(b"a " + b"b" * 500) == slow_fingerprint("a " + "b" * 500)


def test_near_groups_of_odd_rows(docs):
    found = simhash.near_groups(docs(ODD)).collect()
    assert len(found) == len(ODD)
    of = {r.doc_id: r.component_id for r in found}
    assert of[1] == of[2] == of[3] == 1
    assert of[4] == of[5] == of[None] == 4
    assert {r.doc_id for r in simhash.drop_near(docs(ODD)).collect()} >= {1, 4}


def test_near_groups_of_a_table(table):
    rows = table("documents")
    listed = rows.collect()
    prints = [slow_fingerprint(r.text) for r in listed]
    wanted = classes(prints, [r.doc_id for r in listed])
    found = simhash.near_groups(rows).collect()
    assert {r.doc_id: r.fingerprint & (1 << 64) - 1 for r in found} == {r.doc_id: p for r, p in zip(listed, prints)}
    assert {r.doc_id: r.component_id for r in found} == wanted


def around(n, seed):
    """Fingerprints within a few bits of some centres, and others."""
    random.seed(seed)
    centres = [random.getrandbits(64) for _ in range(4)]
    out = set()
    while len(out) < n:
        value = random.choice(centres) if random.random() < 0.8 else random.getrandbits(64)
        for _ in range(random.randint(0, 4)):
            value ^= 1 << random.randrange(64)
        out.add(value)
    return sorted(out)


def test_links_of_calm_and_crowded_anchors(spark, stored):
    values = around(600, 3)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    table = stored(signed, "fingerprint long")
    wanted = classes(values, values)
    for dense in (0, 5, 10_000):
        rows = components.components(simhash.links(table, dense)).collect()
        of = {r.node & (1 << 64) - 1: r.root for r in rows}
        grouped = defaultdict(set)
        for v in values:
            grouped[of.get(v, v if v < 1 << 63 else v - (1 << 64))].add(v)
        expected = defaultdict(set)
        for v, c in wanted.items():
            expected[c].add(v)
        assert sorted(map(sorted, grouped.values())) == sorted(map(sorted, expected.values()))


def test_every_word_has_one_home_and_close_words_share_an_anchor():
    golay = simhash.Golay()
    words = np.arange(1 << 23, step=977, dtype=np.int64)
    index, anchors = golay.near(words, 0)
    assert np.array_equal(index, np.arange(len(words)))
    assert (np.bitwise_count((words ^ anchors).astype(np.uint64)) <= 3).all()
    random.seed(5)
    for _ in range(50):
        x = random.getrandbits(64)
        y = x ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64))
        of = [list(simhash.anchors_of(np.array([v], np.uint64).view(np.int64), golay)) for v in (x, y)]
        home = {int(a) for _, anchor, home in of[0] if home for a in anchor}
        assert home <= {int(a) for _, anchor, _ in of[1] for a in anchor}


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 2000 + i) for i in range(500)]
    odd = [(5000, 5000), (None, 3), (6001, 6000), (6000, 6001)]
    rows = components.components(spark.createDataFrame(chain + star + odd, "a long, b long")).collect()
    of = {r.node: r.root for r in rows}
    assert {of[i] for i in range(201)} == {0}
    assert {of[2000 + i] for i in range(500)} | {of[1000]} == {1000}
    assert of[6000] == of[6001] == 6000
    assert 5000 not in of
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_replicas_of_fingerprints_are_not_broadcast(spark):
    values = [0, 3, 1 << 40, -1]
    nodes = work.written(spark.createDataFrame([(v,) for v in values], "fingerprint long"), "nodes")
    found = simhash.links(nodes)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [anchor" in plan and not re.search(r"BroadcastHashJoin .*Inner", plan)
    assert {frozenset(r) for r in found.collect()} == {frozenset(p) for p in [(0, 3), (0, 1 << 40)]}
