"""Phrase collocations against a plain count, and count transducers against dictionaries."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sqlgauge.llm import collocations, transducers
from tests.llm.conftest import ODD, SCHEMA


def built(counts):
    words = pa.array(sorted({w for p in counts for w in p}), pa.large_binary())
    words, _ = transducers.sorted_words(words)
    code = {w: i for i, w in enumerate(words.to_pylist())}
    phrases = []
    for k in (1, 2, 3):
        some = [p for p in counts if len(p) == k]
        codes = np.array([[code[w] for w in p] for p in some], np.int64).reshape(-1, k)
        phrases.append(transducers.summed(codes, np.array([counts[p] for p in some], np.int64), len(words)))
    return transducers.build(words, phrases)


def listed(words, phrases):
    return {tuple(t.split(b" ")): int(n) for p in phrases for t, n in zip(transducers.texts(words, p).to_pylist(), p.counts)}


def test_transducers():
    random.seed(6)
    for _ in range(150):
        some = [b"a", b"ab", b"a\x01", b"b", b"zz", b"\xc3\xa9"][: random.randint(1, 6)]
        given = [Counter(tuple(random.choices(some, k=random.randint(1, 3))) for _ in range(random.randint(0, 30))) for _ in range(3)]
        parts = [built(c) for c in given]
        for part, counts in zip(parts, given):
            again = transducers.unpacked(part.packed())
            assert listed(again.words, again.paths()) == dict(counts)
        words, phrases = transducers.union(parts)
        total = sum(given, Counter())
        assert listed(words, phrases) == dict(total)
        every = transducers.build(words, phrases)
        assert listed(parts[0].words, every.compose(parts[0])) == {p: total[p] for p in given[0]}
        assert listed(every.words, parts[0].compose(every)) == dict(given[0])


def test_equal_states_are_one():
    part = built({(a, b, c): 2 for a in (b"a", b"b") for b in (b"c", b"d") for c in (b"x", b"y")})
    assert len(part.firsts) - 1 == 3 and part.size == 6


def test_runs_and_limits_divide_the_sorted_phrases():
    shard = collocations.counted([b"the cat sat. the cat ran the\tdog,a\x01b a a\x01 a", b"A the cat"])
    whole = listed(shard.words, shard.phrases)
    assert whole[(b"the", b"cat")] == 3 and whole[(b"a",)] == 3 and (b"ran", b"the", b"dog") in whole and (b"dog", b"a\x01b") not in whole
    order = sorted(b" ".join(p) + b" " for p in whole)
    at = 0
    for first, last, n, part in collocations.runs(shard.words, shard.phrases, 4):
        held = listed(part.words, part.paths())
        assert sorted(b" ".join(p) + b" " for p in held) == order[at : at + n]
        assert (first + b" ", last + b" ") == (order[at], order[at + n - 1])
        at += n
        limits = [collocations.key_of("en", x) for x in (b"a", b"cat", b"the c")]
        for i, some in collocations.divided(part, "en", limits):
            for phrase in listed(some.words, some.paths()):
                assert i == sum(limit <= collocations.key_of("en", b" ".join(phrase)) for limit in limits)
    assert at == len(order)


def plain(rows, least=10, share=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in candidates.items():
            if len(p) == 3:
                for q in (p[:2], p[1:]):
                    around[q] = max(around[q], a)
        kept = []
        for p, a in candidates.items():
            if len(p) == 3 or 100 * around[p] < share * a:
                score, _, l, r = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.collect()))


SMALL = {"shard_bytes": 3000, "run": 50, "per_range": 700, "per_task": 40}


@pytest.mark.parametrize("sizes", [{}, SMALL])
def test_against_a_plain_count(stored, sizes):
    random.seed(7)
    words = ["the", "The", "of", "cat", "Ä", "ä", "x\x01", "x", "und", " ", "日本"] + [f"w{i}" for i in range(30)]
    rows = []
    for i in range(300):
        text = "".join(random.choice(words[: random.choice([4, 11, 41])]) + random.choice([" "] * 9 + ["\t", ". ", "\n", ",", "  "]) for _ in range(60))
        rows.append((i, text, random.choice(["en", "en", "fr", None, "und"]), "s", 0))
    rows += [(None, "of the cat " * 30, "en", None, None)] * 2 + [(1, None, "de", "s", 0), (2, "", "de", "s", 0)]
    table = stored(rows, SCHEMA, 4)
    for options in ({}, {"least": 3, "share": 80, "top": 40}):
        wanted = plain([(lang, text) for _, text, lang, _, _ in rows], **options)
        assert wanted and found(collocations.collocations(table, **options, **sizes)) == wanted


def test_odd_rows_and_long_texts(docs):
    given = [(i, t) for i, t in ODD if i != 6] + [(6, "word " * 40_000), (11, "a b. " * 20_000)]
    assert found(collocations.collocations(docs(given), **SMALL)) == plain([("en", t) for _, t in given])
    assert found(collocations.collocations(docs([]))) == []
    assert found(collocations.collocations(docs([(1, None), (2, "a b")]))) == []


def test_counts_beyond_64_bits(spark):
    rows = [("en", b"a b", 9 * 10**14, role, 9 * 10**14 + role) for role in (0, 1)]
    table = spark.createDataFrame(rows, "lang string, phrase binary, a long, role int, f long")
    a, l, r = 9 * 10**14, 9 * 10**14, 9 * 10**14 + 1
    assert found(collocations.scored(table).select("score", "l", "r")) == [(10**6 * a * a // (l * r), l, r)]
