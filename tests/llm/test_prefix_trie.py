"""The prefix trie of conversations against a plain one, and its query against SQL."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from sqlgauge.llm import prefix_trie, queries
from tests.conftest import DATA

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_rebuilt(rows):
    of = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            of[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in of.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return made


def plain(made):
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, of in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(of) - 1) * words
    out = []
    for node, of in members.items():
        ends = ",".join(map(str, sorted(c for c in of if len(made[c]) == len(node))))
        up = min(members[node[:-1]]) if node else None
        row = (min(of), len(node), up, len(of), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest())
        out.append(row)
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select(COLUMNS).collect()), key=str)


def random_rows(seed, n, most):
    random.seed(seed)
    rows, known = [], [[]]
    for c in random.sample(range(10 * n), n):
        turns = list(random.choice(known))[: random.randint(0, most)]
        turns += [(random.choice(["user", "assistant"]), random.choice(["a", "b b", "", "c\td\n e"])) for _ in range(random.randint(0, most // 2))]
        known.append(turns)
        rows += [(c, k, role, text) for k, (role, text) in enumerate(turns)]
    random.shuffle(rows)
    return rows


ODD = [
    (3, None, "user", "first"),
    (3, None, None, None),
    (3, 1, "user", "x"),
    (3, 1, "user", "x"),
    (3, -5, "system", "early"),
    (None, 0, "user", "of no conversation"),
    (40, 0, "user", "only"),
    (41, 7, "user", "word " * 200_000),
    (42, 7, "user", "word " * 200_000),
    (1 << 60, 0, "a", "x"),
    ((1 << 60) + 1, 0, "a", "x"),
] + [(7, k, "user", f"turn {k % 3}") for k in range(300)] + [(8, k, "user", f"turn {k % 3}") for k in range(200)]


@pytest.mark.parametrize("seed, n, most, block", [(1, 150, 14, 4), (2, 60, 9, 1)])
def test_against_a_plain_trie(stored, seed, n, most, block):
    rows = random_rows(seed, n, most) + (ODD if block == 4 else [])
    # columns whose names clash with the operator's
    table = stored([(*r, 1, "x", 2, "y") for r in rows], "conv_id long, turn long, role string, text string, block long, name string, n long, digest string")
    turns, conversations = prefix_trie.rebuilt(prefix_trie.ordered(table))
    assert found(prefix_trie.trie(turns, conversations, block)) == plain(plain_rebuilt(rows))


def test_empty_and_turnless(stored, spark):
    schema = "conv_id long, turn long, role string, text string"
    empty = prefix_trie.ordered(stored([], schema))
    assert found(prefix_trie.trie(*prefix_trie.rebuilt(empty))) == []
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in range(21, 40)}
    rows = [(c, 0, "user", "gone") for c in h if h[c]]  # their family has no first conversation
    made = plain_rebuilt(rows)
    assert not any(made.values())
    assert found(prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.ordered(stored(rows, schema))))) == plain(made)


def test_query(spark, duck):
    rows = queries.QUERIES["op11_prefix_trie"](spark, DATA)
    assert rows.columns == COLUMNS
    assert found(rows) == sorted(duck.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.ORACLES['op11_prefix_trie']})").fetchall(), key=str)
