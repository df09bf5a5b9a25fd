"""Byte-level BPE against the tiktoken library, and decoding."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from sqlgauge.llm import byte_bpe, queries
from tests.conftest import DATA
from tests.llm.conftest import ODD

PARTS = [" ", "  ", "\n", "\t", "\r\n", "a", "The", "é", "ß", "'s", "'ll", "'", "'re", " 's", "''s", "'S", "r", "e", "s", "t", ".", ","]
PARTS += ["!", "1", "23", "²", " ", "　", "日本", "😀", "\x1c", "\x85", "\x00", "́", "-", "…", "'v", "'ve", "<|endoftext|>"]


@pytest.fixture(scope="module")
def plain():
    ranks = byte_bpe.read_ranks(byte_bpe.default_path())
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(byte_bpe.default_path(), byte_bpe.code_point_classes())


def odd_texts():
    random.seed(3)
    points = [c for c in range(byte_bpe._BEYOND) if not 0xD800 <= c < 0xE000]
    texts = ["".join(random.choices(PARTS, k=random.randint(0, 25))) for _ in range(4000)]
    texts += ["".join(map(chr, random.choices(points, k=2000))) for _ in range(20)]
    texts += ["ab" * random.randint(60, 300) for _ in range(10)] + ["x" * 3000, "", " ", "  ", "\n", " a", "a ", "a  ", "\n\n b"]
    return texts + ["".join(random.choices("abcdeéf日", k=random.randint(100, 600))) for _ in range(100)]


@pytest.mark.parametrize("width", [1, 5, 64])
def test_ids_are_those_of_the_library(codec, plain, monkeypatch, width):
    monkeypatch.setattr(byte_bpe.token_starts, "__defaults__", (width,))
    texts = odd_texts()
    for some in (texts, texts[::-7], [""], [], ["", ""]):
        found = list(codec.encode([t.encode() for t in some]))
        assert [ids.tolist() for ids, _ in found] == [plain(t) for t in some]
        assert [codec.decode(ids, at) for ids, at in found] == [t.encode() for t in some]


def test_both_ways_to_merge_agree(monkeypatch):
    random.seed(4)
    ranks = byte_bpe.read_ranks(byte_bpe.default_path())
    pairs = byte_bpe.Pairs(ranks)
    pieces = list({bytes(random.choices(b"abetoinx\xc3\xa9", k=random.randint(1, 40))) for _ in range(2000)})
    side_by_side = byte_bpe.merge(pieces, ranks, pairs)
    monkeypatch.setattr(byte_bpe, "LONG", 0)
    assert byte_bpe.merge(pieces, ranks, pairs) == side_by_side
    assert byte_bpe.merge([], ranks, pairs) == []


def test_offsets_cut_tokens_out_of_the_text(codec):
    text = "Don't  stop, 日本 12".encode()
    ((ids, at),) = codec.encode([text])
    ends = [*at[1:].tolist(), len(text)]
    assert [text[a:b] for a, b in zip(at.tolist(), ends)] == [codec.decode(ids[k : k + 1]) for k in range(len(ids))]
    with pytest.raises(ValueError):
        codec.decode(ids, at + 1)


def test_long_texts_are_cut_where_pieces_start():
    random.seed(5)
    text = "".join(random.choices(PARTS, k=5000)).encode()
    for part_bytes in (1, 50, 1000, 1 << 20):
        parts = list(byte_bpe.cut(text, part_bytes))
        assert b"".join(parts) == text
    assert list(byte_bpe.cut(b"")) == [b""]


@pytest.mark.parametrize("part_bytes", [1, 300, byte_bpe.PART_BYTES])
def test_odd_rows(docs, plain, part_bytes):
    given = [(i, t if i != 7 else t[:20_000]) for i, t in ODD] + [(9, t) for t in odd_texts()[:200]]
    given = given if part_bytes > 1 else [(i, t) for i, t in given if len(t or "") < 100_000]
    rows = byte_bpe.decode(byte_bpe.encode(docs(given, 2), part_bytes=part_bytes)).collect()
    wanted = [(i is None, i or 0, np.array(plain(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in given]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids, r.decoded) for r in rows) == sorted(wanted)


def test_empty_table(docs):
    assert byte_bpe.decode(byte_bpe.encode(docs([]))).count() == 0


def test_query(spark, table, plain):
    found = {r.doc_id: r for r in queries.QUERIES["op13_byte_bpe"](spark, DATA).collect()}
    given = table("documents").collect()
    assert len(found) == len(given)
    for r in given:
        ids, row = plain(r.text), found[r.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
