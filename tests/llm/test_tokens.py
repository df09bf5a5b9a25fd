"""Token ids, packing, token shards and token counts."""

import io
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sqlgauge.llm import packing, separators, simhash, tokens, wavelet, work
from sqlgauge.llm.disclosure import _ARROW_BYTES as ARROW_BYTES
from tests.llm.conftest import ODD


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(tokens.default_path())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def plain_as_text():
    """Strings of special tokens as ordinary text, as in flat files, where an id of one would end a document."""
    tokenizer = Tokenizer.from_file(tokens.default_path())
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


PARTS = [" ", "  ", "\n", "\t", "\r\n", "a", "The", "é", "ß", "ő", "'s", "don't", ".", ",", "!", "1", "23", "\u00a0", "\u3000", "日本", "😀"]
PARTS += ["x" * 70, "<|endoftext|>", "\x1c", "\x00", "\u0301", "-", "_", "…"]


@pytest.mark.parametrize("special_as_text", [False, True])
def test_cut_texts_have_the_ids_of_whole_texts(plain, plain_as_text, monkeypatch, special_as_text):
    random.seed(1)
    texts = ["".join(random.choices(PARTS, k=random.randint(0, 25))) for _ in range(3000)]
    texts += [None, "", " ", "  ", " a", "a ", "a  ", "\n\n b"]
    texts += ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext", "x<|endoftext|><|endoftext|>"]
    assert plain("a <|endoftext|> b") == [64, 220, 50256, 275]
    encoder = tokens.Encoder(tokens.default_path(), special_as_text)
    assert encoder.cuts
    for remembered in (1_000_000, 50):
        monkeypatch.setattr(tokens, "REMEMBERED", remembered)
        found = [x.tolist() for k in range(0, len(texts), 500) for x in encoder.encode(pa.array(texts[k : k + 500]))]
        assert found == [(plain_as_text if special_as_text else plain)(t) for t in texts]


def places(sizes, ways):
    return [sum(sizes[i] for i in way) for way in packing.differencing(sizes, ways)]


def test_differencing():
    # Worked by hand: 8 and 7 part, then 6, 5 and 4 fill up.
    assert sorted(places([8, 7, 6, 5, 4], 2)) == [14, 16]
    assert packing.differencing([], 2) == [[], []]
    random.seed(2)
    sizes = [random.randint(1, 512) for _ in range(400)]
    for ways in (1, 7, 50):
        found = packing.differencing(sizes, ways)
        assert sorted(i for way in found for i in way) == list(range(400))
        sums = places(sizes, ways)
        assert max(sums) - min(sums) <= 0.01 * sum(sizes) / ways


def test_windows_rise_until_they_hold():
    assert len(packing.windows([6, 6, 6], 10)) == 3  # two would be enough by sum
    assert packing.windows([], 10) == []
    assert packing.windows([10, 10], 10) == [[0], [1]]


def check_packing(rows, given, plain, end):
    assert all(0 < r.length <= packing.CAPACITY for r in rows)
    of = defaultdict(list)
    for r in rows:
        of[r.sequence_id].append(r)
    for some in of.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
    wanted = []
    for doc_id, text in given:
        ids = np.array([*plain(text), end], "<u4")
        wanted.append((doc_id, zlib.crc32(ids.tobytes()), len(ids)))
    pieces = sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows if r.doc_id is not None), key=str)
    by_doc = {doc_id: np.array([*plain(text), end], "<u4") for doc_id, text in given if doc_id is not None}
    for doc_id, start, length, crc, size in pieces:
        ids = by_doc[doc_id]
        assert size == len(ids) and crc == zlib.crc32(ids[start : start + length].tobytes())
    return of, wanted


def test_pack_odd_rows(docs, plain):
    packed = packing.pack(docs(ODD))
    rows = packed.places.collect()
    of, wanted = check_packing(rows, ODD, plain, 1)
    by_piece = {r.piece: r.ids for r in packed.pieces.collect()}
    assert all(zlib.crc32(by_piece[r.piece]) == r.ids_crc32 for r in rows)
    assert sum(r.length for r in rows) == sum(n for _, _, n in wanted)
    assert sum(r.length for r in rows if r.doc_id is None) == [n for i, _, n in wanted if i is None][0]
    for doc_id in (6, 8):
        pieces = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.start)
        ids = b"".join(by_piece[r.piece] for r in pieces)
        assert (doc_id, zlib.crc32(ids), len(ids) // 4) in wanted
    full = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for sequence, some in of.items():
        assert full[sequence] == b"".join(by_piece[r.piece] for r in sorted(some, key=lambda r: r.offset))


def test_packing_leaves_little_padding(table, plain):
    rows = packing.pack(table("documents")).places.collect()
    of, wanted = check_packing(rows, [(r.doc_id, r.text) for r in table("documents").collect()], plain, 1)
    assert sum(r.length for r in rows) == sum(n for _, _, n in wanted)
    assert sum(r.length for r in rows) >= 0.97 * packing.CAPACITY * len(of)


def test_empty_tables(docs):
    assert packing.pack(docs([])).places.count() == 0
    assert wavelet.read_shards(wavelet.write_shards(docs([]))).count() == 0
    assert separators.counted(docs([])).count() == 0


def shard_of(values, ids=None):
    starts = np.array([0, len(values)]) if ids is None else ids[1]
    return wavelet.Shard(io.BytesIO(b"".join(wavelet.build([9] if ids is None else ids[0], starts, np.array(values, np.uint32)))))


@pytest.mark.parametrize("top", [1, 2, 300, 50_257, 1 << 20])
def test_wavelet_queries(monkeypatch, top):
    monkeypatch.setattr(wavelet, "BLOCK", 64)
    random.seed(top)
    values = [min(random.randrange(top), random.randrange(top)) for _ in range(700)]
    shard = shard_of(values)
    assert shard.tokens().tolist() == values
    for i in range(0, 700, 37):
        assert shard.access(i) == values[i]
    for token in {*values[:10], top}:
        where = [i for i, v in enumerate(values) if v == token]
        assert shard.count(token) == len(where)
        assert shard.count(token, 100, 450) == sum(100 <= i < 450 for i in where)
        assert [shard.occurrence(token, j) for j in range(len(where))] == where
        with pytest.raises(IndexError):
            shard.occurrence(token, len(where))


def test_empty_shard_and_missing_ids():
    shard = shard_of([], ([], np.array([0])))
    assert shard.tokens().tolist() == [] and shard.doc_ids == [] and shard.count(5) == 0
    assert shard_of([3, 2], ([None], np.array([0, 2]))).doc_ids == [None]


@pytest.mark.parametrize("shard_bytes", [1 << 24, 1 << 10])
def test_shards_hold_all_rows_in_order(docs, plain, shard_bytes):
    given = ODD + [(i, f"text {i % 3}") for i in range(20, 60)] + [(30, f"more {i}") for i in range(40)]
    rows = wavelet.read_shards(wavelet.write_shards(docs(given, 5), shard_bytes=shard_bytes)).collect()
    rows.sort(key=lambda r: r.start)
    at = 0
    for r in rows:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    wanted = sorted((i is None, i or 0, np.array([*plain(t), 2], "<u4").tobytes()) for i, t in given)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids) for r in rows) == wanted


def test_small_shards_share_a_list_and_tasks(docs):
    """A file or task for each small shard would be some hundred files of one row."""
    given = [(i, f"text {i} " + "word " * 100) for i in range(200)]
    shards = wavelet.write_shards(docs(given, 4), shard_bytes=1 << 10)
    assert shards.files.count() > 50
    assert len(shards.files.inputFiles()) == 1
    read = wavelet.read_shards(shards)
    assert read.rdd.getNumPartitions() <= read.sparkSession.sparkContext.defaultParallelism
    assert sorted(r.doc_id for r in read.select("doc_id").collect()) == list(range(200))


@pytest.mark.parametrize("operator", [wavelet.write_shards, packing.pack, separators.counted, simhash.near_groups])
def test_texts_go_to_python_in_bounded_batches(docs, monkeypatch, operator):
    table = docs([(i, f"{i} " + "common words " * 1_600) for i in range(400)] + [(1000, "common " * 900_000)], parts=1)
    frame, most, asked = type(table), 4 << 20, []
    plain = frame.mapInArrow

    def watched(df, run, schema):
        texts = "text" in df.columns

        def bounded(batches):
            def each():
                for batch in batches:
                    # a batch ends behind the row that fills it
                    if texts and batch.nbytes > most + max(len(str(t)) for t in batch.column("text")) + 64 * batch.num_rows:
                        raise ValueError(f"{batch.num_rows} rows of {batch.nbytes} bytes")
                    yield batch

            return run(each())

        asked.append(texts)
        return plain(df, bounded, schema)

    monkeypatch.setattr(frame, "mapInArrow", watched)
    before = table.sparkSession.conf.get(ARROW_BYTES, None)
    made = operator(table)
    made = made if isinstance(made, frame) else made[0]
    assert made.count() and any(asked)
    assert table.sparkSession.conf.get(ARROW_BYTES, None) == before


def test_texts_are_cut_some_at_a_time(plain, monkeypatch):
    encoder, cut, asked = tokens.Encoder(tokens.default_path()), tokens.Encoder._cut, []

    def watched(self, texts):
        asked.append(texts.nbytes)
        return cut(self, texts)

    monkeypatch.setattr(tokens.Encoder, "_cut", watched)
    text = "some words " * 9_000  # 100 KB
    assert [x.tolist() for x in encoder.encode(pa.array([text] * 100))] == [plain(text)] * 100
    assert len(asked) > 2 and max(asked) < 5 << 20


@pytest.mark.parametrize("block_bytes", [2, 64, 1 << 22])
def test_counts_across_blocks(docs, plain_as_text, block_bytes):
    given = [(i, t) for i, t in ODD if i not in (6, 7)]
    found = separators.counted(docs(given), block_bytes=block_bytes).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.n_tokens) for r in found), key=key) == sorted(((i, len(plain_as_text(t))) for i, t in given), key=key)


def test_counts_of_very_long_texts(docs, plain_as_text):
    given = [(i, t) for i, t in ODD if i in (6, 7)] + [(9, "a short one")]
    found = {r.doc_id: r.n_tokens for r in separators.counted(docs(given), block_bytes=1 << 16).collect()}
    assert found == {i: len(plain_as_text(t)) for i, t in given}


def test_ids_that_do_not_fit_are_refused(docs, tmp_path):
    with pytest.raises(Exception, match="fit 1 bytes"):
        separators.write_flat(docs([(1, "hello there")]), str(tmp_path), end_id=200, width=1)


def test_scan_of_given_files(spark, tmp_path):
    files = {"a": [5, 9, 9, 1, 2, 9, 7], "b": [], "c": [1, 2, 3, 4, 5, 6], "d": [9], "e": [1, 9]}
    for name, values in files.items():
        work.put_file(f"{tmp_path}/{name}.bin", [np.array(values, "<u2").tobytes()])
    for block in (2, 6, 1000):
        rows = separators.scan(spark, str(tmp_path), end_id=9, block_bytes=block).collect()
        found = sorted((r.file[0], r.ordinal, r.start, r.n_tokens, r.ended) for r in rows)
        assert found == [
            ("a", 0, 0, 1, True),
            ("a", 1, 2, 0, True),
            ("a", 2, 3, 2, True),
            ("a", 3, 6, 1, False),
            ("c", 0, 0, 6, False),
            ("d", 0, 0, 0, True),
            ("e", 0, 0, 1, True),
        ]


def test_counts_of_a_table(table, plain_as_text):
    found = {r.doc_id: r.n_tokens for r in separators.counted(table("documents"), block_bytes=1 << 12).collect()}
    assert found == {r.doc_id: len(plain_as_text(r.text)) for r in table("documents").collect()}
