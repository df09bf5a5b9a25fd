"""Token shards as wavelet matrices: one compressed file each, with token access, rank, select and occurrence lookup.

A shard holds the ids of whole documents in ascending doc_id order. Its bit-planes, highest bit first, are cut into
blocks of BLOCK bits that are compressed one by one; a directory has the place of each block and the number of ones
before it, so a query decompresses one block for each plane it passes.

File: magic, length of the header, header (JSON: n_tokens, zeros of each plane, length and kind of each section),
then the sections: doc_ids, their validity, starts of the documents, and for each plane the directory and the blocks.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sqlgauge.llm import work
from sqlgauge.llm.tokens import default_path, encoder

END_ID = 2
#: Bytes of text that a shard takes about; the number of shards follows from the table's size.
SHARD_BYTES = 16 * 1024 * 1024
#: A partition that gets more tokens than this writes a further shard.
SHARD_TOKENS = 1 << 23
BLOCK = 1 << 16
#: Rows of the list of files to one file of it, and tokens that a task reads about; a shard is read by one task.
LISTED = 1 << 16
READ_TOKENS = 1 << 22

_MAGIC = b"WVM1"


def _packed(plane: np.ndarray) -> tuple[bytes, bytes]:
    """Directory (place of each block, ones before it; a last row with the totals) and blocks of a plane of bits."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    places, ranks, blocks = [0], [0], []
    for k in range(0, len(plane), BLOCK):
        bits = plane[k : k + BLOCK]
        raw = np.packbits(bits, bitorder="little").tobytes()
        small = press.compress(raw)
        blocks.append(b"z" + small if len(small) < len(raw) else b"r" + raw)
        places.append(places[-1] + len(blocks[-1]))
        ranks.append(ranks[-1] + int(np.count_nonzero(bits)))
    return np.array([places, ranks], "<i8").tobytes(), b"".join(blocks)


def _kind(n_planes: int) -> type:
    return np.uint16 if n_planes <= 16 else np.uint32


def build(doc_ids: list[int | None], starts: np.ndarray, tokens: np.ndarray) -> Iterator[bytes]:
    """The parts of a shard file. ``starts`` has one more entry than there are documents."""
    n_planes = max(1, int(tokens.max(initial=0)).bit_length())
    rest = tokens.astype(_kind(n_planes), copy=False)
    zeros, sections = [], []
    sections.append(np.array([d or 0 for d in doc_ids], "<i8").tobytes())
    sections.append(np.array([d is not None for d in doc_ids], np.uint8).tobytes())
    sections.append(starts.astype("<i8").tobytes())
    for k in range(n_planes - 1, -1, -1):
        plane = (rest >> k & 1).astype(bool)
        sections.extend(_packed(plane))
        rest = np.concatenate([rest[~plane], rest[plane]])
        zeros.append(int(len(plane) - np.count_nonzero(plane)))
    header = {"n_tokens": len(tokens), "zeros": zeros, "sections": [len(s) for s in sections]}
    text = json.dumps(header).encode()
    yield _MAGIC + struct.pack("<I", len(text)) + text
    yield from sections


class Shard:
    """A shard file opened for reading: anything with ``read`` and ``seek``."""

    def __init__(self, file) -> None:
        self.file = file
        magic, size = file.read(4), struct.unpack("<I", file.read(4))[0]
        if magic != _MAGIC:
            raise ValueError("not a shard file")
        header = json.loads(file.read(size))
        self.n_tokens, self.zeros = header["n_tokens"], header["zeros"]
        self._sizes = header["sections"]
        self._places = np.cumsum([8 + size, *self._sizes])
        valid = np.frombuffer(self._section(1), np.uint8)
        self.doc_ids = [int(d) if v else None for d, v in zip(np.frombuffer(self._section(0), "<i8"), valid)]
        self.starts = np.frombuffer(self._section(2), "<i8")
        self._directories: dict[int, np.ndarray] = {}

    def _section(self, k: int) -> bytes:
        self.file.seek(int(self._places[k]))
        return self.file.read(self._sizes[k])

    def _directory(self, plane: int) -> np.ndarray:
        if plane not in self._directories:
            self._directories[plane] = np.frombuffer(self._section(3 + 2 * plane), "<i8").reshape(2, -1)
        return self._directories[plane]

    def _bits(self, plane: int, block: int) -> np.ndarray:
        places = self._directory(plane)[0]
        self.file.seek(int(self._places[4 + 2 * plane] + places[block]))
        data = self.file.read(int(places[block + 1] - places[block]))
        n = min(BLOCK, self.n_tokens - block * BLOCK)
        return _unpacked(data, n)

    def _rank(self, plane: int, i: int) -> int:
        """Ones before place i."""
        block, inner = divmod(i, BLOCK)
        ones = int(self._directory(plane)[1][block])
        return ones + (int(np.count_nonzero(self._bits(plane, block)[:inner])) if inner else 0)

    def _select(self, plane: int, bit: int, j: int) -> int:
        """Place of the bit's occurrence number j."""
        ones = self._directory(plane)[1]
        before = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK, self.n_tokens) - ones
        block = int(np.searchsorted(before, j, side="right")) - 1
        return block * BLOCK + int(np.flatnonzero(self._bits(plane, block) == bit)[j - int(before[block])])

    def access(self, i: int) -> int:
        """The token at place i."""
        value = 0
        for plane, zeros in enumerate(self.zeros):
            block, inner = divmod(i, BLOCK)
            bits = self._bits(plane, block)
            ones = int(self._directory(plane)[1][block]) + int(np.count_nonzero(bits[:inner]))
            value = value << 1 | int(bits[inner])
            i = zeros + ones if bits[inner] else i - ones
        return value

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        if token >> len(self.zeros):
            return 0, 0
        for plane, zeros in enumerate(self.zeros):
            a, b = self._rank(plane, start), self._rank(plane, end)
            one = token >> (len(self.zeros) - 1 - plane) & 1
            start, end = (zeros + a, zeros + b) if one else (start - a, end - b)
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of a token in [start, end)."""
        a, b = self._range(token, start, self.n_tokens if end is None else end)
        return b - a

    def occurrence(self, token: int, j: int) -> int:
        """Place of a token's occurrence number j, counted from 0."""
        a, b = self._range(token, 0, self.n_tokens)
        if not 0 <= j < b - a:
            raise IndexError(j)
        place = a + j
        for plane in range(len(self.zeros) - 1, -1, -1):
            one = token >> (len(self.zeros) - 1 - plane) & 1
            place = self._select(plane, one, place - self.zeros[plane] if one else place)
        return place

    def tokens(self) -> np.ndarray:
        """All tokens, by undoing the planes from the lowest to the highest."""
        out = np.zeros(self.n_tokens, _kind(len(self.zeros)))
        for plane in range(len(self.zeros) - 1, -1, -1):
            places, data = self._directory(plane)[0], self._section(4 + 2 * plane)
            parts = [
                _unpacked(data[places[b] : places[b + 1]], min(BLOCK, self.n_tokens - b * BLOCK)) for b in range(len(places) - 1)
            ]
            ones = np.concatenate(parts) if parts else np.zeros(0, bool)
            above = np.empty_like(out)
            above[~ones] = out[: self.zeros[plane]]
            above[ones] = out[self.zeros[plane] :] | out.dtype.type(1 << (len(self.zeros) - 1 - plane))
            out = above
        return out


def _unpacked(data: bytes, n: int) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data[1:], max_output_size=BLOCK // 8) if data[:1] == b"z" else data[1:]
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n, bitorder="little").astype(bool)


class Shards(NamedTuple):
    """A written shard set: one row per file with shard, part, uri, n_docs and n_tokens, and the number of files."""

    files: DataFrame
    folder: str


def write_shards(
    docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES
) -> Shards:
    """Encodes every row, appends the end id and writes the shards, in ascending order of doc_id.

    A null text counts as empty; rows without doc_id come first; rows that share an id are ordered by a hash of their
    text, over several shards if there are many. Other columns are not read. An empty table gives no file.
    """
    spark: SparkSession = docs.sparkSession
    folder = folder or work.new_path(spark, "wavelet")
    path = path or default_path()
    rows = work.documents(docs)
    size = rows.agg(F.sum(F.octet_length("text").cast("long") + 64)).first()[0] or 0
    keys = ["doc_id", "hash"]
    n_shards = max(1, -(-size // shard_bytes))
    rows = rows.withColumn("hash", F.xxhash64("text")).repartitionByRange(n_shards, *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, part = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        arrays: list[np.ndarray] = []
        size = 0
        kind = _kind(max(encoder(path).size - 1, end_id).bit_length())
        end = np.array([end_id], kind)

        def flushed() -> pa.RecordBatch:
            starts = np.cumsum([0] + [len(a) + 1 for a in arrays])
            tokens = np.concatenate([x for a in arrays for x in (a, end)])
            arrays.clear()
            uri = f"{folder}/{shard:06d}-{part:06d}.wvm"
            work.put_file(uri, build(ids, starts, tokens))
            columns = [[shard], [part], [uri], [len(ids)], [len(tokens)]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shard", "part", "uri", "n_docs", "n_tokens"])

        for batch in batches:
            for doc_id, tokens in zip(batch.column(0).to_pylist(), encoder(path).encode(batch.column(1))):
                if arrays and size + len(tokens) >= SHARD_TOKENS:
                    yield flushed()
                    ids, arrays, size, part = [], [], 0, part + 1
                ids.append(doc_id)
                arrays.append(tokens.astype(kind))
                size += len(tokens) + 1
        if arrays:
            yield flushed()

    files = rows.select("doc_id", "text").mapInArrow(run, "shard long, part long, uri string, n_docs long, n_tokens long")
    files = files.repartition(-(-n_shards // LISTED))
    return Shards(work.written(files, "shards", batch_bytes=work.BATCH_BYTES), folder)


def placed(shards: Shards) -> DataFrame:
    """The files with ``base``, the number of ids in all files before it. The running sum sees one short row per file."""
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    return shards.files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_shards(shards: Shards) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary, little-endian unsigned 32-bit) of each document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, path = work.file_system(uri)
                with store.open_input_file(path) as file:
                    shard = Shard(file)
                    tokens = shard.tokens()
                    n = len(shard.doc_ids)
                    first = 0
                    while first < n:
                        limit = shard.starts[first] + (1 << 20)
                        last = max(first + 1, int(np.searchsorted(shard.starts, limit, side="right")) - 1)
                        starts = shard.starts[first : last + 1]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(shard.doc_ids[first:last], pa.int64()),
                                pa.array(base + starts[:-1]),
                                pa.array(np.diff(starts)),
                                pa.array([tokens[a:b].astype("<u4").tobytes() for a, b in zip(starts[:-1], starts[1:])], pa.binary()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids"],
                        )
                        first = last

    files = placed(shards).select("uri", "base")
    n_files, n_tokens = shards.files.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    tasks = min(n_files, max(files.sparkSession.sparkContext.defaultParallelism, -(-n_tokens // READ_TOKENS)))
    return files.repartition(max(1, tasks)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
