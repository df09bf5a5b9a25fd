"""Packing of token ids into training sequences by Karmarkar-Karp multiway differencing.

Documents are encoded once and cut: whole windows stand alone, the rest of a document falls into pieces of at most
PIECE tokens. These are dealt evenly into groups of about GROUP pieces by a hash of the piece's number, never by a
key of the data, and each group is partitioned into windows of nearly equal sums: the two partial partitions with the
largest differences are merged, the fullest windows of one with the emptiest of the other, until one is left. If its
fullest window exceeds the capacity, the group gets one more window.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlgauge.llm import work
from sqlgauge.llm.tokens import default_path, encoder

CAPACITY = 2048
END_ID = 1
#: With several pieces to a window differencing comes within a few tokens of equal sums.
PIECE = 512
GROUP = 2048

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, piece long, ids binary"


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """The indices of the sizes in each of the ways."""
    if not sizes:
        return [[] for _ in range(ways)]
    merges: list[tuple[int, int]] = []  # of two sets; below len(sizes) a set is one index
    heap = []
    for i, size in enumerate(sizes):
        sums, sets = np.zeros(ways, np.int64), np.full(ways, -1, np.int64)
        sums[0], sets[0] = size, i
        heap.append((-size if ways > 1 else 0, i, sums, sets))
    heapq.heapify(heap)
    order = len(sizes)
    while len(heap) > 1:
        _, _, sums, sets = heapq.heappop(heap)
        _, _, others, theirs = heapq.heappop(heap)
        sums, theirs = sums + others[::-1], theirs[::-1]
        both = np.flatnonzero((sets >= 0) & (theirs >= 0))
        joined = np.maximum(sets, theirs)
        for k in both.tolist():
            joined[k] = len(sizes) + len(merges)
            merges.append((int(sets[k]), int(theirs[k])))
        down = np.argsort(-sums, kind="stable")
        sums, joined = sums[down], joined[down]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), order, sums, joined))
        order += 1
    ways_out = []
    for top in heap[0][3].tolist():
        members, open_sets = [], [top] if top >= 0 else []
        while open_sets:
            x = open_sets.pop()
            if x < len(sizes):
                members.append(x)
            else:
                open_sets.extend(merges[x - len(sizes)])
        ways_out.append(sorted(members))
    return ways_out


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """As few windows as differencing finds within the capacity, counted up from the least possible number."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, ways)
        if max(sum(sizes[i] for i in way) for way in found) <= capacity:
            return [way for way in found if way]
        ways += 1


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, piece: int = PIECE, end_id: int = END_ID) -> DataFrame:
    """The pieces of each row: its ids and an end id, cut at multiples of the capacity and of the piece size.

    ``ids`` holds little-endian unsigned 32-bit integers, ``piece`` numbers the pieces of the table.
    """
    schema = pa.schema(
        [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "piece")] + [("ids", pa.binary())]
    )

    def cuts(n: int) -> Iterator[tuple[int, int]]:
        full = n - n % capacity
        yield from ((k, capacity) for k in range(0, full, capacity))
        yield from ((k, min(piece, n - k)) for k in range(full, n, piece))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        ends = np.array([end_id], "<u4")
        for batch in batches:
            rows, size = [], 0
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(path).encode(batch.column(1))):
                ids = np.concatenate([ids, ends])
                for start, length in cuts(len(ids)):
                    data = ids[start : start + length].tobytes()
                    rows.append((doc_id, start, length, zlib.crc32(data), len(ids), number, data))
                    number += 1
                    size += len(data)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            pa.default_memory_pool().release_unused()  # else a worker keeps what the largest batch took, also when it idles

    return work.documents(docs).mapInArrow(run, _PIECES)


class Packed(NamedTuple):
    places: DataFrame
    pieces: DataFrame


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, piece: int = PIECE, group: int = GROUP) -> Packed:
    """The places of all pieces (doc_id, start, length, ids_crc32, doc_tokens, piece, sequence_id, offset), and the pieces
    with their ids as they are stored.

    Every id of every row is in exactly one piece; a null or empty text is one piece of the end id. A sequence holds at most
    ``capacity`` tokens and its offsets have no gaps. Repeated rows and rows without doc_id are packed like
    any other. Other columns are not read. An empty table gives no rows.
    """
    stored = work.written(pieces(docs, path or default_path(), capacity, piece), "pieces", "zstd", work.BATCH_BYTES)
    narrow = stored.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "piece")
    whole = narrow.where(F.col("length") == capacity).select(
        "*", (F.lit(1 << 61) + F.col("piece")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = narrow.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group))

    def placed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("piece")
        sizes = rows.column("length").to_pylist()
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for k, way in enumerate(windows(sizes, capacity)):
            sequence[way] = rows.column("group")[0].as_py() << 24 | k
            offset[way] = np.cumsum([0] + [sizes[i] for i in way[:-1]])
        kept = rows.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens", "piece"])
        return kept.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    dealt = rest.withColumn("group", F.pmod(F.xxhash64("piece"), F.lit(groups).cast("long")))
    packed = dealt.groupBy("group").applyInArrow(placed, whole.schema)
    return Packed(whole.unionByName(packed), stored)


def sequences(packed: Packed) -> DataFrame:
    """sequence_id and its ids (binary, little-endian unsigned 32-bit)."""
    parts = packed.places.select("piece", "sequence_id", "offset").join(packed.pieces.select("piece", "ids"), "piece")
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(ordered, F.lit(b""), lambda ids, part: F.concat(ids, part["ids"]))
    return parts.groupBy("sequence_id").agg(joined.alias("ids"))
