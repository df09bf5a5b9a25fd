"""Near-duplicate classes by SimHash fingerprints that meet at the anchors of a covering code.

The anchors are the code words of the binary Golay code of length 23 on two blocks of 23 bits each: every block lies
within 3 bits of exactly one code word. A fingerprint is replicated to every pair of code words within the covering
radius (3 + 3) plus the threshold, the threshold divided between the blocks; two fingerprints that differ in at most
that many bits therefore meet at the home anchor (the one within the covering radius) of either. Per anchor its home
fingerprints are compared with all replicas.

An anchor that is home to more than DENSE fingerprints would make pairs with the square of their number. There the
fingerprints are compared by way of one-bit flips instead: two of them are within two bits of each other exactly if
they share one of the 65 values within one bit, and each value is shared by 65 at most. This is exact, loses no
connection, and its rows grow with the number of fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlgauge.llm import work
from sqlgauge.llm.components import components

SHINGLE = 3
THRESHOLD = 2
DENSE = 32

_BLOCK = 23
_RADIUS = 3
_GENERATOR = 0xAE3  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
_SEED = 42
_CHUNK = 1 << 20


def _hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a text, some at a time."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    start, carried, some = 0, [], False
    while start < len(text):
        end = start + _CHUNK
        while end < len(text) and text[end : end + 1] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = carried + text[start:end].lower().split()
        start = end
        if len(words) >= width:
            some = True
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            cuts = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
            yield np.fromiter((digest(joined[a:b], _SEED) for a, b in cuts), np.uint64, len(words) - width + 1)
            carried = words[len(words) - width + 1 :]
        else:
            carried = words
    if carried and not some:
        yield np.array([digest(b" ".join(carried), _SEED)], np.uint64)


def fingerprint_of(text: bytes | None, width: int = SHINGLE) -> int:
    """64 bits, each set if it is set in over half the hashes; 0 for a text without words."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in _hashes(text or b"", width):
        n += len(hashes)
        for k in range(0, len(hashes), 1 << 14):
            octets = hashes[k : k + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """row, doc_id and fingerprint (a signed long) of each row of a stored table."""
    row = work.unused(docs, "row")
    rows = work.numbered(docs, row).select(
        F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint_of(t.as_py(), width) for t in batch.column(2)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(values.view(np.int64))], ["row", "doc_id", "fingerprint"]
            )

    return rows.mapInArrow(run, "row long, doc_id long, fingerprint long")


class Golay:
    """For each syndrome the error patterns of 3, 4 and 5 bits at most, of at most 3, exactly 4 and exactly 5 bits."""

    def __init__(self) -> None:
        shift = np.arange(_BLOCK, dtype=np.int64)
        # The remainder of x^i by the generator; a word's syndrome is the sum of those of its bits.
        powers, value = [], 1
        for _ in range(_BLOCK):
            powers.append(value)
            value <<= 1
            if value >> 11:
                value ^= _GENERATOR
        self.powers = np.array(powers, np.int64)
        self.lists = []
        patterns = np.zeros(1, np.int64)
        by_weight = [patterns]
        for _ in range(_RADIUS + THRESHOLD):
            grown = patterns[:, None] | (1 << shift)[None, :]
            patterns = grown[(1 << shift)[None, :] > patterns[:, None]]
            by_weight.append(patterns)
        for group in (np.concatenate(by_weight[: _RADIUS + 1]), *by_weight[_RADIUS + 1 :]):
            syndromes = self.syndromes(group)
            order = np.argsort(syndromes, kind="stable")
            counts = np.bincount(syndromes, minlength=1 << 11)
            self.lists.append((group[order], np.cumsum(counts) - counts, counts))

    def syndromes(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        for i, power in enumerate(self.powers):
            out ^= ((words >> i) & 1) * power
        return out

    def near(self, words: np.ndarray, extra: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of a word, and a code word that is 3 + ``extra`` bits away (0: at most 3)."""
        patterns, starts, counts = self.lists[extra]
        which = self.syndromes(words)
        n = counts[which]
        index = np.repeat(np.arange(len(words)), n)
        inner = np.arange(len(index)) - np.repeat(np.cumsum(n) - n, n)
        return index, words[index] ^ patterns[np.repeat(starts[which], n) + inner]


def anchors_of(values: np.ndarray, golay: Golay) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(fingerprints, anchors, whether home) of all replicas."""
    words = values.view(np.uint64)
    mask = np.uint64((1 << _BLOCK) - 1)
    low, high = (words & mask).astype(np.int64), ((words >> np.uint64(_BLOCK)) & mask).astype(np.int64)
    for i in range(THRESHOLD + 1):
        first, a = golay.near(low, i)
        for j in range(THRESHOLD + 1 - i):
            second, b = golay.near(high[first], j)
            yield values[first][second], a[second] << _BLOCK | b, i == j == 0


def _replicas(values: DataFrame, home_only: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            for k in range(0, len(batch), 4096):
                part = batch.column(0)[k : k + 4096].to_numpy(zero_copy_only=False)
                for fingerprint, anchor, home in anchors_of(part, golay):
                    yield pa.RecordBatch.from_arrays([pa.array(fingerprint), pa.array(anchor)], ["fingerprint", "anchor"])
                    if home_only:
                        break

    return values.select("fingerprint").mapInArrow(run, "fingerprint long, anchor long")


def links(values: DataFrame, dense: int = DENSE) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of a stored table.

    All pairs within the threshold at anchors that are home to at most ``dense`` fingerprints; at the others as many
    links as keep together what the pairs would connect.
    """
    home = _replicas(values, home_only=True)
    reach = _replicas(values, home_only=False)
    counts = home.groupBy("anchor").agg(F.count("*").alias("n"))
    crowded = work.written(counts.where(F.col("n") > dense).select("anchor"), "anchors")
    calm = home.join(crowded, "anchor", "left_anti")
    other = reach.withColumnRenamed("fingerprint", "other")
    close = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("other"))) <= THRESHOLD
    # A pair meets at the home of both; where one home is crowded and the other isn't, at the calm one. Spark sizes the replicas
    # like the fingerprints that they are made of, some sixty times too low, and would broadcast them.
    found = calm.join(other.hint("merge"), (calm["anchor"] == other["anchor"]) & (calm["fingerprint"] != other["other"]) & close)
    pairs = found.select(F.col("fingerprint").alias("a"), F.col("other").alias("b"))
    if crowded.isEmpty():
        return pairs
    many = reach.join(crowded, "anchor", "left_semi").select("fingerprint").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    near = many.select("fingerprint", F.explode(F.transform(flips, lambda bit: F.col("fingerprint").bitwiseXOR(bit))).alias("value"))
    shared = near.groupBy("value").agg(F.collect_list("fingerprint").alias("all")).where(F.size("all") > 1)
    least = shared.select(F.array_min("all").alias("b"), F.explode("all").alias("a")).where("a != b")
    return pairs.unionByName(least.select("a", "b").distinct())


def near_groups(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """Each row of a stored table with its fingerprint and its component.

    Columns: row, doc_id, fingerprint, component_id (the smallest doc_id of the component), keep_row, kept. Words are
    what stands between ASCII white space, A-Z lower-cased; a text of fewer words than a shingle is one shingle. Null, empty
    and blank texts have fingerprint 0, which links like any other. Rows with the same fingerprint are one node, so
    copies and repeated rows add nothing to the search. Rows without doc_id come last in their component. An empty
    table gives no rows.
    """
    rows = work.written(fingerprints(docs, width), "fingerprints", batch_bytes=work.BATCH_BYTES)
    nodes = rows.groupBy("fingerprint").agg(F.min(work.smallest("doc_id", "row")).alias("first"))
    nodes = work.written(nodes, "nodes")
    roots = work.written(components(links(nodes)), "roots")
    rooted = nodes.join(roots, nodes["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    classes = rooted.join(least, "root").select("fingerprint", "least")
    return rows.join(classes, "fingerprint").select(
        "row",
        "doc_id",
        "fingerprint",
        F.col("least.id").alias("component_id"),
        F.col("least.row").alias("keep_row"),
        (F.col("row") == F.col("least.row")).alias("kept"),
    )


def drop_near(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """One row of each component of a stored table, the one with the smallest doc_id, with all its columns."""
    row = work.unused(docs, "row")
    dropped = near_groups(docs, width).where(~F.col("kept")).select(F.col("row").alias(row))
    return work.without(work.numbered(docs, row), row, dropped)
