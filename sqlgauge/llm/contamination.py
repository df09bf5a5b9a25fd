"""Benchmark decontamination: windows of test words in a broadcast hash set, looked up along the training texts.

Texts become arrays of word numbers of the benchmark's vocabulary, 0 for any other word. A window can only occur where
all its words are known; there a polynomial hash is looked up in the set, and each hit is verified word by word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlgauge.llm import work

WINDOW = 13
#: Bytes of benchmark text that one broadcast index may hold; a larger benchmark is passed in blocks of this size.
INDEX_BYTES = 32 * 1024 * 1024
#: A document is contaminated from this share of hit words on.
SHARE = 1 / 20

_CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: What is found in a text: words, hit words, items with occurring windows, hit ranges of words [first, last).
FINDINGS = "struct<n_words:bigint,n_hit:bigint,items:array<bigint>,spans:array<struct<first:bigint,last:bigint>>>"


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time: runs of ASCII letters, digits and anything beyond ASCII, A-Z lower-cased."""
    plain, start = text.translate(_WORD_BYTES), 0
    while start < len(plain):
        end = plain.find(b" ", start + _CHUNK)
        end = len(plain) if end < 0 else end
        yield plain[start:end].split()
        start = end


class Windows(NamedTuple):
    """Distinct windows of one size, by hash: where each stands in the words of the index, and the items that have it."""

    hashes: np.ndarray
    places: np.ndarray
    bounds: np.ndarray
    items: np.ndarray

    def items_of(self, windows: np.ndarray) -> np.ndarray:
        """Numbers of the items that have any of the windows."""
        parts = [self.items[self.bounds[k] : self.bounds[k + 1]] for k in np.unique(windows).tolist()]
        return np.unique(np.concatenate(parts))


class Index:
    """Windows of some benchmark items, as arrays: about 30 bytes a word beside the vocabulary."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int = WINDOW) -> None:
        numbers: dict[int | None, int] = {}
        numbered = [numbers.setdefault(item, len(numbers)) for item, _ in items]
        #: Names of the items by number; an item without a name is only known by its words.
        self.names = list(numbers)
        self.vocabulary: dict[bytes, int] = {}
        self.windows: dict[int, Windows] = {}
        known, parts, lengths = self.vocabulary, [], []
        for _, text in items:
            ids = [known.setdefault(w, len(known) + 1) for part in words_of(text) for w in part]
            parts.append(np.array([*ids, 0], np.int32))
            lengths.append(len(ids))
        self.words = np.concatenate([np.zeros(0, np.int32), *parts])
        sizes, names = np.array(lengths, np.int64), np.array(numbered, np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        for size in sorted({min(window, n) for n in lengths if n}):
            fits = sizes >= size if size == window else sizes == size
            n = np.where(fits, sizes - size + 1, 0)
            owner = np.repeat(np.arange(len(n)), n)
            places = starts[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            self.windows[size] = self._distinct(size, places, names[owner])

    def _distinct(self, size: int, places: np.ndarray, items: np.ndarray) -> Windows:
        hashes = _rolled(self.words, size)[places]
        order = np.lexsort((items, hashes))
        hashes, places, items = hashes[order], places[order], items[order]
        new, kept = np.ones(len(order), bool), np.ones(len(order), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | ~_same(self.words, places[1:], self.words, places[:-1], size)
        kept[1:] = new[1:] | (items[1:] != items[:-1])
        number = np.cumsum(new) - 1
        bounds = np.searchsorted(number[kept], np.arange(number[-1] + 2))
        return Windows(hashes[new], places[new], bounds, items[kept])

    def numbers(self, text: bytes) -> np.ndarray:
        get = self.vocabulary.get
        parts = [np.fromiter(map(get, words, repeat(0)), np.int64, len(words)) for words in words_of(text)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, first words, windows) of all occurrences; ids may hold several texts divided by 0."""
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        for size, known in self.windows.items():
            if len(ids) < size:
                continue
            places = np.flatnonzero(unknown[size:] == unknown[:-size])
            values = _rolled(ids, size)[places]
            at = np.searchsorted(known.hashes, values)
            while len(places):  # again only where windows share a hash
                live = known.hashes[np.minimum(at, len(known.hashes) - 1)] == values
                live &= at < len(known.hashes)
                places, values, at = places[live], values[live], at[live]
                same = _same(ids, places, self.words, known.places[at], size)
                if same.any():
                    yield size, places[same], at[same]
                at = at + 1


def _same(words: np.ndarray, places: np.ndarray, others: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Whether the ``size`` words from each place on are those of the others."""
    same = np.ones(len(places), bool)
    for k in range(size):
        same &= words[places + k] == others[at + k]
    return same


def _rolled(ids: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` numbers from each place on."""
    numbers = ids.astype(np.uint64)
    out = np.zeros(max(0, len(ids) - size + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = out * _BASE + numbers[i : i + len(out)] * np.uint64(0xD6E8FEB86659FD93)
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def findings_of(index: Index, texts: list[bytes | None], before: list[dict | None]) -> list[dict]:
    """What the index finds in each text, joined with what earlier blocks found."""
    arrays = [index.numbers(t or b"") for t in texts]
    out, start = [], 0
    while start < len(arrays):
        end, n = start, 0
        while end < len(arrays) and (end == start or n < 1 << 20):
            n += len(arrays[end]) + 1
            end += 1
        starts = np.cumsum([0] + [len(a) + 1 for a in arrays[start:end]])
        flat = np.zeros(n, np.int64)
        for at, a in zip(starts, arrays[start:end]):
            flat[at : at + len(a)] = a
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        items: dict[int, set[int]] = defaultdict(set)
        for size, places, which in index.hits(flat):
            owners = np.searchsorted(starts, places, side="right") - 1
            cuts = np.flatnonzero(np.diff(owners)) + 1
            for first, some, k in zip(np.split(places, cuts), np.split(which, cuts), owners[[0, *cuts]].tolist()):
                spans[k].extend((i, i + size) for i in (first - starts[k]).tolist())
                found = (index.names[n] for n in index.windows[size].items_of(some).tolist())
                items[k].update(name for name in found if name is not None)
        for k, old in enumerate(before[start:end]):
            old = old or {"items": [], "spans": []}
            ranges = _merged(spans.get(k, []) + [(s["first"], s["last"]) for s in old["spans"]])
            out.append(
                {
                    "n_words": len(arrays[start + k]),
                    "n_hit": sum(b - a for a, b in ranges),
                    "items": sorted(items.get(k, set()) | set(old["items"])),
                    "spans": [{"first": a, "last": b} for a, b in ranges],
                }
            )
        start = end
    return out


def blocks_of(benchmark: DataFrame, max_bytes: int = INDEX_BYTES) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items with a text in blocks of about ``max_bytes``. Rows without item_id have no name, but their words count."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    items = items.where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // max_bytes)
    items = work.written(items, "benchmark") if n > 1 else items
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r["item_id"], bytes(r["text"])) for r in block.toLocalIterator()]


def annotated(docs: DataFrame, benchmark: DataFrame, name: str, window: int = WINDOW, max_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows with a struct column ``name`` of findings: n_words, n_hit, items (sorted) and spans in words [first, last).

    Narrow: no shuffle, all other columns pass through as they are. The benchmark is broadcast as an index of at most
    ``max_bytes`` of text (about four times that in memory); beyond that each further block of it is one more scan of the texts,
    of which only rows with hits are written, and these are joined before the last block. Takes a stored table. A text that
    is null or has no words gets zeros and empty arrays, and so does every text if the benchmark is empty. Repeated rows are
    judged alike. An item of fewer words than the window, but not none, is one window. Words of an
    item without item_id are hit like others; it isn't among the items.
    """
    out = docs.withColumn(name, F.lit(None).cast(FINDINGS))
    blocks = blocks_of(benchmark, max_bytes)
    block, earlier = next(blocks, []), None
    row = work.unused(out, "row")
    rows = work.numbered(docs, row)
    for following in blocks:
        found = _searched(rows.select(row, "text", F.lit(None).cast(FINDINGS).alias(name)), block, name, window)
        found = work.written(found.where(F.col(f"{name}.n_hit") > 0).select(row, name), "hits")
        earlier = found if earlier is None else earlier.unionByName(found)
        block = following
    if earlier is not None:
        lists = earlier.groupBy(row).agg(F.collect_list(name).alias(name))  # one entry a block at most
        each = lambda field: F.flatten(F.transform(name, lambda f: f[field])).alias(field)
        joined = F.struct(F.lit(0).alias("n_words"), F.lit(0).alias("n_hit"), each("items"), each("spans")).cast(FINDINGS)
        out = rows.join(lists.select(row, joined.alias(name)), row, "left").drop(row)
    return _searched(out, block, name, window)


def _searched(rows: DataFrame, block: list[tuple[int | None, bytes]], name: str, window: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(Index(block, window))
    return rows.mapInArrow(_pass(shared, name), rows.schema)


def _pass(shared, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            place = batch.schema.get_field_index(name)
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
            found = findings_of(index, texts, batch.column(place).to_pylist())
            yield batch.set_column(place, batch.schema.field(place), pa.array(found, batch.schema.field(place).type))

    return run


def contaminated(name: str, share: float = SHARE):
    """Whether the hit words of the findings in a column reach the share; integers where the share is 1/k."""
    per = round(1 / share)
    return (F.col(f"{name}.n_hit") > 0) & (per * F.col(f"{name}.n_hit") >= F.col(f"{name}.n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows that aren't contaminated, with all their columns."""
    name = work.unused(docs, "findings")
    return annotated(docs, benchmark, name, **options).where(~contaminated(name)).drop(name)


def remove_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """All rows, the words of every hit span cut out of the text together with what stands between them."""
    name = work.unused(docs, "findings")
    found = annotated(docs, benchmark, name, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index("text")
            texts, findings = batch.column(place).to_pylist(), batch.column(batch.schema.get_field_index(name)).to_pylist()
            cut = [_cut(t, f["spans"]) if f["spans"] else t for t, f in zip(texts, findings)]
            yield batch.set_column(place, batch.schema.field(place), pa.array(cut, batch.schema.field(place).type))

    return found.mapInArrow(run, found.schema).drop(name)


def _cut(text: str, spans: list[dict]) -> str:
    data = text.encode()
    plain, places, at = data.translate(_WORD_BYTES), [], 0
    for word in plain.split():
        at = plain.index(word, at)
        places.append((at, at + len(word)))
        at += len(word)
    out, last = [], 0
    for span in spans:
        out.append(data[last : places[span["first"]][0]])
        last = places[span["last"] - 1][1]
    return b"".join([*out, data[last:]]).decode()
