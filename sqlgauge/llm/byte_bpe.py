"""Byte-level BPE over whole texts by a file of ranks, and decoding, without regular expressions.

Text is cut as by the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

An array gives each code point its class, two shifted comparisons add what the pattern looks ahead for, and the rest is
an automaton of eight states. A symbol is a function from states to states; functions compose, and composition is
associative. So a batch of texts is laid out in rows of WIDTH symbols: all rows compose their functions side by
side, a prefix scan over the rows gives the state before each of them, and all rows run once more from that state and
mark where a token may start. The slices between the marks are looked up in a cache of merged pieces; only pieces that
are not there are merged, pair by pair, the lowest rank first. Where each token starts in its text is kept with the ids.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

#: Bytes of text laid out at once, and symbols in a row of the layout.
PART_BYTES = 1 << 20
WIDTH = 64
#: Merged pieces that a worker remembers; beyond that it starts afresh.
REMEMBERED = 200_000
#: Pieces of more bytes are merged by a heap.
LONG = 64

# Classes of code points; letters and the apostrophe that contractions need have their own.
_OTHER, _LETTER, _NUMBER, _WHITE, _SPACE, _QUOTE, _ONE, _R, _V, _L, _E, _END = range(12)
_BEYOND = 0x110000  # stands between texts
# Symbols: a code point and what the pattern looks ahead for.
(_OTHERS, _LETTERS, _NUMBERS, _INNER, _LAST_WHITE, _LAST_SPACE, _QUOTE_ONE, _QUOTE_TWO, _RESET) = range(9)
# States: what the code point before belongs to.
(_FRESH, _ATTACHED, _WORD, _DIGITS, _SIGNS, _BLANKS, _ONE_MORE, _TWO_MORE) = range(8)
_STATES = 8


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def code_point_classes() -> bytes:
    """The class of every code point, by the letters, numbers and white space that the tiktoken library knows."""
    import tiktoken

    points = np.array([c for c in range(_BEYOND) if not 0xD800 <= c < 0xE000], "<u4")
    every = points.tobytes().decode("utf-32-le")
    single = {bytes([b]): b for b in range(256)}
    classes = np.full(_BEYOND + 1, _OTHER, np.uint8)
    for pattern, value in ((r"\p{L}", _LETTER), (r"\p{N}", _NUMBER), (r"\s", _WHITE)):
        found = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
        classes[np.frombuffer(bytes(found).decode().encode("utf-32-le"), "<u4")] = value
    for text, value in ((" ", _SPACE), ("'", _QUOTE), ("stmd", _ONE), ("r", _R), ("v", _V), ("l", _L), ("e", _E)):
        for c in text:
            classes[ord(c)] = value
    classes[_BEYOND] = _END
    return classes.tobytes()


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """For each symbol and state the next state, and whether a token starts at the symbol."""
    after = np.zeros((9, _STATES), np.uint8)
    starts = np.ones((9, _STATES), bool)
    for symbol, own in ((_LETTERS, _WORD), (_NUMBERS, _DIGITS), (_OTHERS, _SIGNS)):
        after[symbol] = own
        starts[symbol, [own, _ATTACHED]] = False
    after[_LETTERS, [_ONE_MORE, _TWO_MORE]] = [_FRESH, _ONE_MORE]
    starts[_LETTERS, [_ONE_MORE, _TWO_MORE]] = False
    for symbol, opened in ((_QUOTE_ONE, _ONE_MORE), (_QUOTE_TWO, _TWO_MORE)):
        after[symbol] = opened
        after[symbol, [_SIGNS, _ATTACHED]] = _SIGNS
        starts[symbol, [_SIGNS, _ATTACHED]] = False
    after[_INNER] = _BLANKS
    starts[_INNER, _BLANKS] = False
    after[_LAST_WHITE] = _FRESH
    after[_LAST_SPACE] = _ATTACHED
    after[_RESET] = _FRESH
    return after, starts


_AFTER, _STARTS = _automaton()


def symbols(points: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The symbol of each code point; the last one has to be the end of a text."""
    own = classes[points]
    ahead = np.append(own[1:], _END)
    further = np.append(own[2:], [_END, _END])[: len(own)]
    out = np.full(len(own), _LETTERS, np.uint8)
    out[own == _OTHER] = _OTHERS
    out[own == _NUMBER] = _NUMBERS
    out[own == _END] = _RESET
    white = (own == _WHITE) | (own == _SPACE)
    last = white & ~((ahead == _WHITE) | (ahead == _SPACE) | (ahead == _END))
    out[white] = _INNER
    out[last] = np.where(own[last] == _SPACE, _LAST_SPACE, _LAST_WHITE)
    two = ((ahead == _L) & (further == _L)) | (((ahead == _R) | (ahead == _V)) & (further == _E))
    quote = own == _QUOTE
    out[quote] = np.where(ahead[quote] == _ONE, _QUOTE_ONE, np.where(two[quote], _QUOTE_TWO, _OTHERS))
    return out


def token_starts(given: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Whether a piece starts at each symbol, by an associative scan of transition functions."""
    n = len(given)
    rows = -(-n // width)
    laid = np.full(rows * width, _RESET, np.uint8)
    laid[:n] = given
    laid = np.ascontiguousarray(laid.reshape(rows, width).T)
    function = np.tile(np.arange(_STATES, dtype=np.uint8), (rows, 1))
    table = _AFTER.reshape(-1)
    for column in laid:
        function = table[(column.astype(np.int16) * _STATES)[:, None] + function]
    step = 1
    while step < rows:  # each row's function becomes that of all rows up to it
        function[step:] = np.take_along_axis(function[step:], function[:-step].copy(), axis=1)
        step *= 2
    state = np.append(np.uint8(_FRESH), function[:-1, _FRESH]) if rows else np.zeros(0, np.uint8)
    marks = np.empty((width, rows), bool)
    opens = _STARTS.reshape(-1)
    for k, column in enumerate(laid):
        place = column.astype(np.int16) * _STATES + state
        marks[k] = opens[place]
        state = table[place]
    return marks.T.reshape(-1)[:n]


class Pairs:
    """The ids of pairs of tokens that are tokens together."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.n = max(ranks.values(), default=0) + 1
        found = []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    found.append((left * self.n + right, rank))
        table = np.array(sorted(found), np.int64).reshape(-1, 2)
        self.keys, self.ranks = np.ascontiguousarray(table[:, 0]), np.append(table[:, 1], self.n)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id of each pair, or n where it is no token."""
        key = left * self.n + right
        at = np.searchsorted(self.keys, key)
        at[np.append(self.keys, -1)[at] != key] = len(self.keys)
        return self.ranks[at]


def merge(pieces: list[bytes], ranks: dict[bytes, int], pairs: Pairs) -> list[bytes]:
    """The ids of distinct pieces, as bytes.

    Of all neighbours in a piece the pair of the lowest rank is joined, the first of several, until none is left. Short
    pieces are merged side by side, one pair of each in a round; long ones by a heap.
    """
    out: list[bytes] = [b""] * len(pieces)
    short = []
    for k, piece in enumerate(pieces):
        whole = ranks.get(piece)
        if whole is not None:
            out[k] = whole.to_bytes(4, "little")
        elif len(piece) > LONG:
            bounds = _merged_long(piece, ranks)
            out[k] = np.array([ranks[piece[a:b]] for a, b in zip(bounds, bounds[1:])], "<u4").tobytes()
        else:
            short.append(k)
    sizes = np.array([len(pieces[k]) for k in short], np.int64)
    tokens = pairs.single[np.frombuffer(b"".join(pieces[k] for k in short), np.uint8)]
    owner = np.repeat(np.arange(len(short)), sizes)
    joined = np.append(pairs.of(tokens[:-1], tokens[1:]), pairs.n) if len(tokens) else tokens
    joined[np.append(owner[1:] != owner[:-1], True)[: len(joined)]] = pairs.n  # behind the last token of a piece
    while len(tokens):
        firsts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        counts = np.diff(np.append(firsts, len(tokens)))
        least = np.minimum.reduceat(joined, firsts)
        done = least == pairs.n
        if done.any():
            data = tokens[np.repeat(done, counts)].astype("<u4").tobytes()
            ends = 4 * np.cumsum(counts[done])
            for k, a, b in zip(owner[firsts[done]].tolist(), (ends - 4 * counts[done]).tolist(), ends.tolist()):
                out[short[k]] = data[a:b]
            rest = np.repeat(~done, counts)
            tokens, owner, joined, counts, least = tokens[rest], owner[rest], joined[rest], counts[~done], least[~done]
            if not len(tokens):
                break
        at = np.flatnonzero(joined == np.repeat(least, counts))
        at = at[np.append(True, owner[at[1:]] != owner[at[:-1]])]  # the first of each piece
        tokens[at] = least
        stays = np.ones(len(tokens), bool)
        stays[at + 1] = False
        joined[at] = joined[at + 1]
        at -= np.arange(len(at))  # their places once one token of each piece before them is gone
        tokens, owner, joined = tokens[stays], owner[stays], joined[stays]
        for k in (at - 1, at):
            k = k[(k >= 0) & (k + 1 < len(tokens))]
            k = k[owner[k] == owner[k + 1]]
            joined[k] = pairs.of(tokens[k], tokens[k + 1])
    return out


def _merged_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The bounds of the tokens of a piece, in time n log n."""
    n = len(piece)
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # by start of a part: its end, and where the part before it starts
    heap = [(ranks[piece[k : k + 2]], k, k + 1, k + 2) for k in range(n - 1) if piece[k : k + 2] in ranks]
    heapq.heapify(heap)

    def offer(start: int, middle: int) -> None:
        rank = ranks.get(piece[start : ends[middle]])
        if rank is not None:
            heapq.heappush(heap, (rank, start, middle, ends[middle]))

    while heap:
        _, start, middle, end = heapq.heappop(heap)
        if ends[start] != middle or ends[middle] != end:
            continue  # one of the two has been joined since
        ends[start], ends[middle] = end, -1
        if end < n:
            before[end] = start
            offer(start, end)
        if before[start] >= 0:
            offer(before[start], start)
    bounds = [0]
    while bounds[-1] < n:
        bounds.append(ends[bounds[-1]])
    return bounds


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of ranges, one after another."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


class Codec:
    def __init__(self, path: str, classes: bytes) -> None:
        self.ranks = read_ranks(path)
        self.classes = np.frombuffer(classes, np.uint8)
        self.pairs = Pairs(self.ranks)
        self.cache: dict[bytes, bytes] = {}
        names = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            names[rank] = token
        self.sizes = np.array([len(t) for t in names], np.int64)
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(names), np.uint8)

    def _merged(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces; those that are not remembered are merged."""
        found = [self.cache.get(p) for p in pieces]
        fresh = [k for k, ids in enumerate(found) if ids is None]
        if len(self.cache) + len(fresh) > REMEMBERED:
            self.cache.clear()
        for k, ids in zip(fresh, merge([pieces[k] for k in fresh], self.ranks, self.pairs)):
            found[k] = ids
            if len(pieces[k]) <= LONG:
                self.cache[pieces[k]] = ids
        return found

    def encode(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of each text and the byte at which each of them starts."""
        data = b"".join(texts)
        text_sizes = np.array([len(t) for t in texts], np.int64)
        plain = np.frombuffer(data.decode().encode("utf-32-le"), "<u4")
        lengths = 1 + (plain >= 0x80).astype(np.int8) + (plain >= 0x800) + (plain >= 0x10000)
        ends = np.searchsorted(np.cumsum(lengths, dtype=np.int64), np.cumsum(text_sizes), side="left") + (text_sizes > 0)
        ends = np.maximum.accumulate(ends)
        points = np.insert(plain, ends, _BEYOND)
        marks = token_starts(symbols(points, self.classes))
        starts = np.concatenate([[0], np.cumsum(np.insert(lengths.astype(np.int64), ends, 0))])[:-1][marks]
        bounds = np.append(starts, len(data))
        bounds = bounds[np.diff(bounds, prepend=-1) > 0]  # ends of texts have no bytes and fall together with starts
        pieces = pa.Array.from_buffers(
            pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)]
        )
        coded = pieces.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        found = self._merged(coded.dictionary.to_pylist())
        sizes = np.array([len(f) for f in found], np.int64) // 4
        table = np.frombuffer(b"".join(found), "<u4")
        ids = table[_ranges((np.cumsum(sizes) - sizes)[codes], sizes[codes])]
        places = np.concatenate([[0], np.cumsum(self.sizes[ids])])
        firsts = np.cumsum(text_sizes) - text_sizes
        cuts = np.searchsorted(places, np.append(firsts, len(data)), side="left")
        for first, a, b in zip(firsts.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
            yield ids[a:b], places[a:b] - first

    def decode(self, ids: np.ndarray, offsets: np.ndarray | None = None) -> bytes:
        """The bytes of the ids. Offsets, where given, have to agree with the sizes of the tokens."""
        if offsets is not None and not np.array_equal(offsets, np.cumsum(self.sizes[ids]) - self.sizes[ids]):
            raise ValueError("offsets of other ids")
        return self.bytes[_ranges(self.firsts[ids], self.sizes[ids])].tobytes()


@lru_cache(2)
def codec(path: str, classes: bytes) -> Codec:
    """One for each worker process and file."""
    return Codec(path, classes)


def cut(text: bytes, part_bytes: int = PART_BYTES) -> Iterator[bytes]:
    """A long text in parts, cut before spaces that follow a visible ASCII character, where a piece always starts."""
    start = 0
    while len(text) - start > part_bytes:
        at = text.find(b" ", start + part_bytes)
        while at >= 0 and not 0x20 < text[at - 1] < 0x7F:
            at = text.find(b" ", at + 1)
        if at < 0:
            break
        yield text[start:at]
        start = at
    yield text[start:]


def _groups(texts: pa.Array, part_bytes: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """The parts of all texts, each with its row and first byte, some at a time."""
    held, size = [], 0
    for row, text in enumerate(texts):
        first = 0
        for part in cut(text.as_py() or b"", part_bytes):
            if held and size + len(part) > part_bytes:
                yield held
                held, size = [], 0
            held.append((row, first, part))
            first += len(part)
            size += len(part)
    if held:
        yield held


def encode(docs: DataFrame, path: str | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, ids and offsets of each row: little-endian unsigned 32-bit integers, the offsets in bytes of the UTF-8 text.

    Nulls and empty texts have no ids; rows without doc_id and repeated rows are encoded like all others; other columns
    are not read; an empty table gives no rows. Texts of any length are encoded whole: a text beyond ``part_bytes`` is laid
    out in parts. No special tokens: their strings are ordinary text.
    """
    path = path or default_path()
    classes = docs.sparkSession.sparkContext.broadcast(code_point_classes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, classes.value)
        for batch in batches:
            first, ids, offsets = 0, [b""], [b""]  # of the row that is open and those after it
            for group in _groups(batch.column(1), part_bytes):
                for (row, start, _), (found, at) in zip(group, own.encode([part for _, _, part in group])):
                    while first + len(ids) <= row:
                        ids.append(b"")
                        offsets.append(b"")
                    ids[row - first] += found.astype("<u4").tobytes()
                    offsets[row - first] += (at + start).astype("<u4").tobytes()
                done = len(ids) - 1
                yield _encoded(batch.column(0)[first : first + done], ids[:done], offsets[:done])
                first, ids, offsets = first + done, ids[done:], offsets[done:]
            if len(batch):
                yield _encoded(batch.column(0)[first:], ids, offsets)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, offsets binary")


def _encoded(doc_ids: pa.Array, ids: list[bytes], offsets: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(ids, pa.binary()), pa.array(offsets, pa.binary())], ["doc_id", "ids", "offsets"])


def n_tokens(ids: Column | str) -> Column:
    return F.shiftright(F.octet_length(ids), 2).cast("long")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of ``encode`` with the bytes that their ids stand for as ``decoded``, held against the offsets.

    Null ids give no bytes.
    """
    path = path or default_path()
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, b"")
        for batch in batches:
            pairs = zip(batch.column("ids"), batch.column("offsets"))
            texts = [own.decode(*(np.frombuffer(x.as_py() or b"", "<u4") for x in pair)) for pair in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*names, "decoded"])

    schema = StructType([*encoded.schema.fields, StructField("decoded", BinaryType())])
    return encoded.mapInArrow(run, schema)
