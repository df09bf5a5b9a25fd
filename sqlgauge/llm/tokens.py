"""Token ids of whole texts by a tokenizers file, for whole Arrow batches.

The byte-level pattern always ends a token before a space that follows a visible character, between a Latin letter and a
mark, and around a single line feed between a visible character and a letter. Texts are cut there, and each distinct
piece of a batch is encoded once, many in a call. Texts where a space stands between other white space, or behind it
at the end, are encoded in one go, since runs of white space are divided by what follows them.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACES = r"\t\n\x{0B}\f\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_LETTERS = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}"
#: Texts that may not be cut; zero characters mark the cuts.
_WHOLE = rf"[{_SPACES}] ([{_SPACES}]|\z)|\x00"
#: Pieces that can be encoded side by side, with a line feed between them that is a token of its own.
_PLAIN = rf"\A ?[!-~{_LETTERS}]{{1,64}}\z"
#: Text that is cut at once; its pieces, codes and places take some 20 times as much.
_BATCH_BYTES = 4 << 20
_JOINED = 1024
#: Distinct pieces whose ids a worker remembers, about 50 bytes each; beyond that it keeps those of the last batch.
REMEMBERED = 1_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    def __init__(self, path: str, special_as_text: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        made = json.loads(self.tokenizer.to_str())
        #: Strings that stand for one id wherever they occur; texts that hold one aren't cut.
        self.added = [t["content"] for t in made["added_tokens"] if not (special_as_text and t["special"])]
        cut = made["pre_tokenizer"] or {}
        bytes_only = cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]
        self.line = self.whole("\n")
        #: Whether texts may be cut; other kinds of tokenizers get whole texts.
        self.cuts = bytes_only and not made["normalizer"] and not made["post_processor"] and len(self.line) == 1
        self.names = pa.array([], pa.large_string())
        self.table, self.starts, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def size(self) -> int:
        return self.tokenizer.get_vocab_size()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _remembered(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As _pieces, of which only the pieces that aren't remembered are encoded."""
        # looked for among the few names of this batch: a table of all that are remembered would be built each time
        found = pc.fill_null(pc.index_in(self.names, value_set=names), -1).to_numpy()
        known = np.flatnonzero(found >= 0)
        places = np.full(len(names), -1, np.int64)
        places[found[known]] = known
        fresh = places < 0
        table, starts, sizes = self._pieces(names.filter(pa.array(fresh)))
        places[fresh] = len(self.names) + np.arange(len(sizes))
        self.names = pa.concat_arrays([self.names, names.filter(pa.array(fresh))])
        self.starts = np.concatenate([self.starts, starts + len(self.table)])
        self.sizes, self.table = np.concatenate([self.sizes, sizes]), np.concatenate([self.table, table])
        found = self.table, self.starts[places], self.sizes[places]
        if len(self.names) > REMEMBERED:
            self.names, self.sizes = names, found[2]
            self.table, self.starts = _gathered(*found), np.cumsum(found[2]) - found[2]
        return found

    def _pieces(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct pieces in one array, and the start and number of those of each."""
        plain = pc.match_substring_regex(names, _PLAIN).to_numpy(zero_copy_only=False)
        some = names.filter(pa.array(plain)).to_pylist()
        joined = ["\n".join(some[k : k + _JOINED]) + "\n" for k in range(0, len(some), _JOINED)]
        ids = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate(ids) if ids else np.zeros(0, "<u4")
        ends = np.flatnonzero(ids == self.line[0])
        others = [self.whole(p) for p in names.filter(pa.array(~plain)).to_pylist()]
        starts, sizes = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        starts[plain] = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else 0
        sizes[plain] = ends - starts[plain]
        sizes[~plain] = [len(o) for o in others]
        starts[~plain] = len(ids) + np.cumsum(sizes[~plain]) - sizes[~plain]
        return np.concatenate([ids, *others]), starts, sizes

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts that may be cut, and the number of ids of each text."""
        marked = pc.replace_substring(texts, " ", "\0 ")
        marked = pc.replace_substring_regex(marked, rf"([{_LETTERS}])([.,;:!?])", "\\1\0\\2")
        marked = pc.replace_substring_regex(marked, rf"([^{_SPACES}\x00])\n([{_LETTERS}])", "\\1\0\n\0\\2")
        pieces = pc.split_pattern(marked, "\0")
        offsets = pieces.offsets.to_numpy()
        coded = pc.list_flatten(pieces).dictionary_encode()
        table, starts, sizes = self._remembered(coded.dictionary)
        codes = coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[codes])])
        counts = np.diff(ends[offsets - offsets[0]])
        return _gathered(table, starts[codes], sizes[codes]), counts

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text in order; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(texts):
            until = (ends[start - 1] if start else 0) + _BATCH_BYTES
            end = max(start + 1, int(np.searchsorted(ends, until, side="right")))
            part = texts[start:end]
            whole = pc.match_substring_regex(part, _WHOLE).to_numpy(zero_copy_only=False) | (not self.cuts)
            for string in self.added:
                whole = whole | pc.match_substring(part, string).to_numpy(zero_copy_only=False)
            ids, counts = self._cut(part.filter(pa.array(~whole)))
            until, seen = np.cumsum(counts), 0
            for k in range(len(part)):
                if whole[k]:
                    yield self.whole(part[k].as_py())
                else:
                    yield ids[until[seen] - counts[seen] : until[seen]]
                    seen += 1
            start = end


def _gathered(table: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges of a table one after another."""
    places = np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
    places += np.arange(len(places))
    return table[places]


@lru_cache(2)
def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """One for each worker process, file and way to read the strings of special tokens: as their ids, or as ordinary text."""
    return Encoder(path, special_as_text)
