"""Count transducers: acyclic automata over words whose paths of one to three words carry counts.

Phrases come sorted, so a state is complete once the prefix that leads to it ends; complete states are looked up in a
register and equal ones (the same arcs with the same counts and targets) are one. Two phrases compare like their words
with a space behind each, byte by byte; words hold no spaces, hence the order of phrases is that of their word tuples.
"""

from __future__ import annotations

import io
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LONGEST = 3


class Phrases(NamedTuple):
    """Sorted distinct phrases of one length: the codes of their words, one column a word, and counts."""

    codes: np.ndarray
    counts: np.ndarray


def sorted_words(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words in order, and the place of each of the given distinct words among them."""
    ended = pc.binary_join_element_wise(words, pa.scalar(b"", pa.large_binary()), pa.scalar(b" ", pa.large_binary()))
    order = pc.array_sort_indices(ended).to_numpy()
    places = np.empty(len(order), np.int64)
    places[order] = np.arange(len(order))
    return words.take(pa.array(order)), places


def summed(codes: np.ndarray, counts: np.ndarray | None, n_words: int) -> Phrases:
    """Sorts phrases and adds up the counts of equal ones; without counts each occurrence counts one."""
    if not len(codes):
        return Phrases(codes, np.zeros(0, np.int64))
    key = codes[:, 0].astype(np.int64)
    for k in range(1, codes.shape[1]):
        if n_words ** (k + 1) >= 1 << 62:  # three codes beyond 64 bits: number the pairs first
            key = np.unique(key, return_inverse=True)[1]
        key = key * n_words + codes[:, k]
    order = np.argsort(key, kind="stable")
    key = key[order]
    firsts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sums = np.diff(np.append(firsts, len(key))) if counts is None else np.add.reduceat(counts[order], firsts)
    return Phrases(codes[order[firsts]], sums.astype(np.int64))


def occurring(codes: np.ndarray, starts: np.ndarray, length: int, n_words: int) -> Phrases:
    """The phrases of so many words at the given places of a text, sorted and counted."""
    if n_words**length >= 1 << 62:  # a key would pass 64 bits
        return summed(np.column_stack([codes[starts + i] for i in range(length)]), None, n_words)
    key = codes[starts].astype(np.int64)
    for i in range(1, length):
        key *= n_words
        key += codes[starts + i]
    key.sort()
    firsts = np.flatnonzero(key[1:] != key[:-1]) + 1
    firsts = np.concatenate([[0], firsts]).astype(np.int64) if len(key) else firsts
    counts = np.diff(np.append(firsts, len(key))).astype(np.int64)
    key = key[firsts]
    columns = []
    for _ in range(length):
        columns.append(key % max(n_words, 1))
        key = key // max(n_words, 1)
    return Phrases(np.column_stack(columns[::-1]), counts)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


class Transducer(NamedTuple):
    """Arcs grouped by state, labels ascending in each; ``targets`` are states, -1 where no arc follows. The root is the last state."""

    words: pa.Array
    labels: np.ndarray
    weights: np.ndarray
    targets: np.ndarray
    firsts: np.ndarray  # of each state its first arc, and the number of arcs

    @property
    def size(self) -> int:
        return len(self.labels)

    def packed(self) -> bytes:
        out = io.BytesIO()
        lengths = pc.binary_length(self.words).to_numpy(zero_copy_only=False)
        for values in (lengths, self.labels, self.weights, self.targets, self.firsts):
            small = np.int32 if max(len(values) and values.max(), 0) < 1 << 31 else np.int64
            np.save(out, values.astype(small), allow_pickle=False)
        out.write(b"".join(self.words.to_pylist()))
        raw = out.getvalue()
        return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)

    def paths(self) -> list[Phrases]:
        """The phrases with counts, by length. An arc without a count is only passed on the way to longer phrases."""
        codes = np.zeros((1, 0), np.int64)
        states = np.array([len(self.firsts) - 2])
        found = []
        for _ in range(LONGEST):
            sizes = np.where(states >= 0, self.firsts[states + 1] - self.firsts[states], 0)
            arcs = _ranges(self.firsts[states], sizes)
            codes = np.column_stack([np.repeat(codes, sizes, axis=0), self.labels[arcs]])
            states, weights = self.targets[arcs].astype(np.int64), self.weights[arcs]
            found.append(Phrases(codes[weights > 0], weights[weights > 0]))
        return found

    def compose(self, asked: Transducer) -> list[Phrases]:
        """The phrases of another automaton that this one holds too, with their counts here; codes are the other's.

        Both are walked at once: a pair of states goes on where both have an arc for the word.
        """
        own = pc.fill_null(pc.index_in(asked.words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        n = len(self.words) + 1
        arcs_of = np.repeat(np.arange(len(self.firsts) - 1), np.diff(self.firsts))
        keys = arcs_of * n + self.labels
        codes = np.zeros((1, 0), np.int64)
        theirs, ours = np.array([len(asked.firsts) - 2]), np.array([len(self.firsts) - 2])
        found = []
        for _ in range(LONGEST):
            sizes = np.where(theirs >= 0, asked.firsts[theirs + 1] - asked.firsts[theirs], 0)
            arcs = _ranges(asked.firsts[theirs], sizes)
            codes = np.column_stack([np.repeat(codes, sizes, axis=0), asked.labels[arcs]])
            state, word = np.repeat(ours, sizes), own[asked.labels[arcs]]
            at = np.minimum(np.searchsorted(keys, state * n + word), max(len(keys) - 1, 0))
            both = (state >= 0) & (word >= 0) & (keys[at] == state * n + word) if len(keys) else np.zeros(len(arcs), bool)
            codes, arcs, at = codes[both], arcs[both], at[both]
            theirs, ours = asked.targets[arcs].astype(np.int64), self.targets[at].astype(np.int64)
            held = (asked.weights[arcs] > 0) & (self.weights[at] > 0)
            found.append(Phrases(codes[held], self.weights[at][held]))
        return found


def _registered(labels: np.ndarray, weights: np.ndarray, targets: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each complete state its number among the different ones, and of those the first state that is equal."""
    sizes = np.diff(firsts)
    states = np.zeros(len(sizes), np.int64)
    single = np.flatnonzero(sizes == 1)
    arcs = firsts[single]
    order = np.lexsort((targets[arcs], weights[arcs], labels[arcs]))
    arcs = arcs[order]
    fresh = np.ones(len(arcs), bool)
    for values in (labels, weights, targets):
        fresh[1:] &= values[arcs[1:]] == values[arcs[:-1]]
    fresh[1:] = ~fresh[1:]
    states[single[order]] = np.cumsum(fresh) - 1
    kept = single[order][fresh].tolist()
    register: dict[bytes, int] = {}
    data = np.column_stack([labels, weights, targets]).astype(np.int64).tobytes()
    several = np.flatnonzero(sizes > 1)
    for k, a, b in zip(several.tolist(), firsts[several].tolist(), firsts[several + 1].tolist()):
        number = register.setdefault(data[24 * a : 24 * b], len(kept))
        if number == len(kept):
            kept.append(k)
        states[k] = number
    return states, np.array(kept, np.int64)


def _both(some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """All of two sorted lists without repeats, sorted."""
    at = np.minimum(np.searchsorted(some, others), max(len(some) - 1, 0))
    missing = others[some[at] != others] if len(some) else others
    return np.sort(np.concatenate([some, missing])) if len(missing) else some


def build(words: pa.Array, phrases: Sequence[Phrases]) -> Transducer:
    """The smallest automaton of this kind for sorted phrases of one, two and three words over sorted words."""
    n = len(words)
    labels, weights, targets, firsts, states, n_arcs = [], [], [], [np.zeros(1, np.int64)], 0, 0
    below_keys, below_states = np.zeros(0, np.int64), np.zeros(0, np.int64)  # prefixes with arcs below them, and where they lead
    pairs = [phrases[1].codes[:, 0] * n + phrases[1].codes[:, 1], phrases[2].codes[:, 0] * n + phrases[2].codes[:, 1]]
    for length in (3, 2, 1):
        own = phrases[length - 1]
        if length == 3:
            keys, last = pairs[1], own.codes[:, 2]
            counts, to = own.counts, np.full(len(own.counts), -1, np.int64)
        else:
            whole = pairs[0] if length == 2 else own.codes[:, 0]
            every = _both(whole, below_keys)  # with prefixes that are no phrases themselves
            counts, to = np.zeros(len(every), np.int64), np.full(len(every), -1, np.int64)
            counts[np.searchsorted(every, whole)] = own.counts
            to[np.searchsorted(every, below_keys)] = below_states
            keys, last = (every // n, every % n) if length == 2 else (np.zeros(len(every), np.int64), every)
        opens = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        groups = np.append(opens, len(keys))
        numbers, kept = _registered(last, counts, to, groups)
        arcs = _ranges(groups[kept], np.diff(groups)[kept])
        labels.append(last[arcs])
        weights.append(counts[arcs])
        targets.append(to[arcs])
        firsts.append(n_arcs + np.cumsum(np.diff(groups)[kept]))
        n_arcs += len(arcs)
        below_keys, below_states = keys[opens], numbers + states
        states += len(kept)
    if not states:
        firsts.append(np.zeros(1, np.int64))  # a root without arcs
    return Transducer(
        words,
        np.concatenate(labels).astype(np.int64),
        np.concatenate(weights),
        np.concatenate(targets),
        np.concatenate(firsts).astype(np.int64),
    )


def unpacked(data: bytes) -> Transducer:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd")
    source = io.BytesIO(raw.to_pybytes())
    lengths, labels, weights, targets, firsts = (np.load(source, allow_pickle=False).astype(np.int64) for _ in range(5))
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    rest = source.read()
    words = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(rest)])
    return Transducer(words, labels, weights, targets, firsts)


def used(words: pa.Array, phrases: Sequence[Phrases]) -> tuple[pa.Array, list[Phrases]]:
    """Sorted words without those that no phrase uses, and the phrases with new codes."""
    held = np.zeros(len(words), bool)
    for p in phrases:
        held[p.codes.reshape(-1)] = True
    new = np.cumsum(held) - 1
    return words.filter(pa.array(held)), [Phrases(new[p.codes].reshape(p.codes.shape), p.counts) for p in phrases]


def union(parts: Sequence[Transducer]) -> tuple[pa.Array, list[Phrases]]:
    """Words and phrases of all parts together, with the sums of their counts."""
    coded = pa.chunked_array([p.words for p in parts], pa.large_binary()).combine_chunks().dictionary_encode()
    words, places = sorted_words(coded.dictionary)
    codes = places[coded.indices.to_numpy(zero_copy_only=False)]
    starts = np.concatenate([[0], np.cumsum([len(p.words) for p in parts])])
    paths = [p.paths() for p in parts]
    found = []
    for k in range(LONGEST):
        of = [codes[start + path[k].codes].reshape(-1, k + 1) for start, path in zip(starts.tolist(), paths)]
        found.append(summed(np.concatenate(of), np.concatenate([path[k].counts for path in paths]), len(words)))
    return words, found


def texts(words: pa.Array, phrases: Phrases) -> pa.Array:
    """The words of each phrase with spaces between them."""
    columns = [words.take(pa.array(phrases.codes[:, k])) for k in range(phrases.codes.shape[1])]
    if len(columns) == 1:
        return columns[0]
    return pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.large_binary()))
