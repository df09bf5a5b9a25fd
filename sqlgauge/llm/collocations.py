"""Phrases of two and three words that occur together more often than their parts would suggest, per language.

Each shard of texts counts its phrases, sorts them and builds count transducers from them (``transducers``), each
over a run of the sorted phrases. Limits drawn from the first phrases of all runs divide the phrases into prefix ranges;
runs are cut there, and what falls into a range meets in one task, which unites the transducers and sums their weights,
some at a time. A range holds a bounded number of phrases however often a first word occurs, since limits may fall behind
a second or third word. The parts of the candidates are then looked up by composing an automaton of the parts asked for
with the transducer of their range; ranges that many candidates ask for are copied to as many tasks as that takes.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlgauge.llm import transducers, work
from sqlgauge.llm.transducers import LONGEST, Phrases, Transducer

LEAST = 10
TOP = 2000
SCALE = 1_000_000

#: Bytes of text in a shard, phrases in a run, phrases of all shards in a range, and parts asked for in a task.
SHARD_BYTES = 12 << 20
RUN = 1 << 15
RANGE = 1 << 20
ASKED = 1 << 20
#: What a task holds beside one range and the parts to be added to it, in arcs, before it unites them.
FRESH = 1 << 18
#: Most limits between ranges and most bytes of one: what the driver and each task hold. Beyond RANGES * RANGE phrases of all
#: shards (10^11) ranges grow, and a task holds as many different phrases as its range has.
RANGES = 1 << 17
LIMIT_BYTES = 128

_KINDS = np.zeros(256, np.uint8)  # 0 word, 1 between words, 2 between pieces
_KINDS[[0x20, 0x09]] = 1
_KINDS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


class Shard(NamedTuple):
    n_words: int
    words: pa.Array
    phrases: list[Phrases]


def counted(texts: list[bytes]) -> Shard:
    """All phrases of some texts with their counts; A-Z lower-cased, no phrase across a mark that ends a piece."""
    data = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
    kinds = _KINDS[data]
    inside = kinds == 0
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edges = np.concatenate([[0] if len(inside) and inside[0] else [], edges, [len(inside)] if len(inside) and inside[-1] else []]).astype(np.int64)
    starts = edges[::2]
    offsets = np.concatenate([[0], np.cumsum(edges[1::2] - starts)]).astype(np.int64)
    held = pa.py_buffer(data[inside].tobytes())
    piece = np.searchsorted(np.flatnonzero(kinds == 2), starts).astype(np.int32)
    n_words = len(starts)
    del data, kinds, inside, edges, starts
    coded = pa.Array.from_buffers(pa.large_binary(), n_words, [None, pa.py_buffer(offsets), held]).dictionary_encode()
    words, places = transducers.sorted_words(coded.dictionary)
    codes = places.astype(np.int32)[coded.indices.to_numpy(zero_copy_only=False)]
    del coded, held, offsets
    phrases = []
    for k in range(1, LONGEST + 1):
        whole = np.flatnonzero(piece[: n_words - k + 1] == piece[k - 1 :]).astype(np.int32) if n_words >= k else np.zeros(0, np.int32)
        phrases.append(transducers.occurring(codes, whole, k, len(words)))
    return Shard(n_words, words, phrases)


def pieces_of(text: bytes, at_most: int) -> Iterator[bytes]:
    """A long text cut where pieces end, so that no phrase is cut."""
    start = 0
    while len(text) - start > at_most:
        kinds = _KINDS[np.frombuffer(text, np.uint8, at_most, start)]
        marks = np.flatnonzero(kinds == 2)
        end = start + int(marks[-1]) + 1 if len(marks) else start + at_most
        while not len(marks) and end < len(text) and _KINDS[text[end]] != 2:
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]


def runs(words: pa.Array, phrases: list[Phrases], run: int) -> Iterator[tuple[bytes, bytes, int, Transducer]]:
    """Transducers over runs of the sorted phrases of all lengths, with the first and last phrase and the number of phrases."""
    n = len(words)
    pairs = phrases[1].codes[:, 0] * n + phrases[1].codes[:, 1]
    # Every phrase comes behind its prefixes, all of which are phrases too.
    behind = np.searchsorted(pairs, phrases[2].codes[:, 0] * n + phrases[2].codes[:, 1])
    longer = np.searchsorted(behind, np.arange(len(pairs)), side="left")
    above = [np.arange(n), np.searchsorted(phrases[1].codes[:, 0], np.arange(n))]
    places = [
        above[0] + above[1] + np.append(longer, len(behind))[above[1]],
        np.arange(len(pairs)) + longer + phrases[1].codes[:, 0] + 1,
        np.arange(len(behind)) + behind + 1 + phrases[2].codes[:, 0] + 1,
    ]
    total = sum(len(p) for p in places)
    for start in range(0, total, run):
        cuts = [np.searchsorted(p, [start, min(start + run, total)]) for p in places]
        some = [Phrases(p.codes[a:b], p.counts[a:b]) for p, (a, b) in zip(phrases, cuts)]
        ends = []
        for wanted in (start, min(start + run, total) - 1):
            k = next(k for k in range(LONGEST) if (at := int(np.searchsorted(places[k], wanted))) < len(places[k]) and places[k][at] == wanted)
            ends.append(b" ".join(w.as_py() for w in words.take(pa.array(phrases[k].codes[at]))))
        yield *ends, min(run, total - start), transducers.build(*transducers.used(words, some))


def key_of(lang: str, phrase: bytes) -> bytes:
    return lang.encode() + b"\0" + phrase + b" "


def divided(part: Transducer, lang: str, limits: list[bytes]) -> Iterator[tuple[int, Transducer]]:
    """The transducer cut at the limits: (range, part of it)."""
    paths = part.paths()

    def key(k: int, at: int) -> bytes:
        return key_of(lang, b" ".join(w.as_py() for w in part.words.take(pa.array(paths[k].codes[at]))))

    keys = [range(len(p.counts)) for p in paths]
    spans = [[bisect.bisect_left(keys[k], limit, key=lambda at, k=k: key(k, at)) for limit in limits] for k in range(LONGEST)]
    for i in range(len(limits) + 1):
        cuts = [((s[i - 1] if i else 0), (s[i] if i < len(limits) else len(p.counts))) for s, p in zip(spans, paths)]
        some = [Phrases(p.codes[a:b], p.counts[a:b]) for p, (a, b) in zip(paths, cuts)]
        if any(b > a for a, b in cuts):
            yield i, transducers.build(*transducers.used(part.words, some))


def _language(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit("und"))


def shards(docs: DataFrame, shard_bytes: int = SHARD_BYTES, run: int = RUN) -> DataFrame:
    """Transducers of all shards. Columns: lang, n_words (once a shard and language), n, first, last and body (of a run)."""
    names = ["lang", "n_words", "n", "first", "last", "body"]

    def made(lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        shard = counted(texts)
        rows = [(shard.n_words, 0, None, None, None)] if shard.n_words else []
        for first, last, n, part in runs(shard.words, shard.phrases, run):
            rows.append((0, n, first, last, part.packed()))
            if len(rows) == 64:
                yield _batch([(lang, *r) for r in rows], names)
                rows = []
        yield _batch([(lang, *r) for r in rows], names)

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for piece in pieces_of(text.as_py(), shard_bytes):
                    held.setdefault(lang, []).append(piece)
                    size += len(piece) + 1
                    if size >= shard_bytes:
                        for name, texts in held.items():
                            yield from made(name, texts)
                        held, size = {}, 0
        for name, texts in held.items():
            yield from made(name, texts)

    rows = docs.select(_language(docs["lang"]).alias("lang"), F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run_task, "lang string, n_words long, n long, first binary, last binary, body binary")


_TYPES = {"lang": pa.string(), "n_words": pa.int64(), "n": pa.int64(), "range": pa.int32()}


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES.get(n, pa.binary())) for c, n in zip(columns, names)], names)


def limits_of(made: DataFrame, per_range: int = RANGE) -> list[bytes]:
    """Limits between prefix ranges of about equal numbers of phrases, at most RANGES of LIMIT_BYTES each."""
    firsts = made.where("n > 0")
    total = firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    count = min(RANGES, -(-total // per_range))
    if count < 2:
        return []
    key = F.concat(F.col("lang").cast("binary"), F.lit(b"\0"), "first", F.lit(b" "))
    keys = firsts.select(F.substring(key, 1, LIMIT_BYTES).alias("key")).repartitionByRange(count, "key")
    found = keys.groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("key")).select("key").distinct()
    return sorted(bytes(r["key"]) for r in found.collect())[1:]


def united(made: DataFrame, limits: list[bytes], least: int = LEAST) -> DataFrame:
    """range, lang and body: the phrases of each range that occur ``least`` times in all shards together."""
    spark = made.sparkSession
    bounds = spark.sparkContext.broadcast(limits)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, first, last, body in zip(*(batch.column(k).to_pylist() for k in range(4))):
                low = bisect.bisect_right(bounds.value, key_of(lang, first))
                high = bisect.bisect_right(bounds.value, key_of(lang, last))
                if low == high:
                    rows = [(low, lang, body)]
                else:
                    parts = divided(transducers.unpacked(body), lang, bounds.value[low:high])
                    rows = [(low + i, lang, part.packed()) for i, part in parts]
                yield _batch(rows, ["range", "lang", "body"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Transducer] = []
        at, fresh = None, 0

        def closed() -> Iterator[pa.RecordBatch]:
            words, phrases = transducers.union(held)
            often = [Phrases(p.codes[p.counts >= least], p.counts[p.counts >= least]) for p in phrases]
            if any(len(p.counts) for p in often):
                body = transducers.build(*transducers.used(words, often)).packed()
                yield _batch([(*at, body)], ["range", "lang", "body"])

        for batch in batches:
            for number, lang, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if at is not None and at != (number, lang):
                    yield from closed()
                    held, fresh = [], 0
                at = number, lang
                held.append(transducers.unpacked(body.as_py()))
                fresh += held[-1].size
                if len(held) > 1 and fresh > max(held[0].size, FRESH):  # what is new has outgrown what was united
                    held = [transducers.build(*transducers.union(held))]
                    fresh = 0
        if at is not None:
            yield from closed()

    schema = "range int, lang string, body binary"
    pieces = made.where("n > 0").select("lang", "first", "last", "body").mapInArrow(cut, schema)
    together = pieces.repartition(max(1, min(len(limits) + 1, 1 << 14)), "range").sortWithinPartitions("range", "lang")
    return together.mapInArrow(merge, schema)


def _roles(length: int) -> list[tuple[int, int, int]]:
    """Of a phrase of so many words the parts to look up: (name, first word, last word)."""
    return [(0, 0, 1), (1, 1, 2)] if length == 2 else [(0, 0, 1), (1, 1, 3), (2, 0, 2), (3, 2, 3)]


def asked(counts: DataFrame, limits: list[bytes]) -> DataFrame:
    """Of each candidate (lang, phrase, a) the parts to look up, each with its range. Role 0 and 1 are the parts before and
    behind a cut after the first word, 2 and 3 those of a cut after the second."""
    bounds = counts.sparkSession.sparkContext.broadcast(limits)
    names = ["range", "lang", "part", "phrase", "a", "role"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, body in zip(batch.column(1).to_pylist(), batch.column(2)):
                held = transducers.unpacked(body.as_py())
                for length, found in enumerate(held.paths(), 1):
                    for start in range(0, len(found.counts) if length > 1 else 0, 1 << 14):
                        some = Phrases(found.codes[start : start + (1 << 14)], found.counts[start : start + (1 << 14)])
                        phrase, a = transducers.texts(held.words, some).cast(pa.binary()), pa.array(some.counts)
                        for role, first, last in _roles(length):
                            part = transducers.texts(held.words, Phrases(some.codes[:, first:last], some.counts)).cast(pa.binary())
                            of = [bisect.bisect_right(bounds.value, key_of(lang, p)) for p in part.to_pylist()]
                            fixed = [pa.array([x] * len(of), t) for x, t in ((lang, pa.string()), (role, pa.int32()))]
                            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), fixed[0], part, phrase, a, fixed[1]], names)

    return counts.mapInArrow(run, "range int, lang string, part binary, phrase binary, a long, role int")


def looked_up(counts: DataFrame, requests: DataFrame, per_task: int = ASKED) -> DataFrame:
    """The requests (stored) with the count f of their part."""
    sizes = requests.groupBy("range").agg(F.ceil(F.count("*") / per_task).cast("int").alias("tasks"))
    names = ["lang", "phrase", "a", "role", "f"]
    copies = counts.join(sizes, "range").select(
        "range", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), "lang", F.lit(0).alias("kind"), "body"
    )
    rows = requests.join(F.broadcast(sizes), "range").select(  # a row for each range, at most RANGES
        "range", F.pmod(F.xxhash64("phrase"), F.col("tasks")).cast("int").alias("task"), "lang", F.lit(1).alias("kind"), "part", "phrase", "a", "role"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.table(batch)
            kinds = table["kind"].to_numpy()
            opens = np.flatnonzero(kinds == 0).tolist()
            for a, b in zip([0, *opens], [*opens, len(kinds)]):
                if a < b and kinds[a] == 0:
                    held, a = transducers.unpacked(table["body"][a].as_py()), a + 1
                if a < b:
                    some = table.slice(a, b - a)
                    f = _composed(held, some["part"].combine_chunks())
                    columns = [some[n].combine_chunks() for n in names[:-1]]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(f)], names)

    stream = copies.unionByName(rows, allowMissingColumns=True)
    stream = stream.repartition("range", "task").sortWithinPartitions("range", "task", "lang", "kind")
    return stream.mapInArrow(run, "lang string, phrase binary, a long, role int, f long")


def _composed(held: Transducer, parts: pa.Array) -> np.ndarray:
    """The counts of the parts: an automaton of the distinct parts, composed with the transducer."""
    coded = parts.cast(pa.large_binary()).dictionary_encode()
    split = [p.split(b" ") for p in coded.dictionary.to_pylist()]
    of = pa.array([w for s in split for w in s], pa.large_binary()).dictionary_encode()
    words, places = transducers.sorted_words(of.dictionary)
    codes = places[of.indices.to_numpy(zero_copy_only=False)]
    sizes = np.array([len(s) for s in split])
    firsts = np.cumsum(sizes) - sizes
    phrases, where = [], []
    for k in range(1, LONGEST + 1):
        rows = np.flatnonzero(sizes == k)
        own = np.column_stack([codes[firsts[rows] + i] for i in range(k)])
        order = np.lexsort(own.T[::-1])
        phrases.append(Phrases(own[order], np.ones(len(rows), np.int64)))
        where.append(rows[order])
    counts = np.concatenate([f.counts for f in held.compose(transducers.build(words, phrases))])
    out = np.empty(len(split), np.int64)
    out[np.concatenate(where)] = counts  # every part of a candidate occurs at least as often as the candidate
    return out[coded.indices.to_numpy(zero_copy_only=False)]


def _cut(k: int) -> Column:
    """The cut after the first k words: exact as long as counts stay below 10^15, in decimals of 38 digits."""
    exact = lambda name: F.col(name).cast("decimal(15,0)")
    l, r = f"f{2 * k - 2}", f"f{2 * k - 1}"
    score = F.call_function("div", exact("a") * exact("a") * F.lit(SCALE).cast("decimal(7,0)"), exact(l) * exact(r))
    found = F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r"))
    return F.when(F.col(r).isNotNull(), found)


def scored(found: DataFrame, share: int = 50) -> DataFrame:
    """lang, phrase, a, l, r and score of the candidates that stay, by the cut with the lowest score, the first of several.

    A candidate of two words goes if one of three words around it occurs ``share`` hundredths as often or more.
    """
    roles = [F.max(F.when(F.col("role") == role, F.col("f"))).alias(f"f{role}") for role in range(4)]
    every = found.groupBy("lang", F.col("phrase").cast("string").alias("phrase")).agg(F.max("a").alias("a"), *roles)
    every = work.written(every, "candidates")
    longer = every.where("f3 IS NOT NULL")
    inner = F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2))
    around = longer.select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("around"))
    around = around.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    short = every.where("f3 IS NULL").join(around, ["lang", "phrase"], "left")
    short = short.where(F.coalesce(F.lit(100) * F.col("around") < F.lit(share) * F.col("a"), F.lit(True))).drop("around")
    lowest = F.array_min(F.array(_cut(1), _cut(2)))
    kept = short.unionByName(longer).withColumn("cut", lowest)
    return kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(
    docs: DataFrame,
    least: int = LEAST,
    share: int = 50,
    top: int = TOP,
    *,
    shard_bytes: int = SHARD_BYTES,
    run: int = RUN,
    per_range: int = RANGE,
    per_task: int = ASKED,
) -> DataFrame:
    """The first phrases of each language by score, then frequency, then phrase.

    Columns: lang (null as ``und``), rank, phrase, a, l, r, n and score. Texts are taken whole; null counts as empty; a
    language without candidates gives no rows, nor does an empty table. Repeated rows and rows without doc_id count like all
    others; other columns are not read. At most RANGES limits of LIMIT_BYTES pass the driver. The sizes of shards, runs,
    ranges and lookups bound what a task holds and don't change the result.
    """
    made = work.written(shards(docs, shard_bytes, run), "shards")
    limits = limits_of(made, per_range)
    counts = work.written(united(made, limits, least), "counts")
    requests = work.written(asked(counts, limits), "requests")
    kept = work.written(scored(looked_up(counts, requests, per_task), share), "scored")
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    first = kept.withColumn("place", F.row_number().over(Window.partitionBy("lang", part).orderBy(*best))).where(F.col("place") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")
    first = first.drop("place").withColumn("rank", rank).where(F.col("rank") <= top)
    sizes = made.groupBy("lang").agg(F.sum("n_words").alias("n"))
    return first.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
