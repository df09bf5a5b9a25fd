"""Personal data and the terms that disclose it, by co-occurrence in the corpus.

Patterns find e-mail and IP addresses, card and phone numbers. What they name is protected at several levels: each
distinct value, the owner and the domain of an address, the network of an IP address, the first six digits of a card and
a phone number without its last four. A term discloses such an entity as far as it tells of its presence: by pointwise
mutual information over documents, as a share of the entity's own information. PMI(e; t) / IC(e) is 1 if t never
occurs without e. Terms that share at least LEAST documents with an entity, wherever they stand in them, and whose share
exceeds GENERALISE are generalised, from REMOVE on removed, wherever they occur.

Counts cover all documents, in two passes over the texts whatever the number of terms. Entities that stand in the
same documents tell the same and are counted as one, and so are terms; so a page of thousands of addresses, copied, is
one entity, and its pairs don't multiply. Where a document still has many entities, its terms are dealt to several
tasks. The second pass lets words through by a bitmap of FILTER_BITS hashes of candidates, exact counts decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlgauge import session
from sqlgauge.llm import work

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
LEAST = 3
GENERALISE = 0.95
REMOVE = 0.999
#: Bits of the filter of candidate terms, a power of two: 16 MB at most, whatever their number.
FILTER_BITS = 1 << 27
#: Entities of a document to one share of its terms.
WIDE = 1024
BATCH_BYTES = work.BATCH_BYTES

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile("[A-Za-z\x80-\U0010ffff]{2,}")
_LETTERS = bytes(c if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

_SPANS = "array<struct<start:bigint,end:bigint,kind:int>>"
_ARROW_BYTES = work.ARROW_BYTES

Span = tuple[int, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches; the local part is found backwards from each @, so a long run of letters is read once."""
    at, done = text.find("@"), 0
    while at >= 0:
        run = text[done:at]
        local = len(run) - len(run.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if local else None
        if found:
            yield at - local, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def base_spans(text: str) -> list[Span]:
    """(start, end, number of the kind) of all matches of a text, by start and kind."""
    out: list[Span] = []
    if "@" in text:
        out.extend((a, b, 0) for a, b in _emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def entities_of(text: str, kind: int) -> list[str]:
    """A value in one spelling (lower case, or digits alone) and the wider entities that it belongs to."""
    value = text.lower() if kind < 2 else _digits(text)
    if kind == 0:
        owner, _, domain = value.partition("@")
        wider = [f"owner:{owner}", f"domain:{domain}"]
    else:
        wider = [f"{KINDS[kind]} in:" + (value.rpartition(".")[0] if kind == 1 else value[:6] if kind == 2 else value[:-4])]
    return [f"{KINDS[kind]}:{value}", *wider]


def _term(word: str) -> str:
    return word.translate(_LOWER)


def _merged(spans: list[Span]) -> list[tuple[int, int]]:
    """The spans by start, each with the furthest end so far."""
    ends: list[tuple[int, int]] = []
    for a, b, _ in spans:
        ends.append((a, max(b, ends[-1][1] if ends else 0)))
    return ends


def terms_of(text: str) -> set[str]:
    """The terms of a text outside all spans."""
    ends, k = _merged(base_spans(text)), 0
    out = set()
    for m in _WORD.finditer(text):
        while k < len(ends) and ends[k][1] <= m.start():
            k += 1
        if k == len(ends) or ends[k][0] >= m.end():
            out.add(_term(m[0]))
    return out


def _written(df: DataFrame, name: str) -> DataFrame:
    return work.written(df, name, batch_bytes=BATCH_BYTES)


def _found(rows: DataFrame) -> DataFrame:
    """row, doc_id, base spans and distinct entities of each row."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, entities = [], []
            for value in batch.column(2):
                text = value.as_py()
                some = base_spans(text)
                spans.append([{"start": a, "end": b, "kind": k} for a, b, k in some])
                entities.append(sorted({e for a, b, k in some for e in entities_of(text[a:b], k)}))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(spans, pa.list_(span)), pa.array(entities, pa.list_(pa.string()))],
                ["row", "doc_id", "spans", "entities"],
            )

    return rows.mapInArrow(run, f"row long, doc_id long, spans {_SPANS}, entities array<string>")


def _terms(rows: DataFrame) -> DataFrame:
    """row, slice and each distinct term of its text; a row's terms are dealt to its ``slices``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, dealt, terms = [], [], []
            for row, text, slices in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                some = sorted(terms_of(text.as_py()))
                held += [row] * len(some)
                dealt += [xxhash.xxh64_intdigest(t, 0) % slices for t in some]
                terms += some
            yield pa.RecordBatch.from_arrays(
                [pa.array(held, pa.int64()), pa.array(dealt, pa.int64()), pa.array(terms, pa.string())], ["row", "slice", "term"]
            )

    return rows.select("row", "text", "slices").mapInArrow(run, "row long, slice long, term string")


def _sets(pairs: DataFrame, name: str, least: int) -> DataFrame:
    """Each name that stands in at least so many rows: their number, and a digest of 128 bits of the set of them."""
    counts = pairs.groupBy(name).agg(
        F.count("*").alias(f"{name}_rows"), F.bit_xor(F.xxhash64("row")).alias("low"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("high")
    )
    return counts.where(F.col(f"{name}_rows") >= least)


def _firsts(sets: DataFrame, name: str) -> DataFrame:
    """The first of the names that stand in the same rows."""
    return sets.groupBy(f"{name}_rows", "low", "high").agg(F.min(name).alias(name))


def candidates(rows: DataFrame, found: DataFrame, n_rows: int, least: int = LEAST, share: float = GENERALISE) -> DataFrame:
    """entity, term, with_entity (rows that hold both), and entity_rows, of pairs that may exceed the share.

    Of entities that stand in the same rows the first is given. The rows of a term among those with an entity are a
    lower bound of all its rows. So the share of a term in all rows of an entity is an upper bound, which leaves
    frequent words out before pairs are counted.
    """
    pairs = found.select("row", F.explode("entities").alias("entity"))
    entities = _firsts(_sets(pairs, "entity", least), "entity").select("entity", "entity_rows")
    pairs = work.written(session.lookup_join(pairs, entities, "entity", F.col("row"), "inner"), "entities")
    slices = pairs.groupBy("row").agg((1 + F.floor(F.count("*") / WIDE)).alias("slices"))
    terms = _written(_terms(rows.join(slices, "row")), "terms")
    most = pairs.agg(F.max("entity_rows")).first()[0] or 0
    bound = lambda rows: F.log2(F.lit(float(n_rows)) / F.col("term_rows")) >= share * F.log2(F.lit(float(n_rows)) / rows) - 1e-9
    rare = work.written(_sets(terms, "term", least).where(bound(F.lit(float(most or 1)))), "rare")
    firsts = work.written(_firsts(rare, "term"), "first_terms")
    dealt = pairs.join(slices, "row").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    met = session.lookup_join(terms, firsts, "term", F.col("row"), "inner", stored=True).join(dealt, ["row", "slice"])
    counts = ["entity", "entity_rows", "term_rows", "low", "high"]
    both = met.where(bound(F.col("entity_rows"))).groupBy(*counts).agg(F.count("*").alias("with_entity"))
    likely = both.where((F.col("with_entity") >= least) & (_share(n_rows) >= share))
    return likely.join(rare, ["term_rows", "low", "high"]).select("entity", "term", "with_entity", "entity_rows")


def _share(n_rows: int) -> Column:
    """PMI over the entity's information; an entity that is in every row has none, and nothing discloses it."""
    information = F.log2(F.lit(float(n_rows)) / F.col("entity_rows"))
    mutual = F.log2(F.col("with_entity") * float(n_rows) / (F.col("entity_rows") * F.col("term_rows")))
    return F.when(information > 0, mutual / information).otherwise(0.0)


def _filter(terms: DataFrame, bits: int) -> np.ndarray:
    """A bit for each hash of a term: at most ``bits`` of them, in pieces of 4 KB."""
    bit = F.col("term_hash").bitwiseAND(F.lit(bits - 1)) + 1
    hashed = terms.select(F.xxhash64("term").alias("term_hash"))
    pieces = hashed.groupBy(F.bitmap_bucket_number(bit).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bitmap"))
    out = np.zeros((-(-bits // 32768), 4096), np.uint8)
    for piece in pieces.toLocalIterator():
        out[piece["piece"] - 1] = np.frombuffer(piece["bitmap"], np.uint8)
    return out.reshape(-1)


def _holding(rows: DataFrame, terms: DataFrame, bits: int) -> DataFrame:
    """row and term of each row that holds any of the terms, and of other words that share a bit with one."""
    shared = rows.sparkSession.sparkContext.broadcast(_filter(terms, bits).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            out = []
            for row, value in zip(batch.column(0).to_pylist(), batch.column(2)):
                for term in sorted(set(_words(value.as_py()))):
                    bit = xxhash.xxh64_intdigest(term, 42) & (bits - 1)
                    if bitmap[bit >> 3] >> (bit & 7) & 1:
                        out.append((row, term.decode()))
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int64()), pa.array([t for _, t in out], pa.string())], ["row", "term"])

    return rows.withColumn("text", F.col("text").cast("binary")).mapInArrow(run, "row long, term string")


def _words(text: bytes) -> Iterator[bytes]:
    plain, start = text.lower().translate(_LETTERS), 0
    while start < len(plain):
        end = plain.find(b" ", start + (1 << 20))
        end = len(plain) if end < 0 else end
        yield from plain[start:end].split()
        start = end


def disclosing(rows: DataFrame, found: DataFrame, least: int, share: float, bits: int) -> tuple[DataFrame, DataFrame]:
    """The disclosing terms (term, share), and the rows that hold them (row, term, share)."""
    n_rows = found.count()
    pairs = work.written(candidates(rows, found, n_rows, least, share), "candidates")
    holding = _written(_holding(rows, pairs.select("term"), bits), "holding")
    every = holding.groupBy("term").agg(F.count("*").alias("term_rows"))
    shares = pairs.join(every, "term").groupBy("term").agg(F.max(_share(n_rows)).alias("share"))
    shares = work.written(shares.where(F.col("share") >= share), "shares")
    return shares, session.lookup_join(holding, shares, "term", F.col("row"), "inner", stored=True)


def _term_spans(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """row and the places of its disclosing terms, each with 4 as its kind, 5 if it is removed."""
    lists = marked.groupBy("row").agg(F.collect_list(F.struct("term", (F.col("share") >= REMOVE).alias("gone"))).alias("terms"))
    lists = work.written(lists, "marked")  # few rows, so the texts needn't be shuffled to them
    few = session.file_bytes(lists) <= session.BROADCAST_BYTES
    holding = rows.join(F.broadcast(lists) if few else lists, "row").select("row", "text", "terms")
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, terms in zip(batch.column(1), batch.column(2)):
                text, kinds = text.as_py(), {t["term"]: 5 if t["gone"] else 4 for t in terms.as_py()}
                taken = base_spans(text)
                spans, k = [], 0
                ends = _merged(taken)
                for m in _WORD.finditer(text):
                    if kind := kinds.get(_term(m[0])):
                        while k < len(ends) and ends[k][1] <= m.start():
                            k += 1
                        if k == len(ends) or ends[k][0] >= m.end():
                            spans.append({"start": m.start(), "end": m.end(), "kind": kind})
                out.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(span))], ["row", "term_spans"])

    return holding.mapInArrow(run, f"row long, term_spans {_SPANS}")


def _rows(docs: DataFrame) -> DataFrame:
    row = work.unused(docs, "row")
    return work.numbered(docs, row).select(
        F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )


def personal_data(
    docs: DataFrame, least: int = LEAST, share: float = GENERALISE, bits: int = FILTER_BITS
) -> DataFrame:
    """row, doc_id, spans and term_spans of each row of a stored table; spans are (start, end, kind) in code points.

    ``kind`` is the place in KINDS; 4 is a disclosing term to generalise, 5 one to remove. A null text counts as
    empty and has no spans. Repeated rows count as documents of their own. An empty table gives no rows.
    """
    rows = _rows(docs)
    found = _written(_found(rows), "personal")
    _, marked = disclosing(rows, found, least, share, bits)
    terms = _written(_term_spans(rows, marked), "term_spans")
    return found.drop("entities").join(terms, "row", "left").withColumn("term_spans", F.coalesce("term_spans", F.array().cast(_SPANS)))


def sanitised(docs: DataFrame, found: DataFrame) -> DataFrame:
    """row, doc_id and the text with every span replaced by its kind in brackets, and removed terms left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                out, last = [], 0
                for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= last:
                        name = "" if s["kind"] == 5 else f"[{(*KINDS, TERM)[s['kind']].upper()}]"
                        out.append(text[last : s["start"]] + name)
                    last = max(last, s["end"])
                texts.append("".join([*out, text[last:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["row", "doc_id", "text"])

    every = found.select("row", F.concat("spans", "term_spans").alias("every"))
    joined = _rows(docs).join(every, "row").select("row", "doc_id", "text", "every")
    return joined.mapInArrow(run, "row long, doc_id long, text string")
