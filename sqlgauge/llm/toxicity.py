"""Toxicity scores: gradient-boosted trees over dense features of whole texts, calibrated by isotonic regression.

The model is fitted on a bounded sample of labelled rows (SAMPLE ids, chosen by hash). From their texts a lexicon is learned: words
and word beginnings that occur significantly more often in toxic texts, counted by distinct neighbours so that copies
of one text count once. The trees see densities of the lexicon, how near to it the second person is, and
rates of capitals, punctuation and disguised spelling; doc_id, lang, source and the labels are no inputs. Sample rows
of one fold are kept from lexicon and trees and calibrate the score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlgauge.llm import work

#: Labelled ids the model is fitted on at most.
SAMPLE = 16_000
FOLDS = 5
HELD_OUT = 0
CALIBRATION = 4
#: Terms of the lexicon: at least so many contexts in toxic texts, and a log-likelihood ratio of at least so much.
LEAST_CONTEXTS = 5
LEAST_RATIO = 20.0
LEXICON = 2_000
#: Lengths in bytes of the word beginnings that are terms beside whole words.
BEGINNINGS = (4, 5, 6)
#: Words around a lexicon word in which the second person counts.
NEAR = 5

#: Second person pronouns in English, German, French and Spanish.
SECOND_PERSON = "you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes".split()
#: Characters that stand for letters in disguised words.
DISGUISE = dict(zip("0134578@$!|", "oieastbasii"))

FEATURES = (
    "lexicon_density",
    "beginning_density",
    "weight_density",
    "hits",
    "strongest",
    "second_person",
    "second_person_near",
    "capitals",
    "capital_words",
    "punctuation",
    "exclamations",
    "disguised",
    "disguised_hits",
    "repeated_letters",
    "log_words",
)

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_PLAIN = bytes(c if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LETTERS = bytes(c for c in range(256) if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128)
_CAPITALS = bytes(range(65, 91))
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_UNMASK = bytes.maketrans(*("".join(x).encode() for x in zip(*DISGUISE.items())))
_MASKS = frozenset("".join(DISGUISE).encode())
_CHUNK = 1 << 20


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, by FOLDS; a missing id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")


def _chunks(text: bytes) -> Iterator[bytes]:
    start = 0
    while start < len(text):
        end = text.find(b" ", start + _CHUNK)
        end = len(text) if end < 0 else end
        yield text[start:end]
        start = end


class Lexicon(NamedTuple):
    words: dict[bytes, float]
    beginnings: dict[bytes, float]

    def features(self, text: bytes | None) -> list[float]:
        """The values of FEATURES; for an empty text all are 0."""
        known, second = self.words, _SECOND
        n = hits = begun = person = person_near = capital_words = disguised = disguised_hits = repeated = 0
        weight = strongest = 0.0
        lengths = [k for k in BEGINNINGS if any(len(b) == k for b in self.beginnings)]
        text = text or b""
        for part in _chunks(text):
            raw = part.split()
            words = part.translate(_LOWER).translate(_PLAIN).split()
            n += len(words)
            at = [i for i, w in enumerate(words) if w in known]
            hits += len(at)
            for i in at:
                w = known[words[i]]
                weight += w
                strongest = max(strongest, w)
            for k in lengths:
                get = self.beginnings.get
                found = [x for x in map(get, [w[:k] for w in words if len(w) >= k]) if x is not None]
                begun += len(found)
                weight += sum(found)
                strongest = max([strongest, *found])
            persons = [i for i, w in enumerate(words) if w in second]
            person += len(persons)
            if at and persons:
                person_near += int((_gaps(np.array(persons), np.array(at)) <= NEAR).sum())
            for w in raw:
                if w.isupper() and len(w) > 1:
                    capital_words += 1
                if not w.isalpha() and not _MASKS.isdisjoint(w.strip(_MARKS_OF)) and any(c in _LETTERS for c in w):
                    disguised += 1
                    if w.translate(_LOWER).translate(_UNMASK).translate(None, _MARKS) in known:
                        disguised_hits += 1
        size = max(1, len(text))
        letters = size - len(text.translate(None, _LETTERS))
        capitals = len(text) - len(text.translate(None, _CAPITALS))
        marks = len(text) - len(text.translate(None, _MARKS))
        for c in b"aeiouAEIOU!?":
            repeated += text.count(bytes([c]) * 3)
        per = max(1, n)
        return [
            hits / per,
            begun / per,
            weight / per,
            float(hits + begun),
            strongest,
            person / per,
            person_near / per,
            capitals / max(1, letters),
            capital_words / per,
            marks / size,
            text.count(b"!") / size,
            disguised / per,
            disguised_hits / per,
            repeated / per,
            math.log1p(n),
        ]


_SECOND = frozenset(w.encode() for w in SECOND_PERSON)
_MARKS_OF = bytes(c for c in _MARKS if c not in b"@$!|") + b"!"


def _gaps(places: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How far each place is from the nearest of the others, which are sorted."""
    right = np.searchsorted(others, places)
    before, behind = others[np.maximum(right - 1, 0)], others[np.minimum(right, len(others) - 1)]
    return np.minimum(np.abs(places - before), np.abs(places - behind))


class Model(NamedTuple):
    """A fitted model; with ``trees`` None every score is ``prior``."""

    lexicon: Lexicon
    trees: object | None
    calibration: object | None
    prior: float


def sampled(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """doc_id, fold, label and text of at most ``size`` labelled ids outside the held-out fold, chosen by hash.

    An id labelled twice is toxic if any of its labels is; of rows that share an id the smallest text counts. Rows
    without id or label are left out.
    """
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    ids = named.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    ids = ids.withColumn("fold", fold(F.col("doc_id"))).where(F.col("fold") != HELD_OUT)
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    rows = work.documents(docs).join(F.broadcast(ids), "doc_id")  # at most ``size`` short rows
    return rows.groupBy("doc_id", "fold", "label").agg(F.min("text").alias("text"))


def learned(sample: DataFrame) -> Lexicon:
    """The lexicon of a stored sample; its rows of the calibration fold aren't read. Its size is bounded by LEXICON."""
    rows = sample.where(F.col("fold") != CALIBRATION)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    listed = rows.select("label", words.alias("words"))

    def terms(kind: int) -> Column:
        w = F.col("words")
        around = lambda i, at: F.coalesce(F.get(w, i + at), F.lit(""))
        name = (lambda x: x) if not kind else (lambda x: F.when(F.octet_length(x) >= kind, F.substring(x.cast("binary"), 1, kind)))
        return F.transform(
            w, lambda x, i: F.struct(name(x.cast("binary")).alias("term"), F.xxhash64(around(i, -1), F.get(w, i), around(i, 1)).alias("context"))
        )

    kinds = [0, *BEGINNINGS]
    exploded = [
        listed.select("label", F.lit(kind).alias("kind"), F.explode(terms(kind)).alias("t")).select("label", "kind", "t.term", "t.context")
        for kind in kinds
    ]
    every = exploded[0].unionByName(exploded[1])
    for more in exploded[2:]:
        every = every.unionByName(more)
    every = every.where("term is not null")
    # Distinct rows first: a frequent term is counted where its contexts are, not gathered in one task.
    toxic = every.where("label = 1").distinct().groupBy("kind", "term").agg(F.count("*").alias("toxic"))
    toxic = toxic.where(F.col("toxic") >= LEAST_CONTEXTS)
    other = every.where("label = 0").join(toxic.select("kind", "term"), ["kind", "term"], "left_semi")
    other = other.distinct().groupBy("kind", "term").agg(F.count("*").alias("other"))
    totals = {r["label"]: r["n"] for r in listed.groupBy("label").agg(F.sum(F.size("words")).alias("n")).collect()}
    a, b = F.col("toxic").cast("double"), F.coalesce("other", F.lit(0)).cast("double")
    n1, n0 = float(totals.get(1) or 1), float(totals.get(0) or 1)
    expected = lambda n: (a + b) * n / (n1 + n0)
    ratio = 2 * (a * F.log(a / expected(n1)) + F.when(b > 0, b * F.log(b / expected(n0))).otherwise(0.0))
    weight = F.log((a + 0.5) / n1) - F.log((b + 0.5) / n0)
    scored = toxic.join(other, ["kind", "term"], "left").select("kind", "term", ratio.alias("ratio"), weight.alias("weight"))
    top = scored.where((F.col("ratio") >= LEAST_RATIO) & (F.col("weight") >= 2)).orderBy(F.desc("ratio"), "kind", "term").limit(LEXICON)
    words_of, beginnings = {}, {}
    for r in top.collect():
        (beginnings if r["kind"] else words_of)[bytes(r["term"])] = float(r["weight"])
    return Lexicon(words_of, beginnings)


def featured(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows with the columns of FEATURES in place of their text."""
    shared = rows.sparkSession.sparkContext.broadcast(tuple(lexicon))
    kept = [f for f in rows.schema if f.name != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{n} double" for n in FEATURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Lexicon(*shared.value)
        for batch in batches:
            place = batch.schema.get_field_index("text")
            values = [words.features(t.as_py()) for t in batch.column(place)]
            columns = np.array(values, np.float64).reshape(-1, len(FEATURES)).T
            others = [i for i in range(batch.num_columns) if i != place]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in others] + [pa.array(c) for c in columns],
                [batch.schema.field(i).name for i in others] + list(FEATURES),
            )

    return rows.withColumn("text", F.col("text").cast("binary")).mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    """Lexicon, trees and calibration from a bounded sample of labelled rows.

    Without both classes among the rows for the trees, each score is the share of toxic rows (0 without any rows); without
    both among those for the calibration, the score is the trees' own probability.
    """
    sample = work.written(sampled(docs, labels, size), "labelled")
    counts = {(r["c"], r["label"]): r["n"] for r in sample.groupBy((F.col("fold") == CALIBRATION).alias("c"), "label").agg(F.count("*").alias("n")).collect()}
    if not counts.get((False, 0)) or not counts.get((False, 1)):
        total = sum(counts.values())
        return Model(Lexicon({}, {}), None, None, sum(n for (_, label), n in counts.items() if label) / total if total else 0.0)
    lexicon = learned(sample)
    rows = work.written(_vectors(featured(sample, lexicon)), "features")
    train = rows.where(F.col("fold") != CALIBRATION).coalesce(8).cache()
    trees = GBTClassifier(labelCol="label", maxIter=20, maxDepth=4, stepSize=0.2, seed=7, minInstancesPerNode=2).fit(train)
    train.unpersist()
    calibration = None
    if counts.get((True, 0)) and counts.get((True, 1)):
        held = trees.transform(rows.where(F.col("fold") == CALIBRATION)).select(_raw().alias("raw"), F.col("label").cast("double").alias("label"))
        calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(held)
    return Model(lexicon, trees, calibration, 0.0)


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).drop(*FEATURES)


def _raw() -> Column:
    return vector_to_array("probability")[1]


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """The rows (with a text) with ``score`` in its place. Every row gets one; null and empty texts have features of 0."""
    if model.trees is None:
        return rows.drop("text").withColumn("score", F.lit(model.prior))
    names = [c for c in rows.columns if c != "text"]
    raw = model.trees.transform(_vectors(featured(rows, model.lexicon))).withColumn("raw", _raw())
    if model.calibration is None:
        return raw.select(*names, F.col("raw").alias("score"))
    return model.calibration.transform(raw).select(*names, F.least(F.greatest("calibrated", F.lit(0.0)), F.lit(1.0)).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """row, doc_id, held_out, score and predicted of each row of a stored table; repeated rows are scored alike."""
    row = work.unused(docs, "row")
    rows = work.numbered(docs, row).select(
        F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    out = scored(rows, fit(docs, labels, size))
    return out.select("row", "doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """The rows of a stored table that score below one half, with all their columns."""
    row = work.unused(docs, "row")
    dropped = toxicity(docs, labels, size).where("predicted = 1").select(F.col("row").alias(row))
    return work.without(work.numbered(docs, row), row, dropped)
