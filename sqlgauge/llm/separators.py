"""Token counts of documents in flat token files that have no index: a scan for end-of-document ids.

A flat file holds nothing but ids of fixed width. Its blocks are scanned on their own: each task reads a range of
bytes, finds the end ids with one vectorised comparison and returns their places. A prefix scan over the blocks of a file
carries the last end before each block, which closes the documents that span blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sqlgauge.llm import work
from sqlgauge.llm.tokens import default_path, encoder

#: <|endoftext|>; texts that spell it out are encoded as ordinary text, so it only ever ends a document.
END_ID = 50256
BLOCK_BYTES = 4 * 1024 * 1024
WIDTH = 2


def write_flat(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, width: int = WIDTH) -> DataFrame:
    """Writes one flat file per partition and returns file, ordinal and doc_id of the documents in it.

    A null or empty text is an end id alone. Nothing is shuffled.
    """
    path = path or default_path()
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, ids = f"{TaskContext.get().partitionId():06d}.bin", []
        end = np.array([end_id], kind).tobytes()

        def parts() -> Iterator[bytes]:
            for batch in batches:
                for doc_id, tokens in zip(batch.column(0).to_pylist(), encoder(path, True).encode(batch.column(1))):
                    ids.append(doc_id)
                    if len(tokens) and int(tokens.max()) > np.iinfo(kind).max:
                        raise ValueError(f"token {tokens.max()} doesn't fit {width} bytes")
                    yield tokens.astype(kind).tobytes() + end

        if work.put_file(f"{folder}/{file}", parts()):
            for k in range(0, len(ids), 1 << 16):
                some = ids[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(some)), pa.array(range(k, k + len(some)), pa.int64()), pa.array(some, pa.int64())],
                    ["file", "ordinal", "doc_id"],
                )

    return work.written(work.documents(docs).mapInArrow(run, "file string, ordinal long, doc_id long"), "named", batch_bytes=work.BATCH_BYTES)


def blocks(spark: SparkSession, folder: str, block_bytes: int) -> DataFrame:
    """file, block, first and size in bytes of each block of the files in a folder; the files aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "length")
    last = F.floor((F.col("length") - 1) / block_bytes)
    listed = files.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    first = F.col("block") * block_bytes
    name = F.element_at(F.split("path", "/"), -1)
    return listed.select(name.alias("file"), "block", first.alias("first"), F.least(F.lit(block_bytes), F.col("length") - first).alias("size"))


def scan(spark: SparkSession, folder: str, end_id: int = END_ID, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, ordinal, start, n_tokens (without the end id) and ended of each document in the flat files of a folder.

    Ids behind the last end of a file are a document that hasn't ended. Files that are empty give no rows; so does a
    folder without files. ``block_bytes`` is a multiple of the width.
    """
    listed = blocks(spark, folder, block_bytes)
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block, first, size in zip(*(c.to_pylist() for c in batch.columns)):
                store, path = work.file_system(f"{folder}/{file}")
                with store.open_input_file(path) as source:
                    source.seek(first)
                    tokens = np.frombuffer(source.read(size // width * width), kind)
                ends = np.flatnonzero(tokens == end_id) + first // width
                found = [[None, *(ends[:-1] + 1).tolist()][: len(ends)], ends.tolist()]
                arrays = [pa.array([x], pa.list_(pa.int64())) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([block]), pa.array([first // width + len(tokens)]), *arrays],
                    ["file", "block", "until", "starts", "ends"],
                )

    n = max(1, listed.count())
    found = listed.repartition(n, "file", "block").mapInArrow(run, "file string, block long, until long, starts array<long>, ends array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = Window.partitionBy("file").orderBy("block")
    some = F.when(F.size("ends") > 0, F.element_at("ends", -1))
    stitched = found.select(
        "file",
        "until",
        F.coalesce(F.last(some, ignorenulls=True).over(before), F.lit(-1)).alias("last"),
        F.coalesce(F.sum(F.size("ends").cast("long")).over(before), F.lit(0)).alias("before"),
        F.lead("block").over(rows).isNull().alias("final"),
        "starts",
        "ends",
    )
    # The first document of a block starts behind the last end before it; the tail of a file is behind its last end.
    named = lambda ordinal, start, end, ended: F.struct(
        ordinal.alias("ordinal"), start.alias("start"), end.alias("end"), F.lit(ended).alias("ended")
    )
    closed = F.transform(
        F.arrays_zip("starts", "ends"),
        lambda d, i: named(F.col("before") + i, F.coalesce(d["starts"], F.col("last") + 1), d["ends"], True),
    )
    behind = F.coalesce(some, F.col("last")) + 1
    tail = F.array(named(F.col("before") + F.size("ends"), behind, F.col("until"), False))
    opened = F.when(F.col("final") & (F.col("until") > behind), F.concat(closed, tail)).otherwise(closed)
    out = stitched.select("file", F.explode(opened).alias("d"))
    return out.select("file", "d.ordinal", "d.start", (F.col("d.end") - F.col("d.start")).alias("n_tokens"), "d.ended")


def counted(docs: DataFrame, path: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, file, start and n_tokens of each row: its text is written to a flat file, and counted by the scan alone.

    The names of the documents are joined by file and ordinal. Null texts count as empty: 0 tokens. Repeated rows and rows
    without doc_id are counted like any other.
    """
    spark = docs.sparkSession
    folder = work.new_path(spark, "flat")
    names = write_flat(docs, folder, path)
    found = scan(spark, folder, block_bytes=block_bytes) if not names.isEmpty() else spark.createDataFrame([], "file string, ordinal long, start long, n_tokens long")
    # The scan's rows come out of arrays, so Spark underrates their size and would broadcast them.
    return names.join(found.hint("merge"), ["file", "ordinal"]).select("doc_id", "file", "start", "n_tokens")
