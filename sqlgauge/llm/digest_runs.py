"""Exact deduplication by a tree of merges of sorted digest runs.

Each row becomes a short record: digest, smallest row, number of rows. The leaves are written in the order of their
digests and dealt to RUNS runs by row number, so copies of one text lie in all of them. The rounds form a binomial
tree of base FAN_IN: in each, the runs whose numbers differ in one digit exchange their records so that this digit of
the run number becomes a digit of the digest. A run is one key of the shuffle, hence in one partition; there its
records are sorted by digest and neighbours with the same digest, length and second hash become one, with the
smallest id. After the last round a run number is a function of the digest, so each digest is in one run, once. A
text that fills a third of the table lies in RUNS / FAN_IN runs in the first round and as one record in each after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlgauge.llm import work

FAN_IN = 16
ROUNDS = 3
RUNS = FAN_IN**ROUNDS
#: What makes two records equal: the digest, and what verifies it.
SAME = ("digest", "n_bytes", "second")


def normalised(text: Column) -> Column:
    """The text with every run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def records(docs: DataFrame) -> DataFrame:
    """Row number, doc_id and digest of each row, and what verifies the digest: the length and a second hash."""
    row = work.unused(docs, "row")
    rows = work.numbered(docs, row)
    text = rows.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("text"))
    return text.select(
        "row", "doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("n_bytes"), F.xxhash64("text").alias("second")
    )


def _digit(level: int) -> Column:
    """The digit of the digest that a round puts into the run number."""
    return F.pmod(F.shiftright(F.xxhash64("digest"), 8 * level), F.lit(FAN_IN)).cast("int")


def leaves(rows: DataFrame) -> DataFrame:
    """The records as runs of one row each record: run, what makes them equal, first (no_id, id, row), number of rows."""
    return rows.select(
        F.pmod(F.xxhash64("row"), F.lit(RUNS)).cast("int").alias("run"),
        *SAME,
        work.smallest("doc_id", "row").alias("first"),
        F.lit(1).cast("long").alias("n"),
    )


def merge_round(runs: DataFrame, level: int) -> DataFrame:
    """Runs whose numbers differ in the digit of ``level`` exchange records; each sorts and merges what it gets.

    Minimum of a struct makes Spark aggregate by sorting, and the partitioning by run serves it, so there is one
    exchange, one sort by (run, digest) and a merge of neighbours.
    """
    place = FAN_IN**level
    kept = F.col("run") - F.pmod(F.floor(F.col("run") / place), F.lit(FAN_IN)) * place
    dealt = runs.withColumn("run", (kept + _digit(level) * place).cast("int")).repartition("run")
    return dealt.groupBy("run", *SAME).agg(F.min("first").alias("first"), F.sum("n").alias("n"))


def merge_tree(rows: DataFrame) -> list[DataFrame]:
    """The runs at every level of the tree, leaves first."""
    levels = [leaves(rows)]
    for level in range(ROUNDS):
        levels.append(merge_round(levels[-1], level))
    return levels


def merged(rows: DataFrame) -> DataFrame:
    """One record per distinct text: digest, length, second hash, first (no_id, id, row) and number of rows."""
    return merge_tree(rows)[-1].drop("run")


def exact_groups(docs: DataFrame) -> DataFrame:
    """Each row of a stored table with the row that stays for its text.

    Columns: row, doc_id, keep_id, keep_row, group_size, kept, digest. Null texts count as empty; empty texts are
    equal to each other. Rows without doc_id come after all others; of rows that share the smallest doc_id the first
    stays. Other columns are not read. An empty table gives no rows.
    """
    rows = work.written(records(docs).sortWithinPartitions(*SAME), "digests")
    joined = rows.join(merged(rows), list(SAME))
    return joined.select(
        "row",
        "doc_id",
        F.col("first.id").alias("keep_id"),
        F.col("first.row").alias("keep_row"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("first.row")).alias("kept"),
        "digest",
    )


def drop_exact(docs: DataFrame) -> DataFrame:
    """The rows of a stored table that stay, with all their columns."""
    row = work.unused(docs, "row")
    dropped = exact_groups(docs).where(~F.col("kept")).select(F.col("row").alias(row))
    return work.without(work.numbered(docs, row), row, dropped)
