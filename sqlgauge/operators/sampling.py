"""Splits and positional subsets."""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_BITS = 16
#: Hex digits of a row's place in a random order.
PLACE_DIGITS = 48


def _place(seed: int, df: DataFrame, order: str = "idx") -> Column:
    """48 hex digits that order rows at random: by a keyed hash of the position, rows that share it by one of all columns."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(order).cast("string")))
    return F.concat(key, F.lower(F.lpad(F.hex(F.xxhash64(*df.columns)), 16, "0")))


def _last_place(df: DataFrame, place: Column, k: int) -> tuple[str, int, int]:
    """Where the k-th smallest place lies, 1 <= k <= rows: its first digits, the rows that share them and how many of those
    count.

    A radix histogram: every pass counts rows by the next four digits below the digits that are known, 65,536 groups at
    most. It ends where the k-th row is the last of its group; that is the second pass or the third unless rows are equal.
    """
    known, digits = "", 4
    while True:
        inside = df.filter(F.startswith(place, F.lit(known))) if known else df
        counts = inside.groupBy(F.substring(place, 1, len(known) + digits).alias("start")).agg(F.count("*").alias("rows"))
        upto = Window.orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        reached = counts.withColumn("upto", F.sum("rows").over(upto)).filter(F.col("upto") >= k)
        known, rows, last = reached.orderBy("start").select("start", "rows", "upto").first()
        k -= last - rows
        if k == rows or len(known) == PLACE_DIGITS:
            return known, rows, k


def split_examples(examples: DataFrame, ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """Marks a share of the training rows as validation, rounded up to whole rows; the same rows on any partitioning.

    Only rows of the training split, or without a split, are drawn; a corpus that has validation rows stays as it is. The
    rows with the smallest keyed hashes are drawn: they are found by counting, nothing is sorted.
    """
    if "split" not in examples.columns:
        examples = examples.withColumn("split", F.lit("train"))
    split = F.coalesce("split", F.lit("train"))
    n, kept = examples.agg(F.count_if(split == "train"), F.count_if(split == "validation")).first()
    if kept:
        return examples
    k = min(math.ceil(ratio * n), n)
    if k <= 0:
        return examples.withColumn("split", split)
    place, train = _place(seed, examples), split == "train"
    known, rows, wanted = _last_place(examples.filter(train), place, k)
    start = F.substring(place, 1, len(known))

    def marked(df: DataFrame, held_out: Column) -> DataFrame:
        return df.withColumn("split", F.when(held_out, F.lit("validation")).otherwise(split))

    if wanted == rows:
        return marked(examples, train & (start <= known))
    # equal rows share the last place: any of them will do
    equal = train & (start == known)
    some = examples.filter(equal).withColumn("_rank", F.row_number().over(Window.partitionBy("split").orderBy(F.lit(0))))
    drawn = marked(some, F.col("_rank") <= wanted).drop("_rank")
    return marked(examples.filter(~equal), train & (start < known)).unionByName(drawn)


def take_first(df: DataFrame, n: int | None, order: str = "idx") -> DataFrame:
    """The first n rows by position; all rows for None. Rows that share a position are ordered by a hash of all columns.

    Positions alone find the page of 2^16 positions where the count reaches n. Rows before it are filtered, which a
    scan can do by its statistics, and only that page is sorted.
    """
    if n is None:
        return df
    place = F.col(order).cast("long")
    page = F.shiftright(place, PAGE_BITS)
    counts = df.groupBy(page.alias("page")).agg(F.count("*").alias("rows"))
    before = Window.orderBy(F.col("page").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = counts.withColumn("upto", F.sum("rows").over(before)).filter(F.col("upto") >= n)
    cut = reached.orderBy("upto").select("page", F.lit(n) - F.col("upto") + F.col("rows")).first()
    if cut is None:
        return df
    if cut[0] is None:
        earlier, inside = F.col(order).isNotNull(), F.col(order).isNull()
    else:
        first = cut[0] << PAGE_BITS
        earlier, inside = place < first, (place >= first) & (place < first + (1 << PAGE_BITS))
    last = df.filter(inside).orderBy(order, F.xxhash64(*df.columns)).limit(cut[1])
    return df.filter(earlier).unionByName(last)


def subset(examples: DataFrame, sizes: Mapping[str, int | None]) -> DataFrame:
    """The first rows of each split by position; splits without a size stay whole."""
    cut = {name: n for name, n in sizes.items() if n is not None}
    if not cut:
        return examples
    rest = examples.filter(~F.coalesce(F.col("split").isin(list(cut)), F.lit(False)))
    return reduce(DataFrame.unionByName, [take_first(examples.filter(F.col("split") == s), n) for s, n in cut.items()], rest)
