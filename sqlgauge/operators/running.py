"""Running totals over groups of any size.

A window over a whole group would put the group into one task. Positions are cut into pages, and pages
into books: the window over rows sees one page, the window over page totals one book, and the window over
book totals one group. With positions below 2^48 each of the three sees at most 2^16 rows of a group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_BITS = 16


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    amounts: Mapping[str, Column],
    page_bits: int = PAGE_BITS,
) -> DataFrame:
    """Adds, for each named amount, its total over the group's rows up to and including this position.

    ``position`` is a whole number, unique within a group.
    """
    names = list(amounts)
    place = F.col(position).cast("long")

    def part(number: Column) -> Column:
        # never NULL: a NULL check that Spark adds to one branch only would keep it from sharing the shuffle
        return F.coalesce(F.shiftright(number, page_bits), F.lit(0).cast("long"))

    rows = df.select(
        "*", *[amounts[n].cast("long").alias(n) for n in names], part(place).alias("_page")
    )
    pages = rows.groupBy(*keys, "_page").agg(*[F.sum(n).alias(f"_{n}") for n in names])
    pages = pages.withColumn("_book", part(F.col("_page")))
    books = pages.groupBy(*keys, "_book").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in names])

    before_book = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_book").rowsBetween(
        Window.unboundedPreceding, -1
    )
    books = books.select(
        *keys,
        "_book",
        *[F.coalesce(F.sum(f"_{n}").over(before_book), F.lit(0)).alias(f"_book_{n}") for n in names],
    )
    before_page = Window.partitionBy(*keys, "_book").orderBy("_page").rowsBetween(
        Window.unboundedPreceding, -1
    )
    pages = pages.select(
        *keys,
        "_book",
        "_page",
        *[F.coalesce(F.sum(f"_{n}").over(before_page), F.lit(0)).alias(f"_page_{n}") for n in names],
    )
    starts = pages.join(books, [*keys, "_book"]).select(
        *keys, "_page", *[(F.col(f"_page_{n}") + F.col(f"_book_{n}")).alias(f"_start_{n}") for n in names]
    )
    in_page = Window.partitionBy(*keys, "_page").orderBy(position).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    totals = rows.select(
        *df.columns, "_page", *[F.sum(n).over(in_page).alias(n) for n in names]
    ).join(starts, [*keys, "_page"])
    return totals.select(
        *df.columns, *[(F.col(n) + F.col(f"_start_{n}")).alias(n) for n in names]
    )
