"""A digest of rows in an order, computed by ranges.

Spark sorts the rows into ranges and numbers them; every ARITY neighbours are
digested together, and their digests again, until one is left. So the digest
depends on rows and order alone, whatever the partitions, and no task holds
more than ARITY rows of it. ``levels`` stops at a fixed height instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.stage import kept, numbered

ARITY = 1024


def _leaves(rows: DataFrame, order: list[str], text: Column) -> DataFrame:
    """_place and _digest of each row, in order and then by digest."""
    return kept(numbered(rows.select(*order, F.sha2(text, 256).alias("_digest")), [*order, "_digest"], "_place").select("_place", "_digest"))


def _above(level: DataFrame) -> DataFrame:
    listed = F.transform(F.sort_array(F.collect_list(F.struct("_place", "_digest"))), lambda x: x["_digest"])  # ARITY at most
    return level.groupBy(F.floor(F.col("_place") / ARITY).alias("_place")).agg(F.sha2(F.array_join(listed, ""), 256).alias("_digest"))


def tree(rows: DataFrame, order: list[str], text: Column) -> DataFrame:
    """One row: rows, how many there were, and digest. A row's own digest is that of its text; no rows have the digest of the empty text."""
    placed = _leaves(rows, order, text)
    n = placed.count()
    level, left = placed, n
    while left > 1:
        level = kept(_above(level))
        left = -(-left // ARITY)
    return level.agg(F.lit(n).cast("long").alias("rows"), F.coalesce(F.max("_digest"), F.sha2(F.lit(""), 256)).alias("digest"))


def levels(rows: DataFrame, order: list[str], text: Column, height: int) -> DataFrame:
    """rows and digest for each node at a fixed height above the rows: one for each ARITY ** height of them, none for no rows."""
    level = _leaves(rows, order, text)
    n = level.count()
    for _ in range(height):
        level = _above(level)
    return level.select(F.lit(n).cast("long").alias("rows"), F.col("_digest").alias("digest"))
