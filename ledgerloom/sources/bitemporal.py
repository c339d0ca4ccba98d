"""Rows with two times: the day that they belong to (event_day) and the day that brought them (arrival_day).

A later delivery never changes event_day. What stood on a day are the rows that
had arrived by then; where rows of a key are versions of one thing, the version
that came last.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_days(days: list[DataFrame]) -> DataFrame:
    """All rows of some days together, none dropped, with arrival_day, the highest of any of them. No days at all raise."""
    if not days:
        raise ValueError("there are no days to merge")
    rows = reduce(DataFrame.unionByName, days)
    last = F.broadcast(rows.agg(F.max("arrival_day").alias("arrival_day")))  # one row
    return rows.drop("arrival_day").join(last)


def standing(rows: DataFrame, day: int) -> DataFrame:
    """The rows that had arrived by a day."""
    return rows.where(F.col("arrival_day") <= day)


def is_late() -> Column:
    return F.col("arrival_day") > F.col("event_day")


def history(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows with valid_from and valid_to: a version holds from its arrival to the day before the next version's. Of several versions of a day the last in the order of the columns as text holds; the others never do and are left out."""
    rest = [c for c in rows.columns if c not in key and c != "arrival_day"]
    text = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rest]) if rest else F.lit("")
    a_day = rows.groupBy(*key, "arrival_day").agg(F.max_by(F.struct(*(rest or [F.lit("").alias("_")])), text).alias("v"))
    following = F.lead("arrival_day").over(Window.partitionBy(*key).orderBy("arrival_day"))  # versions of one key, a row a day at most
    return a_day.select(*key, *[f"v.{c}" for c in rest], "arrival_day", F.col("arrival_day").alias("valid_from"), (following - 1).alias("valid_to"))


def as_of(versions: DataFrame, days: DataFrame) -> DataFrame:
    """What stood on each of some days (day): the versions of ``history`` that hold on it. days has as many rows as a calendar, so it is sent to all tasks."""
    holds = F.col("day").between(F.col("valid_from"), F.coalesce("valid_to", F.lit(2**31 - 1)))
    return versions.join(F.broadcast(days), holds).drop("valid_from", "valid_to")


def latest(rows: DataFrame, key: list[str], day: int) -> DataFrame:
    """The last version of each key that had arrived by a day."""
    return history(standing(rows, day), key).where("valid_to is null").drop("valid_from", "valid_to")
