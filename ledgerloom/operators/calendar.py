"""Working-day arithmetic as joins with a calendar table.

A calendar has a row for each day: d, working, cum (working days up to and
with d) and next_wd (the first working day from d on). It has as many rows as
days, so it may always be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def calendar(spark: SparkSession, first: str, last: str, holidays: Iterable[str], weekly_off: Iterable[int] = (5, 6)) -> DataFrame:
    """holidays: month and day, or dates. weekly_off: days with Monday as 0."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("d"))
    off = F.weekday("d").isin(list(weekly_off)) | F.date_format("d", "MM-dd").isin(list(holidays)) | F.date_format("d", "yyyy-MM-dd").isin(list(holidays))
    order = Window.orderBy("d")
    return days.withColumn("working", ~off).select(
        "d", "working", F.sum(F.col("working").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"),
        F.min(F.when(F.col("working"), F.col("d"))).over(order.rowsBetween(0, Window.unboundedFollowing)).alias("next_wd"),
    )


def add_working_days(rows: DataFrame, days: DataFrame, date: str, n: Column | int, name: str) -> DataFrame:
    """rows with name: n working days after the first working day from date on. Null where that is outside of the calendar or n is null; a negative n raises."""
    c = F.broadcast(days.select(F.col("d").alias("_d"), "next_wd"))
    at = F.broadcast(days.select(F.col("d").alias("_n"), F.col("cum").alias("_at")))
    to = F.broadcast(days.where("working").select(F.col("cum").alias("_ord"), F.col("d").alias(name)))
    count = F.lit(n) if isinstance(n, int) else n
    sure = F.when(count < 0, F.raise_error(F.lit("can't add a negative number of working days")).cast("long")).otherwise(count.cast("long"))
    out = rows.withColumn("_count", sure).join(c, F.col(date) == F.col("_d"), "left").join(at, F.col("next_wd") == F.col("_n"), "left").join(to, F.col("_ord") == F.col("_at") + F.col("_count"), "left")
    return out.drop("_count", "_d", "next_wd", "_n", "_at", "_ord")


def working_days_between(rows: DataFrame, days: DataFrame, start: str, end: str, name: str) -> DataFrame:
    """rows with name: working days in (start, end], or minus those in [end, start) where end is earlier."""
    table = lambda p: F.broadcast(days.select(F.col("d").alias(f"_{p}d"), F.col("cum").alias(f"_{p}c"), (F.col("cum") - F.col("working").cast("long")).alias(f"_{p}b")))
    out = rows.join(table("s"), F.col(start) == F.col("_sd"), "left").join(table("e"), F.col(end) == F.col("_ed"), "left")
    value = F.when(F.col(end) >= F.col(start), F.col("_ec") - F.col("_sc")).otherwise(F.col("_eb") - F.col("_sb"))
    return out.withColumn(name, value).drop("_sd", "_sc", "_sb", "_ed", "_ec", "_eb")


def day_as_of(first: str, last: str, day: Column) -> Column:
    """The date at which a delivery day, counted from 1, is looked at: calendar days from first on. A day before the first, or after last, raises."""
    date = F.date_add(F.lit(first).cast("date"), day.cast("int") - 1)
    fine = (day >= 1) & (date <= F.lit(last).cast("date"))
    return F.when(day.isNotNull() & ~fine, F.raise_error(F.concat(F.lit("no date for day "), day.cast("string"))).cast("date")).otherwise(date)


def has_arrived(date: Column, as_of: Column) -> Column:
    """Whether what belongs to a date can be there."""
    return date <= as_of
