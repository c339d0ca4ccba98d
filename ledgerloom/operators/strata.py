"""First rows by group, and decisions scored by group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_n(rows: DataFrame, stratum: list[str], order: list, count: int) -> DataFrame:
    """The first rows of each stratum in an order that tells all rows apart. Every task keeps that many of its own before any row moves, so a large stratum is as cheap as a small one."""
    by = Window.partitionBy(*stratum).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= count).drop("_n")


def top_with_variety(rows: DataFrame, category: str, order: list, count: int) -> DataFrame:
    """The first row of each category, and the first rows of all, in one order; shown says which of both a row is there for."""
    each = first_n(rows, [category], order, 1).withColumn("shown", F.lit("first of its category"))
    top = rows.orderBy(*order).limit(count).withColumn("shown", F.lit("among the first"))
    return top.unionByName(each.exceptAll(top.withColumn("shown", F.lit("first of its category"))))


def scores(decisions: DataFrame) -> DataFrame:
    """Per stratum how decisions compare with what is true. decisions: stratum, nominated (the candidate that decided, or else the first that was offered), offered (the first), evidence_row_ids, truth (ids), confirmed, oracle_confirmed.

    A confirmation is false where the candidate that decided isn't true.
    """
    true_ = lambda c: F.coalesce(F.array_contains("truth", F.col(c)), F.lit(False))
    return decisions.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("decisions"), F.count("offered").alias("gave_hypothesis"), F.count_if(F.coalesce(F.array_contains("evidence_row_ids", F.col("nominated")), F.lit(False))).alias("nominated_a_cited_row"), F.count_if(true_("nominated")).alias("nominated_correctly"),
        F.count_if(true_("offered")).alias("top_ranked_correct"), F.count_if("confirmed").alias("confirmed"), F.count_if("oracle_confirmed").alias("oracle_confirmed"), F.count_if(F.col("confirmed") & ~true_("nominated")).alias("false_confirms"),
    )
