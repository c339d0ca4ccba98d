"""Duplicate ledger rows: identical ones, and orders that look like one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.stage import tasks_for

FIELDS = ("order_id", "invoice_no", "gross", "order_date", "customer_id", "sku")


def confirmed(ledger: DataFrame) -> DataFrame:
    """A row for each copy beyond the first of rows equal in all fields: order_id, copy, amount."""
    extra = ledger.groupBy(*FIELDS).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return extra.select("order_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") - 1)).alias("copy"), F.col("gross").alias("amount"))


def candidates(ledger: DataFrame) -> DataFrame:
    """Different orders of one customer over one amount, without orders that have confirmed copies: customer_id, gross, order_ids."""
    n = tasks_for(ledger.count())
    distinct = ledger.repartition(n, "order_id").groupBy(*FIELDS).agg(F.count(F.lit(1)).alias("n"))  # the aggregate and the window stay where the orders are
    once = distinct.withColumn("most", F.max("n").over(Window.partitionBy("order_id"))).where("most = 1")
    alike = once.repartition(n, "customer_id", "gross").withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy("customer_id", "gross"))).where("rows >= 2")  # lists are made of these few alone
    return alike.groupBy("customer_id", "gross").agg(F.sort_array(F.collect_set("order_id")).alias("order_ids")).where(F.size("order_ids") >= 2)


def classified(ledger: DataFrame) -> DataFrame:
    """Each distinct order with the rule that fires for it."""
    sure = confirmed(ledger).select("order_id").distinct().withColumn("sure", F.lit(True))
    likely = candidates(ledger).select(F.explode("order_ids").alias("order_id")).distinct().withColumn("likely", F.lit(True))
    rule = F.when(F.col("sure"), "CONFIRMED_DUPLICATE").when(F.col("likely"), "CANDIDATE_DUPLICATE").otherwise("NO_RULE_FIRED")
    return ledger.select("order_id").distinct().join(sure, "order_id", "left").join(likely, "order_id", "left").select("order_id", rule.alias("rule"))
