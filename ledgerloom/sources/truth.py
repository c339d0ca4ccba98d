"""Labels of known outcomes, and outcomes scored against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.normalize import rate

SCHEMA = """cases array<struct<case_id:string,payment_id:string,true_category:string,true_variance_amount:decimal(18,2),resolvable_in_principle:boolean>>,
batch_links array<struct<batch_id:string,bank_txn_id:string,true_category:string,true_variance_amount:decimal(18,2),resolvable_in_principle:boolean>>,
row_variances array<struct<row_id:string,row_kind:string,true_category:string,true_variance_amount:decimal(18,2)>>"""


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    whole = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    return {name: whole.select(F.inline(name)) for name in ("cases", "batch_links", "row_variances")}


def score_cases(outcomes: DataFrame, truth: DataFrame) -> DataFrame:
    """One row. A confirmed case with another category than the true one is a false match; rates over nothing are null."""
    rows = outcomes.join(truth.select("case_id", "true_category"), "case_id", "left")
    sure = F.col("status") == "CONFIRMED"
    wrong = sure & ~F.col("category").eqNullSafe(F.col("true_category"))
    return rows.agg(F.count(F.lit(1)).alias("cases"), F.count_if(sure).alias("confirmed"), F.count_if(wrong).alias("false_matches"), rate(F.count_if(sure), F.count(F.lit(1))).alias("match_rate"), rate(F.count_if(wrong), F.count_if(sure)).alias("false_match_rate"))


def score_links(outcomes: DataFrame, truth: DataFrame) -> DataFrame:
    rows = outcomes.join(truth.select("batch_id", F.col("bank_txn_id").alias("true_bank")), "batch_id", "left")
    sure = F.col("status") == "CONFIRMED"
    wrong = sure & ~F.col("bank_row_id").eqNullSafe(F.col("true_bank"))
    return rows.agg(F.count(F.lit(1)).alias("batches"), F.count_if(sure).alias("linked"), F.count_if(wrong).alias("false_links"), rate(F.count_if(sure), F.count(F.lit(1))).alias("link_rate"), rate(F.count_if(wrong), F.count_if(sure)).alias("false_link_rate"))


def score_rows(outcomes: DataFrame, truth: DataFrame) -> DataFrame:
    """Recall and precision of row variances by row, table and category."""
    key = ["row_id", "source_table", "category"]
    table = F.when(F.col("row_kind") == "ledger_row", "ledger_rows").otherwise("bank_rows")
    want = truth.select("row_id", table.alias("source_table"), F.col("true_category").alias("category")).distinct()
    got = outcomes.select(*key).distinct()
    both = got.withColumn("got", F.lit(1)).join(want.withColumn("want", F.lit(1)), key, "full")
    hit = F.count_if(F.col("got").isNotNull() & F.col("want").isNotNull())
    return both.agg(F.count("got").alias("found"), F.count("want").alias("true"), hit.alias("hits"), rate(hit, F.count("want")).alias("recall"), rate(hit, F.count("got")).alias("precision"))
