"""What is known to be off in the data: rolled up by target, and accounted for in both directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of several categories of one target the first of these counts.
PRECEDENCE = (
    "UNEXPLAINED", "MISSING_VS_LATE_CREDIT", "SPLIT_SETTLEMENT", "UTR_MISSING_MAPPING", "UTR_TRUNCATED_MAPPING", "DUPLICATE_CANDIDATE", "DUPLICATE_CONFIRMED",
    "PARTIAL_CAPTURE", "T_PLUS_N_TIMING", "REFUND_OFFSET", "ROUNDING_DIFFERENCE", "GST_ON_FEE", "MDR_FEE",
)


def rank(category: Column) -> Column:
    """A category's place in the order; categories that aren't in it, and none, come last."""
    place = F.array_position(F.array(*[F.lit(c) for c in PRECEDENCE]), category)
    return F.when(place > 0, place).otherwise(99).cast("int")


def roll_up(annotations: DataFrame) -> DataFrame:
    """One row for each target: its dominant category, the noise that this comes from, all its kinds of noise, the amount that they moved, and whether all of them can be resolved.

    annotations: target_kind, target_id, noise_type, category, amount, resolvable. No category is dominant only where no annotation has one.
    """
    first = F.min(F.struct(rank(F.col("category")).alias("rank"), F.col("noise_type"), F.col("category")))
    rows = annotations.groupBy("target_kind", "target_id").agg(first.alias("f"), F.sort_array(F.collect_set("noise_type")).alias("noise_types"), F.sum("amount").cast("decimal(28,2)").alias("amount"), F.bool_and("resolvable").alias("resolvable"))
    return rows.select("target_kind", "target_id", "f.category", "f.noise_type", "noise_types", "amount", "resolvable")


def account(claimed: DataFrame, observed: DataFrame) -> DataFrame:
    """Both differences, by kind: ids (kind, id) that are observed and that no annotation claims, and ids that are claimed and can't be observed."""
    key = ["kind", "id"]
    both = observed.select(*key).distinct().withColumn("seen", F.lit(True)).join(claimed.select(*key).distinct().withColumn("told", F.lit(True)), key, "full")
    return both.groupBy("kind").agg(F.count("seen").alias("observed"), F.count("told").alias("claimed"), F.count_if(F.col("told").isNull()).alias("unclaimed"), F.count_if(F.col("seen").isNull()).alias("unobserved"))
