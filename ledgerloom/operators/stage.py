"""Tables between the steps of a plan, in the folder that all executors share."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one task sorts or tells apart at a time.
ROWS_A_TASK = 250_000


def tasks_for(rows: int) -> int:
    """A number of partitions to name for so many rows. Spark leaves a number that is named as it is; others it merges by what rows take once they are compressed, which for ids in sequence is little."""
    return max(1, math.ceil(rows / ROWS_A_TASK))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the session's checkpoint folder."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(frame: DataFrame) -> DataFrame:
    """frame, written and read again: computed once, with no lineage behind it."""
    path = shared_path(frame.sparkSession, "stage")
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their place, from 0, in the order of some columns. Spark sorts them into ranges, each of which goes on from those before it; only a row for each range is added up in one place. Equal rows have places next to each other."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = kept(ranged.withColumn("_range", F.shiftright("_at", 33).cast("int")))
    counts = ranged.groupBy("_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("_range", "_first", before.alias("_before")))  # as many rows as ranges
    return ranged.join(starts, "_range").withColumn(name, F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_range", "_first", "_before")
