"""Exceptions: their ids, their legal moves, and views of the table that ``store`` keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The legal moves of an exception.
TRANSITIONS = {
    "OPEN": ("PENDING_EVIDENCE", "PENDING_AI_UNAVAILABLE", "CONFIRMED", "ABSTAINED"),
    "PENDING_EVIDENCE": ("OPEN",),
    "PENDING_AI_UNAVAILABLE": ("OPEN",),
    "CONFIRMED": ("CLOSED",),
    "ABSTAINED": ("CONFIRMED",),
    "CLOSED": (),
}


def exception_id(population: Column, subject: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.lit("exception"), population, subject), 256), 1, 16)


def idempotency_key(id_: Column, kind: Column, evidence: Column) -> Column:
    return F.sha2(F.concat_ws("|", id_, kind, F.sort_array(evidence)), 256)


def transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, to in TRANSITIONS.items() for b in to], "from_status string, to_status string")


def illegal(moves: DataFrame) -> DataFrame:
    """Moves (from_status, to_status) that the table doesn't have."""
    return moves.join(F.broadcast(transitions(moves.sparkSession)), ["from_status", "to_status"], "left_anti")


def _at_stake(rows: DataFrame, population: str, subject: Column, amount: Column, resolved_by: Column, cited: str, kind: str, none: str) -> DataFrame:
    why = F.concat(F.lit(f"{kind} "), F.col({"A": "case_id", "B": "batch_id", "C": "row_id"}[population]), F.lit(": "), F.coalesce("category", F.lit(none)))
    out = rows.select(F.lit(population).alias("population"), subject.alias("subject_id"), "status", "category", amount.cast("decimal(18,2)").alias("amount"), resolved_by.cast("string").alias("resolved_by"), F.array_compact(F.array(cited)).alias("evidence"), why.alias("reason"))
    return out.withColumn("exception_id", exception_id(F.col("population"), F.col("subject_id")))


def of_cases(cases: DataFrame) -> DataFrame:
    """What is at stake in a case is its variance, or its whole amount where that is 0."""
    amount = F.when(F.coalesce(F.col("variance"), F.lit(0)) == 0, F.col("expected_gross")).otherwise(F.col("variance"))
    return _at_stake(cases, "A", F.col("case_id"), amount, F.col("resolved_by"), "batch_id", "case", "unresolved")


def of_links(links: DataFrame) -> DataFrame:
    return _at_stake(links, "B", F.col("batch_id"), F.col("batch_net_total"), F.col("resolved_by"), "bank_row_id", "batch", "unlinked")


def of_rows(rows: DataFrame) -> DataFrame:
    return _at_stake(rows, "C", F.concat_ws("|", "source_table", "row_id"), F.coalesce("amount", F.lit(0)), F.lit(None), "row_id", "row", "unexplained")


def outcomes_of(cases: DataFrame, links: DataFrame, rows: DataFrame) -> DataFrame:
    """The three populations side by side, with the amount that is at stake in each: subject_id, status, category, amount, resolved_by, evidence (ids) and reason."""
    return of_cases(cases).unionByName(of_links(links)).unionByName(of_rows(rows))


def opened(outcomes: DataFrame, day: int) -> DataFrame:
    """New exceptions for subjects that are not confirmed, one for each subject."""
    first = outcomes.where("status <> 'CONFIRMED'").groupBy("exception_id").agg(*[F.min_by(c, F.struct("category", "amount")).alias(c) for c in ("population", "subject_id", "status", "category", "amount")])
    none = lambda kind: F.lit(None).cast(kind)
    return first.select("exception_id", "population", "subject_id", "status", "category", "amount", F.lit(day).alias("first_seen_day"), none("int").alias("confirmed_day"), none("int").alias("closed_day"), none("string").alias("resolved_by"), none("string").alias("note"))


def queue(state: DataFrame, statuses: tuple[str, ...], population: str | None = None) -> DataFrame:
    """The largest amounts first, then by id. Statuses have to be named."""
    if not statuses:
        raise ValueError("name the statuses to list")
    rows = state.where(F.col("status").isin(*statuses))
    return (rows.where(F.col("population") == population) if population else rows).orderBy(F.col("amount").desc(), "exception_id")


def residual_sequence(state: DataFrame, days: DataFrame) -> DataFrame:
    """For each day (arrival_day) the exceptions that were seen by then and neither confirmed nor closed.

    Exceptions are counted by their days first, so the join is of days with days.
    """
    counted = state.groupBy("first_seen_day", "confirmed_day", "closed_day").agg(F.count(F.lit(1)).alias("n"))
    live = (F.col("first_seen_day") <= F.col("arrival_day")) & F.coalesce(F.col("confirmed_day") > F.col("arrival_day"), F.lit(True)) & F.col("closed_day").isNull()
    return days.join(F.broadcast(counted), live, "left").groupBy("arrival_day").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("residual"))
