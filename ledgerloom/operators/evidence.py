"""What an exception rests on: the ids that it cites, and the rows that lie behind them.

``trail`` walks from cited ids along the way that money takes - order, payment,
settlement line and refund, batch, bank row - one equi-join a step and never
back from a batch to all of its lines, so the walk has five steps and its rows
stay as few as the exceptions are. The rows on the way are those that
``inverted_index`` lists under each id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.normalize import UTR_LENGTH
from ledgerloom.operators.metrics import MODEL_CATEGORIES
from ledgerloom.operators.stage import kept, tasks_for

DUPLICATE = "DUPLICATE_CANDIDATE"
#: Stages of the way, in order.
STAGES = ("ledger", "payment", "settlement", "refund", "batch", "bank")


def _shown(*fields: tuple[str, str]) -> Column:
    parts = [F.concat(F.lit(f"{name}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for name, c in fields]
    return F.concat_ws(" ", *parts).alias("detail")


def named_batches(batches: DataFrame, bank: DataFrame) -> DataFrame:
    """bank_txn_id and batch_id where the narration, as it stands, holds the batch's whole reference."""
    words = bank.select("bank_txn_id", F.explode(F.regexp_extract_all("narration", F.lit(f"(?=([A-Z0-9]{{{UTR_LENGTH}}}))"), 1)).alias("utr")).distinct()
    return batches.select("batch_id", "utr").join(words, "utr").select("bank_txn_id", "batch_id")


class Rows:
    """The rows of the six tables by stage: row_id, detail, and the ids by which the way leads to them. Equal rows may come several times."""

    def __init__(self, ledger: DataFrame, payments: DataFrame, refunds: DataFrame, lines: DataFrame, batches: DataFrame, bank: DataFrame):
        def table(frame: DataFrame, key: str, *fields: tuple[str, str], by: str | None = None) -> DataFrame:
            return frame.select(F.col(key).alias("row_id"), *([F.col(by)] if by else []), _shown(*fields))

        called = bank.join(named_batches(batches, bank), "bank_txn_id", "left")
        self.by_stage = {
            "ledger": (table(ledger, "order_id", ("customer", "customer_id"), ("gross", "gross")), {}),
            "payment": (table(payments, "payment_id", ("authorized", "authorized"), ("captured", "captured"), ("status", "status"), by="order_id"), {"ledger": ("row_id", "order_id")}),
            "settlement": (table(lines, "settlement_id", ("type", "line_type"), ("gross", "gross"), ("fee", "fee"), ("tax", "tax"), ("net", "net"), by="payment_id"), {"payment": ("row_id", "payment_id")}),
            "refund": (table(refunds, "refund_id", ("amount", "amount"), ("created", "created_at"), by="payment_id"), {"payment": ("row_id", "payment_id")}),
            "batch": (table(batches, "batch_id", ("utr", "utr"), ("net_total", "net_total"), ("settled", "settled_event_date")), {"settlement": ("batch_id", "row_id")}),
            "bank": (table(called, "bank_txn_id", ("value_date", "value_date"), ("amount", "amount"), ("narration", "narration"), by="batch_id"), {"batch": ("row_id", "batch_id")}),
        }
        self.batch_of = lines.where("batch_id is not null").select(F.col("settlement_id").alias("row_id"), "batch_id")


def inverted_index(rows: Rows) -> DataFrame:
    """id, stage and row_id: every row under each id that it names, its own included. Rows are dealt by id before they are told apart."""
    out = []
    for stage, (frame, above) in rows.by_stage.items():
        keys = {"row_id", *(key for _, key in above.values() if key != "row_id")}
        out += [frame.where(F.col(k).isNotNull()).select(F.col(k).alias("id"), F.lit(stage).alias("stage"), "row_id") for k in sorted(keys)]
    out.append(rows.batch_of.select(F.col("batch_id").alias("id"), F.lit("settlement").alias("stage"), "row_id"))
    n = tasks_for(2 * sum(frame.count() for frame, _ in rows.by_stage.values()))  # a row names another's id and has its own
    return reduce(DataFrame.unionByName, out).repartition(n, "id").distinct()


def cited(exceptions: DataFrame, orders: DataFrame, pairs: DataFrame) -> DataFrame:
    """exception_id and cited, the ids that an exception is shown by.

    exceptions: exception_id, subject_id, category, evidence. A likely
    duplicate is shown by the orders of its group (pairs: order_ids), found
    through its case (orders: subject_id, order_id); any other by what it
    recorded, or else by its subject.
    """
    group = pairs.select(F.explode("order_ids").alias("order_id"), F.col("order_ids").alias("pair")).join(orders, "order_id").select("subject_id", "pair")
    likely = F.col("category").eqNullSafe(DUPLICATE)
    rows = exceptions.join(group, "subject_id", "left")
    recorded = F.coalesce("evidence", F.array().cast("array<string>"))
    plain = F.when(likely | (F.size(recorded) > 0), recorded).otherwise(F.array("subject_id"))
    return rows.select("exception_id", F.sort_array(F.when(likely & F.col("pair").isNotNull(), F.col("pair")).otherwise(plain)).alias("cited"))


def trail(cited_: DataFrame, rows: Rows) -> DataFrame:
    """exception_id, hop, stage, row_id, detail: the distinct rows behind cited ids, each with the fewest steps that lead to it. Ids that no row has lead nowhere."""
    seeds = cited_.select("exception_id", F.explode("cited").alias("row_id")).distinct()
    found: dict[str, DataFrame] = {}
    for stage, (frame, above) in rows.by_stage.items():
        own = frame.select("row_id", "detail").distinct() if stage == "bank" else frame.select("row_id", "detail")
        parts = [seeds.join(own, "row_id").select("exception_id", "row_id", "detail", F.lit(0).alias("hop"))]
        for parent, (mine, key) in above.items():
            before = found[parent].select("exception_id", F.col("row_id").alias("_from"), F.col("hop").alias("_hop"))
            if mine == "batch_id":  # a line's batch
                before = before.join(rows.batch_of.withColumnRenamed("row_id", "_from"), "_from").select("exception_id", F.col("batch_id").alias("_from"), "_hop").distinct()
            parts.append(before.join(frame, F.col("_from") == F.col(key)).select("exception_id", "row_id", "detail", (F.col("_hop") + 1).alias("hop")))
        found[stage] = kept(reduce(DataFrame.unionByName, parts).groupBy("exception_id", "row_id").agg(F.min("hop").alias("hop"), F.min("detail").alias("detail")))  # the next steps start from it
    return reduce(DataFrame.unionByName, [f.select("exception_id", "hop", F.lit(s).alias("stage"), "row_id", "detail") for s, f in found.items()])


def panel(exceptions: DataFrame, cited_: DataFrame, trail_: DataFrame, verdicts: DataFrame, audit: DataFrame | None = None) -> DataFrame:
    """One row for each exception: what it cites, how many rows of each stage lie behind it, whether the way reaches a bank row, whether a model may see it, and for a pair what checking its structure gave.

    verdicts: exception_id, passed, reason_failed of the exceptions that were
    checked. audit, where there is one, gives the number of moves.
    """
    counts = trail_.groupBy("exception_id").agg(*[F.count_if(F.col("stage") == s).alias(f"n_{s}") for s in STAGES])
    out = exceptions.select("exception_id", "category", "status").join(cited_, "exception_id").join(counts, "exception_id", "left").join(verdicts.select("exception_id", "passed", "reason_failed"), "exception_id", "left")
    moves = F.lit(None).cast("long")
    if audit is not None:
        out, moves = out.join(audit.groupBy("exception_id").agg(F.count(F.lit(1)).alias("moves")), "exception_id", "left"), F.coalesce("moves", F.lit(0))
    n = lambda s: F.coalesce(f"n_{s}", F.lit(0))
    open_pair = (F.size("cited") == 2) & F.col("status").isin("OPEN", "PENDING_EVIDENCE", "PENDING_AI_UNAVAILABLE")
    return out.select(
        "exception_id", "cited", *[n(s).alias(f"n_{s}") for s in STAGES], (n("bank") > 0).alias("trail_complete"), F.coalesce(F.col("category").isin(*MODEL_CATEGORIES), F.lit(False)).alias("eligible_for_model"),
        F.col("passed").isNotNull().alias("verification_ran"), F.coalesce("passed", F.lit(False)).alias("verification_passed"), F.coalesce("reason_failed", F.lit("")).alias("verification_failure"), F.when(open_pair, F.col("cited")).otherwise(F.array().cast("array<string>")).alias("competing"), moves.alias("moves"),
    )
