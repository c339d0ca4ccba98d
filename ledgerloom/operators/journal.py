"""Balanced journal entries for confirmed exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.stage import numbered

#: The account that takes up each category's difference; unexplained ones have none on purpose.
LEDGERS = {
    "MDR_FEE": "Bank Charges - Payment Gateway",
    "GST_ON_FEE": "Input GST - Payment Gateway",
    "ROUNDING_DIFFERENCE": "Rounding Off",
    "REFUND_OFFSET": "Refunds Payable",
    "DUPLICATE_CONFIRMED": "Suspense - Duplicate Settlement",
    "DUPLICATE_CANDIDATE": "Suspense - Duplicate Settlement",
    "T_PLUS_N_TIMING": "Settlement In Transit",
    "PARTIAL_CAPTURE": "Settlement In Transit",
    "SPLIT_SETTLEMENT": "Settlement In Transit",
    "UTR_TRUNCATED_MAPPING": "Settlement In Transit",
    "UTR_MISSING_MAPPING": "Settlement In Transit",
    "MISSING_VS_LATE_CREDIT": "Settlement In Transit",
}
CLEARED, BANK = "Settlement In Transit", "Bank Account"


def journal(confirmed: DataFrame) -> DataFrame:
    """Two legs for each confirmed exception (exception_id, category, amount): exception_id, leg, account, debit, credit.

    No category means cleared. A category without an account raises, as does
    an amount that isn't positive.
    """
    spark = confirmed.sparkSession
    accounts = spark.createDataFrame(list(LEDGERS.items()), "category string, account string")
    rows = confirmed.join(F.broadcast(accounts), "category", "left")
    account = F.when(F.col("category").isNull(), CLEARED).when(F.col("account").isNull(), F.raise_error(F.concat(F.lit("no account for "), F.col("category")))).otherwise(F.col("account"))
    amount = F.when(F.col("amount") > 0, F.col("amount")).otherwise(F.raise_error(F.concat(F.lit("no positive amount in "), F.col("exception_id"))))
    legs = rows.select("exception_id", account.alias("account"), amount.alias("value"), F.explode(F.array(F.lit("debit"), F.lit("credit"))).alias("leg"))
    zero = F.lit(0).cast("decimal(18,2)")
    return legs.select("exception_id", "leg", F.when(F.col("leg") == "debit", F.lit(BANK)).otherwise(F.col("account")).alias("account"), F.when(F.col("leg") == "debit", F.col("value")).otherwise(zero).alias("debit"), F.when(F.col("leg") == "credit", F.col("value")).otherwise(zero).alias("credit"))


def totals(legs: DataFrame) -> DataFrame:
    return legs.groupBy("account").agg(F.sum("debit").cast("decimal(28,2)").alias("debit"), F.sum("credit").cast("decimal(28,2)").alias("credit"))


#: Vouchers of a document at most.
DOCUMENT = 10_000
FORMAT = "tally-batch-v1"


def documents(legs: DataFrame, size: int = DOCUMENT) -> DataFrame:
    """exception_id, amount, document and line of each voucher: the largest amounts first, then by id, in documents of a bounded size."""
    vouchers = legs.groupBy("exception_id").agg(F.max("debit").alias("amount")).withColumn("down", -F.col("amount"))
    placed = numbered(vouchers, ["down", "exception_id"], "place")
    return placed.select("exception_id", "amount", F.floor(F.col("place") / size).alias("document"), (F.col("place") % size).alias("line"))


def batches(placed: DataFrame, date: str, provenance: tuple[str, ...]) -> DataFrame:
    """One row for each document: its vouchers, total, key and file name. The key is over the format, the date, where the data come from, and the sorted ids, so the same batch exported twice is the same batch."""
    ids = F.array_join(F.sort_array(F.collect_list("exception_id")), "|")  # as many as a document has vouchers
    text = F.concat_ws("|", F.lit(FORMAT), F.lit(date), *[F.lit(p) for p in provenance], ids)
    rows = placed.groupBy("document").agg(F.count(F.lit(1)).alias("vouchers"), F.sum("amount").cast("decimal(28,2)").alias("total"), F.sha2(text, 256).alias("idempotency_key"))
    return rows.withColumn("filename", F.concat(F.lit(f"tally-{date}-"), F.substring("idempotency_key", 1, 16), F.lit(".xml")))


def to_close(placed: DataFrame, made: DataFrame) -> DataFrame:
    """What the exporter may close: exception_id and note, once the documents are there."""
    note = F.concat(F.lit("exported in batch "), F.substring("idempotency_key", 1, 16), F.lit(" ("), F.col("filename"), F.lit(")"))
    return placed.join(made.select("document", note.alias("note")), "document").select("exception_id", "note")


def escaped(text: Column) -> Column:
    """A text as it stands in an attribute of XML; characters that XML doesn't have become question marks."""
    out = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]", "?")
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def as_xml(legs: DataFrame, date: str) -> DataFrame:
    """A voucher's text for each exception, debit first."""
    both = legs.groupBy("exception_id").agg(F.sort_array(F.collect_list(F.struct(F.col("leg") != "debit", "account", "debit", "credit"))).alias("legs"))
    entry = lambda x: F.format_string('<ENTRY ledger="%s" debit="%s" credit="%s"/>', escaped(x["account"]), x["debit"].cast("string"), x["credit"].cast("string"))
    return both.select("exception_id", F.concat(F.format_string('<VOUCHER id="%s" date="%s">', escaped(F.col("exception_id")), F.lit(date)), F.array_join(F.transform("legs", entry), ""), F.lit("</VOUCHER>")).alias("voucher"))


VOUCHER = "_id string, _date string, ENTRY array<struct<_VALUE:string,_ledger:string,_debit:decimal(18,2),_credit:decimal(18,2)>>"


def checked(vouchers: DataFrame) -> DataFrame:
    """vouchers with what they read as; a text that isn't a voucher of two legs that balance raises."""
    read = vouchers.withColumn("read", F.from_xml("voucher", VOUCHER, {"mode": "PERMISSIVE", "rowTag": "VOUCHER"}))
    legs = F.col("read.ENTRY")
    total = lambda c: F.aggregate(legs, F.lit(0).cast("decimal(28,2)"), lambda a, x: (a + x[c]).cast("decimal(28,2)"))
    fine = (F.col("read._id") == F.col("exception_id")) & F.col("read._date").try_cast("date").isNotNull() & (F.size(legs) == 2) & F.forall(legs, lambda x: F.length(x["_ledger"]) > 0) & (total("_debit") == total("_credit")) & (total("_debit") > 0)
    sure = F.when(F.coalesce(fine, F.lit(False)), F.col("voucher")).otherwise(F.raise_error(F.concat(F.lit("no valid voucher: "), F.col("voucher"))))
    return read.select("exception_id", sure.alias("voucher"), F.size(legs).alias("legs"), total("_debit").cast("decimal(18,2)").alias("amount"))
