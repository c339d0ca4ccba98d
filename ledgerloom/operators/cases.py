"""Payment cases: what each payment should have settled to, and what it did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.normalize import money, profile_of, stable_id
from ledgerloom.operators import duplicates

TOLERANCE = "1.00"


def last_ledger_row(ledger: DataFrame) -> DataFrame:
    """One row of each order: the last one in the order of its fields as text."""
    rest = [c for c in ledger.columns if c != "order_id"]
    last = F.max_by(F.struct(*rest), F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in duplicates.FIELDS[1:]]))
    return ledger.groupBy("order_id").agg(last.alias("last")).select("order_id", "last.*")


def payment_links(lines: DataFrame, payments: DataFrame) -> DataFrame:
    """Per payment with lines: payment_line_ids, settlement_line_ids, batch_ids, is_split."""
    own = lines.join(payments.select("payment_id"), "payment_id", "left_semi")
    grouped = own.groupBy("payment_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("line_type") == "payment", F.col("settlement_id")))).alias("payment_line_ids"),
        F.sort_array(F.collect_list("settlement_id")).alias("settlement_line_ids"),
        F.sort_array(F.collect_set("batch_id")).alias("batch_ids"),
    )
    return grouped.withColumn("is_split", F.size("payment_line_ids") >= 2)


def orphan_lines(lines: DataFrame, payments: DataFrame) -> DataFrame:
    return lines.join(payments.select("payment_id"), "payment_id", "left_anti")


def refund_links(lines: DataFrame, refunds: DataFrame) -> DataFrame:
    """Each refund with its line, if there is one, and whether the amounts agree."""
    own = lines.where("line_type = 'refund'").select("refund_id", "settlement_id", "net")
    return refunds.join(own, "refund_id", "left").select("refund_id", "payment_id", "settlement_id", "amount", (F.abs("net") == F.col("amount")).alias("amount_agrees"))


def orphan_refund_lines(lines: DataFrame, refunds: DataFrame) -> DataFrame:
    return lines.where("line_type = 'refund'").join(refunds.select("refund_id"), "refund_id", "left_anti")


def case_facts(ledger: DataFrame, payments: DataFrame, refunds: DataFrame, lines: DataFrame, rates: DataFrame, gst: str) -> DataFrame:
    """A case for each payment, whatever its status."""
    orders = last_ledger_row(ledger).select("order_id", F.col("gross").alias("order_gross"), profile_of(F.col("customer_id")).alias("merchant_profile"))
    returned = refunds.groupBy("payment_id").agg(F.sum("amount").cast("decimal(18,2)").alias("refund_total"))
    paid = F.col("line_type") == "payment"
    settled = lines.groupBy("payment_id").agg(
        F.sort_array(F.collect_list(F.when(paid, F.col("settlement_id")))).alias("payment_line_ids"),
        F.sort_array(F.collect_list("settlement_id")).alias("settlement_line_ids"),
        F.sort_array(F.collect_set("batch_id")).alias("batch_ids"),
        F.coalesce(F.sum(F.when(paid, F.col("gross"))), F.lit(0)).cast("decimal(18,2)").alias("settled_gross"),
        F.sum("net").cast("decimal(18,2)").alias("line_net_total"),
        F.max(F.when(paid, F.col("settled_event_date"))).alias("last_settled"),
    )
    zero, none = F.lit(0).cast("decimal(18,2)"), F.array().cast("array<string>")
    fee = money(F.col("captured") * F.col("rate"))
    tax = money(F.col("fee") * F.lit(gst).cast("decimal(6,4)"))
    dim = F.broadcast(rates.select(F.col("profile").alias("merchant_profile"), "method", "rate"))  # one row for each profile and method
    return (
        payments.join(orders, "order_id", "left").join(dim, ["merchant_profile", "method"], "left").join(returned, "payment_id", "left").join(settled, "payment_id", "left")
        .withColumn("refund_total", F.coalesce("refund_total", zero)).withColumn("fee", fee).withColumn("tax", tax)
        .select(
            stable_id(F.lit("case"), F.col("payment_id")).alias("case_id"), "payment_id", "order_id", "merchant_profile", "authorized", "captured", "captured_at",
            F.col("order_gross").alias("expected_gross"), (F.col("captured") - F.col("fee") - F.col("tax") - F.col("refund_total")).cast("decimal(18,2)").alias("expected_net"),
            "fee", "tax", "refund_total", F.coalesce("payment_line_ids", none).alias("payment_line_ids"), F.coalesce("settlement_line_ids", none).alias("settlement_line_ids"),
            F.coalesce("batch_ids", none).alias("batch_ids"), F.coalesce("settled_gross", zero).alias("settled_gross"), "line_net_total", "last_settled",
        )
    )


def case_outcomes(facts: DataFrame, ledger: DataFrame, days: DataFrame) -> DataFrame:
    """Status, variance and category of each case.

    The amounts are explained by a partial capture, then by rounding up to
    the tolerance. What is left unexplained, a possible duplicate order and a
    payment without any line keep a case open.
    """
    due = F.broadcast(days.select(F.col("d").alias("captured_at"), F.col("next_wd").alias("due")))
    likely = duplicates.candidates(ledger).select(F.explode("order_ids").alias("order_id")).distinct().withColumn("likely", F.lit(True))
    zero = F.lit(0).cast("decimal(18,2)")
    rows = facts.join(due, "captured_at", "left").join(likely, "order_id", "left")
    rows = rows.withColumn("variance", (F.col("authorized") - F.col("settled_gross")).cast("decimal(18,2)"))
    rows = rows.withColumn("partial", F.when(F.col("authorized") > F.col("captured"), F.col("authorized") - F.col("captured")).otherwise(zero))
    rows = rows.withColumn("rest", (F.col("variance") - F.col("partial")).cast("decimal(18,2)"))
    small = (F.col("rest") != 0) & (F.abs("rest") <= F.lit(TOLERANCE).cast("decimal(18,2)"))
    rows = rows.withColumn("rounding", F.when(small, F.col("rest")).otherwise(zero)).withColumn("unexplained", F.when(small, zero).otherwise(F.col("rest")))
    late = F.col("last_settled").isNotNull() & (F.col("last_settled") != F.col("due"))
    no_line = F.size("settlement_line_ids") == 0
    by_amount = F.when((F.col("partial") > 0) & (F.col("partial") > F.abs("rounding")), "PARTIAL_CAPTURE").when(F.col("rounding") != 0, "ROUNDING_DIFFERENCE")
    category = F.when(F.col("unexplained") != 0, "UNEXPLAINED").otherwise(F.coalesce(by_amount, F.when(late, "T_PLUS_N_TIMING").when(F.col("likely"), "DUPLICATE_CANDIDATE")))
    is_open = (F.col("unexplained") != 0) | F.coalesce("likely", F.lit(False)) | no_line
    return rows.select(
        "case_id", "payment_id", "order_id", F.when(is_open, "OPEN").otherwise("CONFIRMED").alias("status"), F.col("line_net_total").alias("observed_net"), "variance", category.alias("category"),
        F.get("batch_ids", F.lit(0)).alias("batch_id"), F.when(~is_open, "DETERMINISTIC").alias("resolved_by"), "expected_gross", "expected_net", "unexplained",
    )


#: Which finding that moves no money names a case, where none moves any.
ZERO_PRECEDENCE = ("T_PLUS_N_TIMING", "ROUNDING_DIFFERENCE", "DUPLICATE_CANDIDATE")
COMPONENT = "array<struct<category:string,amount:decimal(18,2)>>"


def components(facts: DataFrame, ledger: DataFrame, days: DataFrame) -> DataFrame:
    """case_id, total, components (category, amount, in order of category), unexplained and headline of each case.

    A component of its own for a partial capture, a late line, a likely
    duplicate and rounding. Components and what is unexplained add up to the
    total; a case where they don't raises.
    """
    due = F.broadcast(days.select(F.col("d").alias("captured_at"), F.col("next_wd").alias("due")))
    likely = duplicates.candidates(ledger).select(F.explode("order_ids").alias("order_id")).distinct().withColumn("likely", F.lit(True))
    zero = F.lit(0).cast("decimal(18,2)")
    rows = facts.join(due, "captured_at", "left").join(likely, "order_id", "left").withColumn("total", (F.col("authorized") - F.col("settled_gross")).cast("decimal(18,2)"))
    partial = (F.col("authorized") - F.col("captured")).cast("decimal(18,2)")
    one = lambda category, amount, when: F.when(when, F.struct(F.lit(category).alias("category"), amount.cast("decimal(18,2)").alias("amount")))
    found = [one("PARTIAL_CAPTURE", partial, partial > 0), one("T_PLUS_N_TIMING", zero, F.col("last_settled") != F.col("due")), one("DUPLICATE_CANDIDATE", zero, F.coalesce("likely", F.lit(False)))]
    rest = F.col("total") - F.greatest(partial, zero)
    found.append(one("ROUNDING_DIFFERENCE", rest, (rest != 0) & (F.abs(rest) <= F.lit(TOLERANCE).cast("decimal(18,2)"))))
    rows = rows.withColumn("components", F.sort_array(F.array_compact(F.array(*found))).cast(COMPONENT))
    return balanced(rows.withColumn("headline", headline(F.col("components")))).select("case_id", "total", "components", "unexplained", "headline")


def balanced(rows: DataFrame) -> DataFrame:
    """rows (total, components) with unexplained, the rest; an attribution that doesn't add up to the total in whole paise raises."""
    attributed = F.aggregate("components", F.lit(0).cast("decimal(18,2)"), lambda a, c: (a + c["amount"]).cast("decimal(18,2)"))
    rest = (F.col("total") - attributed).cast("decimal(18,2)")
    adds_up = F.coalesce(attributed + rest == F.col("total"), F.lit(False))
    return rows.withColumn("unexplained", F.when(adds_up, rest).otherwise(F.raise_error(F.lit("a variance isn't the sum of its parts")).cast("decimal(18,2)")))


def headline(parts: Column) -> Column:
    """The category that names a case: the largest amount, of equal ones the last by name; where no money moves the first in the order of ZERO_PRECEDENCE, then by name."""
    moving = F.filter(parts, lambda c: c["amount"] != 0)
    largest = F.element_at(F.sort_array(F.transform(moving, lambda c: F.struct(F.abs(c["amount"]).alias("a"), c["category"].alias("c")))), -1)["c"]
    has = lambda name: F.exists(parts, lambda c: c["category"] == name)
    still = F.when(has(ZERO_PRECEDENCE[0]), ZERO_PRECEDENCE[0])
    for name in ZERO_PRECEDENCE[1:]:
        still = still.when(has(name), name)
    return F.when(F.size(moving) > 0, largest).otherwise(F.coalesce(still, F.array_min(F.transform(parts, lambda c: c["category"]))))


def deduction_reference(gross: Column, net: Column) -> Column:
    """What is to be taken off an amount in all, fees, tax and refunds; a figure to report, never a variance."""
    return money(gross - net)


def residual_cases(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("status <> 'CONFIRMED'")


def batch_profiles(lines: DataFrame, payments: DataFrame, ledger: DataFrame) -> DataFrame:
    """The merchant profile of each batch, through its lines' payments and orders; more than one raises."""
    orders = last_ledger_row(ledger).select("order_id", profile_of(F.col("customer_id")).alias("profile"))
    found = lines.select("batch_id", "payment_id").distinct().join(payments.select("payment_id", "order_id"), "payment_id").join(orders, "order_id")
    grouped = found.groupBy("batch_id").agg(F.min("profile").alias("profile"), F.max("profile").alias("_other"))
    return grouped.select("batch_id", F.when(F.col("profile") == F.col("_other"), F.col("profile")).otherwise(F.raise_error(F.concat(F.lit("several profiles in batch "), F.col("batch_id")))).alias("profile"))
