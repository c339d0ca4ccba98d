"""Queries over the ledger, payments, refunds and settlement lines."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.normalize import rate, stable_id
from ledgerloom.operators import calendar, cases, duplicates
from ledgerloom.operators.stage import shared_path, tasks_for
from ledgerloom.plans.engine import over_lens
from ledgerloom.plans.lens import FIRST_DAY, GST, LAST_DAY, oracle
from ledgerloom.sources import settlement_csv

QUERIES, ORACLES = {}, {}


def query(select: str | None):
    """Registers a function of an Engine, with its SQL over the lens."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(over_lens(spark, sf_dir))
        if select is not None:
            ORACLES[f.__name__] = oracle(select)
        return f

    return register


COPIES = "SELECT order_id, gross, count(*) AS n FROM ledger GROUP BY order_id, invoice_no, gross, order_date, customer_id, sku HAVING count(*) > 1"
LIKELY = f"SELECT customer_id, gross, list_sort(list(DISTINCT order_id)) AS order_ids FROM ledger WHERE order_id NOT IN (SELECT order_id FROM ({COPIES})) GROUP BY ALL HAVING count(DISTINCT order_id) >= 2"
#: Views that further queries build on.
FACTS = f""", likely AS (SELECT unnest(order_ids) AS order_id FROM ({LIKELY})),
one_order AS (SELECT DISTINCT order_id, gross AS order_gross, 'profile_' || lower(substr(customer_id, 14, 1)) AS merchant_profile FROM ledger),
back AS (SELECT payment_id, sum(amount) AS refund_total FROM refunds GROUP BY 1),
got AS (
  SELECT payment_id, coalesce(list_sort(list(settlement_id) FILTER (line_type = 'payment')), []) AS payment_line_ids, list_sort(list(settlement_id)) AS settlement_line_ids, list_sort(list(DISTINCT batch_id)) AS batch_ids,
         coalesce(sum(gross) FILTER (line_type = 'payment'), 0) AS settled_gross, sum(net) AS line_net_total, max(settled_event_date) FILTER (line_type = 'payment') AS last_settled
  FROM lines GROUP BY 1),
facts AS (
  SELECT substr(sha256('case|' || p.payment_id), 1, 16) AS case_id, p.*, merchant_profile, order_gross AS expected_gross, cast(round(captured * rate, 2) AS decimal(18,2)) AS fee,
         cast(round(cast(round(captured * rate, 2) AS decimal(18,2)) * {GST}, 2) AS decimal(18,2)) AS tax, cast(coalesce(refund_total, 0) AS decimal(18,2)) AS refund_total,
         coalesce(payment_line_ids, []) AS payment_line_ids, coalesce(settlement_line_ids, []) AS settlement_line_ids, coalesce(batch_ids, []) AS batch_ids,
         cast(coalesce(settled_gross, 0) AS decimal(18,2)) AS settled_gross, cast(line_net_total AS decimal(18,2)) AS line_net_total, last_settled
  FROM payments p LEFT JOIN one_order USING (order_id) LEFT JOIN rates r ON r.profile = merchant_profile AND r.method = p.method LEFT JOIN back USING (payment_id) LEFT JOIN got USING (payment_id)),
split AS (
  SELECT f.*, c.next_wd AS due, f.order_id IN (SELECT order_id FROM likely) AS likely, cast(authorized - settled_gross AS decimal(18,2)) AS variance, greatest(authorized - captured, 0) AS partial
  FROM facts f LEFT JOIN calendar c ON c.d = captured_at),
parts AS (
  SELECT *, CASE WHEN abs(variance - partial) <= 1 THEN variance - partial ELSE 0 END AS rounding, CASE WHEN abs(variance - partial) <= 1 THEN 0 ELSE variance - partial END AS unexplained FROM split),
outcomes AS (
  SELECT case_id, payment_id, order_id, CASE WHEN unexplained <> 0 OR likely OR len(settlement_line_ids) = 0 THEN 'OPEN' ELSE 'CONFIRMED' END AS status, line_net_total AS observed_net, variance,
         CASE WHEN unexplained <> 0 THEN 'UNEXPLAINED' WHEN partial > abs(rounding) THEN 'PARTIAL_CAPTURE' WHEN rounding <> 0 THEN 'ROUNDING_DIFFERENCE'
              WHEN last_settled <> due THEN 'T_PLUS_N_TIMING' WHEN likely THEN 'DUPLICATE_CANDIDATE' END AS category,
         batch_ids[1] AS batch_id, CASE WHEN NOT (unexplained <> 0 OR likely OR len(settlement_line_ids) = 0) THEN 'DETERMINISTIC' END AS resolved_by,
         expected_gross, cast(captured - fee - tax - refund_total AS decimal(18,2)) AS expected_net, cast(unexplained AS decimal(18,2)) AS unexplained
  FROM parts)
"""


#: Of each table the date by whose year its rows are delivered, in files of three days.
DATED = {"ledger": "order_date", "payments": "captured_at", "refunds": "created_at", "lines": "settled_event_date", "batches": "settled_event_date", "bank": "value_date"}


def delivered(e, table: str):
    """A table written as daily CSV files and read again."""
    spark, folder = e.ledger.sparkSession, shared_path(e.ledger.sparkSession, "deliveries")
    settlement_csv.write(getattr(e, table).withColumn("arrival_day", F.year(DATED[table]) % 3 + 1), folder, table)
    return settlement_csv.load(spark, folder, table)


@query("SELECT order_id, invoice_no, gross, order_date, customer_id, sku, cast(year(order_date) % 3 + 1 AS int) AS arrival_day FROM ledger")
def s_typed_ledger(e):
    return delivered(e, "ledger")


@query("SELECT 'lines' AS tab, cast(year(settled_event_date) % 3 + 1 AS int) AS arrival_day, count(*) AS n, cast(sum(net) AS decimal(28,2)) AS total FROM lines GROUP BY 2 UNION ALL SELECT 'bank', cast(year(value_date) % 3 + 1 AS int), count(*), cast(sum(amount) AS decimal(28,2)) FROM bank GROUP BY 2")
def s_delivered_days(e):
    """Lines and bank rows through their files, by the day they came."""
    of = lambda t, c: delivered(e, t).groupBy(F.lit(t).alias("tab"), "arrival_day").agg(F.count(F.lit(1)).alias("n"), F.sum(c).cast("decimal(28,2)").alias("total"))
    return of("lines", "net").unionByName(of("bank", "amount"))


@query("SELECT 'ledger' AS tab, count(*) AS n FROM ledger UNION ALL SELECT 'payments', count(*) FROM payments UNION ALL SELECT 'refunds', count(*) FROM refunds UNION ALL SELECT 'lines', count(*) FROM lines UNION ALL SELECT 'batches', count(*) FROM batches UNION ALL SELECT 'bank', count(*) FROM bank")
def s_row_counts(e):
    """Rows of each table's files."""
    counts = [delivered(e, t).groupBy(F.lit(t).alias("tab")).agg(F.count(F.lit(1)).alias("n")) for t in DATED]
    return functools.reduce(DataFrame.unionByName, counts)


@query("SELECT c.d, working, cast(cum AS bigint) AS cum, next_wd, coalesce(n, 0) AS lines, coalesce(m, 0) AS captures FROM calendar c LEFT JOIN (SELECT settled_event_date AS d, count(*) AS n FROM lines GROUP BY 1) l USING (d) LEFT JOIN (SELECT captured_at AS d, count(*) AS m FROM payments GROUP BY 1) p USING (d)")
def cal_working_days(e):
    """Each day of the calendar with the lines that settle on it and the payments that are captured on it."""
    of = lambda frame, date, name: frame.groupBy(F.col(date).alias("d")).agg(F.count(F.lit(1)).alias(name))
    rows = e.days.join(of(e.lines, "settled_event_date", "lines"), "d", "left").join(of(e.payments, "captured_at", "captures"), "d", "left")
    return rows.fillna(0, ["lines", "captures"])


@query("SELECT s.day, s.arrivals, date '1994-12-01' + cast(s.day AS int) - 1 AS looked_at FROM (SELECT date_diff('day', date '1994-12-01', order_date) + 1 AS day, count(*) AS arrivals FROM ledger GROUP BY 1) s")
def cal_day_as_of(e):
    """Orders by the number of their day, and the date that this day is looked at."""
    rows = e.ledger.select((F.datediff("order_date", F.lit(FIRST_DAY).cast("date")) + 1).cast("long").alias("day")).groupBy("day").agg(F.count(F.lit(1)).alias("arrivals"))
    return rows.withColumn("looked_at", calendar.day_as_of(FIRST_DAY, LAST_DAY, F.col("day")))


@query("SELECT payment_id, captured_at, w.d AS due FROM charges JOIN cycles USING (profile) JOIN calendar c ON c.d = captured_at JOIN calendar n ON n.d = c.next_wd JOIN working w ON w.ord = n.cum + cycle")
def cal_add_working_days(e):
    profiled = e.facts.select("payment_id", "captured_at", F.col("merchant_profile").alias("profile")).join(F.broadcast(e.cycles), "profile")
    return calendar.add_working_days(profiled, e.days, "captured_at", F.col("cycle").cast("long"), "due").select("payment_id", "captured_at", "due")


@query("""SELECT settlement_id, l.settled_event_date, captured_at, cast(CASE WHEN l.settled_event_date >= captured_at THEN (SELECT count(*) FROM working w WHERE w.d > captured_at AND w.d <= l.settled_event_date)
  ELSE -(SELECT count(*) FROM working w WHERE w.d >= l.settled_event_date AND w.d < captured_at) END AS bigint) AS days_late FROM lines l JOIN payments USING (payment_id)
  UNION ALL SELECT settlement_id, captured_at, l.settled_event_date, cast(CASE WHEN captured_at >= l.settled_event_date THEN (SELECT count(*) FROM working w WHERE w.d > l.settled_event_date AND w.d <= captured_at)
  ELSE -(SELECT count(*) FROM working w WHERE w.d >= captured_at AND w.d < l.settled_event_date) END AS bigint) FROM lines l JOIN payments USING (payment_id)""")
def cal_working_days_between(e):
    rows = e.lines.join(e.payments, "payment_id").select("settlement_id", "settled_event_date", "captured_at")
    both = rows.unionByName(rows.select("settlement_id", F.col("captured_at").alias("settled_event_date"), F.col("settled_event_date").alias("captured_at")))
    return calendar.working_days_between(both, e.days, "captured_at", "settled_event_date", "days_late")


@query("""SELECT payment_id, coalesce(list_sort(list(settlement_id) FILTER (line_type = 'payment')), []) AS payment_line_ids, list_sort(list(settlement_id)) AS settlement_line_ids,
  list_sort(list(DISTINCT batch_id)) AS batch_ids, count(*) FILTER (line_type = 'payment') >= 2 AS is_split FROM lines WHERE payment_id IN (SELECT payment_id FROM payments) GROUP BY 1""")
def p1_payment_link(e):
    return cases.payment_links(e.lines, e.payments)


@query("SELECT settlement_id, payment_id, net FROM lines WHERE payment_id NOT IN (SELECT payment_id FROM payments)")
def p1_orphan_lines(e):
    return cases.orphan_lines(e.lines, e.payments).select("settlement_id", "payment_id", "net")


@query("SELECT r.refund_id, r.payment_id, settlement_id, amount, abs(net) = amount AS amount_agrees FROM refunds r LEFT JOIN lines l ON l.refund_id = r.refund_id AND line_type = 'refund'")
def p4_refund_link(e):
    return cases.refund_links(e.lines, e.refunds)


@query(f"SELECT order_id, cast(unnest(range(1, n)) AS bigint) AS copy, gross AS amount FROM ({COPIES})")
def p7a_duplicates_confirmed(e):
    return duplicates.confirmed(e.ledger)


@query(LIKELY)
def p7b_duplicate_candidates(e):
    return duplicates.candidates(e.ledger)


@query(f"""SELECT DISTINCT order_id, CASE WHEN order_id IN (SELECT order_id FROM ({COPIES})) THEN 'CONFIRMED_DUPLICATE'
  WHEN order_id IN (SELECT unnest(order_ids) FROM ({LIKELY})) THEN 'CANDIDATE_DUPLICATE' ELSE 'NO_RULE_FIRED' END AS rule FROM ledger""")
def dup_classify(e):
    return duplicates.classified(e.ledger)


@query("SELECT DISTINCT batch_id, profile FROM lines WHERE payment_id IN (SELECT payment_id FROM payments)")
def batch_profiles(e):
    return e.profiles


@query(f"""{FACTS} SELECT case_id, payment_id, order_id, merchant_profile, authorized, captured, captured_at, expected_gross, cast(captured - fee - tax - refund_total AS decimal(18,2)) AS expected_net, fee, tax,
  refund_total, payment_line_ids, settlement_line_ids, batch_ids, settled_gross, line_net_total, last_settled FROM facts""")
def case_facts(e):
    return e.facts


@query(f"{FACTS} SELECT * FROM outcomes")
def case_outcomes(e):
    return e.cases


@query(f"{FACTS} SELECT * FROM outcomes WHERE status <> 'CONFIRMED'")
def residual_cases(e):
    return cases.residual_cases(e.cases)


@query(f"{FACTS} SELECT payment_id, fee, tax, cast(captured - fee - tax - refund_total AS decimal(18,2)) AS net FROM facts")
def f_fee_gst_net(e):
    return e.facts.select("payment_id", "fee", "tax", F.col("expected_net").alias("net"))


@query(f"{FACTS} SELECT merchant_profile, count(*) AS cases, cast(sum(cast(expected_gross - (captured - fee - tax - refund_total) AS decimal(18,2))) AS decimal(28,2)) AS deductions FROM facts GROUP BY 1")
def deduction_references(e):
    """What comes off the orders of each profile in all."""
    return e.facts.groupBy("merchant_profile").agg(F.count(F.lit(1)).alias("cases"), F.sum(cases.deduction_reference(F.col("expected_gross"), F.col("expected_net"))).cast("decimal(28,2)").alias("deductions"))


@query("SELECT order_id, substr(sha256('case|' || payment_id || '|' || order_id), 1, 16) AS id FROM payments")
def f_stable_ids(e):
    return e.payments.select("order_id", stable_id(F.lit("case"), F.col("payment_id"), F.col("order_id")).alias("id"))


@query("SELECT refund_id, min(b.settled_event_date) AS first_batch FROM repaid r JOIN batched b ON b.profile = r.profile AND b.settled_event_date >= r.created_at GROUP BY 1")
def refund_first_batch_asof(e):
    """Forward as-of join: one ordered window over the distinct days of each profile instead of a range join."""
    dated = e.batches.join(e.profiles, "batch_id").select("profile", F.col("settled_event_date").alias("d")).distinct()
    refunds = e.refunds.join(e.facts.select("payment_id", F.col("merchant_profile").alias("profile")), "payment_id").select("profile", F.col("created_at").alias("d"), "refund_id")
    # Distinct days of refunds are few whatever the number of refunds, so the window runs over days.
    days = refunds.select("profile", "d").distinct().withColumn("b", F.lit(None).cast("date")).unionByName(dated.withColumn("b", F.col("d")))
    first = days.withColumn("n", F.datediff("d", F.lit("1970-01-01"))).withColumn("first_batch", F.min("b").over(Window.partitionBy("profile").orderBy("n").rangeBetween(0, Window.unboundedFollowing))).select("profile", "d", "first_batch").distinct()
    return refunds.join(first, ["profile", "d"]).where("first_batch IS NOT NULL").select("refund_id", "first_batch")


@query(f"""{FACTS} SELECT status, coalesce(category, 'CLEAN') AS category, count(*) AS n, cast(sum(variance) AS decimal(28,2)) AS variance FROM outcomes GROUP BY ALL""")
def status_counts(e):
    return e.cases.groupBy("status", F.coalesce("category", F.lit("CLEAN")).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.sum("variance").cast("decimal(28,2)").alias("variance"))


@query(f"""{FACTS} SELECT count(*) AS cases, count(*) FILTER (status = 'CONFIRMED') AS confirmed, count(*) FILTER (status <> 'CONFIRMED') AS residual,
  cast(round_even(cast(count(*) FILTER (status = 'CONFIRMED') AS double) / count(*), 6) AS decimal(18,6)) AS match_rate, cast(sum(expected_gross) AS decimal(28,2)) AS expected_gross,
  cast(coalesce(sum(abs(variance)) FILTER (status <> 'CONFIRMED'), 0) AS decimal(28,2)) AS residual_value, cast(4 * count(*) FILTER (status = 'CONFIRMED') AS bigint) AS analyst_minutes FROM outcomes""")
def metrics_a(e):
    ok = F.col("status") == "CONFIRMED"
    n, good = F.count(F.lit(1)), F.count_if(ok)
    return e.cases.agg(n.alias("cases"), good.alias("confirmed"), F.count_if(~ok).alias("residual"), rate(good, n).alias("match_rate"), F.sum("expected_gross").cast("decimal(28,2)").alias("expected_gross"),
                       F.coalesce(F.sum(F.when(~ok, F.abs("variance"))), F.lit(0)).cast("decimal(28,2)").alias("residual_value"), (4 * good).cast("long").alias("analyst_minutes"))


@query("""SELECT 'line_identity' AS rule, count(*) AS violations FROM lines WHERE gross - fee - tax <> net
  UNION ALL SELECT 'batch_total', count(*) FROM batches b LEFT JOIN (SELECT batch_id, sum(net) AS t FROM lines GROUP BY 1) USING (batch_id) WHERE net_total IS DISTINCT FROM t
  UNION ALL SELECT 'lines_equal_batches', CASE WHEN (SELECT sum(net) FROM lines) = (SELECT sum(net_total) FROM batches) THEN 0 ELSE 1 END""")
def conservation_checks(e):
    identity = e.lines.where(F.col("gross") - F.col("fee") - F.col("tax") != F.col("net"))
    totals = e.lines.groupBy("batch_id").agg(F.sum("net").alias("t"))
    unequal = e.batches.join(totals, "batch_id", "left").where(~F.col("net_total").eqNullSafe(F.col("t")))
    sums = e.lines.agg(F.sum("net").alias("a")).crossJoin(e.batches.agg(F.sum("net_total").alias("b")))  # one row each
    count = lambda frame, name: frame.agg(F.lit(name).alias("rule"), F.count(F.lit(1)).alias("violations"))
    return count(identity, "line_identity").unionByName(count(unequal, "batch_total")).unionByName(count(sums.where("a <> b"), "lines_equal_batches"))


@query("""SELECT 'order_id' AS key, order_id AS value, count(*) AS n FROM ledger GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'payment_id', payment_id, count(*) FROM payments GROUP BY 2 HAVING count(*) > 1
  UNION ALL SELECT 'settlement_id', settlement_id, count(*) FROM lines GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'bank_txn_id', bank_txn_id, count(*) FROM bank GROUP BY 2 HAVING count(*) > 1""")
def cardinality_checks(e):
    more = lambda frame, key: frame.groupBy(F.lit(key).alias("key"), F.col(key).alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return more(e.ledger, "order_id").unionByName(more(e.payments, "payment_id")).unionByName(more(e.lines, "settlement_id")).unionByName(more(e.bank, "bank_txn_id"))


@query("""SELECT 'line_payment' AS link, settlement_id AS id FROM lines WHERE payment_id NOT IN (SELECT payment_id FROM payments) UNION ALL SELECT 'payment_order', payment_id FROM payments WHERE order_id NOT IN (SELECT order_id FROM ledger)
  UNION ALL SELECT 'refund_payment', refund_id FROM refunds WHERE payment_id NOT IN (SELECT payment_id FROM payments) UNION ALL SELECT 'line_batch', settlement_id FROM lines WHERE batch_id NOT IN (SELECT batch_id FROM batches)""")
def integrity_checks(e):
    n = tasks_for(max(frame.count() for frame in (e.lines, e.payments, e.ledger)))
    lost = lambda name, child, parent, key, id_: child.select(key, id_).repartition(n, key).join(parent.select(key).repartition(n, key), key, "left_anti").select(F.lit(name).alias("link"), F.col(id_).alias("id"))
    unbatched = e.lines.join(e.batches.select("batch_id"), "batch_id", "left_anti").select(F.lit("line_batch").alias("link"), F.col("settlement_id").alias("id"))  # a few batches of many lines each, so lines aren't dealt by them
    return (
        lost("line_payment", e.lines, e.payments, "payment_id", "settlement_id").unionByName(lost("payment_order", e.payments, e.ledger, "order_id", "payment_id"))
        .unionByName(lost("refund_payment", e.refunds, e.payments, "payment_id", "refund_id")).unionByName(unbatched)
    )


@query("SELECT order_id, count(settlement_id) AS chain_length FROM payments LEFT JOIN lines USING (payment_id) GROUP BY 1")
def chain_length(e):
    return e.payments.join(e.lines.groupBy("payment_id").agg(F.count(F.lit(1)).alias("n")), "payment_id", "left").groupBy("order_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chain_length"))


@query(f"""{FACTS} SELECT merchant_profile, cast(sum(CASE WHEN len(settlement_line_ids) > 0 THEN cast(captured - fee - tax - refund_total AS decimal(18,2)) ELSE 0 END) AS decimal(28,2)) AS settled,
  cast(sum(CASE WHEN len(settlement_line_ids) = 0 THEN cast(captured - fee - tax - refund_total AS decimal(18,2)) ELSE 0 END) AS decimal(28,2)) AS in_flight FROM facts GROUP BY 1""")
def cash_position(e):
    has = F.size("settlement_line_ids") > 0
    return e.facts.groupBy("merchant_profile").agg(F.sum(F.when(has, F.col("expected_net")).otherwise(0)).cast("decimal(28,2)").alias("settled"), F.sum(F.when(~has, F.col("expected_net")).otherwise(0)).cast("decimal(28,2)").alias("in_flight"))
