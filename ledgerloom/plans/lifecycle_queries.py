"""Queries over exceptions, hypotheses, the journal and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import hypotheses as H
from ledgerloom.operators import journal as J
from ledgerloom.operators import lifecycle as S
from ledgerloom.operators.stage import kept
from ledgerloom.plans import case_queries
from ledgerloom.plans.case_queries import FACTS
from ledgerloom.plans.lens import oracle
from ledgerloom.plans.link_queries import PASSES

QUERIES, ORACLES = {}, {}

BOTH = PASSES.lstrip()[1:]
ALL = f"""{FACTS.rstrip()},{BOTH.rstrip()},
every AS (
  SELECT 'A' AS population, case_id AS subject_id, status, category, CASE WHEN variance = 0 THEN expected_gross ELSE variance END AS amount FROM outcomes
  UNION ALL SELECT 'B', batch_id, status, category, batch_net_total FROM links UNION ALL SELECT 'C', source_table || '|' || row_id, status, category, amount FROM rowvar),
exc AS (SELECT substr(sha256('exception|' || population || '|' || subject_id), 1, 16) AS exception_id, population, subject_id, status, category, cast(amount AS decimal(18,2)) AS amount FROM every),
opened AS (SELECT * FROM exc WHERE status <> 'CONFIRMED')
"""


def query(select: str | None):
    def register(f):
        case_queries.query(None)(f)
        QUERIES[f.__name__] = case_queries.QUERIES.pop(f.__name__)
        if select is not None:
            ORACLES[f.__name__] = oracle(select)
        return f

    return register


def _outcomes(e):
    return S.outcomes_of(e.cases, e.batch_links, e.row_variances)


def _opened(e):
    return S.opened(_outcomes(e), 1)


@query(f"{ALL} SELECT exception_id, population, subject_id, status, category, amount FROM opened")
def exceptions_open(e):
    return _opened(e).select("exception_id", "population", "subject_id", "status", "category", "amount")


@query(f"{ALL} SELECT exception_id, amount, status FROM opened WHERE population = 'A' AND status = 'OPEN' ORDER BY amount DESC, exception_id")
def queue_ordered(e):
    return S.queue(_opened(e), ("OPEN",), "A").select("exception_id", "amount", "status")


@query(f"{ALL} SELECT population, count(*) AS denominator, count(*) FILTER (status <> 'CONFIRMED') AS residual, cast(round_even(cast(count(*) FILTER (status <> 'CONFIRMED') AS double) / count(*), 4) AS decimal(18,4)) AS share FROM exc GROUP BY 1")
def population_summaries(e):
    n, left = F.count(F.lit(1)), F.count_if(F.col("status") != "CONFIRMED")
    return _outcomes(e).groupBy("population").agg(n.alias("denominator"), left.alias("residual"), F.bround(left.cast("decimal(20,4)") / n.cast("decimal(20,4)"), 4).cast("decimal(18,4)").alias("share"))


@query("""SELECT l.order_id, l.invoice_no, p.payment_id, s.settlement_id, s.batch_id, bank_txn_id FROM (SELECT DISTINCT * FROM ledger) l LEFT JOIN payments p USING (order_id) LEFT JOIN lines s USING (payment_id)
  LEFT JOIN batches b USING (batch_id) LEFT JOIN bank k ON contains(k.narration, b.utr)""")
def money_trail(e):
    """The chain from each order to the bank rows that name its batch; the narration is read as it stands."""
    words = e.bank.select("bank_txn_id", F.explode(F.regexp_extract_all("narration", F.lit("(?=([A-Z0-9]{16}))"), 1)).alias("utr")).distinct()
    named = e.batches.select("batch_id", "utr").join(words, "utr").select("batch_id", "bank_txn_id")
    orders = e.ledger.select("order_id", "invoice_no", "gross", "order_date", "customer_id", "sku").distinct()
    chain = orders.join(e.payments.select("order_id", "payment_id"), "order_id", "left").join(e.lines.select("payment_id", "settlement_id", "batch_id"), "payment_id", "left")
    return chain.join(named, "batch_id", "left").select("order_id", "invoice_no", "payment_id", "settlement_id", "batch_id", "bank_txn_id")


def _claims(e):
    """Hypotheses as a model might give them: for each pair of likely duplicates one that nominates its last order."""
    pairs = case_queries.duplicates.candidates(e.ledger).select(F.concat_ws("|", "order_ids").alias("exception_id"), "order_ids")
    return pairs.select("exception_id", F.lit(0).alias("rank"), F.lit("DUPLICATE_CANDIDATE").alias("category"), F.get("order_ids", F.size("order_ids") - 1).alias("candidate_id"), F.lit(None).cast("struct<lhs:string,op:string,rhs:string>").alias("assertion"), F.col("order_ids").alias("evidence_row_ids"))


def _index(e, cited):
    return H.row_index({"ledger": (e.ledger, "order_id"), "payments": (e.payments, "payment_id"), "refunds": (e.refunds, "refund_id"), "lines": (e.lines, "settlement_id"), "batches": (e.batches, "batch_id"), "bank": (e.bank, "bank_txn_id")}, cited)


def _chains(payments, lines):
    return payments.join(lines.groupBy("payment_id").agg(F.count(F.lit(1)).alias("n")), "payment_id", "left").groupBy("order_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chain_length"))


def verified(e, claims):
    cited = claims.select(F.explode("evidence_row_ids").alias("row_id"))
    return H.verify(claims, _index(e, cited), e.ledger, _chains(e.payments, e.lines))


def verifier(e, cited):
    """Verifies claims over the cited rows (row_id): what the tables say of these is looked up once, however many rounds of claims there are."""
    cited = kept(cited.distinct())
    orders = cited.select(F.col("row_id").alias("order_id"))
    ledger = kept(e.ledger.join(orders, "order_id", "left_semi"))
    payments = kept(e.payments.select("payment_id", "order_id").join(orders, "order_id", "left_semi"))
    index, chains = kept(_index(e, cited)), kept(_chains(payments, e.lines.join(payments, "payment_id", "left_semi")))
    return lambda claims: H.verify(claims, index, ledger, chains)


CHAINS = "SELECT order_id, count(settlement_id) AS n FROM payments LEFT JOIN lines USING (payment_id) GROUP BY 1"
PAIRS = f"""{FACTS.rstrip()}, pairs AS ({case_queries.LIKELY}), chains AS ({CHAINS}),
claims AS (SELECT array_to_string(order_ids, '|') AS exception_id, order_ids, order_ids[len(order_ids)] AS candidate_id FROM pairs),
judged AS (SELECT exception_id, candidate_id, len(order_ids) = 2 AND (SELECT n FROM chains WHERE order_id = candidate_id) < (SELECT min(n) FROM chains WHERE list_contains(order_ids, order_id) AND order_id <> candidate_id) AS passed FROM claims)
"""


@query(f"{PAIRS} SELECT * FROM judged")
def verify_duplicates(e):
    return verified(e, _claims(e)).select("exception_id", "candidate_id", "passed")


@query(f"{PAIRS} SELECT exception_id, cast(CASE WHEN passed THEN 1.0 ELSE 0.25 END AS decimal(5,4)) AS score, passed AS auto_confirm FROM judged")
def confidence(e):
    return H.confidence(verified(e, _claims(e))).select("exception_id", "score", "auto_confirm")


@query("""SELECT payment_id AS exception_id, abs(authorized - captured) <= 1 AS passed, cast(authorized - captured AS decimal(18,2)) AS computed_residual FROM payments""")
def verify_arithmetic(e):
    assertion = F.struct(F.lit("payments.authorized").alias("lhs"), F.lit("==").alias("op"), F.lit("payments.captured").alias("rhs"))
    claims = e.payments.select(F.col("payment_id").alias("exception_id"), F.lit(0).alias("rank"), F.lit("PARTIAL_CAPTURE").alias("category"), F.col("payment_id").alias("candidate_id"), assertion.alias("assertion"), F.array("payment_id").alias("evidence_row_ids"))
    return verified(e, claims).select("exception_id", "passed", "computed_residual")


@query(f"""{ALL} SELECT variance AS amount, batch_id, list_sort(list(DISTINCT order_id)) AS order_ids FROM outcomes WHERE status <> 'CONFIRMED' AND category = 'DUPLICATE_CANDIDATE' GROUP BY 1, 2 HAVING count(*) = 2""")
def pair_store_rows(e):
    residual = e.cases.where("status <> 'CONFIRMED'").select("case_id", "category", F.col("variance").alias("amount"), "batch_id")
    return H.pairs(residual, e.cases.select("case_id", "order_id"))


def bookable(e):
    return _outcomes(e).where("status = 'CONFIRMED' AND category IS NOT NULL AND category <> 'UNEXPLAINED' AND amount > 0")


JOURNAL = f"""{ALL.rstrip()}, accounts AS (SELECT * FROM (VALUES {", ".join(f"('{c}', '{a}')" for c, a in J.LEDGERS.items())}) t(category, account)),
legs AS (SELECT exception_id, leg, CASE leg WHEN 'debit' THEN '{J.BANK}' ELSE account END AS account, cast(CASE leg WHEN 'debit' THEN amount ELSE 0 END AS decimal(18,2)) AS debit, cast(CASE leg WHEN 'credit' THEN amount ELSE 0 END AS decimal(18,2)) AS credit
  FROM exc JOIN accounts USING (category), (VALUES ('debit'), ('credit')) l(leg) WHERE status = 'CONFIRMED' AND amount > 0)
"""


@query(f"{JOURNAL} SELECT * FROM legs")
def journal_lines(e):
    return J.journal(bookable(e))


@query(f"{JOURNAL} SELECT account, cast(sum(debit) AS decimal(28,2)) AS debit, cast(sum(credit) AS decimal(28,2)) AS credit FROM legs GROUP BY 1")
def journal_totals(e):
    return J.totals(J.journal(bookable(e)))


@query(f"{JOURNAL} SELECT exception_id, '<VOUCHER id=\"' || exception_id || '\" date=\"2001-06-30\">' || string_agg('<ENTRY ledger=\"' || account || '\" debit=\"' || debit || '\" credit=\"' || credit || '\"/>', '' ORDER BY leg DESC) || '</VOUCHER>' AS voucher FROM legs GROUP BY 1")
def journal_xml(e):
    return J.as_xml(J.journal(bookable(e)), "2001-06-30")


@query(f"{ALL} SELECT population, count(*) AS n, sum(cast(('0x' || substr(sha256(concat_ws('|', population, subject_id, status, coalesce(category, 'None'), cast(amount AS string))), 1, 12)) AS bigint)) AS digest FROM exc GROUP BY 1")
def result_hash(e):
    """A digest of each population that does not depend on the order of rows."""
    row = F.sha2(F.concat_ws("|", "population", "subject_id", "status", F.coalesce("category", F.lit("None")), F.col("amount").cast("string")), 256)
    return _outcomes(e).groupBy("population").agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").alias("digest"))
