"""Queries over what exceptions rest on."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import duplicates
from ledgerloom.operators import evidence as V
from ledgerloom.operators import lifecycle as L
from ledgerloom.operators.stage import kept
from ledgerloom.plans import case_queries
from ledgerloom.plans.case_queries import FACTS, LIKELY
from ledgerloom.plans.day_queries import EVERY
from ledgerloom.plans.lens import oracle
from ledgerloom.plans.lifecycle_queries import CHAINS, verified
from ledgerloom.plans.link_queries import PASSES

QUERIES, ORACLES = {}, {}


def query(select: str | None):
    def register(f):
        case_queries.query(None)(f)
        QUERIES[f.__name__] = case_queries.QUERIES.pop(f.__name__)
        if select is not None:
            ORACLES[f.__name__] = oracle(select)
        return f

    return register


CITED = f"""{FACTS.rstrip()},{PASSES.lstrip()[1:].rstrip()}, {EVERY},
pairs AS (SELECT unnest(order_ids) AS order_id, order_ids AS pair FROM ({LIKELY})),
pair_of AS (SELECT case_id AS subject_id, pair FROM outcomes JOIN pairs USING (order_id)),
cited AS (SELECT exception_id, status, category, CASE WHEN category = 'DUPLICATE_CANDIDATE' THEN coalesce(pair, list_sort(evidence)) WHEN len(evidence) > 0 THEN list_sort(evidence) ELSE [subject_id] END AS cited
  FROM exc LEFT JOIN pair_of USING (subject_id) WHERE status <> 'CONFIRMED')
"""
WALK = f"""{CITED.rstrip()}, nodes AS (
  SELECT DISTINCT 'ledger' AS stage, order_id AS row_id, 'customer=' || customer_id || ' gross=' || gross AS detail FROM ledger UNION ALL SELECT 'payment', payment_id, 'authorized=' || authorized || ' captured=' || captured || ' status=' || status FROM payments
  UNION ALL SELECT 'settlement', settlement_id, 'type=' || line_type || ' gross=' || gross || ' fee=' || fee || ' tax=' || tax || ' net=' || net FROM lines UNION ALL SELECT 'refund', refund_id, 'amount=' || amount || ' created=' || created_at FROM refunds
  UNION ALL SELECT 'batch', batch_id, 'utr=' || utr || ' net_total=' || net_total || ' settled=' || settled_event_date FROM batches UNION ALL SELECT 'bank', bank_txn_id, 'value_date=' || value_date || ' amount=' || amount || ' narration=' || narration FROM bank),
edges AS (
  SELECT 'ledger' AS s, order_id AS a, 'payment' AS t, payment_id AS b FROM payments UNION ALL SELECT 'payment', payment_id, 'settlement', settlement_id FROM lines UNION ALL SELECT 'payment', payment_id, 'refund', refund_id FROM refunds
  UNION ALL SELECT 'settlement', settlement_id, 'batch', batch_id FROM lines UNION ALL SELECT 'batch', batch_id, 'bank', bank_txn_id FROM batches JOIN bank ON contains(narration, utr)),
walk AS (
  SELECT exception_id, 0 AS hop, stage, row_id FROM (SELECT exception_id, unnest(cited) AS row_id FROM cited) JOIN nodes USING (row_id)
  UNION ALL SELECT w.exception_id, hop + 1, t, b FROM walk w JOIN edges e ON e.s = w.stage AND e.a = w.row_id),
trail AS (SELECT exception_id, min(hop) AS hop, stage, row_id, any_value(detail) AS detail FROM walk JOIN nodes USING (stage, row_id) GROUP BY exception_id, stage, row_id)
"""


def _opened(e):
    return L.outcomes_of(e.cases, e.batch_links, e.row_variances).where("status <> 'CONFIRMED'")


def _cited(e, opened):
    orders = e.cases.select(F.col("case_id").alias("subject_id"), "order_id")
    return V.cited(opened, orders, duplicates.candidates(e.ledger))


def _rows(e):
    return V.Rows(e.ledger, e.payments, e.refunds, e.lines, e.batches, e.bank)


@query("""SELECT 'ledger' AS stage, count(DISTINCT order_id) AS entries, count(DISTINCT order_id) AS ids FROM ledger UNION ALL SELECT 'payment', count(*) * 2, count(DISTINCT payment_id) + count(DISTINCT order_id) FROM payments
  UNION ALL SELECT 'settlement', count(*) * 2 + count(payment_id), count(DISTINCT settlement_id) + count(DISTINCT payment_id) + count(DISTINCT batch_id) FROM lines UNION ALL SELECT 'refund', count(*) * 2, count(DISTINCT refund_id) + count(DISTINCT payment_id) FROM refunds
  UNION ALL SELECT 'batch', count(*), count(*) FROM batches UNION ALL SELECT 'bank', count(*) + count(b), count(*) + count(DISTINCT b) FROM (SELECT bank_txn_id, batch_id AS b FROM bank LEFT JOIN batches ON contains(narration, utr))""")
def evidence_inverted_index(e):
    """Entries and distinct ids of the index from ids to the rows that name them."""
    return V.inverted_index(_rows(e)).groupBy("stage").agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("id").alias("ids"))


@query(f"{CITED} SELECT exception_id, cited FROM cited")
def evidence_cited(e):
    return _cited(e, _opened(e))


@query(f"{WALK} SELECT * FROM trail")
def evidence_rows(e):
    """Per exception the rows behind it, with the fewest steps to each."""
    return V.trail(kept(_cited(e, _opened(e))), _rows(e))


@query(f"""{WALK}, chains AS ({CHAINS}),
  checked AS (SELECT exception_id, (SELECT n FROM chains WHERE order_id = cited[1]) < (SELECT n FROM chains WHERE order_id = cited[2]) AS passed FROM cited WHERE category = 'DUPLICATE_CANDIDATE' AND len(cited) = 2),
  counts AS (SELECT exception_id, {", ".join(f"count(*) FILTER (stage = '{s}') AS n_{s}" for s in V.STAGES)} FROM trail GROUP BY 1)
  SELECT exception_id, cited, {", ".join(f"coalesce(n_{s}, 0) AS n_{s}" for s in V.STAGES)}, coalesce(n_bank, 0) > 0 AS trail_complete, coalesce(category IN ({", ".join(f"'{c}'" for c in V.MODEL_CATEGORIES)}), false) AS eligible_for_model,
  passed IS NOT NULL AS verification_ran, coalesce(passed, false) AS verification_passed, CASE WHEN NOT passed THEN 'chains don''t tell them apart' ELSE '' END AS verification_failure,
  CASE WHEN len(cited) = 2 AND status IN ('OPEN', 'PENDING_EVIDENCE', 'PENDING_AI_UNAVAILABLE') THEN cited ELSE [] END AS competing FROM cited LEFT JOIN counts USING (exception_id) LEFT JOIN checked USING (exception_id)""")
def evidence_panel(e):
    """What a reviewer sees of each exception."""
    opened = kept(_opened(e))
    cited = kept(_cited(e, opened))
    both = cited.join(opened.select("exception_id", "category"), "exception_id").where((F.col("category") == V.DUPLICATE) & (F.size("cited") == 2))
    claims = both.select("exception_id", F.lit(0).alias("rank"), "category", F.get("cited", F.lit(0)).alias("candidate_id"), F.lit(None).cast("struct<lhs:string,op:string,rhs:string>").alias("assertion"), F.col("cited").alias("evidence_row_ids"))
    return V.panel(opened, cited, V.trail(cited, _rows(e)), verified(e, claims)).drop("moves")
