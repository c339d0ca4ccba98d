"""Queries for figures: outcomes held against labels, baselines, minutes, and views over stored exceptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import batch_link as B
from ledgerloom.operators import duplicates
from ledgerloom.operators import lifecycle as S
from ledgerloom.operators import metrics as M
from ledgerloom.plans import case_queries
from ledgerloom.plans.case_queries import FACTS, LIKELY
from ledgerloom.plans.lens import oracle
from ledgerloom.plans.lifecycle_queries import ALL
from ledgerloom.plans.link_queries import PASSES
from ledgerloom.sources import truth as T

QUERIES, ORACLES = {}, {}


def query(select: str):
    def register(f):
        case_queries.query(None)(f)
        QUERIES[f.__name__] = case_queries.QUERIES.pop(f.__name__)
        ORACLES[f.__name__] = oracle(select)
        return f

    return register


def _rate(part: str, whole: str) -> str:
    return f"cast(round_even(cast({part} AS double) / nullif({whole}, 0), 6) AS decimal(18,6))"


def _sum(value: str, when: str = "true") -> str:
    return f"cast(coalesce(sum({value}) FILTER ({when}), 0) AS decimal(28,2))"


SURELY = "count(*) FILTER (status = 'CONFIRMED')"
SURE, WRONG = "status = 'CONFIRMED'", "status = 'CONFIRMED' AND category IS DISTINCT FROM true_category"


@query(f"""{FACTS} SELECT count(*) AS case_count, count(*) FILTER ({SURE}) AS confirmed_case_count, count(*) FILTER (NOT {SURE}) AS deterministic_residual_count, {_rate(f"count(*) FILTER ({SURE})", "count(*)")} AS case_match_rate,
  {_rate(f"count(*) FILTER (NOT {SURE})", "count(*)")} AS residual_abstention_rate, {_rate(f"count(*) FILTER ({WRONG})", f"count(*) FILTER ({SURE})")} AS residual_false_match_rate, cast(NULL AS decimal(18,6)) AS residual_explanation_precision,
  {_sum("o.expected_gross")} AS gross_total, {_sum("o.expected_gross", SURE)} AS gross_matched, {_rate(_sum("o.expected_gross", SURE), _sum("o.expected_gross"))} AS gross_match_rate, {_sum("o.expected_gross", WRONG)} AS gross_false_match_value,
  {_sum("o.expected_net", SURE)} AS net_reconciled, {_sum("o.expected_net", f"NOT {SURE}")} AS net_unresolved, {_rate("count(o.batch_id)", "count(*)")} AS evidence_coverage
  FROM outcomes o LEFT JOIN true_cases t USING (case_id)""")
def labelled_metrics_a(e):
    return M.population_a(e.cases, e.facts, e.labels["true_cases"])


LINKED, FALSE_LINK, NOISY, RECOVERED = "bank_row_id IS NOT NULL", "bank_row_id IS NOT NULL AND bank_row_id IS DISTINCT FROM bank_txn_id", "true_category IS NOT NULL", "true_category IS NOT NULL AND bank_row_id = bank_txn_id"
DEFECT = "amount_off = 0 AND true_category = 'ROUNDING_DIFFERENCE'"


@query(f"""{PASSES}, judged AS (SELECT l.*, t.bank_txn_id, t.true_category, abs(net_total - amount) AS amount_off FROM links l LEFT JOIN true_links t USING (batch_id) JOIN batches USING (batch_id) LEFT JOIN bank b ON b.bank_txn_id = t.bank_txn_id)
  SELECT count(*) AS batch_count, count(*) FILTER ({LINKED}) AS linked_count, {_rate(f"count(*) FILTER ({LINKED})", "count(*)")} AS link_rate, count(*) FILTER ({FALSE_LINK}) AS false_link_count,
  {_rate(f"count(*) FILTER ({FALSE_LINK})", f"count(*) FILTER ({LINKED})")} AS false_link_rate, {_sum("batch_net_total", LINKED)} AS linked_value, {_sum("batch_net_total", FALSE_LINK)} AS false_link_value, {_sum("batch_net_total")} AS total_value,
  count(*) FILTER ({NOISY}) AS noise_count, count(*) FILTER ({RECOVERED}) AS noise_recovered_count, {_rate(f"count(*) FILTER ({RECOVERED})", f"count(*) FILTER ({NOISY})")} AS recovery_rate,
  {_rate(f"count(*) FILTER ({RECOVERED} AND NOT coalesce({DEFECT}, false))", f"count(*) FILTER ({NOISY} AND NOT coalesce({DEFECT}, false))")} AS recovery_rate_without_defects,
  count(*) FILTER (status = 'OPEN') AS unresolved_count, {_rate("count(*) FILTER (status = 'OPEN' AND category IS NOT DISTINCT FROM true_category)", "count(*) FILTER (status = 'OPEN')")} AS category_precision,
  coalesce(list_sort(list(DISTINCT batch_id) FILTER ({DEFECT})), []) AS defects_excluded FROM judged""")
def labelled_metrics_b(e):
    """Defects are batches labelled with a difference that their amounts don't have."""
    links = e.labels["true_links"]
    off = links.where("true_category = 'ROUNDING_DIFFERENCE'").join(e.batches, "batch_id").join(e.bank.select("bank_txn_id", "amount"), "bank_txn_id").where("amount = net_total")
    return M.population_b(e.batch_links, links, off.select("batch_id"))


@query(f"""{PASSES} SELECT count(*) AS row_count, (SELECT count(*) FROM true_rows) AS truth_row_count, count(*) FILTER (category = true_category) AS matched_row_count, {_rate("count(*) FILTER (category = true_category)", "(SELECT count(*) FROM true_rows)")} AS recall,
  {_rate("count(*) FILTER (category = true_category)", "count(*)")} AS precision, {_sum("amount")} AS row_value FROM rowvar LEFT JOIN true_rows USING (row_id)""")
def labelled_metrics_c(e):
    return M.population_c(e.row_variances, e.labels["true_rows"])


TOP20 = """, top20 AS (SELECT bank_txn_id, batch_id FROM (SELECT bank_txn_id, batch_id, row_number() OVER (PARTITION BY bank_txn_id ORDER BY abs(amount - net_total), abs(date_diff('day', settled_event_date, value_date)), batch_id) AS rank FROM cr CROSS JOIN batches) WHERE rank <= 20)"""


@query(f"""{PASSES}{TOP20} SELECT count(*) AS answerable, count(s.batch_id) AS hits, {_rate("count(s.batch_id)", "count(*)")} AS recall FROM cr JOIN true_links t USING (bank_txn_id) LEFT JOIN top20 s ON s.bank_txn_id = cr.bank_txn_id AND s.batch_id = t.batch_id""")
def recall_at_20(e):
    return M.recall_at(B.nearest_batches(e.credits, e.batches), e.labels["true_links"], e.credits)


@query("SELECT count(*) AS payments, count(*) FILTER (payment_id IN (SELECT payment_id FROM lines)) AS with_a_line FROM payments")
def naive_case_count(e):
    with_line = e.payments.join(e.lines.select("payment_id").distinct(), "payment_id", "left_semi").agg(F.count(F.lit(1)).alias("with_a_line"))
    return e.payments.agg(F.count(F.lit(1)).alias("payments")).crossJoin(with_line)  # one row each


SENDABLE = ", ".join(f"'{c}'" for c in M.MODEL_CATEGORIES)


@query(f"{ALL} SELECT exception_id, category, amount FROM opened WHERE category IN ({SENDABLE}) ORDER BY amount DESC, exception_id")
def eligible_exceptions(e):
    return M.eligible(S.opened(S.outcomes_of(e.cases, e.batch_links, e.row_variances), 1)).select("exception_id", "category", "amount")


@query(f"SELECT 'dup-' || array_to_string(order_ids, '-') AS exception_id, 'DUPLICATE_CANDIDATE' AS category, gross AS amount, 'OPEN' AS status, order_ids AS evidence_row_ids FROM ({LIKELY})")
def duplicate_pair_exceptions(e):
    return M.duplicate_pairs(duplicates.candidates(e.ledger))


_KINDS = {"bank": ("bank", "bank_txn_id"), "batch": ("batches", "batch_id"), "case": ("facts", "case_id"), "order": ("ledger", "order_id"), "payment": ("payments", "payment_id"), "refund": ("refunds", "refund_id"), "settlement": ("lines", "settlement_id")}
_ids = lambda kind: f"SELECT {_KINDS[kind][1]} FROM {_KINDS[kind][0]}"


@query(f"{FACTS} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, (SELECT count(*) FROM ({_ids(a)} INTERSECT {_ids(b)})) AS common" for a in _KINDS for b in _KINDS if a < b))
def namespace_overlaps(e):
    """Ids of seven kinds, of which no two have any in common."""
    return M.overlaps({kind: getattr(e, table).select(id_) for kind, (table, id_) in _KINDS.items()})


@query("SELECT DISTINCT bank_txn_id, token FROM (SELECT bank_txn_id, unnest(string_split(replace(replace(narration, '/', ' '), '-', ' '), ' ')) AS token FROM bank) WHERE regexp_full_match(token, '[A-Z0-9]{16}')")
def reference_tokens(e):
    return M.reference_tokens(e.bank)


@query(f"{FACTS} SELECT case_id, status, category FROM outcomes ORDER BY case_id")
def case_outcomes_ordered(e):
    return e.cases.select("case_id", "status", "category").orderBy("case_id")


@query(f"{PASSES} SELECT source_table, row_id, category FROM rowvar ORDER BY ALL")
def row_variances_ordered(e):
    return e.row_variances.select("source_table", "row_id", "category").orderBy("source_table", "row_id", "category")


@query(f"""{FACTS}, per AS (SELECT year(captured_at) AS seed, count(*) FILTER (outcomes.status <> 'CONFIRMED') AS open FROM outcomes JOIN payments USING (payment_id) GROUP BY 1)
  SELECT count(*) AS seeds, cast(sum(open) AS bigint) AS total, cast(avg(open) AS decimal(18,4)) AS mean, min(open) AS least, max(open) AS most, cast(stddev_samp(open) AS decimal(18,4)) AS deviation, cast(sqrt(avg(open)) AS decimal(18,4)) AS by_chance, count(*) FILTER (open > 0) AS seeds_with_any FROM per""")
def open_over_years(e):
    """Open cases of each year, summed up over the years as over seeds."""
    per = e.cases.join(e.payments.select("payment_id", F.year("captured_at").alias("seed")), "payment_id").groupBy("seed").agg(F.count_if(F.col("status") != "CONFIRMED").alias("open"))
    rows = M.over_seeds(per, "open")
    return rows.select("seeds", "total", *[F.round(c, 4).cast("decimal(18,4)").alias(c) for c in ("mean", "deviation", "by_chance")], "least", "most", "seeds_with_any")


@query(f"""{FACTS},{PASSES.lstrip()[1:]} SELECT 'cases' AS population, count(*) AS n, {SURELY} AS decided, count(*) FILTER (status = 'CONFIRMED' AND category IS DISTINCT FROM true_category) AS wrong FROM outcomes LEFT JOIN true_cases USING (case_id)
  UNION ALL SELECT 'links', count(*), {SURELY}, count(*) FILTER (status = 'CONFIRMED' AND bank_row_id IS DISTINCT FROM t.bank_txn_id) FROM links LEFT JOIN true_links t USING (batch_id)
  UNION ALL SELECT 'rows', (SELECT count(*) FROM true_rows), count(*), count(*) FILTER (true_category IS NULL) FROM (SELECT DISTINCT row_id, category FROM rowvar) r LEFT JOIN true_rows t ON t.row_id = r.row_id AND t.true_category = r.category""")
def truth_scores(e):
    """Outcomes of the three populations against labels: how many were decided, and how many of those wrongly."""
    kind = F.when(F.col("row_id").startswith("ORD_"), "ledger_row").otherwise("bank_row").alias("row_kind")
    cases, links = T.score_cases(e.cases, e.labels["true_cases"]), T.score_links(e.batch_links, e.labels["true_links"])
    rows = T.score_rows(e.row_variances, e.labels["true_rows"].select("row_id", kind, "true_category"))
    one = lambda name, frame, n, decided, wrong: frame.select(F.lit(name).alias("population"), F.col(n).alias("n"), F.col(decided).alias("decided"), wrong.alias("wrong"))
    return one("cases", cases, "cases", "confirmed", F.col("false_matches")).unionByName(one("links", links, "batches", "linked", F.col("false_links"))).unionByName(one("rows", rows, "true", "found", F.col("found") - F.col("hits")))
