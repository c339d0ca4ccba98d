"""Queries over batches and bank credits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.normalize import rate
from ledgerloom.operators import batch_link as B
from ledgerloom.plans import case_queries
from ledgerloom.plans.case_queries import COPIES
from ledgerloom.plans.lens import AS_OF, oracle

QUERIES, ORACLES = {}, {}

WORDS = "trim(regexp_replace(upper(narration), '[^A-Z0-9]+', ' ', 'g'))"


def _turn(n: int) -> str:
    """Views of one round of the fuzzy pass: each credit in its turn, given what the round before has linked (t0: nothing)."""
    there = "(taker IS NULL OR f.bank_txn_id <= taker)"
    return f""", o{n} AS (SELECT open_b.*, t.bank_txn_id AS taker FROM open_b LEFT JOIN t{n} t USING (batch_id)),
len{n} AS (SELECT f.bank_txn_id, t, (SELECT max(n) FROM range(6, 17) r(n) WHERE substr(t, 1, n) = substr(utr, 1, n) AND len(t) >= n AND len(utr) >= n) AS n FROM tok f JOIN o{n} ON substr(t, 1, 6) = substr(utr, 1, 6) WHERE {there}),
frag{n} AS (SELECT bank_txn_id, arg_max(t, (n, len(t))) AS fragment FROM len{n} GROUP BY 1),
pre{n} AS (SELECT f.bank_txn_id, batch_id, fragment, utr, abs(date_diff('day', due, value_date)) AS gap, CASE WHEN abs(amount - net_total) <= 1 THEN 1 ELSE 0 END AS agrees,
  coalesce((SELECT max(n) FROM range(1, 17) r(n) WHERE substr(fragment, 1, n) = substr(utr, 1, n) AND len(fragment) >= n), 0) AS same
  FROM free f JOIN o{n} ON {there} LEFT JOIN frag{n} fr ON fr.bank_txn_id = f.bank_txn_id),
scores{n} AS (SELECT bank_txn_id, batch_id, fragment, gap, CASE WHEN fragment IS NULL THEN 'B' ELSE 'A' END AS path,
  cast(CASE WHEN gap > 3 THEN 0 ELSE round_even(CASE WHEN fragment IS NULL THEN 0.6 * agrees + 0.4 * round_even(cast(3 - gap AS double) / 3, 6)
    ELSE 0.5 * same / len(fragment) + 0.3 * (1 - levenshtein(fragment, substr(utr, 1, len(fragment))) / len(fragment)) + 0.2 * agrees END, 6) END AS decimal(9,6)) AS score FROM pre{n}),
verdict{n} AS (SELECT bank_txn_id, CASE WHEN score <= 0 OR score = nxt THEN 'ABSTAINED' WHEN score < CASE path WHEN 'A' THEN 0.85 ELSE 0.90 END OR score - coalesce(nxt, 0) < 0.15 THEN 'AMBIGUOUS' ELSE 'ACCEPTED' END AS outcome,
  path, batch_id, score AS best_score, nxt AS runner_up_score
  FROM (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS nxt FROM scores{n} WINDOW w AS (PARTITION BY bank_txn_id ORDER BY score DESC, batch_id)) WHERE n = 1),
t{n + 1} AS (SELECT batch_id, min(bank_txn_id) AS bank_txn_id FROM verdict{n} WHERE outcome = 'ACCEPTED' GROUP BY 1)"""


#: Views of the passes. In the lens no two batches want the same credit in P2 and P2b, and the fuzzy pass is settled in two rounds; tests hold the passes against loops over contested rows.
PASSES = f""", cr AS (SELECT *, {WORDS} AS words FROM bank WHERE direction = 'credit'),
due AS (SELECT b.batch_id, utr, net_total, due FROM credits b),
p2 AS (SELECT batch_id, min(bank_txn_id) AS bank_txn_id FROM due JOIN cr ON amount = net_total AND value_date = due AND contains(words, utr) GROUP BY 1),
p2b AS (SELECT batch_id, min(bank_txn_id) AS bank_txn_id FROM due JOIN cr ON abs(amount - net_total) <= 1 AND contains(words, utr)
  WHERE batch_id NOT IN (SELECT batch_id FROM p2) AND bank_txn_id NOT IN (SELECT bank_txn_id FROM p2) GROUP BY 1),
done AS (SELECT * FROM p2 UNION ALL SELECT * FROM p2b),
open_b AS (SELECT * FROM due WHERE batch_id NOT IN (SELECT batch_id FROM done) AND due <= date '{AS_OF}'),
free AS (SELECT * FROM cr WHERE bank_txn_id NOT IN (SELECT bank_txn_id FROM done)),
tok AS (SELECT bank_txn_id, unnest(list_distinct(list_filter(string_split(words, ' '), lambda t: len(t) BETWEEN 6 AND 16))) AS t FROM free),
t0 AS (SELECT batch_id, '' AS bank_txn_id FROM open_b WHERE false){_turn(0)}{_turn(1)}{_turn(2)},
verdict AS (SELECT * FROM verdict2), scores AS (SELECT * FROM scores2),
p8 AS (SELECT batch_id, bank_txn_id FROM verdict WHERE outcome = 'ACCEPTED'),
rest_b AS (SELECT * FROM open_b WHERE batch_id NOT IN (SELECT batch_id FROM p8)),
rest_c AS (SELECT * FROM free WHERE bank_txn_id NOT IN (SELECT bank_txn_id FROM p8)),
linked AS (SELECT batch_id, bank_txn_id, amount FROM (SELECT * FROM done UNION ALL SELECT * FROM p8) JOIN cr USING (bank_txn_id)),
links AS (SELECT batch_id, CASE WHEN l.bank_txn_id IS NOT NULL THEN 'CONFIRMED' WHEN due > date '{AS_OF}' THEN 'PENDING_EVIDENCE' ELSE 'OPEN' END AS status, l.bank_txn_id AS bank_row_id, net_total AS batch_net_total,
  amount AS linked_amount, cast(net_total - amount AS decimal(18,2)) AS variance,
  CASE WHEN l.bank_txn_id IS NOT NULL THEN CASE WHEN amount <> net_total THEN 'ROUNDING_DIFFERENCE' END WHEN due > date '{AS_OF}' THEN NULL
       WHEN EXISTS (SELECT 1 FROM rest_c WHERE contains(words, substr(utr, 1, 6))) THEN 'UTR_TRUNCATED_MAPPING' WHEN EXISTS (SELECT 1 FROM rest_c c WHERE abs(c.amount - net_total) <= 1) THEN 'UTR_MISSING_MAPPING'
       ELSE 'MISSING_VS_LATE_CREDIT' END AS category, CASE WHEN l.bank_txn_id IS NOT NULL THEN 'DETERMINISTIC' END AS resolved_by
  FROM due LEFT JOIN linked l USING (batch_id)),
orphans AS (SELECT bank_txn_id, value_date, amount, narration FROM rest_c c WHERE NOT EXISTS (SELECT 1 FROM due WHERE contains(words, substr(utr, 1, 6)) OR abs(c.amount - net_total) <= 1)),
rowvar AS (SELECT order_id AS row_id, 'ledger_rows' AS source_table, 'CONFIRMED' AS status, 'DUPLICATE_CONFIRMED' AS category, gross AS amount FROM (SELECT order_id, gross, unnest(range(1, n)) FROM ({COPIES}))
  UNION ALL SELECT bank_txn_id, 'bank_rows', 'OPEN', 'UNEXPLAINED', amount FROM orphans)
"""


def query(select: str | None):
    def register(f):
        case_queries.query(None)(f)
        QUERIES[f.__name__] = case_queries.QUERIES.pop(f.__name__)
        if select is not None:
            ORACLES[f.__name__] = oracle(select)
        return f

    return register


@query(f"{PASSES} SELECT * FROM p2")
def p2_batch_bank_exact(e):
    return e.passes.exact


@query(f"""{PASSES}, owned AS (SELECT cr.*, p2.batch_id AS owner FROM cr LEFT JOIN p2 USING (bank_txn_id))
  SELECT batch_id, EXISTS (SELECT 1 FROM owned WHERE contains(words, utr) AND (owner IS NULL OR owner >= batch_id)) AS utr_seen, EXISTS (SELECT 1 FROM owned WHERE amount = net_total AND (owner IS NULL OR owner >= batch_id)) AS amount_seen FROM due""")
def p2_diagnostics(e):
    return B.diagnostics(e.passes.due, e.passes.credits, e.passes.exact)


@query(f"{PASSES} SELECT * FROM p2b")
def p2b_tolerance(e):
    return e.passes.near


@query(f"{PASSES} SELECT bank_txn_id, batch_id, fragment, path, score FROM scores WHERE gap <= 3")
def p8_candidate_scores(e):
    """The scores within the window of days; beyond it all are 0."""
    return B.candidate_scores(e.passes.open, e.passes.free, e.passes.fuzzy).select("bank_txn_id", "batch_id", "fragment", "path", "score")


@query(f"{PASSES} SELECT bank_txn_id, outcome, path, CASE WHEN outcome = 'ACCEPTED' THEN batch_id END AS matched_batch_id, best_score, runner_up_score FROM verdict")
def p8_verdicts(e):
    return B.verdicts(e.passes.open, e.passes.free, e.passes.fuzzy)


@query(f"{PASSES} SELECT * FROM p8")
def p8_fuzzy_links(e):
    return e.passes.fuzzy


@query(f"{PASSES} SELECT * FROM links")
def batch_outcomes(e):
    return e.batch_links


@query(f"{PASSES} SELECT * FROM orphans")
def orphan_credits(e):
    return e.passes.orphan_credits()


@query(f"{PASSES} SELECT * FROM rowvar")
def row_variances(e):
    return e.row_variances


@query(f"""{PASSES} SELECT count(*) AS batches, count(*) FILTER (status = 'CONFIRMED') AS linked, cast(round_even(cast(count(*) FILTER (status = 'CONFIRMED') AS double) / count(*), 6) AS decimal(18,6)) AS link_rate,
  count(*) FILTER (status = 'PENDING_EVIDENCE') AS pending, cast(coalesce(sum(batch_net_total) FILTER (status = 'OPEN'), 0) AS decimal(28,2)) AS open_value FROM links""")
def metrics_b(e):
    n, good = F.count(F.lit(1)), F.count_if(F.col("status") == "CONFIRMED")
    return e.batch_links.agg(n.alias("batches"), good.alias("linked"), rate(good, n).alias("link_rate"), F.count_if(F.col("status") == "PENDING_EVIDENCE").alias("pending"), F.coalesce(F.sum(F.when(F.col("status") == "OPEN", F.col("batch_net_total"))), F.lit(0)).cast("decimal(28,2)").alias("open_value"))


@query(f"{PASSES} SELECT source_table, category, count(*) AS n, cast(sum(amount) AS decimal(28,2)) AS value FROM rowvar GROUP BY ALL")
def metrics_c(e):
    return e.row_variances.groupBy("source_table", "category").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("decimal(28,2)").alias("value"))


@query(f"{PASSES} SELECT status, coalesce(category, 'NONE') AS category, count(*) AS n FROM links GROUP BY ALL")
def batch_status_counts(e):
    return e.batch_links.groupBy("status", F.coalesce("category", F.lit("NONE")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{PASSES} SELECT bank_txn_id, batch_id, rank FROM (SELECT bank_txn_id, batch_id, cast(row_number() OVER (PARTITION BY bank_txn_id ORDER BY abs(amount - net_total), abs(date_diff('day', settled_event_date, value_date)), batch_id) AS int) AS rank
  FROM cr CROSS JOIN batches) WHERE rank <= 20""")
def top20_candidates(e):
    return B.nearest_batches(e.credits, e.batches)


@query("SELECT count(*) AS batches, count(*) FILTER (n = 1) AS unique_amounts, cast(round_even(cast(count(*) FILTER (n = 1) AS double) / count(*), 6) AS decimal(18,6)) AS ratio FROM batches JOIN (SELECT net_total, count(*) AS n FROM batches GROUP BY 1) USING (net_total)")
def amount_uniqueness(e):
    per = e.batches.groupBy("net_total").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("batches"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).cast("long").alias("unique_amounts"), rate(F.sum(F.when(F.col("n") == 1, 1).otherwise(0)), F.sum("n")).alias("ratio"))


#: Views: batches in order, each taking the best credit that is left by amount and date.
NAIVE = f"""{PASSES}, near AS (SELECT batch_id, bank_txn_id, abs(date_diff('day', settled_event_date, value_date)) AS gap, abs(amount - net_total) AS off
    FROM batches JOIN cr ON abs(amount - net_total) <= 1 AND abs(date_diff('day', settled_event_date, value_date)) <= 5 AND value_date <= date '{AS_OF}'),
  turns AS (SELECT *, dense_rank() OVER (ORDER BY batch_id) AS turn FROM near),
  greedy AS (
    SELECT 0::bigint AS turn, ''::varchar AS batch_id, ''::varchar AS bank_txn_id, []::varchar[] AS used
    UNION ALL
    SELECT g.turn + 1, coalesce((SELECT any_value(batch_id) FROM turns t WHERE t.turn = g.turn + 1), ''), coalesce(c.bank_txn_id, ''), CASE WHEN c.bank_txn_id IS NULL THEN g.used ELSE list_append(g.used, c.bank_txn_id) END
    FROM greedy g LEFT JOIN LATERAL (SELECT t.bank_txn_id FROM turns t WHERE t.turn = g.turn + 1 AND NOT list_contains(g.used, t.bank_txn_id) ORDER BY gap, off, t.bank_txn_id LIMIT 1) c ON true
    WHERE g.turn < (SELECT max(turn) FROM turns))"""


@query(f"{NAIVE} SELECT batch_id, bank_txn_id FROM greedy WHERE bank_txn_id <> ''")
def naive_links(e):
    """Amount and date alone, batches in order; a credit serves one."""
    return B.naive_links(e.batches, e.passes.credits, e.passes.as_of)
