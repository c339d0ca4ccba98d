"""Queries over the hypothesis loop: recorded responses, what becomes of them, and links that a model names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import batch_link as B
from ledgerloom.operators import duplicates
from ledgerloom.operators import hypotheses as H
from ledgerloom.operators import hypothesis_loop as A
from ledgerloom.operators import metrics as M
from ledgerloom.operators import store as S
from ledgerloom.operators.stage import kept, shared_path
from ledgerloom.plans import case_queries
from ledgerloom.plans.case_queries import FACTS, LIKELY
from ledgerloom.plans.lens import oracle
from ledgerloom.plans.lifecycle_queries import CHAINS, verifier
from ledgerloom.plans.link_queries import NAIVE, PASSES

QUERIES, ORACLES = {}, {}


def query(select: str | None):
    def register(f):
        case_queries.query(None)(f)
        QUERIES[f.__name__] = case_queries.QUERIES.pop(f.__name__)
        if select is not None:
            ORACLES[f.__name__] = oracle(select)
        return f

    return register


def _item(nominee: str, orders: str, residual: str = '"0.00"', category: str = "DUPLICATE_CANDIDATE") -> str:
    return f"""'{{"category": "{category}", "candidate_id": "' || {nominee} || '", "assertion": null, "residual_amount": {residual}, "evidence_row_ids": ' || {orders} || ', "reason": "the shorter chain"}}'"""


def _whole(*items: str) -> str:
    listed = " || ', ' || ".join(items)
    return f"""'{{"hypotheses": [' || {listed} || ']}}'"""


_LAST, _FIRST = _item("last", "orders"), _item("first", "orders")
GOOD, SWAPPED, BOTH = _whole(_LAST), _whole(_FIRST), _whole(_FIRST, _LAST)
FENCED = "'```json' || chr(10) || " + GOOD + " || chr(10) || '```'"
#: A number that isn't exact, a category that isn't one, something else than an object, and a usable fourth that isn't read; ids that aren't texts.
ODD = _whole(_item("last", "orders", "0.5"), _item("last", "orders", category="A_GUESS"), "'7'", _LAST)
NO_TEXTS = _whole(_item("last", "'[1, 2]'"))
NO_LIST = "'{\"hypotheses\": {}}'"
BROKEN = "'{\"hypotheses\": ['"
#: What is recorded for a pair, by the first digit of the digest of its id: round, attempt, response (null: the service is down). No row: no recording.
RECORDED = {
    "0": [(1, 1, BROKEN), (1, 2, GOOD)], "1": [(1, k, BROKEN) for k in (1, 2, 3)], "2": [(1, 1, None), (2, 1, GOOD)], "3": [], "4": [(1, 1, BOTH)], "5": [(1, 1, ODD), (1, 2, FENCED)],
    "6": [(1, 1, NO_TEXTS), (1, 2, GOOD)], "7": [(1, k, NO_LIST) for k in (1, 2, 3)], "8": [(1, 1, SWAPPED)], "9": [(k, 1, None) for k in range(1, 4)], **{c: [(1, 1, GOOD)] for c in "abcdef"},
}


def _recorded(pairs: str) -> str:
    """SELECT of the responses over pairs (exception_id, first, last, orders as JSON, digit); Spark and DuckDB both run it."""
    rows = [(d, *r) for d, all_ in RECORDED.items() for r in all_]
    one = lambda d, round_, attempt, response: f"SELECT exception_id, {round_} AS round, {attempt} AS attempt, {response or 'cast(NULL AS string)'} AS response, {'true' if response is None else 'false'} AS unavailable FROM {pairs} WHERE digit = '{d}'"
    return " UNION ALL ".join(one(*r) for r in rows)


PAIRS = f""", pairs AS (SELECT *, 'dup-' || array_to_string(order_ids, '-') AS exception_id, order_ids[1] AS first, order_ids[len(order_ids)] AS last, '["' || array_to_string(order_ids, '","') || '"]' AS orders FROM ({LIKELY})),
digits AS (SELECT *, substr(sha256(exception_id), 1, 1) AS digit FROM pairs),
recorded AS ({_recorded("digits")})
"""


def _pairs(e) -> DataFrame:
    rows = M.duplicate_pairs(duplicates.candidates(e.ledger))
    ids = F.col("evidence_row_ids")
    return rows.select("exception_id", "category", "amount", F.get(ids, F.lit(0)).alias("first"), F.get(ids, F.size(ids) - 1).alias("last"), F.concat(F.lit('["'), F.array_join(ids, '","'), F.lit('"]')).alias("orders"), F.substring(F.sha2("exception_id", 256), 1, 1).alias("digit"), ids.alias("evidence_row_ids"))


def _responses(pairs: DataFrame) -> DataFrame:
    text = _recorded("__PAIRS__").replace("{", "{{").replace("}", "}}").replace("__PAIRS__", "{pairs}")
    return pairs.sparkSession.sql(text, pairs=pairs)


_FAULT = lambda path: f"CASE WHEN {{}} THEN '$.hypotheses[' || rank || '].{path}' END"
_TEXT = "json_type(h, '$.{0}') IS DISTINCT FROM 'VARCHAR'"
_CATEGORIES = ", ".join(f"'{c}'" for c in M.MODEL_CATEGORIES)


@query(f"""{PAIRS}, bodies AS (SELECT exception_id, round, attempt, regexp_replace(regexp_replace(response, '^\\s*```(?:json)?\\s*', ''), '\\s*```\\s*$', '') AS body FROM recorded WHERE NOT unavailable),
  lists AS (SELECT *, CASE WHEN json_valid(body) THEN json_type(body, '$.hypotheses') END AS kind FROM bodies),
  items AS (SELECT exception_id, round, attempt, cast(unnest(range(least(3, cast(json_array_length(body, '$.hypotheses') AS bigint)))) AS int) AS rank, body FROM lists WHERE kind = 'ARRAY'),
  each AS (SELECT exception_id, round, attempt, rank, json_extract(body, '$.hypotheses[' || rank || ']') AS h FROM items)
  SELECT exception_id, round, attempt, cast(NULL AS int) AS rank, [CASE WHEN NOT json_valid(body) THEN '$: not JSON' ELSE '$.hypotheses: not an array' END] AS faults FROM lists WHERE kind IS DISTINCT FROM 'ARRAY'
  UNION ALL SELECT exception_id, round, attempt, rank, CASE WHEN json_type(h) <> 'OBJECT' THEN ['$.hypotheses[' || rank || ']'] ELSE list_filter([
    {_FAULT("category").format(f"coalesce(json_extract_string(h, '$.category') NOT IN ({_CATEGORIES}), true)")}, {_FAULT("candidate_id").format(_TEXT.format("candidate_id"))}, {_FAULT("reason").format(_TEXT.format("reason"))},
    {_FAULT("evidence_row_ids").format("len(list_filter(cast(json_extract(h, '$.evidence_row_ids') AS json[]), lambda x: json_type(x) <> 'VARCHAR')) > 0")}, {_FAULT("residual_amount").format("json_type(h, '$.residual_amount') NOT IN ('VARCHAR', 'NULL', 'BIGINT', 'UBIGINT')")}], lambda x: x IS NOT NULL) END FROM each""")
def response_faults(e):
    """What the schema says against every recorded response, by path."""
    return H.validate(_responses(_pairs(e)).where("not unavailable").drop("unavailable"), M.MODEL_CATEGORIES).select("exception_id", "round", "attempt", "rank", "faults")


_runs: dict[str, tuple[S.Store, DataFrame]] = {}


def looped(e) -> tuple[S.Store, DataFrame]:
    """The store of likely duplicates after the loop, and its outcomes. Run once for a session and folder."""
    spark = e.ledger.sparkSession
    key = f"{spark.sparkContext.applicationId} {e.labels.folder}"
    if key not in _runs:
        pairs = kept(_pairs(e))
        cited = pairs.select("exception_id", F.explode("evidence_row_ids").alias("row_id")).withColumn("detail", F.lit("order"))
        prompts = kept(H.prompts(pairs.select("exception_id", "category", "amount"), cited).select("exception_id", "prompt_hash"))
        store = S.Store(spark, shared_path(spark, "loop"))
        opened = pairs.select("exception_id", F.lit("A").alias("population"), F.col("exception_id").alias("subject_id"), F.lit("OPEN").alias("status"), "category", "amount", F.col("evidence_row_ids").alias("evidence"), F.lit("one customer, one amount").alias("reason"))
        S.close_day(store, 1, opened)
        responses = kept(_responses(pairs).join(prompts, "exception_id").drop("exception_id"))
        told = H.parse(responses.select(F.col("prompt_hash").alias("exception_id"), "response"), M.MODEL_CATEGORIES)
        verify = verifier(e, told.select(F.explode("evidence_row_ids").alias("row_id")))
        outcomes = A.run(store, 2, prompts, lambda n: responses.where(F.col("round") == n), lambda claims: H.confidence(verify(claims)))
        _runs[key] = (store, kept(outcomes))
    return _runs[key]


def _shorter(a: str, b: str) -> str:
    return f"len(order_ids) = 2 AND (SELECT n FROM chains WHERE order_id = {a}) < (SELECT n FROM chains WHERE order_id = {b})"


#: Views: who is asked in each of the rounds, and what comes of it.
LOOP = f"""{PAIRS}, chains AS ({CHAINS}), judged AS (SELECT *, {_shorter("last", "first")} AS last_passes, {_shorter("first", "last")} AS first_passes FROM digits),
told AS (SELECT exception_id, r AS round, order_ids, last, first, CASE WHEN digit = '9' OR (digit = '2' AND r = 1) THEN 'unavailable' WHEN digit = '3' THEN 'fixture_miss' WHEN digit IN ('1', '7') THEN 'no_hypothesis' ELSE 'answered' END AS reply,
    CASE WHEN digit IN ('0', '5', '6') THEN 2 WHEN digit IN ('1', '7') THEN 3 ELSE 1 END AS attempt, CASE WHEN digit = '4' THEN [first_passes, last_passes] WHEN digit = '8' THEN [first_passes] ELSE [last_passes] END AS verdicts
  FROM judged, (VALUES (1), (2), (3)) t(r) WHERE r = 1 OR digit = '9' OR (digit = '2' AND r = 2)),
decided AS (SELECT exception_id, round, CASE WHEN reply = 'unavailable' THEN 'PENDING_AI_UNAVAILABLE' WHEN reply = 'answered' AND list_contains(verdicts, true) THEN 'CONFIRMED' ELSE 'ABSTAINED' END AS outcome,
  CASE WHEN reply IN ('fixture_miss', 'no_hypothesis') THEN reply WHEN reply = 'answered' AND NOT list_contains(verdicts, true) THEN 'all_rejected' END AS abstain_reason, attempt, CASE WHEN reply = 'answered' THEN len(verdicts) ELSE 0 END AS seen,
  CASE WHEN reply <> 'answered' THEN 0 WHEN list_contains(verdicts, true) THEN list_position(verdicts, true) - 1 ELSE len(verdicts) END AS rejected FROM told)
"""


@query(f"{LOOP} SELECT exception_id, round, outcome, abstain_reason, attempt, seen, cast(rejected AS int) AS rejected FROM decided")
def loop_outcomes(e):
    """What became of each likely duplicate in each round that asked about it."""
    return looped(e)[1].select("exception_id", "round", "outcome", "abstain_reason", "attempt", "seen", "rejected")


_N = lambda c: f"count(*) FILTER ({c})"


@query(f"""{LOOP} SELECT round, count(*) AS sent, {_N("outcome = 'CONFIRMED'")} AS confirmed, {_N("outcome = 'ABSTAINED'")} AS abstained, {_N("outcome = 'PENDING_AI_UNAVAILABLE'")} AS unavailable, {", ".join(f'{_N(f"abstain_reason = {chr(39)}{r}{chr(39)}")} AS {r}' for r in A.REASONS)},
  coalesce(cast(cast(round_even(cast({_N("outcome = 'ABSTAINED'")} AS double) / nullif({_N("outcome <> 'PENDING_AI_UNAVAILABLE'")}, 0), 4) AS decimal(18,4)) AS varchar), 'n/a') AS abstention_rate FROM decided GROUP BY 1""")
def loop_report(e):
    """Rounds of asking: confirmed, abstained and out of reach, which add up to what was sent."""
    return A.report(looped(e)[1])


@query(f"""{LOOP}, last_round AS (SELECT exception_id, arg_max(outcome, round) AS status FROM decided GROUP BY 1) SELECT status, CASE WHEN status = 'CONFIRMED' THEN 'AI_VERIFIED' ELSE 'NONE' END AS resolved_by, count(*) AS n, cast(sum(gross) AS decimal(28,2)) AS value FROM last_round JOIN pairs USING (exception_id) GROUP BY 1""")
def loop_tallies(e):
    return M.tallies(looped(e)[0].read("exceptions"))


@query(f"""{LOOP} SELECT 2 AS arrival_day, from_status, to_status, actor, count(*) AS n FROM (
  SELECT 'OPEN' AS from_status, 'PENDING_AI_UNAVAILABLE' AS to_status, 'AI' AS actor FROM decided WHERE round = 1 AND outcome = 'PENDING_AI_UNAVAILABLE' UNION ALL SELECT 'OPEN', outcome, 'AI' FROM decided WHERE outcome <> 'PENDING_AI_UNAVAILABLE'
  UNION ALL SELECT 'PENDING_AI_UNAVAILABLE', 'OPEN', 'AI' FROM decided WHERE round > 1 AND outcome <> 'PENDING_AI_UNAVAILABLE') GROUP BY ALL
  UNION ALL SELECT 1, NULL, 'OPEN', 'DETERMINISTIC', count(*) FROM pairs""")
def loop_moves(e):
    """Moves in the audit of the loop, by kind."""
    return looped(e)[0].read("audit").groupBy("arrival_day", "from_status", "to_status", "actor").agg(F.count(F.lit(1)).alias("n"))


#: A response for each credit, by the first digit of the digest of its id: the true batch, another one, an abstention in three forms, or a broken one.
def _link_response(sha: str) -> str:
    link = lambda batch: f"""'{{"links": [{{"bank_txn_id": "' || bank_txn_id || '", "batch_id": ' || {batch} || ', "confidence": 0.75}}]}}'"""
    digit = f"substr({sha}, 1, 1)"
    return f"""CASE {digit} WHEN '0' THEN {link("'null'")} WHEN '1' THEN '[{{"bank_txn_id": "' || bank_txn_id || '"}}]' WHEN '2' THEN 'I think it is' WHEN '3' THEN {link("'\"BAT_OTHER\"'")} WHEN '4' THEN '[{{"batch_id": "x"}}]' WHEN '5' THEN {link("'\"\"'")}
  ELSE {link("coalesce('\"' || batch_id || '\"', 'null')")} END"""


#: Views: what the model says of each credit.
SAID = """, said AS (SELECT bank_txn_id, batch_id, substr(sha256('link|' || bank_txn_id), 1, 1) AS digit FROM cr LEFT JOIN true_links USING (bank_txn_id)),
  llm AS (SELECT bank_txn_id, digit IN ('2', '4') AS failed, CASE WHEN digit = '3' THEN 'BAT_OTHER' WHEN digit NOT IN ('0', '1', '2', '4', '5') THEN batch_id END AS said, batch_id FROM said)"""


def _said(e) -> DataFrame:
    spark = e.ledger.sparkSession
    credits = e.credits.select("bank_txn_id").join(e.labels["true_links"].where("bank_txn_id is not null").select("bank_txn_id", "batch_id"), "bank_txn_id", "left")
    response = _link_response("sha2(concat('link|', bank_txn_id), 256)")
    return spark.sql(f"SELECT bank_txn_id AS asked, batch_id AS true_batch, {response.replace('{', '{{').replace('}', '}}')} AS response FROM {{credits}}", credits=credits)


@query(f"""{PASSES}{SAID} SELECT count(*) AS prompts, count(*) FILTER (failed) AS parse_failures, count(*) FILTER (NOT failed AND said IS NULL) AS abstentions, count(said) AS linked, count(*) FILTER (said IS NOT NULL AND said IS DISTINCT FROM batch_id) AS false_links FROM llm""")
def link_baseline(e):
    """Links that a model names for each credit, held against the true ones; an abstention is neither a failure nor a link."""
    links = H.parse_links(_said(e))
    named = F.col("batch_id").isNotNull()
    return links.agg(F.count(F.lit(1)).alias("prompts"), F.count_if("failed").alias("parse_failures"), F.count_if(~F.col("failed") & ~named).alias("abstentions"), F.count_if(named).alias("linked"), F.count_if(named & ~F.col("batch_id").eqNullSafe(F.col("true_batch"))).alias("false_links"))


_AGAINST = lambda name, rows: f"SELECT '{name}' AS baseline, count(*) AS linked, count(*) FILTER (l.bank_txn_id IS DISTINCT FROM t.bank_txn_id) AS false_links FROM {rows} l LEFT JOIN true_links t USING (batch_id)"


@query(f"""{NAIVE}{SAID} {_AGAINST("engine", "linked")} UNION ALL {_AGAINST("exact", "p2")} UNION ALL {_AGAINST("naive", "(SELECT * FROM greedy WHERE bank_txn_id <> '')")} UNION ALL {_AGAINST("model", "(SELECT said AS batch_id, bank_txn_id FROM llm WHERE said IS NOT NULL)")}""")
def baselines(e):
    """How many links each way of linking makes, and how many of them are false."""
    truth = e.labels["true_links"]
    engine = e.batch_links.where("bank_row_id is not null").select("batch_id", F.col("bank_row_id").alias("bank_txn_id"))
    model = H.parse_links(_said(e)).where("batch_id is not null")
    named = {"engine": engine, "exact": e.passes.exact, "naive": B.naive_links(e.batches, e.passes.credits, e.passes.as_of), "model": model}
    rows = [M.baseline(name, links, truth) for name, links in named.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


_CONFIRMED = "(SELECT count(*) FROM decided WHERE outcome = 'CONFIRMED')"
_BY_RULE = "count(*) FILTER (status = 'CONFIRMED')"


@query(f"{LOOP}{FACTS} SELECT 6 AS minutes_per_review, {_BY_RULE} AS deterministic_resolutions, {_BY_RULE} * 6 AS minutes_saved_deterministic, cast({_CONFIRMED} AS int) AS model_resolutions, cast({_CONFIRMED} * 6 AS int) AS minutes_saved_model FROM outcomes")
def analyst_minutes(e):
    """Minutes of review saved by rules, and by what the model said of likely duplicates."""
    return M.analyst_minutes(e.cases, 6, looped(e)[1].where("outcome = 'CONFIRMED'").count())


#: Fixed value: what a decision of the model costs, in rupees.
PER_DECISION = "0.4845"


@query(f"{LOOP} SELECT round, {_N(chr(39).join(('outcome = ', 'CONFIRMED', '')))} AS resolved, cast(count(*) * {PER_DECISION} AS decimal(18,4)) AS cost, cast(round_even(cast(count(*) * {PER_DECISION} AS double) / nullif({_N(chr(39).join(('outcome = ', 'CONFIRMED', '')))}, 0), 4) AS decimal(18,4)) AS per_resolved FROM decided GROUP BY 1")
def cost_per_resolved(e):
    """What each round of asking cost, in all and for each exception that it resolved."""
    done, cost = F.count_if(F.col("outcome") == "CONFIRMED"), F.count(F.lit(1)).cast("decimal(12,0)") * F.lit(PER_DECISION).cast("decimal(6,4)")
    return looped(e)[1].groupBy("round").agg(done.alias("resolved"), cost.cast("decimal(18,4)").alias("cost"), M.cost_per_resolved(cost, done).alias("per_resolved"))
