"""Queries over days of deliveries: rows that come late, and the store after a stream has taken them in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import lifecycle as L
from ledgerloom.operators import metrics as M
from ledgerloom.operators import store as S
from ledgerloom.operators.stage import kept, shared_path
from ledgerloom.plans import case_queries
from ledgerloom.plans.case_queries import FACTS
from ledgerloom.plans.engine import Engine
from ledgerloom.plans.lens import AS_OF, CUTS, DELIVERED, oracle
from ledgerloom.plans.link_queries import PASSES
from ledgerloom.sources import bitemporal, settlement_csv
from ledgerloom.streaming import days as D

QUERIES, ORACLES = {}, {}
#: The date that each delivery is looked at.
LOOKED_AT = {1: CUTS[0], 2: CUTS[1], 3: AS_OF}


def query(select: str | None):
    def register(f):
        case_queries.query(None)(f)
        QUERIES[f.__name__] = case_queries.QUERIES.pop(f.__name__)
        if select is not None:
            ORACLES[f.__name__] = oracle(select)
        return f

    return register


def _days(e, count: int = 3) -> DataFrame:
    return e.ledger.sparkSession.range(1, count + 1).select(F.col("id").cast("int").alias("day"))


STOOD = "(SELECT cast(range AS int) AS day FROM range(1, 4))"


@query("SELECT day, tab, count(*) AS n, count(*) FILTER (arrival_day > event_day) AS n_late FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS tab, event_day, arrival_day FROM {t}_days" for t in DELIVERED) + f") r JOIN {STOOD} d ON r.arrival_day <= d.day GROUP BY ALL")
def s_asof_tables(e):
    """Rows of each table that stood on each day, and how many of them had come late. Rows are counted by their days before they meet the days."""
    counted = [e.labels[f"{t}_days"].groupBy(F.lit(t).alias("tab"), "event_day", "arrival_day").agg(F.count(F.lit(1)).alias("n")) for t in DELIVERED]
    rows = reduce(DataFrame.unionByName, counted).join(F.broadcast(_days(e)), F.col("arrival_day") <= F.col("day"))
    return rows.groupBy("day", "tab").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(bitemporal.is_late(), F.col("n"))), F.lit(0)).alias("n_late"))


AMENDED = "SELECT refund_id, payment_id, amount, created_at, event_day, arrival_day FROM refunds_days UNION ALL SELECT refund_id, payment_id, cast(amount + 1 AS decimal(18,2)), created_at, event_day, arrival_day + 1 FROM refunds_days WHERE substr(sha256('amend|' || refund_id), 1, 1) = '3'"


@query(f"SELECT day, refund_id, arg_max(amount, arrival_day) AS amount, any_value(event_day) AS event_day, max(arrival_day) AS arrival_day FROM ({AMENDED}) r JOIN {STOOD} d ON r.arrival_day <= d.day GROUP BY ALL")
def s_asof(e):
    """Refunds as they stood on each day: some come late, some are amended a day after they came."""
    first = e.labels["refunds_days"].select("refund_id", "payment_id", "amount", "created_at", "event_day", "arrival_day")
    amended = first.where(F.substring(F.sha2(F.concat(F.lit("amend|"), F.col("refund_id")), 256), 1, 1) == "3")
    versions = first.unionByName(amended.withColumn("amount", (F.col("amount") + 1).cast("decimal(18,2)")).withColumn("arrival_day", F.col("arrival_day") + 1))
    return bitemporal.as_of(bitemporal.history(versions, ["refund_id"]), _days(e)).select("day", "refund_id", "amount", "event_day", "arrival_day")


def deciding(e):
    """What the engine says of the rows that have arrived by a day, as of that day's date."""

    def decide(tables: dict[str, DataFrame], day: int) -> DataFrame:
        now = Engine(tables, e.days, e.rates, e.cycles, e.gst, LOOKED_AT[day])
        return L.outcomes_of(now.cases, now.batch_links, now.row_variances)

    return decide


_stores: dict[tuple[str, str], S.Store] = {}


def _deliver(e, folder: str, days: tuple[int, ...]) -> None:
    for table in settlement_csv.TABLES:
        settlement_csv.write(e.labels[f"{table}_days"].where(F.col("arrival_day").isin(*days)), folder, table)


def replayed(e) -> S.Store:
    """The store after three deliveries: two are there when the stream starts, the third comes before it is started again. Taken in once for a session and folder."""
    spark = e.ledger.sparkSession
    key = (spark.sparkContext.applicationId, e.labels.folder)
    if key not in _stores:
        folder, checkpoint, store = (shared_path(spark, name) for name in ("deliveries", "stream", "store"))
        taken = D.store_of(spark, store)
        for days in ((1, 2), (3,)):
            _deliver(e, folder, days)
            D.follow(taken, folder, checkpoint, deciding(e)).awaitTermination()
        _stores[key] = taken
    return _stores[key]


_TABLES = ", ".join(f"{t} AS (SELECT * FROM {t}_days WHERE arrival_day <= __DAY__)" for t in DELIVERED)
_CREDITS = """credits AS (SELECT b.batch_id, utr, net_total, coalesce(w.d, b.settled_event_date) AS due FROM batches b
  LEFT JOIN (SELECT batch_id, min(profile) AS profile FROM lines WHERE payment_id IN (SELECT payment_id FROM payments) GROUP BY 1) p USING (batch_id)
  LEFT JOIN cycles y ON y.profile = p.profile LEFT JOIN calendar c ON c.d = b.settled_event_date LEFT JOIN calendar n ON n.d = c.next_wd LEFT JOIN working w ON w.ord = n.cum + y.cycle)"""
#: Views over those of the passes: all outcomes, each with the ids that it rests on.
EVERY = """every AS (
  SELECT 'A' AS population, case_id AS subject_id, status, category, CASE WHEN variance = 0 THEN expected_gross ELSE variance END AS amount, [batch_id] AS cited FROM outcomes
  UNION ALL SELECT 'B', batch_id, status, category, batch_net_total, [bank_row_id] FROM links UNION ALL SELECT 'C', source_table || '|' || row_id, status, category, amount, [row_id] FROM rowvar),
exc AS (SELECT substr(sha256('exception|' || population || '|' || subject_id), 1, 16) AS exception_id, population, subject_id, status, category, cast(amount AS decimal(18,2)) AS amount, list_filter(cited, lambda x: x IS NOT NULL) AS evidence FROM every)"""
_ONE_DAY = f"WITH {_TABLES}, {_CREDITS}{FACTS.rstrip()},{PASSES.lstrip()[1:].rstrip()}, {EVERY} SELECT * FROM exc"


def _one_day(day: int) -> str:
    return _ONE_DAY.replace("__DAY__", str(day)).replace(f"'{AS_OF}'", f"'{LOOKED_AT[day]}'")


#: Views: what each day says, and where that leaves each exception.
REPLAY = f""", {", ".join(f"day{n} AS ({_one_day(n)})" for n in LOOKED_AT)},
outs AS ({" UNION ALL ".join(f"SELECT {n} AS day, * FROM day{n}" for n in LOOKED_AT)}),
firsts AS (SELECT exception_id, min(day) AS first_seen_day FROM outs WHERE status <> 'CONFIRMED' GROUP BY 1),
solved AS (SELECT exception_id, min(day) AS confirmed_day, arg_min(evidence, day) AS cited FROM outs JOIN firsts USING (exception_id) WHERE status = 'CONFIRMED' AND day > first_seen_day GROUP BY 1),
held AS (SELECT o.exception_id, population, subject_id, o.status AS opened_as, coalesce(category, '') AS category, amount, evidence, first_seen_day, confirmed_day, cited
  FROM outs o JOIN firsts f ON f.exception_id = o.exception_id AND f.first_seen_day = o.day LEFT JOIN solved s ON s.exception_id = o.exception_id WHERE o.status <> 'CONFIRMED'),
state AS (SELECT *, CASE WHEN confirmed_day IS NULL THEN opened_as ELSE 'CONFIRMED' END AS status, CASE WHEN confirmed_day IS NOT NULL THEN 'DETERMINISTIC' END AS resolved_by FROM held),
entries AS (
  SELECT confirmed_day AS arrival_day, 0 AS phase, 0 AS step, exception_id, amount, opened_as AS from_status, 'OPEN' AS to_status, 'evidence arrived on day ' || confirmed_day || '; reopened for decision' AS note, cited AS evidence_ids FROM held WHERE confirmed_day IS NOT NULL AND opened_as <> 'OPEN'
  UNION ALL SELECT confirmed_day, 0, 1, exception_id, amount, 'OPEN', 'CONFIRMED', 'DETERMINISTIC_REEVALUATION', cited FROM held WHERE confirmed_day IS NOT NULL
  UNION ALL SELECT first_seen_day, 1, 0, exception_id, amount, NULL, opened_as, CASE population WHEN 'A' THEN 'case ' || subject_id || ': ' || coalesce(nullif(category, ''), 'unresolved') WHEN 'B' THEN 'batch ' || subject_id || ': ' || coalesce(nullif(category, ''), 'unlinked')
    ELSE 'row ' || split_part(subject_id, '|', 2) || ': ' || coalesce(nullif(category, ''), 'unexplained') END, evidence FROM held),
audit AS (SELECT exception_id, arrival_day, row_number() OVER (PARTITION BY arrival_day ORDER BY phase, amount DESC, exception_id, step) - 1 AS sequence, from_status, to_status, 'DETERMINISTIC' AS actor, note, evidence_ids FROM entries)
"""


@query(f"{REPLAY} SELECT exception_id, population, subject_id, status, category, amount, first_seen_day, confirmed_day FROM state")
def day_replay(e):
    """Exceptions after a stream has taken in three deliveries, with rows that come late and a restart half way."""
    return replayed(e).read("exceptions").select("exception_id", "population", "subject_id", "status", "category", "amount", "first_seen_day", "confirmed_day")


@query(f"{REPLAY} SELECT * FROM audit")
def replay_audit(e):
    """Every move of every exception over those days, numbered day by day."""
    return replayed(e).read("audit")


@query(f"{REPLAY} SELECT exception_id, to_status, note, n AS moves FROM (SELECT *, row_number() OVER (PARTITION BY exception_id ORDER BY arrival_day DESC, sequence DESC) AS k, count(*) OVER (PARTITION BY exception_id) AS n FROM audit) WHERE k = 1")
def replay_last_notes(e):
    return S.last_note(replayed(e).read("audit")).select("exception_id", "to_status", "note", "moves")


@query(f"{REPLAY} SELECT sha256(concat_ws('|', exception_id, 'DETERMINISTIC_REEVALUATION', CASE WHEN len(cited) > 0 THEN array_to_string(list_sort(cited), '|') END)) AS idempotency_key, exception_id, 'DETERMINISTIC_REEVALUATION' AS resolution_type, cited AS evidence_ids, confirmed_day AS arrival_day FROM held WHERE confirmed_day IS NOT NULL")
def replay_resolutions(e):
    return replayed(e).read("resolutions")


_COUNTS = " UNION ALL ".join(f"SELECT 'day' || arrival_day || '_{settlement_csv.TABLES[t][0]}.csv' AS path, arrival_day, count(*) AS row_count FROM {t}_days WHERE arrival_day <= 3 GROUP BY ALL" for t in DELIVERED)


@query(f"SELECT path, arrival_day, row_number() OVER (PARTITION BY arrival_day ORDER BY path) AS arrival_seq, row_count, row_count = 0 AS is_empty FROM ({_COUNTS})")
def replay_files(e):
    """The files that were taken in, in order and without gaps."""
    return replayed(e).read("files").drop("content_hash")


@query("SELECT 'ingest' AS name, 3 AS arrival_day, 6::bigint AS arrival_seq, (SELECT count(*) FROM lines_days WHERE arrival_day <= 3) AS lines UNION ALL SELECT 'stream', 3, 1, (SELECT count(*) FROM lines_days WHERE arrival_day <= 3)")
def replay_watermarks(e):
    """How far the store has come, beside the settlement lines that it holds."""
    store = replayed(e)
    return store.read("watermarks").join(F.broadcast(store.read("lines").agg(F.count(F.lit(1)).alias("lines"))))


@query(f"{REPLAY} SELECT d.day AS arrival_day, count(*) FILTER (first_seen_day <= d.day AND (confirmed_day IS NULL OR confirmed_day > d.day)) AS residual FROM state, {STOOD} d GROUP BY 1")
def residual_sequence(e):
    """Exceptions that are neither confirmed nor closed on each day of the replay."""
    return L.residual_sequence(replayed(e).read("exceptions"), _days(e).withColumnRenamed("day", "arrival_day"))


@query(f"{REPLAY} SELECT status, coalesce(resolved_by, 'NONE') AS resolved_by, count(*) AS n, cast(coalesce(sum(amount), 0) AS decimal(28,2)) AS value FROM state GROUP BY ALL")
def store_tallies(e):
    return M.tallies(replayed(e).read("exceptions"))


@query(f"""{REPLAY}, today AS (SELECT exception_id, any_value(category) AS current_category, any_value(status) AS current_status FROM day3 GROUP BY 1)
  SELECT h.exception_id, population, subject_id, category, current_category, current_status, t.exception_id IS NOT NULL AS present FROM held h LEFT JOIN today t USING (exception_id) WHERE first_seen_day <= 2""")
def current_categories(e):
    """Exceptions as they stood after two days against what the third day says of their subjects."""
    store = replayed(e)
    today = store.read("outcomes").where("arrival_day = 3").dropDuplicates(["exception_id"])
    return M.current_categories(store.read("exceptions", version=2), today)


@query(f"""{FACTS}, asked AS (SELECT substr(sha256('exception|A|' || case_id), 1, 16) AS exception_id, case_id, order_id, status FROM outcomes WHERE status <> 'CONFIRMED' AND category = 'DUPLICATE_CANDIDATE')
  SELECT exception_id, 'CONFIRMED' AS status, cast(0.9 AS decimal(5,4)) AS confidence, 'HUMAN' AS resolved_by, 2 AS confirmed_day, 1::bigint AS resolutions, 2::bigint AS moves, sha256(exception_id || '|REVIEWED|' || order_id) AS idempotency_key FROM asked""")
def confirm_twice(e):
    """Likely duplicates, opened on one day and confirmed on the next; the first writer is lost before its commit, and the confirmation is repeated after it. Each ends with one resolution."""
    store = S.Store(e.ledger.sparkSession, shared_path(e.ledger.sparkSession, "store"))
    likely = kept(L.of_cases(e.cases).where("status <> 'CONFIRMED' AND category = 'DUPLICATE_CANDIDATE'"))
    S.close_day(store, 1, likely)
    orders = e.cases.select(F.col("case_id").alias("subject_id"), "order_id")
    asked = kept(likely.join(orders, "subject_id").select("exception_id", F.lit("REVIEWED").alias("resolution_type"), F.array("order_id").alias("evidence_ids"), F.lit("0.9").cast("decimal(5,4)").alias("confidence")))

    def confirmed(crash: bool) -> None:
        state, done, audit = (store.read(t) for t in ("exceptions", "resolutions", "audit"))
        after, new, entries = S.confirm(state, done, asked.unionByName(asked), 2, "HUMAN", "HUMAN")
        changes = {"exceptions": after, "resolutions": new, "audit": S.sequenced([entries], audit, 2)}
        changes = {name: store.stage(name, frame)[0] for name, frame in changes.items()}
        if not crash:
            store.commit(changes)

    for crash in (True, False, False):
        confirmed(crash)
    per = store.read("resolutions").groupBy("exception_id").agg(F.count(F.lit(1)).alias("resolutions"), F.max("idempotency_key").alias("idempotency_key"))
    moves = store.read("audit").groupBy("exception_id").agg(F.count(F.lit(1)).alias("moves"))
    return store.read("exceptions").select("exception_id", "status", "confidence", "resolved_by", "confirmed_day").join(per, "exception_id").join(moves, "exception_id")


@query(f"""{REPLAY}, states AS (SELECT from_status AS s, count(*) AS n FROM audit WHERE from_status IS NOT NULL GROUP BY 1 UNION ALL SELECT to_status, count(*) FROM audit GROUP BY 1), once AS (SELECT s, sum(n) AS n FROM states GROUP BY 1)
  SELECT a.s AS from_status, b.s AS to_status, cast(a.n AS bigint) AS entries FROM once a, once b WHERE (a.s, b.s) NOT IN (({"), (".join(f"'{x}', '{y}'" for x, to in L.TRANSITIONS.items() for y in to)}))""")
def transitions_illegal(e):
    """Of the statuses that the audit of the replay has, the moves from one to another that may not be made; with the entries that name the first."""
    audit = replayed(e).read("audit")
    named = audit.select(F.explode(F.array_compact(F.array("from_status", "to_status"))).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("entries"))
    moves = named.withColumnRenamed("s", "from_status").crossJoin(F.broadcast(named.select(F.col("s").alias("to_status"))))  # six statuses at most
    return L.illegal(moves).select("from_status", "to_status", "entries")
