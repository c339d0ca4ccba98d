"""The six settlement tables as views over the star schema of the test data.

The views are deterministic SQL that Spark and DuckDB both run; the few
functions that they spell differently are in ``Dialect``. Each kind of noise
that a matching pass answers to is put in by order key or batch number.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators.stage import kept

#: The rate of each profile and method, the tax on fees, each profile's settlement cycle in working days.
RATES = {
    "profile_a": {"card": "0.0200", "upi": "0.0000", "netbanking": "0.0175", "wallet": "0.0210"},
    "profile_b": {"card": "0.0235", "upi": "0.0000", "netbanking": "0.0190", "wallet": "0.0200"},
    "profile_c": {"card": "0.0180", "upi": "0.0000", "netbanking": "0.0160", "wallet": "0.0195"},
}
GST = "0.1800"
CYCLES = {"profile_a": 2, "profile_b": 1, "profile_c": 3}
#: Holidays, which the lens keeps every year.
HOLIDAYS = ("09-07", "09-17", "10-02", "10-20", "11-02", "11-11", "11-19", "11-26")
FIRST_DAY, LAST_DAY, AS_OF = "1994-12-01", "2002-01-31", "2001-06-30"
#: Charges that settle; some never do, and half of the orders that were entered twice are paid once.
PAID = "k % 89 <> 11 AND NOT (k % 202 = 0 AND tail LIKE 'R%')"
#: The last dates of the first two deliveries; of each table its date, and the id by which some rows come one or two deliveries late.
CUTS = ("1996-06-30", "1999-06-30")
DELIVERED = {"ledger": ("order_date", None), "payments": ("captured_at", None), "refunds": ("created_at", "refund_id"), "lines": ("settled_event_date", "settlement_id"), "batches": ("settled_event_date", None), "bank": ("value_date", "bank_txn_id")}


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)" if self.spark else f"sha256({x})"

    def plus(self, date: str, days: str) -> str:
        return f"date_add({date}, cast({days} as int))" if self.spark else f"({date} + cast({days} as int))"

    def weekday(self, date: str) -> str:
        return f"weekday({date})" if self.spark else f"(isodow({date}) - 1)"

    @property
    def days(self) -> str:
        if self.spark:
            return f"SELECT explode(sequence(date '{FIRST_DAY}', date '{LAST_DAY}')) AS d"
        return f"SELECT cast(unnest(generate_series(date '{FIRST_DAY}', date '{LAST_DAY}', INTERVAL 1 DAY)) AS date) AS d"

    @cached_property
    def views(self) -> dict[str, str]:
        """Name and SELECT of each view, each over those before it."""
        holidays = ", ".join(f"'{h}'" for h in HOLIDAYS)
        month_day = "lpad(cast(month(d) AS string), 2, '0') || '-' || lpad(cast(day(d) AS string), 2, '0')"
        rates = ", ".join(f"('{p}', '{m}', cast({r} AS decimal(6,4)))" for p, row in RATES.items() for m, r in row.items())
        cycles = ", ".join(f"('{p}', {n})" for p, n in CYCLES.items())
        s = lambda x: f"cast({x} AS string)"
        money = lambda x: f"cast(round({x}, 2) AS decimal(18,2))"
        return {
            "calendar": f"""
                SELECT d, working, sum(CASE WHEN working THEN 1 ELSE 0 END) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) AS cum,
                       min(CASE WHEN working THEN d END) OVER (ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_wd
                FROM (SELECT d, {self.weekday("d")} < 5 AND {month_day} NOT IN ({holidays}) AS working FROM ({self.days}))""",
            "working": "SELECT cast(cum AS int) AS ord, d FROM calendar WHERE working",
            "rates": f"SELECT * FROM (VALUES {rates}) AS t(profile, method, rate)",
            "cycles": f"SELECT * FROM (VALUES {cycles}) AS t(profile, cycle)",
            "sales": f"""
                SELECT o_orderkey AS k, {s("o_orderkey")} AS tail, cast(o_totalprice AS decimal(18,2)) AS gross, cast(o_orderdate AS date) AS day,
                       'CUST-PROFILE_' || CASE c_nationkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END || '-' || lpad({s("o_custkey")}, 5, '0') AS customer_id
                FROM orders JOIN customer ON o_custkey = c_custkey""",
            "orders_once": """
                SELECT k, tail, gross, day, customer_id FROM sales UNION ALL SELECT k, 'R' || tail, gross, day, customer_id FROM sales WHERE k % 101 = 0""",
            "ledger": f"""
                SELECT 'ORD_' || tail AS order_id, 'INV_' || tail AS invoice_no, gross, day AS order_date, customer_id, 'SKU-' || {s("k % 50")} AS sku FROM orders_once
                UNION ALL SELECT 'ORD_' || tail, 'INV_' || tail, gross, day, customer_id, 'SKU-' || {s("k % 50")} FROM orders_once WHERE k % 97 = 0""",
            "charges": f"""
                SELECT k, tail, 'PAY_' || tail AS payment_id, 'ORD_' || tail AS order_id, CASE k % 4 WHEN 0 THEN 'card' WHEN 1 THEN 'upi' WHEN 2 THEN 'netbanking' ELSE 'wallet' END AS method,
                       gross AS authorized, CASE WHEN k % 50 = 7 THEN {money("gross * 0.6")} ELSE gross END AS captured, day AS captured_at,
                       'profile_' || lower(substr(customer_id, 14, 1)) AS profile,
                       CASE WHEN k % 211 = 0 THEN 'failed' WHEN k % 17 = 3 THEN 'refunded' WHEN k % 50 = 7 THEN 'partial' ELSE 'captured' END AS status
                FROM orders_once""",
            "payments": "SELECT payment_id, order_id, method, authorized, captured, status, captured_at FROM charges",
            "repaid": f"""
                SELECT profile, payment_id, 'RFD_' || tail AS refund_id, CASE WHEN k % 2 = 0 THEN captured ELSE {money("captured * 0.25")} END AS amount, {self.plus("captured_at", "5")} AS created_at
                FROM charges WHERE k % 17 = 3""",
            "refunds": "SELECT refund_id, payment_id, amount, created_at FROM repaid",
            "settled": f"""
                SELECT profile, 'payment' AS line_type, payment_id, cast(NULL AS string) AS refund_id, 'SET_' || tail || part AS settlement_id, method, w.d AS settled_event_date,
                       CASE WHEN k % 61 = 8 AND part = 'x' THEN {money("captured * 0.5")} WHEN k % 61 = 8 THEN captured - {money("captured * 0.5")}
                            WHEN k % 173 = 5 THEN captured - 0.37 WHEN k % 179 = 9 THEN captured - 25.00 ELSE captured END AS gross
                FROM charges JOIN (VALUES ('x'), ('y')) AS t(part) ON part = 'x' OR k % 61 = 8
                JOIN calendar c ON c.d = captured_at JOIN calendar n ON n.d = c.next_wd JOIN working w ON w.ord = n.cum + CASE WHEN k % 67 = 5 THEN 2 ELSE 0 END
                WHERE {PAID}
                UNION ALL SELECT profile, 'payment', 'PAY_GHOST' || tail, NULL, 'SET_G' || tail, method, next_wd, captured FROM charges JOIN calendar ON d = captured_at WHERE k % 499 = 1
                UNION ALL SELECT profile, 'refund', payment_id, refund_id, 'SET_F' || refund_id, NULL, next_wd, -amount FROM repaid JOIN calendar ON d = created_at""",
            "priced": f"""
                SELECT s.*, CASE WHEN line_type = 'refund' THEN cast(0 AS decimal(18,2)) ELSE {money("gross * rate")} END AS fee, year(settled_event_date) * 100 + month(settled_event_date) AS month
                FROM settled s LEFT JOIN rates r ON r.profile = s.profile AND r.method = s.method""",
            "lines": f"""
                SELECT settlement_id, 'BAT_' || upper(substr({self.sha("profile || '|' || " + s("month"))}, 1, 12)) AS batch_id, line_type, payment_id, refund_id, gross, fee,
                       {money(f"fee * {GST}")} AS tax, cast(gross - fee - {money(f"fee * {GST}")} AS decimal(18,2)) AS net, settled_event_date, profile FROM priced""",
            "batched": f"""
                SELECT batch_id, upper(substr({self.sha("'utr|' || batch_id")}, 1, 16)) AS utr, cast(sum(net) AS decimal(18,2)) AS net_total, max(settled_event_date) AS settled_event_date,
                       min(profile) AS profile, row_number() OVER (ORDER BY batch_id) AS rn FROM lines GROUP BY batch_id""",
            "batches": "SELECT batch_id, utr, net_total, settled_event_date FROM batched",
            "credits": """
                SELECT b.*, w.d AS due FROM batched b JOIN cycles y ON y.profile = b.profile JOIN calendar c ON c.d = b.settled_event_date
                JOIN calendar n ON n.d = c.next_wd JOIN working w ON w.ord = n.cum + y.cycle""",
            "bank": f"""
                SELECT 'BNK_' || upper(substr({self.sha("'bank|' || batch_id")}, 1, 12)) AS bank_txn_id, CASE WHEN rn % 20 = 4 THEN {self.plus("due", "1")} ELSE due END AS value_date,
                       cast(CASE WHEN rn % 20 = 3 THEN net_total + 0.40 WHEN rn % 20 = 6 THEN net_total + 5.00 WHEN rn % 20 = 7 THEN net_total + 50.00 ELSE net_total END AS decimal(18,2)) AS amount,
                       CASE WHEN rn % 20 = 1 THEN 'NEFT/' || substr(utr, 1, 8) || '/SETTLEMENT' WHEN rn % 20 = 2 THEN 'NEFT SETTLEMENT'
                            WHEN rn % 20 = 6 THEN 'imps-' || lower(substr(utr, 3, 9)) || ' settlement' ELSE 'NEFT/' || utr || '/SETTLEMENT' END AS narration, 'credit' AS direction
                FROM credits WHERE rn % 20 <> 5
                UNION ALL SELECT 'BNK_O' || upper(substr({self.sha("'orphan|' || batch_id")}, 1, 11)), due, cast(98765432.10 + rn * 10 AS decimal(18,2)), 'NEFT UNKNOWN PARTY', 'credit' FROM credits WHERE rn % 40 = 9
                UNION ALL SELECT 'BNK_D' || upper(substr({self.sha("'debit|' || batch_id")}, 1, 11)), due, net_total, 'NEFT/' || utr || '/CHARGES', 'debit' FROM credits WHERE rn % 30 = 10""",
            # What the noise above is, as labels would say it.
            "true_links": f"""
                SELECT batch_id, CASE WHEN rn % 20 <> 5 THEN 'BNK_' || upper(substr({self.sha("'bank|' || batch_id")}, 1, 12)) END AS bank_txn_id,
                       CASE rn % 20 WHEN 1 THEN 'UTR_TRUNCATED_MAPPING' WHEN 2 THEN 'UTR_MISSING_MAPPING' WHEN 3 THEN 'ROUNDING_DIFFERENCE' WHEN 5 THEN 'MISSING_VS_LATE_CREDIT' WHEN 6 THEN 'UTR_TRUNCATED_MAPPING' WHEN 7 THEN 'UNEXPLAINED' END AS true_category
                FROM credits""",
            "true_cases": f"""
                SELECT substr({self.sha("'case|' || payment_id")}, 1, 16) AS case_id, order_id, CASE WHEN k % 50 = 7 THEN 'PARTIAL_CAPTURE' WHEN k % 179 = 9 AND k % 89 <> 11 THEN 'UNEXPLAINED' WHEN k % 101 = 0 THEN 'DUPLICATE_CANDIDATE'
                       WHEN k % 173 = 5 AND k % 89 <> 11 THEN 'ROUNDING_DIFFERENCE' WHEN k % 67 = 5 AND k % 89 <> 11 THEN 'T_PLUS_N_TIMING' END AS true_category
                FROM charges""",
            "true_rows": f"""
                SELECT 'ORD_' || tail AS row_id, 'DUPLICATE_CONFIRMED' AS true_category FROM orders_once WHERE k % 97 = 0
                UNION ALL SELECT 'BNK_O' || upper(substr({self.sha("'orphan|' || batch_id")}, 1, 11)), 'UNEXPLAINED' FROM credits WHERE rn % 40 = 9""",
            # What was done to the data, as whoever did it would note it down.
            "annotations": f"""
                SELECT 'case' AS target_kind, payment_id AS target_id, 'partial_captures' AS noise_type, 'PARTIAL_CAPTURE' AS category, authorized - captured AS amount, true AS resolvable FROM charges WHERE k % 50 = 7 AND authorized > captured
                UNION ALL SELECT 'case', payment_id, 'split_settlement', 'SPLIT_SETTLEMENT', cast(0 AS decimal(18,2)), true FROM charges WHERE k % 61 = 8 AND {PAID}
                UNION ALL SELECT 'case', payment_id, 'rounding_residual', 'ROUNDING_DIFFERENCE', cast(0.37 AS decimal(18,2)), true FROM charges WHERE k % 173 = 5 AND k % 61 <> 8 AND {PAID}
                UNION ALL SELECT 'case', payment_id, 'unexplainable', 'UNEXPLAINED', cast(25 AS decimal(18,2)), false FROM charges WHERE k % 179 = 9 AND k % 173 <> 5 AND k % 61 <> 8 AND {PAID}
                UNION ALL SELECT 'case', payment_id, 'delayed_settlement', 'T_PLUS_N_TIMING', cast(0 AS decimal(18,2)), true FROM charges WHERE k % 67 = 5 AND {PAID}
                UNION ALL SELECT 'case', payment_id, 'garbled_narration', cast(NULL AS string), cast(0 AS decimal(18,2)), true FROM charges WHERE k % 50 = 7 AND k % 4 = 1
                UNION ALL SELECT 'ledger_row', 'ORD_' || tail, 'duplicate_ledger_rows', 'DUPLICATE_CONFIRMED', gross, true FROM orders_once WHERE k % 97 = 0
                UNION ALL SELECT 'batch_link', batch_id, 'truncate_utr', 'UTR_TRUNCATED_MAPPING', cast(0 AS decimal(18,2)), true FROM credits WHERE rn % 20 IN (1, 6)
                UNION ALL SELECT 'batch_link', batch_id, 'drop_utr', 'UTR_MISSING_MAPPING', cast(0 AS decimal(18,2)), true FROM credits WHERE rn % 20 = 2
                UNION ALL SELECT 'batch_link', batch_id, 'unexplainable', 'MISSING_VS_LATE_CREDIT', net_total, false FROM credits WHERE rn % 20 = 5
                UNION ALL SELECT 'bank_row', 'BNK_O' || upper(substr({self.sha("'orphan|' || batch_id")}, 1, 11)), 'unexplainable', 'UNEXPLAINED', cast(98765432.10 + rn * 10 AS decimal(18,2)), false FROM credits WHERE rn % 40 = 9""",
            **self._days(),
        }

    def _days(self) -> dict[str, str]:
        """The tables as they are delivered: event_day, the delivery that a row's date belongs to, and arrival_day, the one that brings it."""
        bundle = lambda date: f"CASE WHEN {date} <= date '{CUTS[0]}' THEN 1 WHEN {date} <= date '{CUTS[1]}' THEN 2 ELSE 3 END"
        lag = lambda id_: f"CASE substr({self.sha(f"'late|' || {id_}")}, 1, 1) WHEN '0' THEN 1 WHEN '1' THEN 2 ELSE 0 END"
        return {f"{table}_days": f"SELECT *, {bundle(date)} AS event_day, {bundle(date)} + {lag(late) if late else '0'} AS arrival_day FROM {table}" for table, (date, late) in DELIVERED.items()}


SPARK, DUCKDB = Dialect(True), Dialect(False)
_SOURCES = ("orders", "customer")


#: What a delivery would bring as files, and the sales that they all come from: written once for each session and folder, then read like files.
_DELIVERED = ("sales", "ledger", "payments", "refunds", "charges", "repaid", "lines", "batched", "batches", "bank")
_written: dict[tuple[str, str], dict[str, DataFrame]] = {}


class Lens:
    """The views as DataFrames over the tables in a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.folder = spark, sf_dir
        self.frames = _written.setdefault((spark.sparkContext.applicationId, sf_dir), {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _SOURCES})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.frames:
            view = self._view(name)
            self.frames[name] = kept(view) if name in _DELIVERED else view
        return self.frames[name]

    def _view(self, name: str) -> DataFrame:
        sql = SPARK.views[name]
        earlier = list(SPARK.views)[: list(SPARK.views).index(name)]
        used = [v for v in [*_SOURCES, *earlier] if _named(v, sql)]
        for v in used:
            sql = re.sub(_use(v), rf"\1 {{{v}}}", sql)
        return self.spark.sql(sql, **{v: self[v] for v in used})


def _use(view: str) -> str:
    return rf"\b(FROM|JOIN) {view}\b"


def _named(view: str, sql: str) -> bool:
    return re.search(_use(view), sql) is not None


def oracle(select: str) -> str:
    """DuckDB SQL: the views, then select over them; select may begin with further views after a comma."""
    views = ",\n".join(f"{name} AS ({sql})" for name, sql in DUCKDB.views.items())
    return f"WITH RECURSIVE {views}\n{select}"
