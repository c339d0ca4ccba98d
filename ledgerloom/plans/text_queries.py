"""Queries over the text, amount and date functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import normalize as N
from ledgerloom.plans.lens import Lens, oracle

QUERIES, ORACLES = {}, {}

#: Inputs in the shapes that files bring; both engines run this SQL.
AMOUNTS = """SELECT payment_id AS id, CASE k % 11 WHEN 0 THEN g WHEN 1 THEN '(' || g || ')' WHEN 2 THEN '₹' || g WHEN 3 THEN '  ' || g || ' ' WHEN 4 THEN substr(g, 1, 1) || ',' || substr(g, 2)
  WHEN 5 THEN 'x' || g WHEN 6 THEN '' WHEN 7 THEN '-' || g WHEN 8 THEN g || '7' WHEN 9 THEN '(-' || g || ')' ELSE substr(g, 1, 3) END AS raw
  FROM (SELECT payment_id, k, cast(captured AS string) AS g FROM charges) x"""
DATES = """SELECT payment_id AS id, CASE k % 6 WHEN 0 THEN y || '-' || m || '-' || t WHEN 1 THEN y || '/' || m || '/' || t WHEN 2 THEN t || '/' || m || '/' || y WHEN 3 THEN t || '-' || m || '-' || y WHEN 4 THEN '31/02/' || y ELSE t || '/' || m || '-' || y END AS raw
  FROM (SELECT payment_id, k, cast(year(captured_at) AS string) AS y, lpad(cast(month(captured_at) AS string), 2, '0') AS m, lpad(cast(day(captured_at) AS string), 2, '0') AS t FROM charges) x"""
NAMES = """SELECT payment_id AS id, CASE k % 6 WHEN 0 THEN 'Carbon ' || n || ' Pvt Ltd' WHEN 1 THEN 'CARBON' || n || 'PVTLTD' WHEN 2 THEN 'Private Limited' WHEN 3 THEN 'carbon-' || n || ' private' WHEN 4 THEN 'LTD' ELSE 'Carbon   ' || n END AS raw
  FROM (SELECT payment_id, k, cast(k % 1000 AS string) AS n FROM charges) x"""


DIGITS = "regexp_replace(regexp_replace(trim(raw), '₹', '', 'g'), '[(),]', '', 'g')"


def _text_query(name: str, inputs: str, make, select: str) -> None:
    """make gives the columns over raw on call, as they need a session."""

    def run(spark, sf_dir):
        frame = spark.sql(inputs.replace("FROM charges", "FROM {charges}"), charges=Lens(spark, sf_dir)["charges"])
        return frame.select("id", *[c.alias(n) for n, c in make().items()])

    QUERIES[name] = run
    ORACLES[name] = oracle(f", inputs AS ({inputs}) {select}")


_text_query("f_parse_amount", AMOUNTS, lambda: {"value": N.parse_amount(F.col("raw"))}, f"""
  SELECT id, CASE WHEN raw LIKE '(%' THEN CASE WHEN regexp_full_match({DIGITS}, '\\d+(\\.\\d+)?') THEN -cast(round(cast({DIGITS} AS decimal(30,6)), 2) AS decimal(18,2)) END
                  WHEN regexp_full_match({DIGITS}, '-?\\d+(\\.\\d+)?') THEN cast(round(cast({DIGITS} AS decimal(30,6)), 2) AS decimal(18,2)) END AS value FROM inputs""")
_text_query("f_parse_date", DATES, lambda: {"value": N.parse_date(F.col("raw"))["value"], "ambiguous": N.parse_date(F.col("raw"))["ambiguous"]}, """
  , p AS (SELECT id, raw, coalesce(try_strptime(raw, '%Y-%m-%d'), try_strptime(raw, '%Y/%m/%d')) AS iso, CASE WHEN NOT regexp_matches(raw, '/.*-') THEN try_strptime(replace(raw, '-', '/'), '%d/%m/%Y') END AS a,
         CASE WHEN NOT regexp_matches(raw, '/.*-') THEN try_strptime(replace(raw, '-', '/'), '%m/%d/%Y') END AS b FROM inputs)
  SELECT id, cast(coalesce(iso, CASE WHEN a IS NULL OR b IS NULL OR a = b THEN coalesce(a, b) END) AS date) AS value, iso IS NULL AND a IS NOT NULL AND b IS NOT NULL AND a <> b AS ambiguous FROM p""")
_text_query("f_merchant_name", NAMES, lambda: {"name": N.merchant_name(F.col("raw"))}, """
  , w AS (SELECT id, string_split(trim(regexp_replace(upper(raw), '[^A-Z0-9]+', ' ', 'g')), ' ') AS words FROM inputs),
  k AS (SELECT id, words, list_filter(words, lambda x: x NOT IN ('PRIVATE', 'LIMITED', 'PVT', 'LTD')) AS kept FROM w)
  SELECT id, regexp_replace(array_to_string(CASE WHEN len(kept) > 0 THEN kept ELSE words END, ''), '^(.+?)(PRIVATE|LIMITED|PVT|LTD)+$', '\\1') AS name FROM k""")


def f_normalize_narration(spark, sf_dir):
    return Lens(spark, sf_dir)["bank"].select("bank_txn_id", N.narration(F.col("narration")).alias("words"), N.utr(F.col("narration")).alias("joined"))


def f_utr_candidates(spark, sf_dir):
    return Lens(spark, sf_dir)["bank"].select("bank_txn_id", N.utr_candidates(F.col("narration")).alias("tokens"))


def f_profile(spark, sf_dir):
    return Lens(spark, sf_dir)["ledger"].select("order_id", N.profile_of(F.col("customer_id")).alias("profile")).distinct()


QUERIES |= {"f_normalize_narration": f_normalize_narration, "f_utr_candidates": f_utr_candidates, "f_profile": f_profile}
ORACLES |= {
    "f_normalize_narration": oracle("SELECT bank_txn_id, trim(regexp_replace(upper(narration), '[^A-Z0-9]+', ' ', 'g')) AS words, regexp_replace(upper(narration), '[^A-Z0-9]+', '', 'g') AS joined FROM bank"),
    "f_utr_candidates": oracle("""SELECT bank_txn_id, list_transform(list_sort(list_transform(list_distinct(list_filter(string_split(trim(regexp_replace(upper(narration), '[^A-Z0-9]+', ' ', 'g')), ' '), lambda t: len(t) BETWEEN 6 AND 16)),
      lambda t: {'n': -len(t), 't': t})), lambda s: s.t) AS tokens FROM bank"""),
    "f_profile": oracle("SELECT DISTINCT order_id, lower(regexp_extract(customer_id, '^CUST-(PROFILE_[A-Z])-', 1)) AS profile FROM ledger"),
}
