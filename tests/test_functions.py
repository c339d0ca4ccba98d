from datetime import date, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import normalize as N
from ledgerloom.operators import calendar as C


def column(spark, values, make):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").select("i", make(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows)]


def test_amounts(spark):
    good = {"1234.00": "1234.00", "1,234.00": "1234.00", "1234.0": "1234.00", "1234": "1234.00", " 1234.00 ": "1234.00", "₹1,234.00": "1234.00", "(1,234.00)": "-1234.00", "(0.00)": "0.00", "1,23,456.00": "123456.00", "1234.567": "1234.57", "-5.005": "-5.01", "\t7\n": "7.00"}
    assert column(spark, good, N.parse_amount) == [D(x) for x in good.values()]
    bad = ["", "  ", "abc", "1.2.3", "12 34.00", "(1234.00", "1234.00)", "1234-", "NULL", "-", ".50", "1234.", "(-5.00)", None]
    assert column(spark, bad, N.parse_amount) == [None] * len(bad)


def test_dates(spark):
    values = ["2026-03-25", "2026/03/25", "25/03/2026", "03/25/2026", "05-05-2026", "03/04/2026", "31/02/2026", "25 Mar 2026", "1/2-2026", None]
    got = column(spark, values, N.parse_date)
    d = date(2026, 3, 25)
    assert [r.value for r in got] == [d, d, d, d, date(2026, 5, 5), None, None, None, None, None]
    assert [r.ambiguous for r in got] == [False] * 5 + [True] + [False] * 4
    assert column(spark, ["03/04/2026", "25/03/2026"], lambda x: N.parse_date(x, day_first=False)["value"]) == [date(2026, 3, 4), None]


def test_names_and_references(spark):
    names = {"CARBON WORKS PVT LTD": "CARBONWORKS", "Carbon Works Private Limited": "CARBONWORKS", "CARBON WORKS": "CARBONWORKS", "CARBONWORKSPVTLTD": "CARBONWORKS", "AURORA RETAIL PVT": "AURORARETAIL", "PVT LTD": "PVT"}
    assert column(spark, names, N.merchant_name) == list(names.values())
    assert column(spark, ["NEFT/3D05D31C183F6613/SETTLEMENT"], N.narration) == ["NEFT 3D05D31C183F6613 SETTLEMENT"]
    assert column(spark, ["neft ABCDEF1 x ABCDEF1 SETTLEMENT ABCDEFG", ""], N.utr_candidates) == [["SETTLEMENT", "ABCDEF1", "ABCDEFG"], []]
    assert column(spark, ["CUST-PROFILE_B-1", "nobody"], N.profile_of) == ["profile_b", None]
    assert column(spark, ["ABCX", "ABCD", "X", ""], lambda x: N.common_prefix(x, F.lit("ABCDE"))) == [3, 4, 0, 0]


def test_rounding(spark):
    row = spark.range(1).select(N.money(F.lit("0.125").cast("decimal(9,3)")).alias("m"), N.rate(F.lit(1), F.lit(128)).alias("r"), N.rate(F.lit(1), F.lit(0)).alias("none")).first()
    assert (row.m, row.r, row.none) == (D("0.13"), D("0.007812"), None)


HOLIDAYS = ("2026-09-07", "2026-09-17", "2026-10-02", "2026-10-20", "2026-11-02", "2026-11-11", "2026-11-19", "2026-11-26")


@pytest.fixture(scope="module")
def days(spark):
    return C.calendar(spark, "2026-08-01", "2026-12-31", HOLIDAYS).cache()


def working(d):
    return d.weekday() < 5 and str(d) not in HOLIDAYS


def test_adding_working_days(spark, days):
    starts = [date(2026, 9, 1) + timedelta(i) for i in range(80)]
    rows = spark.createDataFrame([(s, n) for s in starts for n in range(4)], "s date, n long")
    for r in C.add_working_days(rows, days, "s", F.col("n"), "due").collect():
        d = r.s
        while not working(d):
            d += timedelta(1)
        for _ in range(r.n):
            d += timedelta(1)
            while not working(d):
                d += timedelta(1)
        assert r.due == d
    assert C.add_working_days(rows.where("s = '2026-10-30' AND n = 2"), days, "s", 2, "due").first().due == date(2026, 11, 4)


def test_days_between_are_asymmetric(spark, days):
    some = [date(2026, 10, 26) + timedelta(i) for i in range(12)]
    rows = spark.createDataFrame([(a, b) for a in some for b in some], "a date, b date")
    for r in C.working_days_between(rows, days, "a", "b", "n").collect():
        late = sum(working(r.a + timedelta(i)) for i in range(1, (r.b - r.a).days + 1))
        early = sum(working(r.b + timedelta(i)) for i in range((r.a - r.b).days))
        assert r.n == (late if r.b >= r.a else -early)


def test_rows_of_many_texts_are_compiled(spark):
    """What a row of amounts and dates is parsed by stays below the size from which the JVM no longer compiles a method."""
    amounts = ["12.50", "-0.00", "9999999999999999.99", "1,234.5", "(7.25)", "₹ 3.10", "5", "", "12.50\n", None]
    dates = ["2001-02-28", "2001-02-30", "0000-01-01", " 2001-02-28", "2001-02-28\n", "28/02/2001", "02-03-2001", "x", None]
    rows = spark.createDataFrame([(a, d) for a in amounts for d in dates], "a string, d string")
    got = rows.select("a", "d", *[N.parse_amount(F.concat("a", F.lit(""))).alias(f"a{i}") for i in range(4)], *[N.parse_date(F.concat("d", F.lit("")))["value"].cast("string").alias(f"d{i}") for i in range(2)])
    codes = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(got._jdf.queryExecution().executedPlan())
    assert codes.size() == 1 and 0 < codes.apply(0)._3().maxMethodCodeSize() < 8000
    plain = rows.select("a", "d", N._parse_amount(F.col("a")).alias("pa"), N._parse_date(F.col("d"), None)["value"].cast("string").alias("pd")).collect()
    assert [(r.a0, r.a3, r.d0, r.d1) for r in got.collect()] == [(r.pa, r.pa, r.pd, r.pd) for r in plain]
