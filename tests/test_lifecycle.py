from datetime import date
from decimal import Decimal as D
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import hypotheses as H
from ledgerloom.operators import hypothesis_loop as A
from ledgerloom.operators import journal as J
from ledgerloom.plans import lifecycle_queries as Q
from ledgerloom.sources import config, settlement_csv


def test_hypotheses(spark):
    asked = spark.createDataFrame([("e1", "h1"), ("e2", "h2"), ("e3", "h3")], "exception_id string, prompt_hash string")
    body = """```json
    {"hypotheses": [{"category": "NONSENSE", "candidate_id": "x", "evidence_row_ids": []},
     {"category": "PARTIAL_CAPTURE", "candidate_id": "p1", "assertion": {"lhs": "payments.authorized", "op": "==", "rhs": "99.50"}, "evidence_row_ids": ["p1"], "reason": "r"}]}
    ```"""
    replies = H.replay(asked, spark.createDataFrame([("h1", body, None), ("h2", None, True)], "prompt_hash string, response string, unavailable boolean"))
    assert {r.exception_id: r.reply for r in replies.collect()} == {"e1": "answered", "e2": "unavailable", "e3": "fixture_miss"}
    claims = H.parse(replies, ("PARTIAL_CAPTURE", "DUPLICATE_CANDIDATE"))
    assert [(r.exception_id, r["rank"]) for r in claims.collect()] == [("e1", 1)]
    index = H.row_index({"payments": (spark.createDataFrame([("p1", D("100.00"))], "payment_id string, authorized decimal(18,2)"), "payment_id")})
    ledger = spark.createDataFrame([("o1", "c", D("5")), ("o2", "c", D("5"))], "order_id string, customer_id string, gross decimal(18,2)")
    chains = spark.createDataFrame([("o1", 2), ("o2", 1)], "order_id string, chain_length long")
    scored = H.confidence(H.verify(claims, index, ledger, chains))
    row = scored.first()
    assert (row.passed, row.computed_residual, row.score, row.auto_confirm) == (True, D("0.50"), D("1.0000"), True)
    answers = replies.select("exception_id", "reply", F.lit(1).alias("attempt"), F.lit(1).alias("seen"))
    assert {r.exception_id: r.outcome for r in A.decide(answers, scored).collect()} == {"e1": "CONFIRMED", "e2": "PENDING_AI_UNAVAILABLE", "e3": "ABSTAINED"}
    orders = H.row_index({"ledger": (ledger, "order_id")})
    for nominee, cited, passed in (("o2", ["o1", "o2"], True), ("o1", ["o1", "o2"], False), ("o2", ["o2"], False), ("o2", ["o1", "o9"], False)):
        claim = spark.createDataFrame([("e", 0, "DUPLICATE_CANDIDATE", nominee, None, cited)], "exception_id string, rank int, category string, candidate_id string, assertion struct<lhs:string,op:string,rhs:string>, evidence_row_ids array<string>")
        assert H.verify(claim, orders, ledger, chains).first().passed == passed


def test_journal_balances(spark):
    rows = spark.createDataFrame([("e1", "ROUNDING_DIFFERENCE", D("0.40")), ("e2", None, D("9.00"))], "exception_id string, category string, amount decimal(18,2)")
    legs = J.journal(rows)
    total = legs.agg(F.sum("debit").alias("d"), F.sum("credit").alias("c")).first()
    assert total.d == total.c == D("9.40") and legs.count() == 4
    key = lambda rows: J.batches(J.documents(rows), "2026-09-01", ("x",)).first()
    assert key(legs) == key(legs.repartition(3))
    for bad in (("e", "UNEXPLAINED", D("1")), ("e", None, D("0"))):
        with pytest.raises(Exception, match="no account|no positive"):
            J.journal(spark.createDataFrame([bad], rows.schema)).collect()


def write(path, name, text):
    (path / name).write_text(text, encoding="utf-8")


def test_csv(spark, tmp_path):
    header = "refund_id,payment_id,amount,created_at\n"
    write(tmp_path, "day1_refunds.csv", header + 'R1,P1,"1,234.50",2026-09-12\n')
    write(tmp_path, "day2_refunds.csv", header)
    write(tmp_path, "day3_refunds.csv", header + "R2,P2,₹5,25/09/2026\n")
    got = settlement_csv.load(spark, str(tmp_path), "refunds", ("2026-09-01", "2026-11-30")).orderBy("refund_id").collect()
    assert [(r.refund_id, r.amount, r.arrival_day) for r in got] == [("R1", D("1234.50"), 1), ("R2", D("5.00"), 3)]
    assert settlement_csv.load(spark, str(tmp_path), "refunds", until_day=2).count() == 1
    assert settlement_csv.days_in(spark, str(tmp_path), "refunds") == [1, 2, 3]
    with pytest.raises(settlement_csv.IngestError, match="outside"):
        settlement_csv.load(spark, str(tmp_path), "refunds", ("2026-09-01", "2026-09-20"))
    write(tmp_path, "day4_refunds.csv", header + "R3,P2,-5,2026-09-12\n")
    with pytest.raises(settlement_csv.IngestError, match=r"day4_refunds.csv: R3,P2,-5,2026-09-12: .*positive"):
        settlement_csv.load(spark, str(tmp_path), "refunds")
    write(tmp_path, "day4_refunds.csv", "refund_id,amount,payment_id,created_at\n")
    with pytest.raises(settlement_csv.IngestError, match="header"):
        settlement_csv.load(spark, str(tmp_path), "refunds")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        settlement_csv.load(spark, str(tmp_path), "bank")


def test_csv_round_trip(spark, tmp_path):
    rows = [("S1", "B1", "payment", "P1", None, D("10.00"), D("0.20"), D("0.04"), D("9.76"), date(2026, 9, 1), 1), ("S2", "B1", "refund", "P1", "R1", D("-10.00"), D("0"), D("0"), D("-10.00"), date(2026, 9, 2), 3)]
    frame = spark.createDataFrame(rows, "settlement_id string, batch_id string, line_type string, payment_id string, refund_id string, gross decimal(18,2), fee decimal(18,2), tax decimal(18,2), net decimal(18,2), settled_event_date date, arrival_day int")
    settlement_csv.write(frame, str(tmp_path), "lines")
    assert sorted(map(tuple, settlement_csv.load(spark, str(tmp_path), "lines").collect())) == sorted(rows)
    assert settlement_csv.days_in(spark, str(tmp_path), "lines") == [1, 3]


def test_config(tmp_path):
    pytest.importorskip("yaml")
    methods = "".join(f'      {m}: "0.01"\n' for m in config.METHODS)
    write(tmp_path, "r.yaml", f'version: v\ngst_rate: "0.18"\nprofiles:\n  profile_a:\n    methods:\n{methods}')
    rates = config.Rates.load(str(tmp_path / "r.yaml"))
    assert rates.rates["profile_a"]["upi"] == D("0.01") and len(config.config_hash(rates)) == 16
    for broken in ("version: v\n", f'version: v\ngst_rate: 0.18\nprofiles:\n  profile_a:\n    methods:\n{methods}', f'version: v\ngst_rate: "0.18"\nextra: "1"\nprofiles:\n  profile_a:\n    methods:\n{methods}'):
        write(tmp_path, "r.yaml", broken)
        with pytest.raises(config.ConfigError):
            config.Rates.load(str(tmp_path / "r.yaml"))


def test_cited_rows_are_looked_up_once(spark):
    ledger = spark.createDataFrame([(f"o{i}", f"c{i // 2}", D("5.00")) for i in range(8)], "order_id string, customer_id string, gross decimal(18,2)")
    payments = spark.createDataFrame([(f"p{i}", f"o{i}", D("5.00")) for i in range(8)], "payment_id string, order_id string, captured decimal(18,2)")
    lines = spark.createDataFrame([(f"s{i}", f"p{i}", D("5.00")) for i in range(0, 8, 2)], "settlement_id string, payment_id string, net decimal(18,2)")
    other = {"refunds": "refund_id", "batches": "batch_id", "bank": "bank_txn_id"}
    e = SimpleNamespace(ledger=ledger, payments=payments, lines=lines, **{t: spark.createDataFrame([], f"{k} string") for t, k in other.items()})
    claims = spark.createDataFrame([("a", 0, "DUPLICATE_CANDIDATE", "o1", None, ["o0", "o1"]), ("b", 0, "DUPLICATE_CANDIDATE", "o2", None, ["o2", "o3"]), ("c", 0, "DUPLICATE_CANDIDATE", "o4", None, ["o4", "gone"]), ("d", 0, "UNEXPLAINED", "p5", None, ["p5"])], "exception_id string, rank int, category string, candidate_id string, assertion struct<lhs:string,op:string,rhs:string>, evidence_row_ids array<string>")
    verify = Q.verifier(e, claims.select(F.explode("evidence_row_ids").alias("row_id")))
    rows = verify(claims)
    assert sorted(map(str, rows.collect())) == sorted(map(str, Q.verified(e, claims).collect()))
    assert {r.exception_id: r.reason_failed for r in rows.collect()} == {"a": None, "b": "chains don't tell them apart", "c": "missing evidence", "d": "no assertion"}
    read = {f.rsplit("/", 2)[1] for f in rows.inputFiles()}
    assert len(read) == 3 and all(name.startswith("stage-") for name in read)  # what was looked up, and none of the tables
