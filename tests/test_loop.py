import json
import re
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import evidence as V
from ledgerloom.operators import hypotheses as H
from ledgerloom.operators import hypothesis_loop as A
from ledgerloom.operators import stage
from ledgerloom.operators import store as S

GOOD = {"category": "UNEXPLAINED", "candidate_id": "c", "assertion": None, "residual_amount": "0.10", "evidence_row_ids": ["b", "a"], "reason": "r"}


def reply(*items):
    return json.dumps({"hypotheses": list(items)})


def test_faults_by_path(spark):
    cases = {
        reply(GOOD): [[]], "{": [["$: not JSON"]], "[]": [["$: not an object"]], '{"hypotheses": 3}': [["$.hypotheses: not an array"]], reply(): [["$.hypotheses: empty"]],
        reply(GOOD | {"category": "X"}, 5, GOOD | {"candidate_id": 7, "reason": None}, GOOD): [["$.hypotheses[0].category"], ["$.hypotheses[1]"], ["$.hypotheses[2].candidate_id", "$.hypotheses[2].reason"]],
        reply(GOOD | {"residual_amount": 1.5}, GOOD | {"residual_amount": True}, GOOD | {"residual_amount": "1,0"}): [[f"$.hypotheses[{k}].residual_amount"] for k in range(3)],
        reply(GOOD | {"residual_amount": 2}, GOOD | {"residual_amount": None}, {k: v for k, v in GOOD.items() if k != "residual_amount"}): [[], [], []],
        reply(GOOD | {"evidence_row_ids": "a"}, GOOD | {"evidence_row_ids": ["a", None]}, GOOD | {"evidence_row_ids": []}): [["$.hypotheses[0].evidence_row_ids"], ["$.hypotheses[1].evidence_row_ids"], []],
    }
    rows = spark.createDataFrame([(str(i), text) for i, text in enumerate(cases)], "exception_id string, response string")
    got = {}
    for r in H.validate(rows, ("UNEXPLAINED",)).orderBy("rank").collect():
        got.setdefault(int(r.exception_id), []).append(r.faults)
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    one = H.parse(rows.where("exception_id = '0'"), ("UNEXPLAINED",)).first()
    assert (one["rank"], one.evidence_row_ids, one.residual_amount, one.assertion) == (0, ["a", "b"], D("0.10"), None)


def test_links(spark):
    texts = ['{"links": [{"bank_txn_id": "k", "batch_id": "b", "confidence": 0.5}, {"bank_txn_id": "k", "batch_id": null}, {"batch_id": "b"}, {"bank_txn_id": "k", "batch_id": "", "confidence": "x"}]}', '```json\n[{"bank_txn_id": "k", "batch_id": "null"}]\n```', "no", "[]"]
    rows = H.parse_links(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, response string")).collect()
    assert sorted([(r.n, r.bank_txn_id, r.batch_id, r.failed) for r in rows], key=str) == sorted([(0, "k", "b", False), (0, "k", None, False), (0, None, None, True), (0, None, None, True), (1, "k", None, False), (2, None, None, True)], key=str)


def responses(spark, rows):
    return spark.createDataFrame(rows, "prompt_hash string, attempt int, response string, unavailable boolean")


def test_attempts(spark):
    asked = spark.createDataFrame([(c, "h" + c) for c in "abcdef"], "exception_id string, prompt_hash string")
    rows = [("ha", 1, "{", None), ("ha", 2, reply(GOOD), False), ("hb", 1, reply(), None), ("hb", 2, None, True), ("hc", 1, "{", None), ("hc", 2, "{", None), ("hc", 3, "{", None), ("hd", 1, "{", None), ("hf", 1, reply(GOOD, GOOD), None), ("hf", 2, None, True)]
    answers, usable = A.attempts(asked, responses(spark, rows), ("UNEXPLAINED",))
    got = {r.exception_id: (r.reply, r.attempt, r.seen) for r in answers.collect()}
    assert got == {"a": ("answered", 2, 1), "b": ("unavailable", 2, 0), "c": ("no_hypothesis", 3, 0), "d": ("fixture_miss", 2, 0), "e": ("fixture_miss", 1, 0), "f": ("answered", 1, 2)}
    assert sorted(r.exception_id for r in usable.collect()) == ["a", "f", "f"]


def test_rounds(spark, tmp_path):
    store = S.Store(spark, str(tmp_path))
    ids = "abcdg"
    opened = spark.createDataFrame([(c, "A", c, "OPEN", "UNEXPLAINED", D("5"), [], "r") for c in ids], "exception_id string, population string, subject_id string, status string, category string, amount decimal(18,2), evidence array<string>, reason string")
    S.close_day(store, 1, opened)
    asked = spark.createDataFrame([(c, "h" + c) for c in ids], "exception_id string, prompt_hash string")
    down = lambda c: ("h" + c, 1, None, True)
    told = {1: [("ha", 1, reply(GOOD | {"candidate_id": "no"}, GOOD), None), down("b"), down("c"), ("hd", 1, reply(GOOD | {"candidate_id": "no"}), None), ("hg", 1, reply(GOOD | {"candidate_id": "low"}), None)], 2: [("hb", 1, reply(GOOD), None), down("c")]}

    def verify(claims):
        passed = F.col("candidate_id") != "no"
        return claims.withColumn("passed", passed).withColumn("score", F.when(F.col("candidate_id") == "low", F.lit("0.5")).otherwise(F.lit("0.9")).cast("decimal(5,4)")).withColumn("auto_confirm", passed & (F.col("score") > 0.8))

    outcomes = A.run(store, 2, asked, lambda n: responses(spark, told.get(n, [down("c")])), verify)
    got = sorted((r.round, r.exception_id, r.outcome, r.abstain_reason, r.rejected) for r in outcomes.collect())
    wait = "PENDING_AI_UNAVAILABLE"
    assert got == [(1, "a", "CONFIRMED", None, 1), (1, "b", wait, None, 0), (1, "c", wait, None, 0), (1, "d", "ABSTAINED", "all_rejected", 1), (1, "g", "ABSTAINED", "below_threshold", 0), (2, "b", "CONFIRMED", None, 0), (2, "c", wait, None, 0), (3, "c", wait, None, 0)]
    table = {r.round: (r.sent, r.confirmed, r.abstained, r.unavailable, r.below_threshold, r.abstention_rate) for r in A.report(outcomes).collect()}
    assert table == {1: (5, 1, 2, 2, 1, "0.6667"), 2: (2, 1, 0, 1, 0, "0.0000"), 3: (1, 0, 0, 1, 0, "n/a")}
    assert {r.exception_id: (r.status, r.confidence) for r in store.read("exceptions").collect()} == {"a": ("CONFIRMED", D("0.9")), "b": ("CONFIRMED", D("0.9")), "c": (wait, D("0")), "d": ("ABSTAINED", D("0")), "g": ("ABSTAINED", D("0"))}
    of_b = [(r.from_status, r.to_status) for r in store.read("audit").where("exception_id = 'b'").orderBy("arrival_day", "sequence").collect()]
    assert of_b == [(None, "OPEN"), ("OPEN", wait), (wait, "OPEN"), ("OPEN", "CONFIRMED")]
    with pytest.raises(Exception, match="add up"):
        A.report(outcomes.withColumn("outcome", F.lit("OTHER"))).collect()


def test_trail(spark):
    utr = "ABCDEFGH12345678"
    rows = V.Rows(
        spark.createDataFrame([("o1", "c", D("5")), ("o1", "c", D("5")), ("o2", "c", D("5"))], "order_id string, customer_id string, gross decimal(18,2)"),
        spark.createDataFrame([("p1", "o1", D("5"), D("5"), "captured"), ("p2", "o1", D("5"), D("5"), "failed")], "payment_id string, order_id string, authorized decimal(18,2), captured decimal(18,2), status string"),
        spark.createDataFrame([("r1", "p2", D("1"), "2026-09-01")], "refund_id string, payment_id string, amount decimal(18,2), created_at string"),
        spark.createDataFrame([("s1", "p1", "b1", None, "payment", D("5")), ("s2", "p1", "b1", None, "payment", D("5")), ("s3", "p9", None, None, "payment", D("5"))], "settlement_id string, payment_id string, batch_id string, refund_id string, line_type string, gross decimal(18,2)").selectExpr("*", "gross AS fee", "gross AS tax", "gross AS net"),
        spark.createDataFrame([("b1", utr, D("9"), "2026-09-02")], "batch_id string, utr string, net_total decimal(18,2), settled_event_date string"),
        spark.createDataFrame([("k1", "2026-09-03", D("9"), f"NEFT/{utr}/X"), ("k2", "2026-09-03", D("9"), "NEFT")], "bank_txn_id string, value_date string, amount decimal(18,2), narration string"),
    )
    cited = spark.createDataFrame([("e1", ["o1", "o2"]), ("e2", ["b1"]), ("e3", ["nothing"]), ("e4", ["k2", "b1", "s1"]), ("e5", [])], "exception_id string, cited array<string>")
    got = sorted((r.exception_id, r.hop, r.row_id) for r in V.trail(cited, rows).collect())
    assert got == [
        ("e1", 0, "o1"), ("e1", 0, "o2"), ("e1", 1, "p1"), ("e1", 1, "p2"), ("e1", 2, "r1"), ("e1", 2, "s1"), ("e1", 2, "s2"), ("e1", 3, "b1"), ("e1", 4, "k1"),
        ("e2", 0, "b1"), ("e2", 1, "k1"), ("e4", 0, "b1"), ("e4", 0, "k2"), ("e4", 0, "s1"), ("e4", 1, "k1"),
    ]
    index = {(r.id, r.row_id) for r in V.inverted_index(rows).collect()}
    assert {("b1", "s1"), ("b1", "s2"), ("b1", "b1"), ("b1", "k1"), ("p1", "s1"), ("p1", "p1"), ("o1", "p2"), ("p2", "r1"), ("k2", "k2")} <= index
    opened = spark.createDataFrame([("e1", "s", "DUPLICATE_CANDIDATE", "OPEN", ["b1"]), ("e2", "t", None, "OPEN", ["b1"]), ("e3", "nothing", "X", "OPEN", [])], "exception_id string, subject_id string, category string, status string, evidence array<string>")
    orders = spark.createDataFrame([("s", "o1")], "subject_id string, order_id string")
    shown = V.cited(opened, orders, spark.createDataFrame([(["o1", "o2"],)], "order_ids array<string>"))
    assert {r.exception_id: r.cited for r in shown.collect()} == {"e1": ["o1", "o2"], "e2": ["b1"], "e3": ["nothing"]}


def test_index_tasks_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(stage, "ROWS_A_TASK", 5)
    frame = lambda cols, *rows: spark.createDataFrame(list(rows), ", ".join(f"{c} string" for c in cols.split()))
    rows = V.Rows(
        frame("order_id customer_id gross", *[("o1", "c", "5")] * 3, ("o1", "d", "5")), frame("payment_id order_id authorized captured status", *[(f"p{i}", "o1", "5", "5", "x") for i in range(20)]), frame("refund_id payment_id amount created_at"),
        frame("settlement_id payment_id batch_id line_type gross fee tax net"), frame("batch_id utr net_total settled_event_date"), frame("bank_txn_id value_date amount narration"),
    )
    index = V.inverted_index(rows)
    got = sorted((r.id, r.stage, r.row_id) for r in index.collect())
    assert got == sorted([("o1", "ledger", "o1"), *[(i, "payment", f"p{k}") for k in range(20) for i in ("o1", f"p{k}")]])
    plan = index._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"RepartitionByExpression \[id#\d+\], 10\b", plan)  # 2 * 24 rows, 5 in a task
    assert plan.count("Aggregate [") == 3  # equal rows are told apart once they are dealt; two are of the words in narrations, for either id of a bank row
