import hashlib
import xml.etree.ElementTree as ET
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import annotations as N
from ledgerloom.operators import cases as C
from ledgerloom.operators import digest, strata
from ledgerloom.operators import journal as J


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_digest_is_that_of_the_order(spark, monkeypatch):
    monkeypatch.setattr(digest, "ARITY", 3)
    rows = spark.range(20).select((F.col("id") * 7 % 20).alias("k"))
    level = [sha(f"row {k}") for k in range(20)]
    while len(level) > 1:
        level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    for parts in (1, 5):
        got = digest.tree(rows.repartition(parts), ["k"], F.concat(F.lit("row "), F.col("k").cast("string"))).collect()
        assert list(map(tuple, got)) == [(20, level[0])]
    one = digest.tree(rows.where("k = 4"), ["k"], F.lit("x")).first()
    assert (one.rows, one.digest) == (1, sha("x")) and tuple(digest.tree(rows.limit(0), ["k"], F.lit("x")).first()) == (0, sha(""))


def test_digests_at_a_fixed_height(spark, monkeypatch):
    """Two levels for any number of rows: the groups that a third would join stay apart, and one row is digested twice more."""
    monkeypatch.setattr(digest, "ARITY", 3)
    text = F.concat(F.lit("row "), F.col("k").cast("string"))
    for n in (0, 1, 3, 9, 10, 20, 28):
        level = [sha(f"row {k}") for k in range(n)]
        for _ in range(2):
            level = [sha("".join(level[i : i + 3])) for i in range(0, n and len(level), 3)]
        rows = spark.range(n).select(((F.col("id") * 11 + 5) % n).alias("k") if n else F.col("id").alias("k"))
        assert sorted(map(tuple, digest.levels(rows, ["k"], text, 2).collect())) == sorted((n, x) for x in level)


def test_documents(spark):
    rows = spark.createDataFrame([(f"e{i}", "ROUNDING_DIFFERENCE", D(i % 3 + 1)) for i in range(7)], "exception_id string, category string, amount decimal(18,2)")
    placed = J.documents(J.journal(rows), size=3)
    order = ["e2", "e5", "e1", "e4", "e0", "e3", "e6"]
    assert [(r.exception_id, r.document, r.line) for r in placed.orderBy("document", "line").collect()] == [(x, i // 3, i % 3) for i, x in enumerate(order)]
    made = J.batches(placed, "2026-09-01", ("a", "b")).orderBy("document").collect()
    assert [r.vouchers for r in made] == [3, 3, 1] and made[0].total == D("8.00")
    assert made[0].idempotency_key == sha("tally-batch-v1|2026-09-01|a|b|e1|e2|e5") and made[0].filename == f"tally-2026-09-01-{made[0].idempotency_key[:16]}.xml"
    notes = J.to_close(placed, J.batches(placed, "2026-09-01", ("a", "b"))).where("exception_id = 'e6'").first()
    assert notes.note.startswith("exported in batch ") and made[2].filename in notes.note


def test_xml_is_escaped_and_checked(spark):
    odd = "A<b> & \"c\" 'd'\t\n\x07é"
    legs = spark.createDataFrame([(odd, "debit", odd, D("5"), D("0")), (odd, "credit", "B", D("0"), D("5"))], "exception_id string, leg string, account string, debit decimal(18,2), credit decimal(18,2)")
    text = J.as_xml(legs, "2026-09-01").first().voucher
    root = ET.fromstring(text)
    assert root.attrib["id"] == odd.replace("\x07", "?") == root[0].attrib["ledger"] and [x.attrib["debit"] for x in root] == ["5.00", "0.00"]
    plain = legs.withColumn("exception_id", F.lit("e1"))
    got = J.checked(J.as_xml(plain, "2026-09-01")).first()
    assert (got.exception_id, got.legs, got.amount) == ("e1", 2, D("5.00"))
    for bad in (plain.where("leg = 'debit'"), plain.withColumn("debit", F.col("debit") * 2), plain.withColumn("account", F.lit(""))):
        with pytest.raises(Exception, match="no valid voucher"):
            J.checked(J.as_xml(bad.withColumn("debit", F.col("debit").cast("decimal(18,2)")), "2026-09-01")).collect()
    with pytest.raises(Exception, match="no valid voucher"):
        J.checked(spark.createDataFrame([("e1", "<VOUCHER")], "exception_id string, voucher string")).collect()


def test_components(spark):
    parts = lambda *xs: [(c, D(a)) for c, a in xs]
    rows = [
        (D("5"), parts(("PARTIAL_CAPTURE", "3"), ("ROUNDING_DIFFERENCE", "-1")), D("3"), "PARTIAL_CAPTURE"), (D("0"), parts(("PARTIAL_CAPTURE", "1"), ("ROUNDING_DIFFERENCE", "-1")), D("0"), "ROUNDING_DIFFERENCE"),
        (D("2"), parts(("T_PLUS_N_TIMING", "0"), ("DUPLICATE_CANDIDATE", "0")), D("2"), "T_PLUS_N_TIMING"), (D("0"), parts(("Z", "0"), ("Y", "0")), D("0"), "Y"), (D("0"), [], D("0"), None),
    ]
    frame = spark.createDataFrame([(i, t, p) for i, (t, p, *_) in enumerate(rows)], f"i int, total decimal(18,2), components {C.COMPONENT}")
    got = C.balanced(frame.withColumn("headline", C.headline(F.col("components")))).orderBy("i").collect()
    assert [(r.unexplained, r.headline) for r in got] == [x[2:] for x in rows]
    with pytest.raises(Exception, match="sum of its parts"):
        C.balanced(frame.withColumn("total", F.lit(None).cast("decimal(18,2)"))).collect()


def test_strata(spark):
    rows = spark.range(100).select(F.when(F.col("id") < 98, "a").otherwise("b").alias("s"), F.col("id").alias("k"))
    assert sorted((r.s, r.k) for r in strata.first_n(rows, ["s"], ["k"], 3).collect()) == [("a", 0), ("a", 1), ("a", 2), ("b", 98), ("b", 99)]
    shown = sorted((r.k, r.shown) for r in strata.top_with_variety(rows, "s", [F.col("k")], 2).collect())
    assert shown == [(0, "among the first"), (1, "among the first"), (98, "first of its category")]
    decisions = spark.createDataFrame(
        [("x", "r", "r", ["r", "o"], ["r"], True, True), ("x", "o", "o", ["r", "o"], ["r"], True, False), ("x", "z", "r", ["r", "o"], ["r"], False, False), ("y", None, None, ["r"], ["r"], False, True)],
        "stratum string, nominated string, offered string, evidence_row_ids array<string>, truth array<string>, confirmed boolean, oracle_confirmed boolean",
    )
    assert sorted(map(tuple, strata.scores(decisions).collect())) == [("x", 3, 3, 2, 1, 2, 2, 1, 1), ("y", 1, 0, 0, 0, 0, 0, 1, 0)]


def test_annotations(spark):
    rows = [("case", "1", "b", "PARTIAL_CAPTURE", D("5"), True), ("case", "1", "a", "UNEXPLAINED", D("1"), False), ("case", "1", "a", None, D("0"), True), ("case", "2", "n", None, D("0"), True), ("case", "3", "z", "PARTIAL_CAPTURE", D("1"), True), ("case", "3", "y", "PARTIAL_CAPTURE", D("1"), True)]
    frame = spark.createDataFrame(rows, "target_kind string, target_id string, noise_type string, category string, amount decimal(18,2), resolvable boolean")
    got = {r.target_id: (r.category, r.noise_type, r.noise_types, r.amount, r.resolvable) for r in N.roll_up(frame).collect()}
    assert got == {"1": ("UNEXPLAINED", "a", ["a", "b"], D("6"), False), "2": (None, "n", ["n"], D("0"), True), "3": ("PARTIAL_CAPTURE", "y", ["y", "z"], D("2"), True)}
    ids = lambda *x: spark.createDataFrame(list(x), "kind string, id string")
    found = N.account(ids(("a", "1"), ("a", "2"), ("b", "9")), ids(("a", "2"), ("a", "3"), ("a", "3"), ("c", "5")))
    assert sorted(map(tuple, found.collect())) == [("a", 2, 2, 1, 1), ("b", 0, 1, 0, 1), ("c", 1, 0, 1, 0)]


def test_working_days_are_not_taken_back(spark):
    from ledgerloom.operators import calendar

    days = calendar.calendar(spark, "2026-09-01", "2026-09-30", ["2026-09-07"])
    rows = spark.createDataFrame([("2026-09-05", 0), ("2026-09-05", 2), ("2026-09-30", 5), ("2026-09-01", None)], "d string, n int").withColumn("d", F.col("d").cast("date"))
    got = [str(r.due) for r in calendar.add_working_days(rows, days, "d", F.col("n"), "due").orderBy("d", "n").collect()]
    assert got == ["None", "2026-09-08", "2026-09-10", "None"]
    with pytest.raises(Exception, match="negative"):
        calendar.add_working_days(rows.withColumn("n", F.lit(-1)), days, "d", F.col("n"), "due").collect()
    numbers = spark.createDataFrame([(1,), (30,)], "n int").select(calendar.day_as_of("2026-09-01", "2026-09-30", F.col("n")).alias("d"))
    assert [str(r.d) for r in numbers.orderBy("d").collect()] == ["2026-09-01", "2026-09-30"]
    for bad in (0, 31):
        with pytest.raises(Exception, match="no date for day"):
            spark.range(1).select(calendar.day_as_of("2026-09-01", "2026-09-30", F.lit(bad))).collect()
    assert spark.range(1).select(calendar.has_arrived(F.lit("2026-09-01").cast("date"), F.lit("2026-09-01").cast("date"))).first()[0]


def test_labels_and_figures(spark, tmp_path):
    from ledgerloom.operators import metrics as M
    from ledgerloom.sources import truth as T

    (tmp_path / "truth.json").write_text(
        """{"cases": [{"case_id": "c1", "payment_id": "p1", "true_category": null, "true_variance_amount": "0.00", "resolvable_in_principle": true}, {"case_id": "c2", "payment_id": "p2", "true_category": "X", "true_variance_amount": "5.00", "resolvable_in_principle": false}],
        "batch_links": [{"batch_id": "b1", "bank_txn_id": "k1", "true_category": null, "true_variance_amount": "0.00", "resolvable_in_principle": true}, {"batch_id": "b2", "bank_txn_id": null, "true_category": "Y", "true_variance_amount": "1.00", "resolvable_in_principle": true}],
        "row_variances": [{"row_id": "o1", "row_kind": "ledger_row", "true_category": "DUPLICATE_CONFIRMED", "true_variance_amount": "1.00"}, {"row_id": "k9", "row_kind": "bank_row", "true_category": "UNEXPLAINED", "true_variance_amount": "1.00"}]}"""
    )
    truth = T.read(spark, str(tmp_path / "truth.json"))
    assert sorted(r.true_variance_amount for r in truth["cases"].collect()) == [D("0.00"), D("5.00")]
    cases = spark.createDataFrame([("c1", "CONFIRMED", None), ("c2", "CONFIRMED", None), ("c3", "OPEN", "X")], "case_id string, status string, category string")
    got = T.score_cases(cases, truth["cases"]).first()
    assert (got.cases, got.confirmed, got.false_matches, got.match_rate, got.false_match_rate) == (3, 2, 1, D("0.666667"), D("0.500000"))
    links = spark.createDataFrame([("b1", "CONFIRMED", "k1"), ("b2", "CONFIRMED", "k5")], "batch_id string, status string, bank_row_id string")
    assert tuple(T.score_links(links, truth["batch_links"]).first())[:3] == (2, 2, 1)
    rows = spark.createDataFrame([("o1", "ledger_rows", "DUPLICATE_CONFIRMED"), ("k8", "bank_rows", "UNEXPLAINED")], "row_id string, source_table string, category string")
    assert tuple(T.score_rows(rows, truth["row_variances"]).first()) == (2, 2, 1, D("0.500000"), D("0.500000"))
    assert T.score_cases(cases.limit(0), truth["cases"]).first().match_rate is None
    timings = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 5.0), ("a", 3, 2.0), ("b", 1, 4.0)], "stage string, repetition int, seconds double")
    assert sorted(map(tuple, M.by_stage(timings).collect())) == [("a", 2.0, 3), ("b", 4.0, 1)]
    figures = M.over_seeds(spark.createDataFrame([(1, 0), (2, 4)], "seed int, n int"), "n").first()
    assert (figures.total, figures["mean"], figures.seeds_with_any) == (4, 2.0, 1)
