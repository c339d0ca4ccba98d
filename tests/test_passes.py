import random
from datetime import date, timedelta
from decimal import ROUND_HALF_EVEN
from decimal import Decimal as D
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import batch_link as B
from ledgerloom.operators import duplicates, stage
from ledgerloom.plans import case_queries
from ledgerloom.plans.engine import Engine, over_lens

SMALL = "/root/testdata/sf0.001"


def loop_claims(pairs):
    taken, links = set(), {}
    for batch in sorted({b for b, _ in pairs}):
        free = sorted(c for b, c in pairs if b == batch and c not in taken)
        if free:
            links[batch] = free[0]
            taken.add(free[0])
    return links


@pytest.mark.parametrize("seed", range(3))
def test_claims_are_greedy(spark, seed):
    rng = random.Random(seed)
    pairs = {(f"B{rng.randrange(12):02}", f"C{rng.randrange(14):02}") for _ in range(30)}
    got = B.claim(spark.createDataFrame(sorted(pairs), "batch_id string, bank_txn_id string")).collect()
    assert {r.batch_id: r.bank_txn_id for r in got} == loop_claims(pairs) and len(got) == len(loop_claims(pairs))


def test_contested_claims_stay_apart(spark):
    """Batches that lose a credit go on to the next one, and no task gathers all of them in one row."""
    pairs = [(f"B{g}{i}", f"C{g}{j}") for g in range(10, 60) for i, wants in enumerate([(3, 1), (1, 2), (2, 3), (3, 4)]) for j in wants]
    got = B.claim(spark.createDataFrame(pairs, "batch_id string, bank_txn_id string"))
    assert {r.batch_id: r.bank_txn_id for r in got.collect()} == loop_claims(pairs)
    assert "collect_list" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("folded", [1, 3, 256])
def test_claims_in_folds(spark, monkeypatch, folded):
    monkeypatch.setattr(B, "FOLDED", folded)
    rng = random.Random(folded)
    pairs = {(f"B{rng.randrange(9):02}", f"C{rng.randrange(8):02}") for _ in range(25)} | {(f"D{i}", f"E{j}") for i in range(7) for j in range(5)} | {(f"X{i:02}", f"Y{i + k:02}") for i in range(12) for k in (0, 1)}
    got = B.claim(spark.createDataFrame(sorted(pairs), "batch_id string, bank_txn_id string")).collect()
    assert {r.batch_id: r.bank_txn_id for r in got} == loop_claims(pairs) and len(got) == len(loop_claims(pairs))


def test_steps_do_not_grow_with_contention(spark, monkeypatch):
    steps = []
    monkeypatch.setattr(B, "kept", lambda frame, f=B.kept: steps.append(1) or f(frame))
    counts = []
    for n in (4, 25, 60):
        steps.clear()
        pairs = [(f"B{i:02}", f"C{j:02}") for i in range(n) for j in range(n)]
        got = B.claim(spark.createDataFrame(pairs, "batch_id string, bank_txn_id string")).collect()
        assert {r.batch_id: r.bank_txn_id for r in got} == {f"B{i:02}": f"C{i:02}" for i in range(n)}
        counts.append(len(steps))
    assert len(set(counts)) == 1


def test_preferences_decide(spark):
    pairs = [("B1", "C1", 2), ("B1", "C2", 1), ("B2", "C2", 0), ("B2", "C1", 5), ("B3", "C1", 0)]
    got = B.claim(spark.createDataFrame(pairs, "batch_id string, bank_txn_id string, gap int"), "gap").collect()
    assert {r.batch_id: r.bank_txn_id for r in got} == {"B1": "C2", "B2": "C1"}


def test_duplicates(spark):
    row = lambda o, c="c1", g="10.00", i="i": (o, i, D(g), date(2026, 9, 1), c, "s")
    ledger = spark.createDataFrame([row("o1"), row("o1"), row("o1"), row("o2"), row("o3"), row("o4", "c2"), row("o5", g="11.00")], "order_id string, invoice_no string, gross decimal(18,2), order_date date, customer_id string, sku string")
    assert [(r.order_id, r.copy) for r in duplicates.confirmed(ledger).orderBy("copy").collect()] == [("o1", 1), ("o1", 2)]
    assert [r.order_ids for r in duplicates.candidates(ledger).collect()] == [["o2", "o3"]]  # o1 is confirmed, so it is no candidate


def test_orders_are_listed_only_where_two_are_alike(spark):
    rows = [("o1", "i", D("1.00"), "d", "c", "s"), ("o1", "i", D("1.00"), "d", "c", "t"), ("o2", "i", D("1.00"), "d", "c", "s"), ("o3", "i", D("2.00"), "d", "c", "s"), ("o3", "j", D("2.00"), "d", "c", "s"), (None, "i", D("3.00"), "d", None, "s"), ("o4", "i", D("3.00"), "d", None, "s"), ("o5", "i", D("3.00"), "d", None, "s"), ("o6", "i", D("1.00"), "d", "c", "s"), ("o6", "i", D("1.00"), "d", "c", "s")]
    found = duplicates.candidates(spark.createDataFrame(rows, "order_id string, invoice_no string, gross decimal(18,2), order_date string, customer_id string, sku string"))
    assert sorted(r.order_ids for r in found.collect()) == [["o1", "o2"], ["o4", "o5"]]  # o3 is one order of two rows, o6 is confirmed
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_set(") == 1 and ">= 2)" in plan[plan.index("collect_set(") :].split("Window", 1)[0]


def fuzzy(spark, batches, credits):
    """Links and verdicts; verdicts are (outcome, best, runner-up)."""
    day = lambda n: date(2026, 9, 1) + timedelta(n)
    open_ = spark.createDataFrame([(b, u, D(a), day(d)) for b, u, a, d in batches], "batch_id string, utr string, net_total decimal(18,2), due date")
    free = B.credits_of(spark.createDataFrame([(c, day(d), D(a), n, "credit") for c, n, a, d in credits], "bank_txn_id string, value_date date, amount decimal(18,2), narration string, direction string"))
    found = B.fuzzy_links(open_, free)
    verdicts = {r.bank_txn_id: (r.outcome, r.best_score, r.runner_up_score) for r in B.verdicts(open_, free, found).collect()}
    return {r.bank_txn_id: r.batch_id for r in found.collect()}, verdicts


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def loop_fuzzy(batches, credits):
    """The rule, credit by credit."""
    same = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    six = lambda x: x.quantize(D("0.000001"), ROUND_HALF_EVEN)
    left, links, verdicts = {b[0]: b for b in batches}, {}, {}
    for c, words, amount, day in sorted(credits):
        if not left:
            break
        fragment, most = None, 5
        for t in sorted({w for w in words.split() if 6 <= len(w) <= 16}, key=lambda t: (-len(t), t)):
            k = max(same(t, u) for _, u, *_ in left.values())
            if k > most:
                fragment, most = t, k
        scored = []
        for b, utr, total, due in left.values():
            gap, agrees = abs(day - due), int(abs(D(amount) - D(total)) <= 1)
            if gap > 3:
                score = D(0)
            elif fragment:
                n = len(fragment)
                score = six(D("0.5") * same(fragment, utr) / n + D("0.3") * (1 - D(edits(fragment, utr[:n])) / n) + D("0.2") * agrees)
            else:
                score = six(D("0.6") * agrees + D("0.4") * six(D(3 - gap) / 3))
            scored.append((-score, b))
        scored.sort()
        best, second = -scored[0][0], -scored[1][0] if len(scored) > 1 else None
        clear = best >= (D("0.85") if fragment else D("0.90")) and best - (second or 0) >= D("0.15")
        outcome = "ABSTAINED" if best <= 0 or best == second else "ACCEPTED" if clear else "AMBIGUOUS"
        verdicts[c] = (outcome, best, second)
        if outcome == "ACCEPTED":
            links[c] = scored[0][1]
            del left[scored[0][1]]
    return links, verdicts


def test_fuzzy_verdicts(spark):
    utr = "ABCDEF123456"
    links, verdicts = fuzzy(spark, [("B1", utr, "100.00", 0), ("B2", "XYZXYZ999999", "250.00", 20)], [("C1", f"NEFT {utr}", "100.00", 0), ("C2", "NEFT QQQQQQQQ", "7.00", 0), ("C3", "IMPS", "250.50", 20), ("C4", utr, "100.00", 60)])
    assert verdicts["C1"] == ("ACCEPTED", D("1.000000"), 0) and links["C1"] == "B1"
    assert verdicts["C2"] == ("ABSTAINED", 0, None)  # the one batch that is left lies beyond the window
    assert verdicts["C3"] == ("ACCEPTED", D("1.000000"), None) and links["C3"] == "B2"
    assert "C4" not in verdicts  # no batch is left


def test_equal_candidates_abstain_and_batches_leave(spark):
    twins = [("B1", "AAAAAA000001", "100.00", 0), ("B2", "BBBBBB000002", "100.00", 0)]
    links, verdicts = fuzzy(spark, twins, [("C1", "IMPS", "100.00", 0)])
    assert verdicts["C1"][0] == "ABSTAINED" and links == {}
    # The first credit names one of them; then only the other is left for the second credit.
    links, verdicts = fuzzy(spark, twins, [("C1", "AAAAAA0", "100.00", 0), ("C2", "IMPS", "100.00", 0)])
    assert links == {"C1": "B1", "C2": "B2"} and verdicts["C2"] == ("ACCEPTED", 1, None)


@pytest.mark.parametrize("seed", range(3))
def test_fuzzy_pass_is_that_of_a_loop(spark, seed):
    """Few references, amounts and days, so that credits compete and chains form."""
    rng = random.Random(seed)
    utrs = ["ABCDEF1234567890", "ABCDEF12345699", "ABCDEFG7777777", "ZZZZZZ000000", "ABCXYZ123456"]
    batches = [(f"B{i:02}", rng.choice(utrs)[: rng.choice([12, 16])], f"{rng.choice([100, 101, 200])}.00", rng.randrange(8)) for i in range(14)]
    credits = [(f"C{i:02}", rng.choice(["IMPS", "PAY", "NEFT " + rng.choice(utrs)[: rng.choice([6, 8, 11, 16])]]), f"{rng.choice([100, 102, 200])}.50", rng.randrange(8)) for i in range(20)]
    assert fuzzy(spark, batches, credits) == loop_fuzzy(batches, credits)


def test_nearest_batches_are_those_of_all(spark):
    rng = random.Random(4)
    day = lambda: date(2026, 9, 1) + timedelta(rng.randrange(30))
    batches = [(f"B{i:03}", D(rng.choice([10, 10, 11, 500, 10**9, rng.randrange(3000)])), day()) for i in range(300)]
    credits = [(f"C{i:02}", D(rng.choice([10, 600, 10**8, rng.randrange(3000)])), day()) for i in range(40)]
    got = B.nearest_batches(spark.createDataFrame(credits, "bank_txn_id string, amount decimal(18,2), value_date date"), spark.createDataFrame(batches, "batch_id string, net_total decimal(18,2), settled_event_date date")).collect()
    want = {(c, b[0], k + 1) for c, a, d in credits for k, b in enumerate(sorted(batches, key=lambda b: (abs(b[1] - a), abs((d - b[2]).days), b[0]))[:20])}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_naive_links_are_greedy(spark):
    rng = random.Random(6)
    day = lambda n: date(2026, 9, 1) + timedelta(n)
    batches = [(f"B{i:02}", D(rng.choice([100, 101, 300])), day(rng.randrange(12))) for i in range(30)]
    credits = [(f"C{i:02}", D(rng.choice([100, 101, 300])), day(rng.randrange(14))) for i in range(35)]
    free, want = dict((c, (a, d)) for c, a, d in credits if d <= day(10)), {}
    for b, total, settled in batches:
        near = sorted((abs((d - settled).days), abs(a - total), c) for c, (a, d) in free.items() if abs(a - total) <= 1 and abs((d - settled).days) <= 5)
        if near:
            want[b] = near[0][2]
            del free[near[0][2]]
    got = B.naive_links(spark.createDataFrame(batches, "batch_id string, net_total decimal(18,2), settled_event_date date"), spark.createDataFrame(credits, "bank_txn_id string, amount decimal(18,2), value_date date"), F.lit(day(10)))
    assert {r.batch_id: r.bank_txn_id for r in got.collect()} == want


@pytest.fixture(scope="module")
def engine(spark):
    return over_lens(spark, SMALL)


def test_every_branch_fires(engine):
    cases = {(r.status, r.category) for r in engine.cases.select("status", "category").distinct().collect()}
    assert {c for _, c in cases} >= {None, "UNEXPLAINED", "PARTIAL_CAPTURE", "ROUNDING_DIFFERENCE", "T_PLUS_N_TIMING", "DUPLICATE_CANDIDATE"}
    links = {(r.status, r.category) for r in engine.batch_links.select("status", "category").distinct().collect()}
    assert links >= {("CONFIRMED", None), ("CONFIRMED", "ROUNDING_DIFFERENCE"), ("OPEN", "MISSING_VS_LATE_CREDIT"), ("PENDING_EVIDENCE", None)}
    assert {r.source_table for r in engine.row_variances.select("source_table").distinct().collect()} == {"ledger_rows", "bank_rows"}


def test_populations_are_whole(engine):
    assert engine.cases.count() == engine.payments.count() == engine.cases.select("case_id").distinct().count()
    assert engine.batch_links.count() == engine.batches.count()
    taken = engine.batch_links.where(F.col("bank_row_id").isNotNull())
    assert taken.count() == taken.select("bank_row_id").distinct().count()


def test_variance_adds_up(engine):
    """What is explained and what isn't make the whole variance, up to the tolerance that rounding takes."""
    off = engine.cases.join(engine.facts.select("case_id", "authorized", "captured"), "case_id").where(F.abs(F.col("variance") - (F.col("authorized") - F.col("captured")) - F.col("unexplained")) > 1)
    assert off.count() == 0


def test_tables_are_asked_for_when_a_query_needs_them(spark):
    """The nearest batches need credits and batches alone, so no other table is made for them."""
    batches = spark.createDataFrame([("B1", "U", D("5.00"), date(2001, 1, 1))], "batch_id string, utr string, net_total decimal(18,2), settled_event_date date")
    bank = spark.createDataFrame([("C1", date(2001, 1, 2), D("7.00"), "NEFT U", "credit"), ("C2", date(2001, 1, 2), D("5.00"), "NEFT U", "debit")], "bank_txn_id string, value_date date, amount decimal(18,2), narration string, direction string")
    engine = Engine({"batches": batches, "bank": bank}, None, None, None, "", "2001-06-30")
    assert list(map(tuple, B.nearest_batches(engine.credits, engine.batches).collect())) == [("C1", "B1", 1)]


def test_integrity_tasks_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(stage, "ROWS_A_TASK", 3)
    frame = lambda cols, *rows: spark.createDataFrame(list(rows), ", ".join(f"{c} string" for c in cols.split()))
    e = SimpleNamespace(
        ledger=frame("order_id", ("o1",), ("o1",)), payments=frame("payment_id order_id", ("p1", "o1"), ("p2", "o2")), refunds=frame("refund_id payment_id", ("r1", "p1"), ("r2", "p9")),
        lines=frame("settlement_id payment_id batch_id", *[(f"s{i}", "p1", "b1") for i in range(9)], ("s9", "p9", "b1"), ("sa", "p2", "b9")), batches=frame("batch_id", ("b1",)),
    )
    lost = case_queries.integrity_checks(e)
    assert sorted((r.link, r.id) for r in lost.collect()) == [("line_batch", "sa"), ("line_payment", "s9"), ("payment_order", "p2"), ("refund_payment", "r2")]
    plan = lost._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 6 and "Aggregate" not in plan  # both sides of three links; a parent that comes twice does no harm
    assert [stage.tasks_for(n) for n in (0, 3, 4, 11)] == [1, 1, 2, 4]
