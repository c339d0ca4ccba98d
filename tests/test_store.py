from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import lifecycle as L
from ledgerloom.operators import store as S
from ledgerloom.operators.stage import numbered
from ledgerloom.sources import bitemporal, settlement_csv
from ledgerloom.streaming import days

OUTCOMES = "population string, subject_id string, status string, category string, amount decimal(18,2), evidence array<string>, reason string"
ASKED = "exception_id string, resolution_type string, evidence_ids array<string>, confidence decimal(5,4)"


def outcomes(spark, *rows):
    frame = spark.createDataFrame([(p, s, st, c, D(a), e, f"about {s}") for p, s, st, c, a, e in rows], OUTCOMES)
    return frame.withColumn("exception_id", L.exception_id(F.col("population"), F.col("subject_id")))


def held(store):
    return {r.subject_id: (r.status, r.first_seen_day, r.confirmed_day, r.closed_day, r.confidence, r.resolved_by) for r in store.read("exceptions").collect()}


def audit(store):
    subject = {r.exception_id: r.subject_id for r in store.read("exceptions").collect()}
    return [(r.arrival_day, r.sequence, subject[r.exception_id], r.from_status, r.to_status, r.actor) for r in store.read("audit").orderBy("arrival_day", "sequence").collect()]


ZERO = D("0.0000")
FIRST = (("A", "1", "OPEN", "UNEXPLAINED", "5", ["x"]), ("B", "2", "PENDING_EVIDENCE", None, "9", [None]), ("A", "3", "CONFIRMED", None, "7", []))
SECOND = (("A", "1", "CONFIRMED", "UNEXPLAINED", "5", ["b", None, "a"]), ("B", "2", "CONFIRMED", None, "9", None), ("A", "4", "OPEN", None, "1", []))


def test_days(spark, tmp_path):
    store = S.Store(spark, str(tmp_path))
    assert store.version == 0 and store.read("exceptions").count() == 0
    assert S.close_day(store, 1, outcomes(spark, *FIRST), marks={"ingest": (1, 6)}) == 1
    S.close_day(store, 1, outcomes(spark, *FIRST))  # the same day again changes nothing
    assert held(store) == {"1": ("OPEN", 1, None, None, ZERO, None), "2": ("PENDING_EVIDENCE", 1, None, None, ZERO, None)}
    assert audit(store) == [(1, 0, "2", None, "PENDING_EVIDENCE", "DETERMINISTIC"), (1, 1, "1", None, "OPEN", "DETERMINISTIC")]
    for _ in range(2):
        S.close_day(store, 2, outcomes(spark, *SECOND), marks={"ingest": (2, 12)})
    assert held(store) == {"1": ("CONFIRMED", 1, 2, None, ZERO, "DETERMINISTIC"), "2": ("CONFIRMED", 1, 2, None, ZERO, "DETERMINISTIC"), "4": ("OPEN", 2, None, None, ZERO, None)}
    assert [x[1:5] for x in audit(store)[2:]] == [(0, "2", "PENDING_EVIDENCE", "OPEN"), (1, "2", "OPEN", "CONFIRMED"), (2, "1", "OPEN", "CONFIRMED"), (3, "4", None, "OPEN")]
    assert sorted(map(tuple, store.read("resolutions").select("evidence_ids", "arrival_day").collect())) == [([], 2), (["a", "b"], 2)]
    assert list(map(tuple, store.read("watermarks").collect())) == [("ingest", 2, 12)]
    assert store.read("exceptions", version=1).where("status = 'OPEN'").count() == 1
    sequence = L.residual_sequence(store.read("exceptions"), spark.createDataFrame([(0,), (1,), (2,)], "arrival_day int"))
    assert sorted(map(tuple, sequence.collect())) == [(0, 0), (1, 2), (2, 1)]
    assert [r.subject_id for r in L.queue(store.read("exceptions"), ("OPEN", "CONFIRMED")).collect()] == ["2", "1", "4"]
    with pytest.raises(ValueError):
        L.queue(store.read("exceptions"), ())
    last = {r.exception_id: r.note for r in S.last_note(store.read("audit")).collect()}
    assert sorted(last.values()) == ["DETERMINISTIC_REEVALUATION"] * 2 + ["about 4"]


def asks(spark, *rows):
    return spark.createDataFrame([(L_id(s), kind, e, None if c is None else D(c)) for s, kind, e, c in rows], ASKED)


def L_id(subject):
    import hashlib

    return hashlib.sha256(f"exception|A|{subject}".encode()).hexdigest()[:16]


def test_confirm(spark, tmp_path):
    store = S.Store(spark, str(tmp_path))
    S.close_day(store, 1, outcomes(spark, ("A", "1", "OPEN", "X", "5", []), ("A", "2", "PENDING_EVIDENCE", "X", "6", [])))
    base = lambda: [store.read(t) for t in ("exceptions", "resolutions")]
    asked = asks(spark, ("1", "AI", ["b", "a"], "0.9"), ("1", "AI", ["a", "b"], "0.9"), ("2", "AI", None, None))
    after, new, entries = S.confirm(*base(), asked, 2, "AI", "AI_VERIFIED")
    changes = {"exceptions": after, "resolutions": new, "audit": S.sequenced([entries], store.read("audit"), 2)}
    for name, frame in changes.items():
        store.stage(name, frame)  # a writer that is lost before its commit
    assert held(store)["1"][0] == "OPEN" and store.read("resolutions").count() == 0
    store.commit(changes)
    assert held(store) == {"1": ("CONFIRMED", 1, 2, None, D("0.9000"), "AI_VERIFIED"), "2": ("CONFIRMED", 1, 2, None, ZERO, "AI_VERIFIED")}
    keys = {r.idempotency_key for r in store.read("resolutions").collect()}
    import hashlib

    assert hashlib.sha256(f"{L_id('1')}|AI|a|b".encode()).hexdigest() in keys and hashlib.sha256(f"{L_id('2')}|AI".encode()).hexdigest() in keys
    again, new, entries = S.confirm(*base(), asked, 3)
    assert new.count() == 0 and entries.count() == 0 and sorted(again.collect()) == sorted(store.read("exceptions").collect())
    for bad in (("1", "AI", ["other"], None),), (("9", "AI", [], None),):
        with pytest.raises(Exception, match="can't go from"):
            S.confirm(*base(), asks(spark, *bad), 3)[0].collect()
    fresh = S.Store(spark, str(tmp_path / "fresh"))
    S.close_day(fresh, 1, outcomes(spark, ("A", "1", "OPEN", "X", "5", [])))
    with pytest.raises(Exception, match="two reasons"):
        S.confirm(fresh.read("exceptions"), fresh.read("resolutions"), asks(spark, ("1", "AI", ["a"], None), ("1", "HUMAN", ["a"], None)), 2)[0].collect()


def test_moves(spark, tmp_path):
    store = S.Store(spark, str(tmp_path))
    S.close_day(store, 1, outcomes(spark, ("A", "1", "OPEN", "X", "5", []), ("A", "2", "OPEN", "X", "6", [])))
    move = lambda s, to: spark.createDataFrame([(L_id(s), to, "seen", ["e"])], "exception_id string, to_status string, note string, evidence_ids array<string>")
    state, entries = S.mark(store.read("exceptions"), move("1", "ABSTAINED"), "AI", 2)
    assert {r.subject_id: r.status for r in state.collect()} == {"1": "ABSTAINED", "2": "OPEN"} and entries.count() == 1
    state, _ = S.mark(state, move("1", "CONFIRMED"), "HUMAN", 3)
    assert [r.confirmed_day for r in state.orderBy("subject_id").collect()] == [3, None]
    for to in ("CLOSED", "CONFIRMED", "PENDING_EVIDENCE"):
        with pytest.raises(Exception, match="can't go from"):
            S.mark(state, move("1", to), "HUMAN", 4)[0].collect()
    with pytest.raises(Exception, match="can't go from nowhere"):
        S.mark(state, move("7", "OPEN"), "HUMAN", 4)[0].collect()
    closing = lambda s: spark.createDataFrame([(L_id(s), "exported")], "exception_id string, note string")
    done, entries = S.close(state, closing("1"), 5)
    assert [(r.status, r.closed_day) for r in done.orderBy("subject_id").collect()] == [("CLOSED", 5), ("OPEN", None)] and entries.first().actor == "EXPORTER"
    with pytest.raises(Exception, match="can't go from OPEN to CLOSED"):
        S.close(state, closing("2"), 5)[0].collect()


def test_writers(spark, tmp_path, monkeypatch):
    one, other = S.Store(spark, str(tmp_path)), S.Store(spark, str(tmp_path))
    one.commit({"watermarks": S.watermark(one.read("watermarks"), "a", 1, 1)})
    two = {"watermarks": S.watermark(one.read("watermarks"), "a", 2, 2)}
    one.commit(two, expected=1)
    with pytest.raises(S.Conflict):
        other.commit(two, expected=1)
    assert one.version == 2
    monkeypatch.setitem(S.SCHEMAS, "audit", S.SCHEMAS["audit"] + ", at timestamp")
    with pytest.raises(S.StoreError, match="audit.at"):
        S.Store(spark, str(tmp_path))


def test_numbered(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("a"), F.lit("x").alias("b"))
    assert numbered(rows, ["a"], "n").where("a = n").count() == 1000
    assert sorted(r.n for r in numbered(rows, ["b"], "n").collect()) == list(range(1000)) and numbered(rows.limit(0), ["a"], "n").count() == 0


HEADERS = {stem: ",".join(columns) for stem, columns in settlement_csv.TABLES.values()}


def deliver(folder, day, refunds=()):
    for stem, header in HEADERS.items():
        (folder / f"day{day}_{stem}.csv").write_text("\n".join([header, *(refunds if stem == "refunds" else ()), ""]))


def lines(spark, folder):
    return spark.read.text(f"{folder}/day*_*.csv").select("value", F.col("_metadata.file_path").alias("file"))


def decide(tables, day):
    """A refund is an exception until another one of its payment has come."""
    rows = tables["refunds"].groupBy("payment_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"), F.sort_array(F.collect_list("refund_id")).alias("evidence"))
    status = F.when(F.col("n") > 1, "CONFIRMED").otherwise("OPEN")
    return rows.select(F.lit("A").alias("population"), F.col("payment_id").alias("subject_id"), status.alias("status"), F.lit("X").alias("category"), F.col("amount").cast("decimal(18,2)").alias("amount"), F.lit(None).cast("string").alias("resolved_by"), "evidence", F.lit("r").alias("reason"), L.exception_id(F.lit("A"), F.col("payment_id")).alias("exception_id"))


def files_of(store):
    return [(r.arrival_day, r.arrival_seq, r.path, r.row_count, r.is_empty) for r in store.read("files").orderBy("arrival_day", "arrival_seq").collect()]


def test_deliveries_are_taken_once(spark, tmp_path):
    source, store = tmp_path / "in", days.store_of(spark, str(tmp_path / "store"))
    source.mkdir()
    deliver(source, 1, ["R1,P1,5.00,2026-09-01", "", "R2,P2,6.00,2026-09-01"])
    assert days.take_in(store, str(source), lines(spark, source), decide) == [1] and days.take_in(store, str(source), lines(spark, source), decide) == []
    # Six headers alone are alike but for their columns, so each is a content of its own.
    assert [x[:2] for x in files_of(store)] == [(1, k) for k in range(1, 7)] and files_of(store)[4][2:] == ("day1_refunds.csv", 2, False) and files_of(store)[0][4]
    assert {s: v[0] for s, v in held(store).items()} == {"P1": "OPEN", "P2": "OPEN"}
    order = spark.createDataFrame([("R2,P2,6.00,2026-09-01",), (HEADERS["refunds"],), ("R1,P1,5.00,2026-09-01",)], "value string").select("value", F.lit("/x/day4_refunds.csv/part-1").alias("file"))
    known = store.read("files")
    assert days.new_files(days.files_in(order), known).count() == 0  # the same rows in other parts, under another name


def test_stream_goes_on_after_a_crash(spark, tmp_path):
    source, checkpoint, store = tmp_path / "in", str(tmp_path / "checkpoint"), days.store_of(spark, str(tmp_path / "store"))
    source.mkdir()
    deliver(source, 1, ["R1,P1,5.00,2026-09-01", "R2,P2,6.00,2026-09-01"])

    def lost(number):
        raise RuntimeError("lost after the commit")

    with pytest.raises(Exception, match="lost after the commit"):
        days.follow(store, str(source), checkpoint, decide, lost).awaitTermination()
    assert store.version == 1
    days.follow(store, str(source), checkpoint, decide).awaitTermination()  # the batch comes again and changes nothing
    assert store.version == 1
    deliver(source, 2)
    (source / "day2_refunds.csv").write_text(HEADERS["refunds"] + "\nR3,P1,1.00,2026-09-02\n")
    days.follow(store, str(source), checkpoint, decide).awaitTermination()  # the other tables bring headers alone, as on day 1
    assert store.version == 2 and {s: v[0] for s, v in held(store).items()} == {"P1": "CONFIRMED", "P2": "OPEN"}
    deliver(source, 3)  # nothing but headers
    days.follow(store, str(source), checkpoint, decide).awaitTermination()
    assert store.version == 3 and [(r.name, r.arrival_day) for r in store.read("watermarks").orderBy("name").collect()] == [("ingest", 3), ("stream", 3)]
    (source / "day4_bank.csv").write_text(HEADERS["bank"] + "\nB1,2026-09-02,5.00,NEFT,credit\n")
    with pytest.raises(Exception, match="day 4 has no"):
        days.follow(store, str(source), checkpoint, decide).awaitTermination()


def test_two_times(spark):
    rows = spark.createDataFrame([("a", 1, 1, 1), ("a", 2, 1, 3), ("b", 5, 1, 2), ("b", 6, 1, 2), ("c", 9, 3, 3)], "k string, v int, event_day int, arrival_day int")
    got = bitemporal.as_of(bitemporal.history(rows, ["k"]), spark.createDataFrame([(1,), (2,), (3,)], "day int"))
    assert sorted((r.day, r.k, r.v, r.arrival_day) for r in got.collect()) == [(1, "a", 1, 1), (2, "a", 1, 1), (2, "b", 6, 2), (3, "a", 2, 3), (3, "b", 6, 2), (3, "c", 9, 3)]
    assert sorted((r.k, r.v) for r in bitemporal.latest(rows, ["k"], 2).collect()) == [("a", 1), ("b", 6)]
    merged = bitemporal.merge_days([rows, rows.where("k = 'b'")])
    assert merged.count() == 7 and merged.select("arrival_day").distinct().collect()[0][0] == 3 and rows.where(bitemporal.is_late()).count() == 3
    with pytest.raises(ValueError):
        bitemporal.merge_days([])
