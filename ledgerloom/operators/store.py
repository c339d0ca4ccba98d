"""Exceptions over days as versioned tables: one commit a step, every merge keyed.

A store is a folder. A commit writes its rows below new names and then puts a
version file in place, which lists the paths that make up each table from then
on; a version that exists can't be put in place again. So a reader sees a
commit whole or not at all, what a crashed writer leaves is never read, and of
two writers one fails. ``exceptions`` and ``watermarks`` are replaced by each
commit that changes them, the other tables only grow.

Status is changed in here alone. A confirmation has a key made of exception,
kind and evidence; one whose key is there already changes nothing, so a step
that is repeated after a crash ends as if it had run once.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.operators.lifecycle import TRANSITIONS, idempotency_key, transitions
from ledgerloom.operators.stage import kept, numbered

SCHEMAS = {
    "exceptions": "exception_id string, population string, subject_id string, category string, amount decimal(18,2), status string, confidence decimal(5,4), evidence_row_ids array<string>, reason string, resolved_by string, first_seen_day int, confirmed_day int, closed_day int",
    "audit": "exception_id string, arrival_day int, sequence long, from_status string, to_status string, actor string, note string, evidence_ids array<string>",
    "resolutions": "idempotency_key string, exception_id string, resolution_type string, evidence_ids array<string>, arrival_day int",
    "files": "content_hash string, path string, arrival_day int, arrival_seq long, row_count long, is_empty boolean",
    "watermarks": "name string, arrival_day int, arrival_seq long",
}
REPLACED = ("exceptions", "watermarks")
#: Types that would let a clock or a rounding into the state.
REFUSED = ("timestamp", "timestamp_ntz", "date", "float", "double")
#: States that are looked at again each day, those of them that reopen first, who acts, the type of a confirmation by looking again.
RESIDUAL = ("OPEN", "PENDING_EVIDENCE", "PENDING_AI_UNAVAILABLE")
WAITING, ENGINE, EXPORTER, BY_RULE, REEVALUATED = RESIDUAL[1:], "DETERMINISTIC", "EXPORTER", "DETERMINISTIC", "DETERMINISTIC_REEVALUATION"
#: Columns of audit rows before they have a sequence: phase and step order the rows of a commit.
ENTRY = ("phase", "amount", "exception_id", "step", "from_status", "to_status", "actor", "note", "evidence_ids")


class StoreError(ValueError):
    pass


class Conflict(StoreError):
    """Someone else has committed in between."""


class Store:
    """The tables in a folder that all executors share. data: further tables that only grow, name and schema."""

    def __init__(self, spark: SparkSession, folder: str, data: dict[str, str] | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.schemas = {**SCHEMAS, **(data or {})}
        bad = [f"{t}.{f.name}" for t in SCHEMAS for f in StructType.fromDDL(self.schemas[t]).fields if f.dataType.typeName() in REFUSED]
        if bad:
            raise StoreError(f"state can't have {', '.join(bad)}")

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    @property
    def _files(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    @property
    def version(self) -> int:
        """The last commit; 0 before the first."""
        if not self._files.exists(self._path("versions")):
            return 0
        names = [f.getPath().getName() for f in self._files.listStatus(self._path("versions"))]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def _paths(self, version: int) -> dict[str, list[str]]:
        if version == 0:
            return {}
        rows = self.spark.read.text(str(self._path("versions", f"{version:08d}.json")), wholetext=True).first()
        return json.loads(rows[0])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version, by default the last."""
        paths = self._paths(self.version if version is None else version).get(name, [])
        if not paths:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(*[f"{self.folder}/{p}" for p in paths])

    def stage(self, name: str, frame: DataFrame) -> tuple[str, DataFrame]:
        """frame, written below a name that no version lists yet, and read again."""
        fields = StructType.fromDDL(self.schemas[name])
        path = f"{name}/{uuid.uuid4().hex}"
        frame.select(*[F.col(f.name).cast(f.dataType) for f in fields]).write.parquet(f"{self.folder}/{path}")
        return path, self.spark.read.schema(fields).parquet(f"{self.folder}/{path}")

    def commit(self, changes: dict[str, DataFrame | str], expected: int | None = None) -> int:
        """One new version: rows (or paths of staged ones) that replace or are added to each table. expected: the version that changes are based on."""
        base = self.version if expected is None else expected
        written = {name: c if isinstance(c, str) else self.stage(name, c)[0] for name, c in changes.items()}
        paths = self._paths(base)
        for name, path in written.items():
            paths[name] = [path] if name in REPLACED else [*paths.get(name, []), path]
        self._put(base + 1, json.dumps(paths))
        return base + 1

    def _put(self, version: int, text: str) -> None:
        draft, final = self._path("versions", f".{uuid.uuid4().hex}"), self._path("versions", f"{version:08d}.json")
        out = self._files.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        if self._files.exists(final) or not self._files.rename(draft, final):
            raise Conflict(f"version {version} of {self.folder} is there already")


def entry(**values: Column) -> list[Column]:
    return [values[c].alias(c) for c in ENTRY]


def _text(value: str | None) -> Column:
    return F.lit(value).cast("string")


def upsert(state: DataFrame, outcomes: DataFrame, day: int) -> tuple[DataFrame, DataFrame]:
    """State with an exception for each subject that isn't confirmed and has none yet, and the entries for the audit.

    outcomes: exception_id, population, subject_id, status, category, amount,
    evidence and reason. What is there already stays as it is. Several
    outcomes of a subject are one exception, the least by category and amount.
    """
    columns = ("population", "subject_id", "status", "category", "amount", "evidence", "reason")
    least = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("category", "amount", "status")])
    once = outcomes.where("status <> 'CONFIRMED'").groupBy("exception_id").agg(F.min_by(F.struct(*columns), least).alias("o")).select("exception_id", "o.*")
    new = once.join(state.select("exception_id"), "exception_id", "left_anti")
    rows = new.select(
        "exception_id", "population", "subject_id", F.coalesce("category", F.lit("")).alias("category"), F.coalesce("amount", F.lit(0)).cast("decimal(18,2)").alias("amount"), "status", F.lit(0).cast("decimal(5,4)").alias("confidence"),
        F.sort_array(F.array_compact(F.coalesce("evidence", F.array().cast("array<string>")))).alias("evidence_row_ids"), "reason", _text(None).alias("resolved_by"), F.lit(day).alias("first_seen_day"), F.lit(None).cast("int").alias("confirmed_day"), F.lit(None).cast("int").alias("closed_day"),
    )
    entries = rows.select(*entry(phase=F.lit(1), amount=F.col("amount"), exception_id=F.col("exception_id"), step=F.lit(0), from_status=_text(None), to_status=F.col("status"), actor=F.lit(ENGINE), note=F.col("reason"), evidence_ids=F.col("evidence_row_ids")))
    return state.unionByName(rows), entries


def _illegal(from_: Column, to: Column) -> Column:
    return F.raise_error(F.concat(F.lit("exception "), F.col("exception_id"), F.lit(" can't go from "), F.coalesce(from_, F.lit("nowhere")), F.lit(" to "), to)).cast("string")


def confirm(state: DataFrame, resolutions: DataFrame, asked: DataFrame, day: int, actor: str = ENGINE, resolved_by: str = BY_RULE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """State, new resolutions and entries after confirming what is asked: exception_id, resolution_type, evidence_ids and confidence.

    What has been confirmed under the same key, or is asked twice, counts
    once. Waiting exceptions become OPEN first. A null confidence leaves the
    one that is there. A null in evidence is left out. Confirming an unknown
    exception, one that is confirmed otherwise, or one for two reasons at
    once raises.
    """
    evidence = F.sort_array(F.array_compact(F.coalesce("evidence_ids", F.array().cast("array<string>"))))
    keyed = asked.withColumn("evidence_ids", evidence).withColumn("idempotency_key", idempotency_key(F.col("exception_id"), F.col("resolution_type"), F.col("evidence_ids")))
    once = keyed.groupBy("idempotency_key").agg(F.max(F.struct("exception_id", "resolution_type", "evidence_ids", "confidence")).alias("a")).select("idempotency_key", "a.*")
    fresh = once.join(resolutions.select("idempotency_key"), "idempotency_key", "left_anti")
    per = fresh.groupBy("exception_id").agg(F.first(F.struct("resolution_type", "evidence_ids", "confidence")).alias("a"), F.count(F.lit(1)).alias("n"))
    rows = state.withColumn("known", F.lit(True)).join(per, "exception_id", "full")
    moves = F.col("n").isNotNull()
    legal = F.array(*[F.lit(s) for s, to in TRANSITIONS.items() if "CONFIRMED" in to or s in WAITING])
    fine = F.col("known").isNotNull() & (F.col("n") == 1) & F.array_contains(legal, F.col("status"))
    status = F.when(moves & ~fine, _illegal(F.when(F.col("n") > 1, F.lit("two reasons")).otherwise(F.col("status")), F.lit("CONFIRMED"))).when(moves, F.lit("CONFIRMED")).otherwise(F.col("status"))
    rows = rows.withColumn("before", F.col("status")).withColumn("status", status)
    after = rows.select(
        "exception_id", "population", "subject_id", "category", "amount", "status", F.coalesce(F.when(moves, F.col("a.confidence")), "confidence").cast("decimal(5,4)").alias("confidence"), "evidence_row_ids", "reason",
        F.when(moves, F.lit(resolved_by)).otherwise(F.col("resolved_by")).alias("resolved_by"), "first_seen_day", F.when(moves, F.lit(day)).otherwise(F.col("confirmed_day")).alias("confirmed_day"), "closed_day",
    )
    waited = F.col("before").isin(*WAITING)
    hop = lambda step, from_, to, note: F.struct(F.lit(step).alias("step"), from_.alias("from_status"), F.lit(to).alias("to_status"), note.alias("note"))
    last = lambda from_: hop(1, from_, "CONFIRMED", F.col("a.resolution_type"))
    reopened = hop(0, F.col("before"), "OPEN", F.lit(f"evidence arrived on day {day}; reopened for decision"))
    hops = F.when(waited, F.array(reopened, last(F.lit("OPEN")))).otherwise(F.array(last(F.col("before"))))
    entries = rows.where(moves & (F.col("status") == "CONFIRMED")).select("amount", "exception_id", F.col("a.evidence_ids").alias("evidence_ids"), F.explode(hops).alias("h"))
    entries = entries.select(*entry(phase=F.lit(0), amount=F.col("amount"), exception_id=F.col("exception_id"), step=F.col("h.step"), from_status=F.col("h.from_status"), to_status=F.col("h.to_status"), actor=F.lit(actor), note=F.col("h.note"), evidence_ids=F.col("evidence_ids")))
    return after, fresh.select("idempotency_key", "exception_id", "resolution_type", "evidence_ids", F.lit(day).alias("arrival_day")), entries


def _moved(state: DataFrame, asked: DataFrame, actor: str, day: int) -> tuple[DataFrame, DataFrame]:
    wanted = asked.select("exception_id", "to_status", "note", F.sort_array(F.coalesce("evidence_ids", F.array().cast("array<string>"))).alias("evidence_ids"))
    legal = F.broadcast(transitions(state.sparkSession).select(F.col("from_status").alias("status"), "to_status", F.lit(True).alias("legal")))
    rows = state.withColumn("known", F.lit(True)).join(wanted, "exception_id", "full").join(legal, ["status", "to_status"], "left")
    moves = F.col("to_status").isNotNull()
    status = F.when(moves & F.col("legal").isNull(), _illegal(F.col("status"), F.col("to_status"))).when(moves, F.col("to_status")).otherwise(F.col("status"))
    rows = rows.withColumn("before", F.col("status")).withColumn("status", status)
    dated = lambda to, c: F.when(moves & (F.col("to_status") == to), F.lit(day)).otherwise(F.col(c)).alias(c)
    after = rows.select(*[c for c in state.columns if c not in ("confirmed_day", "closed_day")], dated("CONFIRMED", "confirmed_day"), dated("CLOSED", "closed_day")).select(*state.columns)
    entries = rows.where(moves & (F.col("status") == F.col("to_status"))).select(*entry(phase=F.lit(0), amount=F.col("amount"), exception_id=F.col("exception_id"), step=F.lit(0), from_status=F.col("before"), to_status=F.col("to_status"), actor=F.lit(actor), note=F.col("note"), evidence_ids=F.col("evidence_ids")))
    return after, entries


def mark(state: DataFrame, asked: DataFrame, actor: str, day: int) -> tuple[DataFrame, DataFrame]:
    """State and entries after the moves asked for: exception_id, to_status, note, evidence_ids. An illegal move raises, and so does any to CLOSED."""
    closed = F.when(F.col("to_status") == "CLOSED", _illegal(F.lit("here"), F.lit("CLOSED"))).otherwise(F.col("to_status"))
    return _moved(state, asked.withColumn("to_status", closed), actor, day)


def close(state: DataFrame, asked: DataFrame, day: int) -> tuple[DataFrame, DataFrame]:
    """Confirmed exceptions (exception_id, note) become CLOSED, by the exporter alone."""
    rows = asked.select("exception_id", F.lit("CLOSED").alias("to_status"), "note", F.array().cast("array<string>").alias("evidence_ids"))
    return _moved(state, rows, EXPORTER, day)


def sequenced(entries: list[DataFrame], audit: DataFrame, day: int) -> DataFrame:
    """Audit rows of entries: a day's rows are numbered on from those it has; confirmations come before new exceptions, large amounts before small ones."""
    before = audit.where(F.col("arrival_day") == day).agg(F.coalesce(F.max("sequence"), F.lit(-1))).first()[0]
    rows = reduce(DataFrame.unionByName, entries).withColumn("down", -F.col("amount"))
    placed = numbered(rows, ["phase", "down", "exception_id", "step"], "place")
    return placed.withColumn("sequence", F.col("place") + before + 1).withColumn("arrival_day", F.lit(day)).select(*[f.name for f in StructType.fromDDL(SCHEMAS["audit"])])


def watermark(rows: DataFrame, name: str, day: int, sequence: int) -> DataFrame:
    """watermarks with the one of a name set."""
    one = rows.sparkSession.createDataFrame([(name, day, sequence)], SCHEMAS["watermarks"])
    return rows.where(F.col("name") != name).unionByName(one)


def reevaluate(state: DataFrame, outcomes: DataFrame) -> DataFrame:
    """What to confirm: exceptions that are looked at again and whose subject is confirmed now, with its evidence. Several outcomes of a subject are one."""
    solved = outcomes.where("status = 'CONFIRMED'").groupBy("exception_id").agg(F.min(F.array_compact("evidence")).alias("evidence_ids"))
    residual = state.where(F.col("status").isin(*RESIDUAL)).select("exception_id")
    return residual.join(solved, "exception_id").select("exception_id", F.lit(REEVALUATED).alias("resolution_type"), "evidence_ids", F.lit(None).cast("decimal(5,4)").alias("confidence"))


def close_day(store: Store, day: int, outcomes: DataFrame, more: dict[str, DataFrame | str] | None = None, marks: dict[str, tuple[int, int]] | None = None) -> int:
    """Look at a day's outcomes, which are read twice: confirm what they explain, open what is new, and commit that with more and the watermarks in one version."""
    base = store.version
    state, resolutions, audit = (store.read(t, base) for t in ("exceptions", "resolutions", "audit"))
    after, resolved, confirmed = confirm(state, resolutions, kept(reevaluate(state, outcomes)), day)
    after, opened = upsert(after, outcomes, day)
    changes = {"exceptions": after, "resolutions": resolved, "audit": sequenced([confirmed, opened], audit, day), **(more or {})}
    rows = store.read("watermarks", base)
    for name, (at, sequence) in (marks or {}).items():
        rows = watermark(rows, name, at, sequence)
    return store.commit({**changes, "watermarks": rows}, base)


def trail(audit: DataFrame) -> DataFrame:
    """audit with step, an entry's place among those of its exception, in order of day and sequence."""
    return audit.withColumn("step", F.row_number().over(Window.partitionBy("exception_id").orderBy("arrival_day", "sequence")))


def last_note(audit: DataFrame) -> DataFrame:
    """Each exception's last entry: its status, actor and note, with moves, the number of its entries. The audit moves once."""
    last = F.max_by(F.struct("to_status", "actor", "note"), F.struct("arrival_day", "sequence"))
    return audit.groupBy("exception_id").agg(last.alias("l"), F.count(F.lit(1)).alias("moves")).select("exception_id", "l.*", "moves")
