"""Daily CSV deliveries, read under strict schemas.

A file, or a folder of part files, is named day{N}_{stem}.csv. Every column is
read as text, then typed; rows that don't parse are counted by column and
refused together, the first ones with their file, row and value. A file without
rows is an empty table, a missing file is an error.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.normalize import parse_amount, parse_date

#: Columns of each table in file order, with what they are parsed as.
TABLES = {
    "ledger": ("ledger", {"order_id": "text", "invoice_no": "text", "gross": "money", "order_date": "date", "customer_id": "text", "sku": "text"}),
    "payments": ("payments", {"payment_id": "text", "order_id": "text", "method": ("card", "upi", "netbanking", "wallet"), "authorized": "money", "captured": "money", "status": ("captured", "refunded", "partial", "failed"), "captured_at": "date"}),
    "refunds": ("refunds", {"refund_id": "text", "payment_id": "text", "amount": "money", "created_at": "date"}),
    "lines": ("settlements", {"settlement_id": "text", "batch_id": "text", "line_type": ("payment", "refund"), "payment_id": "text", "refund_id": "optional", "gross": "money", "fee": "money", "tax": "money", "net": "money", "settled_event_date": "date"}),
    "batches": ("batches", {"batch_id": "text", "utr": "text", "net_total": "money", "settled_event_date": "date"}),
    "bank": ("bank", {"bank_txn_id": "text", "value_date": "date", "amount": "money", "narration": "text", "direction": ("credit", "debit")}),
}


class IngestError(ValueError):
    pass


def schema_of(table: str) -> str:
    """The columns of a typed table as DDL."""
    kinds = {"money": "decimal(18,2)", "date": "date"}
    return ", ".join(f"{c} {kinds.get(k, 'string') if isinstance(k, str) else 'string'}" for c, k in TABLES[table][1].items())


#: Rows with faults that an error shows.
SHOWN_FAULTS = 5


def raw(spark: SparkSession, folder: str, table: str, only_day: int | None = None) -> DataFrame:
    """All deliveries of a table, or a day's, as text, with arrival_day and the name of the file. A header that differs in name or order is refused when the rows are read."""
    stem, columns = TABLES[table]
    schema = ", ".join(f"{c} string" for c in columns)
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("nullValue", "\0").option("emptyValue", "").csv(f"{folder.rstrip('/')}/day{'*' if only_day is None else only_day}_{stem}.csv")
    name = F.regexp_extract(F.col("_metadata.file_path"), rf"day(\d+)_{stem}\.csv", 0)
    return rows.select(*columns, F.regexp_extract(name, r"^day(\d+)_", 1).cast("int").alias("arrival_day"), name.alias("file"))


def _typed(name: str, kind) -> Column:
    c = F.col(name)
    if kind == "money":
        return parse_amount(c)
    if kind == "date":
        return parse_date(c)["value"]
    if kind == "optional":
        return F.nullif(c, F.lit(""))
    if kind == "text":
        return c
    return F.when(c.isin(*kind), c)


def load(spark: SparkSession, folder: str, table: str, window: tuple[str, str] | None = None, until_day: int | None = None, only_day: int | None = None) -> DataFrame:
    """A table's rows, typed, of all days, those up to until_day, or one."""
    _, columns = TABLES[table]
    rows = raw(spark, folder, table, only_day)
    rows = rows if until_day is None else rows.where(F.col("arrival_day") <= until_day)
    typed = rows.select(*[_typed(c, k).alias(c) for c, k in columns.items()], "arrival_day", "file", *[F.col(c).alias(f"_{c}") for c in columns])
    faults = {f"{c} doesn't parse": F.col(c).isNull() for c, k in columns.items() if k not in ("text", "optional")}
    if window:
        faults |= {f"{c} is outside of the window": ~F.col(c).between(*[F.lit(x).cast("date") for x in window]) for c, k in columns.items() if k == "date"}
    if table == "lines":
        faults["refund_id doesn't fit line_type"] = (F.col("line_type") == "refund") != F.col("refund_id").isNotNull()
    if table == "refunds":
        faults["amount isn't positive"] = F.col("amount") <= 0
    try:
        found = typed.agg(*[F.count_if(fault).alias(name.replace(".", "_")) for name, fault in faults.items()]).first().asDict()
    except Exception as e:
        if "CSV header" in str(e):
            raise IngestError(f"{table}: the header of a file isn't {','.join(columns)}") from e
        raise
    if bad := {k: n for k, n in found.items() if n}:
        which = F.array_compact(F.array(*[F.when(fault, F.lit(name)) for name, fault in faults.items()]))
        first = typed.select("file", F.array(*[f"_{c}" for c in columns]).alias("row"), which.alias("faults")).where(F.size("faults") > 0).limit(SHOWN_FAULTS).collect()
        raise IngestError(f"{table}: {bad}; " + "; ".join(f"{r.file}: {','.join(x or '' for x in r.row)}: {', '.join(r.faults)}" for r in first))
    return typed.select(*columns, "arrival_day")


def _found(spark: SparkSession, folder: str, table: str, day: int | str) -> list[str]:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/day{day}_{TABLES[table][0]}.csv")
    found = path.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(path) or []
    return [f.getPath().getName() for f in found]


def is_there(spark: SparkSession, folder: str, table: str, day: int) -> bool:
    """Whether a day has a table's file, with rows or without."""
    return bool(_found(spark, folder, table, day))


def days_in(spark: SparkSession, folder: str, table: str = "batches") -> list[int]:
    """The days that have a file of a table; a folder without any raises."""
    days = sorted(int(re.match(r"day(\d+)_", name)[1]) for name in _found(spark, folder, table, "*"))
    if not days:
        raise IngestError(f"{folder} has no deliveries")
    return days


def write(frame: DataFrame, folder: str, table: str) -> None:
    """A table as the deliveries that ``load`` reads, a folder of part files for each arrival_day, columns in file order. It is written in one go and moved into place day by day."""
    stem, columns = TABLES[table]
    context, draft = frame.sparkSession.sparkContext, f"{folder.rstrip('/')}/.{uuid.uuid4().hex}"
    rows = frame.select("arrival_day", *[F.col(c).cast("string").alias(c) for c in columns])
    rows.write.option("header", True).option("emptyValue", "").option("nullValue", "").partitionBy("arrival_day").csv(draft)
    path = context._jvm.org.apache.hadoop.fs.Path
    files = path(draft).getFileSystem(context._jsc.hadoopConfiguration())
    for found in files.listStatus(path(draft)):
        name = found.getPath().getName()
        if name.startswith("arrival_day="):
            files.rename(found.getPath(), path(f"{folder.rstrip('/')}/day{name.removeprefix('arrival_day=')}_{stem}.csv"))
    files.delete(path(draft), True)
