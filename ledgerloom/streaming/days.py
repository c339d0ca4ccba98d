"""Deliveries as a stream: each new file once, each day in turn, all that a day changes in one commit.

``follow`` reads the lines of new files as a stream and hands each batch to
``take_in``. A delivery is known by a digest of its rows, so what a restarted
stream brings again, or what is delivered again under another name, changes
nothing. The days of a batch are taken one by one: a day's rows go into the
store, the engine decides on everything that has arrived by then, and the
day's rows, files, exceptions, audit and watermarks become visible together.
Late rows need no watermark of the stream's own, as each day decides again on
all that there is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators import store as S
from ledgerloom.operators.stage import kept
from ledgerloom.sources import settlement_csv

#: What the rows of deliveries look like in a store.
DATA = {table: settlement_csv.schema_of(table) + ", arrival_day int" for table in settlement_csv.TABLES} | {
    "outcomes": "population string, subject_id string, status string, category string, amount decimal(18,2), resolved_by string, evidence array<string>, reason string, exception_id string, arrival_day int"
}
#: Names of the watermarks: the last day and file, and the last batch of the stream.
INGEST, STREAM = "ingest", "stream"
NAME = r"(day(\d+)_[a-z]+\.csv)"


def store_of(spark: SparkSession, folder: str) -> S.Store:
    return S.Store(spark, folder, DATA)


def files_in(lines: DataFrame) -> DataFrame:
    """path, arrival_day, content_hash and row_count of each delivery that lines (value, file) come from.

    A delivery is a file or a folder of part files. Its digest is the same in
    whatever order and parts the rows come, and leaves the headers out; it is
    added up where the lines are read, so no file has to fit into memory.
    """
    headers = {f"day_{stem}.csv": ",".join(columns) for stem, columns in settlement_csv.TABLES.values()}
    name = F.regexp_extract("file", NAME, 1)
    header = F.create_map(*[F.lit(x) for pair in headers.items() for x in pair])[F.regexp_replace(name, r"^day\d+", "day")]
    rows = lines.select("value", name.alias("path"), (F.trim("value") == "").alias("blank"), header.alias("header")).where("path <> ''")
    data = ~F.col("blank") & (F.col("value") != F.coalesce("header", F.lit("")))
    exact = lambda h: F.coalesce(F.sum(F.when(data, h.cast("decimal(20,0)"))), F.lit(0)).cast("decimal(38,0)").cast("string")
    digest = F.sha2(F.concat_ws("|", F.first("header"), F.count_if(data).cast("string"), exact(F.xxhash64("value")), exact(F.xxhash64("value", F.lit("again")))), 256)
    found = rows.groupBy("path").agg(digest.alias("content_hash"), F.count_if(data).alias("row_count"))
    return found.withColumn("arrival_day", F.regexp_extract("path", NAME, 2).cast("int"))


def new_files(found: DataFrame, known: DataFrame) -> DataFrame:
    """The files table's rows for deliveries whose content isn't known, each content once; a day's sequence goes on in order of paths, without gaps."""
    once = found.groupBy("content_hash").agg(F.min_by(F.struct("path", "arrival_day", "row_count"), F.struct("arrival_day", "path")).alias("f")).select("content_hash", "f.*")
    fresh = once.join(known.select("content_hash"), "content_hash", "left_anti")
    before = known.groupBy("arrival_day").agg(F.max("arrival_seq").alias("before"))
    placed = fresh.join(before, "arrival_day", "left").withColumn("place", F.row_number().over(Window.partitionBy("arrival_day").orderBy("path")))  # a day has a dozen files
    return placed.select("content_hash", "path", "arrival_day", (F.coalesce("before", F.lit(0)) + F.col("place")).alias("arrival_seq"), "row_count", (F.col("row_count") == 0).alias("is_empty"))


def take_day(store: S.Store, source: str, day: int, files: DataFrame, decide: Callable[[dict[str, DataFrame], int], DataFrame], batch: int) -> int:
    """Commit a day: its rows and files, and what decide (tables by name, day -> outcomes) says of all rows that have arrived by then.

    Only files of new content are read: a table that brings the same rows
    again, or none again, has a file and adds nothing. A table without a file
    raises, as that is no quiet day but a delivery that failed.
    """
    spark, base = store.spark, store.version
    brought = {r.path: r.arrival_seq for r in files.collect()}
    tables, staged = {}, {}
    for table, (stem, _) in settlement_csv.TABLES.items():
        earlier = store.read(table, base).where(F.col("arrival_day") <= day)
        if f"day{day}_{stem}.csv" in brought:
            staged[table], rows = store.stage(table, settlement_csv.load(spark, source, table, only_day=day))
            earlier = earlier.unionByName(rows)
        elif not settlement_csv.is_there(spark, source, table, day):
            raise settlement_csv.IngestError(f"day {day} has no {stem}")
        tables[table] = earlier.drop("arrival_day")
    marks = {INGEST: (day, max(brought.values(), default=0)), STREAM: (day, batch)}
    staged["outcomes"], outcomes = store.stage("outcomes", decide(tables, day).withColumn("arrival_day", F.lit(day)))
    return S.close_day(store, day, outcomes, {"files": files, **staged}, marks)


def take_in(store: S.Store, source: str, lines: DataFrame, decide: Callable[[dict[str, DataFrame], int], DataFrame], batch: int = 0) -> list[int]:
    """Take the new deliveries in lines, day by day: days with new content, and days after the last one that was taken, however quiet. The days that were taken."""
    found = kept(files_in(lines))
    files = kept(new_files(found, store.read("files")))
    last = store.read("watermarks").where(F.col("name") == INGEST).agg(F.coalesce(F.max("arrival_day"), F.lit(0))).first()[0]
    due = found.where(F.col("arrival_day") > last).select("arrival_day").union(files.select("arrival_day")).distinct()
    days = sorted(r.arrival_day for r in due.collect())  # a calendar has few
    for day in days:
        take_day(store, source, day, files.where(F.col("arrival_day") == day), decide, batch)
    return days


def follow(store: S.Store, source: str, checkpoint: str, decide: Callable[[dict[str, DataFrame], int], DataFrame], on_batch: Callable[[int], None] | None = None):
    """A stream over all deliveries that are in source now, or come there until it is started again with the same checkpoint. on_batch is called after a batch's commits."""
    lines = store.spark.readStream.text(f"{source.rstrip('/')}/day*_*.csv").select("value", F.col("_metadata.file_path").alias("file"))

    def batch(rows: DataFrame, number: int) -> None:
        take_in(store, source, rows, decide, number)
        if on_batch is not None:
            on_batch(number)

    return lines.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(batch).start()
