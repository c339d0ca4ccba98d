"""Small helpers that the text operators share."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows that one Arrow batch carries to Python; texts can be long.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Arrow batches of whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def release() -> None:
    """Give the memory that a task's Python no longer needs back to the machine, as the worker lives on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library, which may keep it
        return


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: that of checkpoint(), or the one named in spark.checkpoint.dir."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder.rstrip("/")


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(frame: DataFrame) -> DataFrame:
    """frame, written to the folder that all executors share and read again: computed once, whatever is lost later."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")  # what was shuffled for it isn't needed once it is written; other actions may still read theirs when they return
    try:
        frame.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(frame.schema).parquet(path)
    out.kept_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Remove kept frames that nothing will read again."""
    for frame in frames:
        context = frame.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(frame.kept_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of a filter: so many for each key, within these bounds (64 MB). A full filter lets everything through, which costs work and no result.
KEY_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 17, 1 << 29


def filter_bits(values: Column | str, frame: DataFrame, key_bits: int = KEY_BITS) -> bytes:
    """A one-hash Bloom filter over 64-bit hashes, put together by Spark in slices of 4 KB. frame is counted first, so it should be a kept one."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (key_bits * frame.count()).bit_length()))
    position = F.pmod(F.col(values) if isinstance(values, str) else values, F.lit(bits)) + 1  # bitmap buckets count from 1
    slices = frame.select(position.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = bytearray(bits // 8)
    for row in slices.collect():
        at = (row["k"] - 1) * 4096
        out[at : at + 4096] = row["bits"]
    return bytes(out)


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """bits: the filter as bytes. Whether each 64-bit hash may be in it."""
    at = (hashes.astype(np.uint64) & np.uint64(8 * len(bits) - 1)).astype(np.int64)  # sizes are powers of two, so the sign makes no difference
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def split_by_key(rows: DataFrame, special: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows without and with a key (a 64-bit hash) that may be in special; so that only rows it may concern are shuffled to meet it."""
    bits = rows.sparkSession.sparkContext.broadcast(filter_bits("key", special.select("key")))

    @F.pandas_udf("boolean")
    def may_be_in(keys: pd.Series) -> pd.Series:
        return pd.Series(passes(np.frombuffer(bits.value, np.uint8), keys.to_numpy()))

    return rows.where(~may_be_in("key")), rows.where(may_be_in("key"))


def one_of_each(docs: DataFrame, key: Column, decided: DataFrame) -> DataFrame:
    """The rows of docs that stay. decided: key, stays, for each row; a key that comes more than once stays at most once.

    docs may have columns of any name; its rows travel as one struct.
    """
    special = keep(decided.groupBy("key").agg(F.bool_or("stays").alias("stays"), F.count(F.lit(1)).alias("n")).where("not stays or n > 1").select("key", "stays"))
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"))
    same, perhaps = split_by_key(rows, special)
    perhaps = perhaps.join(special, "key", "left").withColumn("stays", F.coalesce("stays", F.lit(True)))
    single, several = perhaps.where("stays"), special.where("stays").select("key")
    repeated = single.join(several, "key", "left_semi").dropDuplicates(["key"])
    return same.select("row.*").unionByName(single.join(several, "key", "left_anti").select("row.*")).unionByName(repeated.select("row.*"))


class WordHashes(dict):
    """A 64-bit hash for each word that comes along; of 200,000 short words at most it is remembered."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) > 200_000:
                self.clear()
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k words in a row, from the words' hashes."""
    with np.errstate(over="ignore"):
        out = h[: len(h) - k + 1].copy()
        for j in range(1, k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j]
    return mix64(out, k)


def text_of(name: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values for each seed."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
