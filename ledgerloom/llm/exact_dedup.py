"""Exact deduplication against a minimal perfect hash of historical digests.

``build_index`` turns the distinct digests of a history into shards, each a
minimal perfect hash whose slots hold the full digest, the id of the row that
won it and the number of rows that had it. ``look_up`` sends the distinct
digests of a new batch to those shards; a digest is a member only if its bytes
equal the slot's, as the hash maps strangers to slots too. Members take the
slot's winner, and nonmembers are grouped among themselves.

Rows are counted by digest before anything moves, so a text that a third of
all rows share is one row for each task in these steps. Rows meet their
group's result in two ways: groups of many rows are so few that they are sent
to all tasks, and only the rows of other groups are shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import SPACE, keep, mix64, one_of_each, table, text_of

SHARD_DIGESTS = 50_000
#: Groups that are sent to all tasks at most (3 MB).
LARGE_GROUPS = 50_000
#: Bits for each key that a level of the hash offers.
LEVEL_SPACE = 2
INDEX_SCHEMA = "shard int, n_keys long, levels array<binary>, digests binary, winners binary, counts binary"


def _positions(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """A bit position for each key of four 64-bit words; it depends on all of them."""
    state = np.zeros(len(words), np.uint64)
    for i in range(4):
        state = mix64(state ^ words[:, i], level)
    return (state % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Levels of bits: a key's slot is the rank of the first bit that it alone claimed."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        ones = [int(x.sum()) for x in levels]
        self.before = np.concatenate([[0], np.cumsum(ones)]).astype(np.int64)
        self.ranks = [np.cumsum(x, dtype=np.int64) - x for x in levels]

    @classmethod
    def build(cls, words: np.ndarray) -> PerfectHash:
        """words: distinct keys, n x 4. Keys that meet at a position go on to the next level."""
        levels = []
        while len(words):
            size = LEVEL_SPACE * len(words) + 8
            at = _positions(words, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            words = words[~alone[at]]
        return cls(levels)

    @classmethod
    def load(cls, blobs) -> PerfectHash:
        return cls([np.unpackbits(np.frombuffer(b, np.uint8)[8:], count=int(np.frombuffer(b[:8], "<i8")[0])).astype(bool) for b in blobs])

    def dump(self) -> list[bytes]:
        return [np.int64(len(x)).tobytes() + np.packbits(x).tobytes() for x in self.levels]

    def slots(self, words: np.ndarray) -> np.ndarray:
        """The slot of each key; for a stranger any slot, or -1."""
        out, left = np.full(len(words), -1, np.int64), np.arange(len(words))
        for k, bits in enumerate(self.levels):
            if not len(left):
                break
            at = _positions(words[left], k, len(bits))
            hit = bits[at]
            out[left[hit]] = self.before[k] + self.ranks[k][at[hit]]
            left = left[~hit]
        return out


def _words(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, digests)), "<u8").reshape(-1, 4)


def _build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    words = _words(rows["digest"])
    mph = PerfectHash.build(words)
    order = np.argsort(mph.slots(words))
    return pd.DataFrame([{
        "shard": rows["shard"].iloc[0], "n_keys": len(rows), "levels": mph.dump(), "digests": words[order].tobytes(),
        "winners": rows["winner"].to_numpy("<i8")[order].tobytes(), "counts": rows["n"].to_numpy("<i8")[order].tobytes(),
    }])


def _look_up_shard(rows: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    out = rows[["digest", "min_id", "has_id", "n"]].assign(member=False, winner=0, n_before=0)
    if len(rows) and len(index):
        slot, words = index.iloc[0], _words(rows["digest"])
        at = PerfectHash.load(slot["levels"]).slots(words)
        stored = np.frombuffer(slot["digests"], "<u8").reshape(-1, 4)
        member = at >= 0
        member[member] = (stored[at[member]] == words[member]).all(axis=1)
        at = np.where(member, at, 0)
        out = out.assign(member=member, winner=np.frombuffer(slot["winners"], "<i8")[at], n_before=np.frombuffer(slot["counts"], "<i8")[at])
    return out


def sha256() -> Column:
    """Of the normalised text, in lowercase hex."""
    return F.sha2(F.regexp_replace(text_of(), SPACE, " ").cast("binary"), 256)


def digests_of(docs: DataFrame) -> DataFrame:
    """doc_id and the digest of the normalised text, as 32 bytes."""
    return docs.select("doc_id", F.unhex(sha256()).alias("digest"))


def _shard(n_shards: int):
    return F.pmod(F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long"), F.lit(n_shards)).cast("int").alias("shard")


def build_index(history: DataFrame, n_shards: int) -> DataFrame:
    """history: doc_id, digest. One row for each shard that holds a digest."""
    distinct = history.groupBy("digest").agg(F.min("doc_id").alias("winner"), F.count(F.lit(1)).alias("n"))
    return distinct.where("winner is not null").select(_shard(n_shards), "*").groupBy("shard").applyInPandas(_build_shard, INDEX_SCHEMA)


def look_up(batch: DataFrame, index: DataFrame, n_shards: int) -> DataFrame:
    """batch: doc_id, digest. One row for each distinct digest: digest, min_id, n, member, winner, n_before."""
    distinct = batch.groupBy("digest").agg(F.min("doc_id").alias("min_id"), F.count(F.lit(1)).alias("n"))
    distinct = distinct.withColumn("has_id", F.col("min_id").isNotNull()).withColumn("min_id", F.coalesce("min_id", F.lit(0)))  # pandas would make null and all other ids floating
    found = (
        distinct.select(_shard(n_shards), "*").groupBy("shard").cogroup(index.groupBy("shard"))
        .applyInPandas(_look_up_shard, "digest binary, min_id long, has_id boolean, n long, member boolean, winner long, n_before long")
    )
    return found.withColumn("min_id", F.when(F.col("has_id"), F.col("min_id"))).drop("has_id")


def exact_duplicates(docs: DataFrame, split: int | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Rows with an id up to ``split`` (by default the middle of the id range)
    are the history that the index is built on; the rest is the new batch.

    Null texts equal the empty text. Rows with a null doc_id count in
    group_size and are never kept while their text has a row with an id; if
    it has none, keep_id is null and every such row stays. A row that appears
    twice with the same id appears twice here. An empty table gives no rows.
    """
    rows = keep(digests_of(docs))  # 40 bytes a row; the texts are read once
    low, high, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    split = split if split is not None else ((low or 0) + (high or 0)) // 2
    n_shards = max(1, math.ceil(n / SHARD_DIGESTS))
    old = (F.col("doc_id") <= split).eqNullSafe(True)
    history, batch = rows.where(old), rows.where(~old)
    index = build_index(history, n_shards)
    found = look_up(batch, index, n_shards)
    members = found.where("member").select("digest", F.col("winner").alias("keep_id"), (F.col("n") + F.col("n_before")).alias("group_size"))
    others = found.where("not member").groupBy("digest").agg(F.min("min_id").alias("keep_id"), F.sum("n").alias("group_size"))
    before = history.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = keep(before.join(members.select("digest"), "digest", "left_anti").unionByName(members).unionByName(others))
    large = F.col("group_size") > max(1000, n // LARGE_GROUPS)  # so LARGE_GROUPS groups at most
    often = F.broadcast(groups.where(large))
    rest = rows.join(often.select("digest"), "digest", "left_anti").join(groups.where(~large), "digest")
    return rows.join(often, "digest").unionByName(rest).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_duplicates(docs: DataFrame, split: int | None = None) -> DataFrame:
    """docs with one row of each text: a row that ``exact_duplicates`` keeps, or one without an id where no row has one."""
    found = exact_duplicates(docs, split)
    decided = found.select(F.xxhash64("doc_id", "text_sha256").alias("key"), (F.col("kept") | F.col("keep_id").isNull()).alias("stays"))
    return one_of_each(docs, F.xxhash64("doc_id", sha256()), decided)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
