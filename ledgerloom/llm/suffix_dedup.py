"""Repeated passages by a sparse suffix array over all documents.

Only suffixes at minimisers stay: of each SPAN consecutive runs of HEAD words
those with the least hash. Two passages of PASSAGE words with equal words
select the same places, so every repeated passage shares one. A suffix
carries codes of its first words and the words to its left. Spark sorts the suffixes
into ranges, which are the suffix array, a slice to a task. Suffixes of equal
heads are a group; each of its windows of PASSAGE words around the head is
found wherever it stands, and its least place (uid, at) is the one that stays.

A filter lets only suffixes through whose first HEAD words come twice in the
corpus, so that unique text is never shuffled. Suffixes of one head are in one
slice, but for heads that a slice couldn't hold, as of a passage that a third
of all documents share: these are dealt by all of their words and their place.
Then the words from the head on with which a slice begins or ends may go on in
the next one, so for each window with these words the slice passes on one row,
its first place there, and these rows are compared by the window.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import WordHashes, filter_bits, grams, keep, mix64, passes, release, small_batches, table, text_of
from ledgerloom.operators.stage import numbered

#: Words of a passage that counts, and of a suffix's head; a window of SPAN heads has PASSAGE words.
PASSAGE, HEAD = 50, 10
SPAN = PASSAGE - HEAD + 1
#: Words that a suffix carries on its left and, with its head, on its right.
LEFT, RIGHT = SPAN - 1, PASSAGE
#: Heads are compared by 64 bits, each word around them by a code of 32.
SLICE_ROWS = 50_000
#: Suffixes of a head beyond which they are dealt over slices.
HOT_ROWS = 20_000
#: Suffixes of a slice that are compared at once, or more where one head has more.
GROUP_ROWS = 5_000


def _over_windows(x: np.ndarray, size: int, better) -> np.ndarray:
    """better (minimum or maximum) over each size neighbours, by doubling."""
    done = 1
    while 2 * done <= size:
        x, done = better(x[:-done], x[done:]), 2 * done
    return better(x[: len(x) - (size - done)], x[size - done :]) if done < size else x


def minimisers(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and head hashes, from the words' hashes: heads that are the least of some SPAN in a row, equal ones all."""
    if len(h) < PASSAGE:
        return np.array([], np.int64), np.array([], np.uint64)
    g = grams(h, HEAD)
    least = np.zeros(len(g) + SPAN - 1, np.uint64)  # of the windows that hold a head, with none beyond the ends
    least[SPAN - 1 : len(g)] = _over_windows(g, SPAN, np.minimum)
    at = np.flatnonzero(_over_windows(least, SPAN, np.maximum) == g)
    return at, g[at]


def _heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = WordHashes()
    for rows in batches:
        found = [minimisers(hashes.of(t.encode("utf-8", "surrogatepass").split()))[1] for t in rows["text"]]
        heads, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.array([], np.uint64), [])
        yield pd.DataFrame({"head": heads.astype(np.int64), "n": n})


def _contexts(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each position the codes of the LEFT words before it and of the RIGHT words from it on, a row each; zeros beyond the text's ends."""
    codes = np.zeros(LEFT + len(h) + RIGHT, np.uint32)
    codes[LEFT : LEFT + len(h)] = h.astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(codes, LEFT + RIGHT)[at]


def _blobs(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as binary."""
    size = rows.shape[1] * rows.itemsize
    offsets = np.arange(0, size * len(rows) + 1, size, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _matrix(blobs: pa.Array, width: int) -> np.ndarray:
    """The rows of ``_blobs`` again."""
    if not len(blobs):
        return np.zeros((0, width), np.uint32)
    _, offsets, data = blobs.buffers()
    first, last = np.frombuffer(offsets, np.int32)[[blobs.offset, blobs.offset + len(blobs)]]
    return np.frombuffer(data, np.uint8)[first:last].view(np.uint32).reshape(-1, width)


#: hot: the head is dealt over slices.
SUFFIX = "head long, hot boolean, right binary, left binary, uid long, doc_id long, at int, n_words int"
MATCH = "uid long, doc_id long, n_words int, start int, end int, other long, earlier boolean"
#: What a slice gives: MATCH, or with a key a window that other slices may have too: n times here, for the first time at start.
FOUND = f"{MATCH}, key long, n long"


@dataclass
class Suffixes:
    """Columns of suffixes; ids stay in Arrow, where null and the largest ids have their place."""

    head: np.ndarray
    left: np.ndarray
    right: np.ndarray
    uid: np.ndarray
    at: np.ndarray
    n_words: np.ndarray
    doc_id: pa.Array

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Suffixes:
        column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        return cls(column("head"), _matrix(batch.column("left"), LEFT), _matrix(batch.column("right"), RIGHT), column("uid"), column("at").astype(np.int64), column("n_words"), batch.column("doc_id"))

    def __getitem__(self, rows: slice | np.ndarray) -> Suffixes:
        ids = self.doc_id[rows] if isinstance(rows, slice) else self.doc_id.take(pa.array(rows))
        return Suffixes(self.head[rows], self.left[rows], self.right[rows], self.uid[rows], self.at[rows], self.n_words[rows], ids)

    def __len__(self) -> int:
        return len(self.head)

    @classmethod
    def joined(cls, parts: list[Suffixes]) -> Suffixes:
        whole = lambda c: np.concatenate([getattr(p, c) for p in parts])
        return cls(*map(whole, ("head", "left", "right", "uid", "at", "n_words")), pa.concat_arrays([p.doc_id for p in parts]))


def _prefixes(codes: np.ndarray) -> np.ndarray:
    """Hashes of each row's first 0, 1 ... codes, a line for each number."""
    out = np.zeros((codes.shape[1] + 1, len(codes)), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(codes.shape[1]):
            out[k + 1] = mix64(out[k] * np.uint64(0x9E3779B97F4A7C15) + codes[:, k].astype(np.uint64), k)
    return out


def _windows(rows: Suffixes) -> tuple[np.ndarray, ...]:
    """Of each window of PASSAGE words around a head: its key, the first and the second row that have it, how many have it; and the hashes of the words from the head on.

    rows are in order of uid and at. An array has a line for each number of
    words that a window has on the left of the head; where the text is too
    short for a window, no row has it.
    """
    left, right = _prefixes(rows.left[:, ::-1]), _prefixes(rows.right)  # nearest first
    head = rows.head.astype(np.uint64)
    keys = np.zeros((SPAN, len(rows)), np.uint64)
    first, second, n = (np.zeros((SPAN, len(rows)), np.int32) for _ in range(3))
    for before in range(SPAN):
        with np.errstate(over="ignore"):
            keys[before] = mix64(mix64(left[before], before) + right[PASSAGE - before] + head * np.uint64(0x9E3779B97F4A7C15))
        there = np.flatnonzero((rows.at >= before) & (rows.n_words - rows.at >= PASSAGE - before))
        if not len(there):
            continue
        order = np.argsort(keys[before, there], kind="stable")
        row, key = there[order], keys[before, there[order]]
        new = np.append(True, key[1:] != key[:-1])
        begin, group = np.flatnonzero(new), np.cumsum(new) - 1
        first[before, row] = row[begin][group]
        second[before, row] = row[np.minimum(begin + 1, len(row) - 1)][group]
        n[before, row] = np.diff(np.append(begin, len(row)))[group]
    return keys, first, second, n, right


def _slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FOUND of a slice."""
    held, n, ends = [], 0, []
    for batch in batches:
        rows, hot = Suffixes.of(batch), batch.column("hot")
        if not len(rows):
            continue
        if not ends and hot[0].as_py():
            ends = [rows[:1]]  # the slice before may end with such words
        last = rows[-1:] if hot[-1].as_py() else None
        held, n = [*held, rows], n + len(rows)
        if n >= GROUP_ROWS and held[0].head[0] != rows.head[-1]:
            rows = Suffixes.joined(held)
            cut = int(rows.head.searchsorted(rows.head[-1]))
            yield from _groups(rows[:cut], ends)
            held, n = [rows[cut:]], len(rows) - cut
    if held:
        yield from _groups(Suffixes.joined(held), ends if last is None else [*ends, last])
    del held
    release()


def _groups(rows: Suffixes, ends: list[Suffixes]) -> Iterator[pa.RecordBatch]:
    """FOUND of all suffixes of some heads. ends: the suffixes with which the slice begins and ends, if other slices may have their words too."""
    rows = rows[np.lexsort((rows.at, rows.uid))]
    keys, first, second, n, right = _windows(rows)
    here, edge = np.arange(len(rows)), np.zeros(first.shape, bool)
    for end in ends:
        edge |= (rows.head == end.head[0]) & (right == _prefixes(end.right))[PASSAGE - SPAN + 1 :][::-1]

    def of(row: np.ndarray, start: np.ndarray, end: np.ndarray, other: pa.Array, earlier: np.ndarray, key: pa.Array | None = None, times: pa.Array | None = None) -> pa.RecordBatch:
        none = pa.nulls(len(row), pa.int64())
        columns = [pa.array(rows.uid[row]), rows.doc_id.take(pa.array(row)), pa.array(rows.n_words[row]), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), other, pa.array(earlier), none if key is None else key, none if times is None else times]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in FOUND.split(", ")])

    # Windows in a row with the same other place are one match.
    is_first = first == here
    said = np.where((n > 1) & ~(edge & is_first), 2 * np.where(is_first, second, first) + ~is_first, -1).T
    new = np.ones(said.shape, bool)
    new[:, 1:] = said[:, 1:] != said[:, :-1]
    begin = np.flatnonzero(new)
    end, code = np.append(begin[1:], said.size), said.ravel()[begin]
    begin, end, code = begin[code >= 0], end[code >= 0], code[code >= 0]
    row, least, most = begin // SPAN, begin % SPAN, (end - 1) % SPAN
    other, earlier = code // 2, code % 2 == 1
    start, end = rows.at[row] - most, rows.at[row] - least + PASSAGE
    # Where the other place is in the same text and overlaps, only what lies behind that place counts as later.
    behind = rows.at[other] - least + PASSAGE
    over = earlier & (rows.uid[row] == rows.uid[other]) & (behind > start)
    row, other = np.append(row, row[over]), np.append(other, other[over])
    start, end, earlier = np.append(start, np.maximum(start, behind)[over]), np.append(end, end[over]), np.append(earlier & ~over, np.ones(int(over.sum()), bool))
    # What overlaps in a text is one match from here on, with one of the other places: a text of one word again and again has many.
    begins, start, end = _islands(rows.uid[row], earlier, start, end)
    yield of(row[begins], start, end, rows.doc_id.take(pa.array(other[begins])), earlier[begins])

    before, row = np.nonzero(edge & is_first & (n > 0))
    start, several = rows.at[row] - before, n[before, row]
    following = rows.doc_id.take(pa.array(second[before, row], mask=several == 1))
    yield of(row, start, start + PASSAGE, following, np.zeros(len(row), bool), pa.array(keys[before, row].astype(np.int64)), pa.array(several.astype(np.int64)))


def _islands(uid: np.ndarray, earlier: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the same uid and kind that overlap or touch as one: the number of a span in each, its start and its end."""
    if not len(uid):
        return np.array([], np.int64), start, end
    order = np.lexsort((start, earlier, uid))
    uid, earlier, start, end = uid[order], earlier[order], start[order], end[order]
    group = np.cumsum(np.append(True, (uid[1:] != uid[:-1]) | (earlier[1:] != earlier[:-1]))).astype(np.int64) << 32
    reach = np.maximum.accumulate(group + end)  # starts anew with each group, as its numbers are larger
    begins = np.flatnonzero(np.append(True, group[1:] + start[1:] > reach[:-1]))
    return order[begins], start[begins], np.maximum.reduceat(end, begins)


def _in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text and uid, a number for each row in order of id, then of the text's digest, wherever the rows lie. Ids that are all there and all different number the rows themselves; otherwise the rows are sorted for it, nulls first."""
    rows = docs.select("doc_id", text_of().alias("text"))
    if rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").isEmpty():
        return rows.select(F.col("doc_id").alias("uid"), "doc_id", "text")
    rows = keep(rows.withColumn("row", F.monotonically_increasing_id()))
    places = numbered(rows.select("doc_id", F.sha2("text", 256).alias("digest"), "row"), ["doc_id", "digest", "row"], "uid")  # rows that are equal in both may stand either way
    return rows.join(places.select("row", "uid"), "row").select("uid", "doc_id", "text")


def matches(docs: DataFrame) -> DataFrame:
    """MATCH for the places of all windows of PASSAGE words that stand in two places or more; those of one head that overlap in a text come as one."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = _in_order(docs)
    heads = rows.select("text").mapInPandas(_heads, "head long, n long").groupBy("head").agg(F.sum("n").alias("n")).where("n > 1")
    heads = keep(heads)
    n_suffixes = heads.agg(F.sum("n")).first()[0] or 0
    hot_heads = np.sort(heads.where(F.col("n") > HOT_ROWS).select("head").toArrow()["head"].to_numpy())  # one for HOT_ROWS suffixes at most
    bits = spark.sparkContext.broadcast(filter_bits("head", heads))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, mask = WordHashes(), np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            row, heads, places, n_words, around = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                h = hashes.of(text.encode("utf-8", "surrogatepass").split())
                at, head = minimisers(h)
                if len(at) and (hit := passes(mask, head)).any():
                    at, head = at[hit], head[hit]
                    row.append(np.full(len(at), i))
                    heads.append(head.astype(np.int64))
                    places.append(at.astype(np.int32))
                    n_words.append(np.full(len(at), len(h), np.int32))
                    around.append(_contexts(h, at))
            if row:
                around, of = np.concatenate(around), pa.array(np.concatenate(row))
                heads = np.concatenate(heads)
                columns = [pa.array(heads), pa.array(np.isin(heads, hot_heads)), _blobs(around[:, LEFT:]), _blobs(around[:, :LEFT]), batch.column("uid").take(of), batch.column("doc_id").take(of), pa.array(np.concatenate(places)), pa.array(np.concatenate(n_words))]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SUFFIX.split(", ")])
        del hashes
        release()

    order = ["head", "right", "uid", "at"]
    kept = keep(rows.mapInArrow(suffixes, SUFFIX))  # the ranges are found by a look at all of them
    bounds = ["head", *[F.when(F.col("hot"), F.col(c)) for c in order[1:]]]
    array = kept.repartitionByRange(max(1, math.ceil(n_suffixes / SLICE_ROWS)), *bounds).sortWithinPartitions(*order)
    found = keep(array.mapInArrow(_slice, FOUND))

    # Windows of heads that several slices may have: one row for each slice and window.
    columns = [c.split()[0] for c in MATCH.split(", ")]
    by = Window.partitionBy("key").orderBy("uid", "start")
    place = F.first(F.struct("uid", "start", F.col("doc_id").alias("id"))).over(by)
    edge = found.where("key is not null").withColumn("rank", F.row_number().over(by)).withColumn("next", F.lead(F.struct(F.col("doc_id").alias("id"))).over(by)).withColumn("place", place)
    edge = edge.where("rank > 1 or n > 1 or next is not null").withColumn("other", F.when(F.col("rank") > 1, F.col("place.id")).when(F.col("n") > 1, F.col("other")).otherwise(F.col("next.id")))
    until = F.when((F.col("rank") > 1) & (F.col("place.uid") == F.col("uid")), F.col("place.start") + PASSAGE).otherwise(0)
    edge = edge.withColumn("until", until).withColumn("over", F.col("until") > F.col("start")).withColumn("earlier", (F.col("rank") > 1) & ~F.col("over"))
    behind = F.struct(*[{"start": F.col("until"), "earlier": F.lit(True)}.get(c, F.col(c)).alias(c) for c in columns])
    edge = edge.select(F.inline(F.when(F.col("over"), F.array(F.struct(*columns), behind)).otherwise(F.array(F.struct(*columns)))))
    return found.where("key is null").select(columns).unionByName(edge)


def _merged(spans: DataFrame, name: str) -> DataFrame:
    """uid and the union of each uid's spans (start, end), in order."""
    by = Window.partitionBy("uid").orderBy("start", "end")
    begins = F.coalesce(F.col("start") > F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    islands = spans.withColumn("begins", begins).withColumn("island", F.sum(F.col("begins").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    unions = islands.groupBy("uid", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return unions.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(name))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """A row for each row of docs that has a passage of PASSAGE words which stands elsewhere too, in it or another.

    uid (of the row), doc_id, n_words, spans (start and end of the repeated
    words, counted in words), cut_spans (the words of each window of PASSAGE
    words that stands at an earlier place too, in order of doc_id (nulls first),
    then the text's digest, then place, however the rows lie; where both places
    overlap in one text, only what lies behind the earlier one),
    other_ids (documents that share the passages: for the windows around a head
    one of an earlier place, or for the earliest place one of a later). Words
    are runs without the six ASCII blanks.

    Null texts equal the empty text; texts of fewer than PASSAGE words are
    never in the result, nor are rows of an empty table. Repeated rows repeat
    each other's passages. Only doc_id and text are read.
    """
    found = keep(matches(docs))
    rows = found.groupBy("uid").agg(F.any_value("doc_id").alias("doc_id"), F.any_value("n_words").alias("n_words"), F.sort_array(F.collect_set("other")).alias("other_ids"))
    spans, cut = _merged(found.select("uid", "start", "end"), "spans"), _merged(found.where("earlier").select("uid", "start", "end"), "cut_spans")
    none = F.array().cast("array<struct<start:int,end:int>>")
    return rows.join(spans, "uid").join(cut, "uid", "left").select("uid", "doc_id", "n_words", "spans", F.coalesce("cut_spans", none).alias("cut_spans"), "other_ids")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    found = repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), words("spans").alias("n_repeated_words"), words("cut_spans").alias("n_cut_words"), written("spans").alias("spans"), written("cut_spans").alias("cut_spans"), "other_ids")
