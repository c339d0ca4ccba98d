"""Hard negatives by a full sort of every anchor's scores.

All rows are scored against all anchors in cells, a block of anchors by a block
of rows. In a cell the scores of an anchor are sorted by score and id, so the
cells of an anchor are the sorted runs of one long order: the best of the
runs' first rows are its first rows, and a limit is found in each run by binary
search. Two passes go over the cells. The first takes from each run the first
rows with the anchor's label, and of those the anchor's positives. The second
searches each positive's upper limit in each run and reads from there rows with
another label down to the lower limit. What a run gives is at most as many rows
as are asked for, so nothing unbounded is ever gathered: a cell holds a block of
rows, whatever the table's size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import forget, keep, release, table

#: Rows and anchors of a cell at most, about; scores that a task holds at a time.
BLOCK_ROWS, BLOCK_ANCHORS, SCORES = 65_536, 1024, 1 << 20
#: Blocks of rows that even a small table is dealt into, so that there is work for all cores.
LEAST_BLOCKS = 12
INT64 = np.iinfo(np.int64)


def quantised(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label and whole-numbered components of the rows that take part."""
    x = lambda c: c.cast("double")
    finite = F.forall("embedding", lambda c: F.coalesce(~F.isnan(x(c)) & (F.abs(x(c)) != float("inf")), F.lit(False)))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    return rows.select("vec_id", "label", F.transform("embedding", lambda c: F.floor(F.lit(scale) * x(c))).alias("v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    whole = column.combine_chunks()
    n = np.diff(whole.offsets.to_numpy())
    flat = whole.flatten().to_numpy(zero_copy_only=False)
    width = int(n.max()) if len(n) else 0
    if (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width), np.int64)
    out[np.arange(width) < n[:, None]] = flat
    return out


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products; one beyond 64 bits counts as the nearest end."""
    width = min(anchors.shape[1], rows.shape[1])
    a, b = anchors[:, :width], rows[:, :width]
    size = lambda m: max(abs(int(m.min())), abs(int(m.max()))) if m.size else 0
    most = width * size(a) * size(b)
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), INT64.min, INT64.max).astype(np.int64)


def _sorted_runs(anchors: pa.Table, rows: pa.Table):
    """Each anchor with the rows in order of its scores, ties by id: number of the anchor, places of the rows, their scores."""
    ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
    a, b = _matrix(anchors["v"]), _matrix(rows["v"])
    step = max(1, SCORES // max(1, len(ids)))
    for at in range(0, len(a), step):
        for i, row in enumerate(scores(a[at : at + step], b), at):
            order = np.lexsort((labels, ids, -np.maximum(row, INT64.min + 1)))
            yield i, order, row[order]


def _first_of_label(count: int):
    def cell(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        ids, labels, numbers = (rows[c].to_numpy() for c in ("vec_id", "label", "number"))
        of, own = anchors["number"].to_numpy(), anchors["label"].to_numpy()
        out = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i, order, score in _sorted_runs(anchors, rows):
            first = np.flatnonzero((labels[order] == own[i]) & (numbers[order] != of[i]))[:count]
            for part, x in zip(out, (np.full(len(first), of[i]), ids[order[first]], score[first]), strict=True):
                part.append(x)
        release()
        return pa.table([pa.array(np.concatenate(x), pa.int64()) for x in out], ["anchor", "positive_id", "positive_score"])

    return cell


def limits(positive_score: int, low: int, high: int) -> tuple[int, int]:
    """The least and the most score of a negative, with low and high in hundredths of the positive's."""
    return -(-low * positive_score // 100), high * positive_score // 100


def _read_negatives(count: int, low: int, high: int):
    def cell(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        of, own, positives = anchors["number"].to_pylist(), anchors["label"].to_numpy(), anchors["positives"].to_pylist()
        out = []
        for i, order, score in _sorted_runs(anchors, rows):
            other = np.flatnonzero(labels[order] != own[i])
            descending = -np.maximum(score[other], INT64.min + 1)
            for p in positives[i]:
                least, most = limits(p["positive_score"], low, high)
                begin, end = np.searchsorted(descending, max(-most, INT64.min)), np.searchsorted(descending, min(-least, INT64.max), side="right")
                taken = other[begin : min(end, begin + count)]
                out += [(of[i], p["number"], int(x), int(s)) for x, s in zip(ids[order[taken]], score[taken], strict=True)]
        release()
        names = ("anchor", "positive", "negative_id", "negative_score")
        return pa.table([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], list(names))

    return cell


def _first(rows: DataFrame, key: list[str], score: str, id_: str, count: int, name: str) -> DataFrame:
    by = Window.partitionBy(*key).orderBy(F.col(score).desc(), id_)
    return rows.withColumn(name, F.row_number().over(by)).where(F.col(name) <= count)


def mine(rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """rows: vec_id, label and v, an array of long. For each anchor and positive its first negatives.

    Scores go down, ties up by id. An anchor's positives are the first other
    rows of its label; a row that comes twice is two rows, and so an anchor
    that comes twice gives its rows twice. Negatives have another label and a
    score between low and high hundredths of the positive's; a negative
    positive score leaves none. Vectors of other lengths are filled up with
    zeros. Rows that are equal in score and id may be taken for one another.
    An empty table, one without anchors and a label of one row give no rows.
    """
    kept = keep(rows.withColumn("number", F.monotonically_increasing_id()).withColumn("anchor", is_anchor))
    n, n_anchors = kept.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    blocks, sets = max(min(LEAST_BLOCKS, n), math.ceil(n / BLOCK_ROWS)), max(1, math.ceil(n_anchors / BLOCK_ANCHORS))
    place = lambda k, seed: F.pmod(F.xxhash64("number", F.lit(seed)), F.lit(k)).cast("int")
    names = ("number", "vec_id", "label", "v")
    anchors = kept.where("anchor").select(*[F.col(c).alias(c) for c in names])  # columns of their own, for the two sides of a cell
    body = kept.select(*names, place(max(1, blocks), 1).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("set")).groupBy("set", "block")
    asked = lambda frame: frame.select("*", place(sets, 2).alias("set"), F.explode(F.sequence(F.lit(0), F.lit(max(1, blocks) - 1))).alias("block")).groupBy("set", "block")
    runs = asked(anchors).cogroup(body).applyInArrow(_first_of_label(n_positives), "anchor long, positive_id long, positive_score long")
    chosen = keep(_first(runs, ["anchor"], "positive_score", "positive_id", n_positives, "place"))
    listed = chosen.groupBy("anchor").agg(F.collect_list(F.struct(F.col("place").cast("long").alias("number"), "positive_score")).alias("positives"))
    with_positives = anchors.join(listed.withColumnRenamed("anchor", "number"), "number")
    found = asked(with_positives).cogroup(body).applyInArrow(_read_negatives(n_negatives, low, high), "anchor long, positive long, negative_id long, negative_score long")
    ranked = keep(_first(found, ["anchor", "positive"], "negative_score", "negative_id", n_negatives, "rank"))
    ids = anchors.select(F.col("number").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = ranked.join(chosen.withColumnRenamed("place", "positive"), ["anchor", "positive"]).join(ids, "anchor")
    out = keep(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    forget(kept, chosen, ranked)
    return out


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"))
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", noisy.cast("long")), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: cast(floor(256 * cast(x AS double)) AS bigint)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, r.vec_id, r.label, cast(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * r.v[i])) AS bigint) AS score
  FROM e a JOIN e r ON a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, cast(row_number() OVER w AS int) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.own AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY rank <= 3
"""
