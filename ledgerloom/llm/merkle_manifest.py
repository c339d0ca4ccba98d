"""A Merkle manifest of a table: digests built bottom-up, proofs pushed top-down.

Every row is a leaf. The leaves of a source form a tree, whose root is the
source's subroot; the subroots form a tree of the same kind. Each level is
written as a table of its own: a node has its place in its tree and the
digests of its children, so the level below finds its parent by an equi-join
on (tree, place). Proofs come down the same way: a child's proof is its own
siblings, then what its parent inherited.

Places are numbered by ranges: rows are sorted into ranges by Spark and written
with their number, and a range starts where the ones before it end. So no task
sees a whole source, however large it is. A level is a third of the one below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import forget, keep, table

#: Children of a node.
ARITY = 3
#: Rows of a range, about, beyond which there are more ranges than the session's shuffle partitions.
RANGE_ROWS = 1_000_000
#: What a leaf is made of, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<before:string,after:string>>"


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def framed(value: Column) -> Column:
    """A value with its length in bytes before it, so that no two rows read alike; a null is a dash."""
    return F.coalesce(F.concat(F.octet_length(value.cast("string")).cast("string"), F.lit(":"), value.cast("string")), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    """A row's digest; text stands for its text."""
    return _digest(F.concat(*[framed(text if c == "text" and text is not None else F.col(c)) for c in COLUMNS]))


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Kept rows with _range and _at, and per group (null is one too) and range the place of its first row: _range, _first, before and size, the group's rows.

    A row's place in its group is _at - _first + before.
    """
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    key = [F.col(c) for c in (*group, *order)]
    ranged = rows.repartitionByRange(n, *key).sortWithinPartitions(*key).withColumn("_at", F.monotonically_increasing_id())
    ranged = keep(ranged.withColumn("_range", F.shiftright("_at", 33).cast("int")))
    counts = ranged.groupBy(*group, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*group)  # one row for each range that a group has a part of
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return ranged, counts.select(*group, "_range", "_first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("size"))


def build(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """nodes: tree, place, size (of the tree's level) and hash. The levels above, each with the hashes of a node's kids, and a root for each tree: tree, hash."""
    height, most = 0, nodes.agg(F.max("size")).first()[0] or 0
    while most > 1:
        most, height = -(-most // ARITY), height + 1
    levels, below = [], nodes
    for _ in range(height):
        parent = F.floor(F.col("place") / ARITY).alias("place")
        kids = F.transform(F.sort_array(F.collect_list(F.struct("place", "hash"))), lambda x: x["hash"])  # three at most
        rows = below.where("size > 1").groupBy("tree", parent).agg(F.ceil(F.first("size") / ARITY).alias("size"), kids.alias("kids"))
        below = keep(rows.withColumn("hash", _digest(F.array_join("kids", ""))))
        levels.append(below)
    roots = nodes.where("size = 1").select("tree", "hash")
    for level in levels:
        roots = roots.unionByName(level.where("size = 1").select("tree", "hash"))
    return levels, roots


def push(nodes: DataFrame, levels: list[DataFrame], inherited: DataFrame) -> DataFrame:
    """nodes with what their tree inherits (tree, steps and further columns): steps becomes a node's proof, from its siblings up.

    A step has the digests that stand before and after the one that is proven.
    """
    rest = [c for c in inherited.columns if c not in ("tree", "steps")]
    above = None
    for k in range(len(levels), -1, -1):
        here = levels[k - 1] if k else nodes
        own = here.where("size = 1").join(inherited, "tree")
        if above is not None:
            of_parent = above.select("tree", F.col("place").alias("_parent"), F.col("kids").alias("_kids"), "steps", *rest)
            child = here.where("size > 1").withColumn("_parent", F.floor(F.col("place") / ARITY))
            at = F.pmod("place", F.lit(ARITY)).cast("int")
            step = F.struct(F.array_join(F.slice("_kids", F.lit(1), at), "").alias("before"), F.array_join(F.slice("_kids", at + 2, F.lit(ARITY)), "").alias("after"))
            below = child.join(of_parent, ["tree", "_parent"]).withColumn("steps", F.concat(F.array(step), "steps")).drop("_parent", "_kids")
            own = own.unionByName(below)
        above = keep(own) if k else own
    return above


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(steps, start, lambda h, s: _digest(F.concat(s["before"], h, s["after"])))


def proof_digest(steps: Column) -> Column:
    return _digest(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""))


def manifest(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, leaf, other_leaf (with altered in place of its text), subroot, root and steps, its proof.

    A null is a value of its own in every column; a null source comes first
    and is one source, null ids come first in theirs. Rows with one id stand
    in order of their digests, rows that are equal in all columns have places
    next to each other. A source with one row has its leaf as subroot, a
    table with one source its subroot as root. An empty table gives no rows.
    Other columns of docs are not looked at.
    """
    text = F.col("text") if altered is None else altered
    leaves = keep(docs.select("doc_id", "source", leaf().alias("hash"), leaf(text).alias("other_leaf")).withColumn("_row", F.monotonically_increasing_id()))
    ranged, starts = numbered(leaves, ["source"], ["doc_id", "hash", "_row"])  # _row parts the ranges of rows that are equal
    starts = keep(starts)
    sources, first = numbered(starts.groupBy("source").agg(F.first("size").alias("n_leaves")), [], ["source"])
    place = (F.col("_at") - F.col("_first") + F.col("before")).alias("place")
    trees = keep(sources.join(first, "_range").select("source", F.col("n_leaves").alias("size"), place.alias("tree"), F.col("size").alias("n_trees")))
    placed = starts.alias("s").join(trees.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("t.tree", F.col("s.source").alias("_source"), F.col("_range").alias("_part"), "_first", "before", "s.size")
    nodes = ranged.join(placed, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_part"))).select("tree", place, "size", "doc_id", "hash", "other_leaf")
    nodes = keep(nodes)
    levels, subroots = build(nodes)
    tops = keep(trees.join(subroots, "tree").select(F.lit(0).alias("tree"), F.col("tree").alias("place"), F.col("n_trees").alias("size"), "hash"))
    top_levels, roots = build(tops)
    whole = roots.select("tree", F.col("hash").alias("root"), F.array().cast(STEPS).alias("steps"))
    proven = push(tops, top_levels, whole).select(F.col("place").alias("tree"), F.col("hash").alias("subroot"), "root", "steps")
    proven = keep(proven)
    forget(leaves, ranged, sources, starts)
    return push(nodes, levels, proven).select("doc_id", F.col("hash").alias("leaf"), "other_leaf", "subroot", "root", "steps")


def tampered() -> Column:
    """The text without its line feeds, in documents whose id has an even checksum."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(F.coalesce(even, F.lit(False)), F.translate("text", "\n", "")).otherwise(F.col("text"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest(table(spark, sf_dir, "documents"), tampered())
    return rows.withColumn("folded_root", folded(F.col("other_leaf"), F.col("steps"))).select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def _framed_sql(c: str) -> str:
    return f"coalesce(strlen(cast({c} AS varchar)) || ':' || cast({c} AS varchar), '-')"


def _levels_sql(name: str, leaves: str) -> str:
    """The nodes of all levels over leaves (tree, place, size, hash)."""
    return f"""{name} AS (
  SELECT 0 AS level, tree, place, size, hash FROM {leaves} UNION ALL
  SELECT any_value(level) + 1, tree, place // 3, any_value(size + 2) // 3, sha256(string_agg(hash, '' ORDER BY place)) FROM {name} WHERE size > 1 GROUP BY tree, place // 3)"""


def _steps_sql(name: str, leaves: str, levels: str) -> str:
    """Per leaf its steps as texts, what stands before and after parted by a bar."""
    return f"""{name}_one AS (
  SELECT l.tree, l.place, n.level, coalesce(string_agg(n.hash, '' ORDER BY n.place) FILTER (n.place < l.place // cast(pow(3, n.level) AS bigint)), '') || '|' || coalesce(string_agg(n.hash, '' ORDER BY n.place) FILTER (n.place > l.place // cast(pow(3, n.level) AS bigint)), '') AS step
  FROM {leaves} l JOIN {levels} n ON n.tree = l.tree AND n.size > 1 AND n.place // 3 = l.place // cast(pow(3, n.level) AS bigint) // 3 GROUP BY 1, 2, 3),
{name} AS (SELECT tree, place, list(step ORDER BY level) AS steps FROM {name}_one GROUP BY 1, 2)"""


_TAMPERED = "CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END"
_FRAMES = " || ".join(_framed_sql(c) for c in COLUMNS[:-1])
ORACLE = f"""
WITH RECURSIVE byte AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crcs FROM range(256) r(i)),
summed AS (SELECT d.*, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id AS varchar), ''), lambda c: ascii(c)::bigint)), lambda a, c: xor(a >> 8, crcs[cast(xor(a, c) & 255 AS bigint) + 1])), 4294967295) AS crc FROM documents d, byte),
hashed AS (SELECT doc_id, source, sha256({_FRAMES} || {_framed_sql("text")}) AS hash, sha256({_FRAMES} || {_framed_sql(f"({_TAMPERED})")}) AS other FROM summed),
leaves AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, hash) - 1 AS place, count(*) OVER (PARTITION BY source) AS size FROM hashed),
{_levels_sql("nodes", "leaves")},
tops AS (SELECT 0 AS tree, tree AS place, count(*) OVER () AS size, hash FROM nodes WHERE size = 1),
{_levels_sql("upper_nodes", "tops")},
{_steps_sql("low", "leaves", "nodes")}, {_steps_sql("high", "tops", "upper_nodes")},
proven AS (
  SELECT l.doc_id, l.hash AS leaf, l.other, t.hash AS subroot, (SELECT hash FROM upper_nodes WHERE size = 1) AS root, list_concat(coalesce(low.steps, []), coalesce(high.steps, [])) AS steps
  FROM leaves l JOIN tops t ON t.place = l.tree LEFT JOIN low ON low.tree = l.tree AND low.place = l.place LEFT JOIN high ON high.place = l.tree)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '|', '')) AS proof_sha256,
  list_reduce(list_prepend(other, steps), lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2))) AS folded_root, folded_root = root AS verified
FROM proven
"""
