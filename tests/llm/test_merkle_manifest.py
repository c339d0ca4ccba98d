import hashlib
import random
import zlib

from pyspark.sql import functions as F

from ledgerloom.llm import merkle_manifest as M

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, hash string, place string, size string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels_over(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def path(levels, at):
    """(before, after) of each level below the root."""
    out = []
    for level in levels[:-1]:
        run = at // 3 * 3
        out.append(("".join(level[run:at]), "".join(level[at + 1 : run + 3])))
        at //= 3
    return out


def plain(rows):
    def leaf(row, text):
        values = [None if v is None else str(v) for v in (*row[:4], text)]
        return digest("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))

    sources = {}
    for row in rows:
        text = row[4]
        if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and text is not None:
            text = text.replace("\n", "")
        sources.setdefault(row[1], []).append((row[0], leaf(row, row[4]), leaf(row, text)))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for rows_of in sources.values():
        rows_of.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: levels_over([x[1] for x in sources[s]]) for s in order}
    top = levels_over([trees[s][-1][0] for s in order])
    out = []
    for i, s in enumerate(order):
        for at, (doc_id, h, other) in enumerate(sources[s]):
            steps = path(trees[s], at) + path(top, i)
            root = other
            for before, after in steps:
                root = digest(before + root + after)
            out.append((doc_id, h, trees[s][-1][0], top[-1][0], digest("".join(a + b for a, b in steps)), root, root == top[-1][0]))
    return sorted(out, key=str)


def run(spark, rows, tmp_path, name):
    extra = [(*r, "clash", "clash", "clash") for r in rows]
    spark.createDataFrame(extra, SCHEMA).repartition(5).write.parquet(str(tmp_path / name / "documents.parquet"))
    return sorted(map(tuple, M.op13_merkle_manifest(spark, str(tmp_path / name)).collect()), key=str)


def test_against_plain_version(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        text = rng.choice(["one\ntwo", "plain", "", None, "ü\n\n"])
        rows.append((i, rng.choice(["hot"] * 5 + ["é", "a", "Z", "", None]), rng.choice(["en", None]), rng.choice([None, 5]), text))
    rows += [(None, "a", None, None, "x\ny"), (None, "a", None, None, "z"), (7, "hot", "en", 1, "again\n"), (7, "hot", "en", 1, "again\n"), (-4, "alone", "en", 3, "a\n" * 200_000)]
    assert run(spark, rows, tmp_path, "many") == plain(rows)


def test_small_tables(spark, tmp_path):
    for name, rows in (("none", []), ("one", [(1, None, None, None, "a\nb")]), ("three", [(i, "s", "en", 1, f"t{i}\n") for i in range(3)]), ("ten", [(i, f"s{i}", "en", 1, f"t{i}\n") for i in range(10)]), ("equal", [(5, "s", "en", 1, "t")] * 11)):
        assert run(spark, rows, tmp_path, name) == plain(rows), name


def test_levels_are_thirds(spark):
    nodes = spark.range(28).select(F.lit(0).alias("tree"), F.col("id").alias("place"), F.lit(28).cast("long").alias("size"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    levels, roots = M.build(nodes)
    assert [x.count() for x in levels] == [10, 4, 2, 1] and roots.count() == 1
    proofs = M.push(nodes, levels, roots.select("tree", F.col("hash").alias("root"), F.array().cast(M.STEPS).alias("steps")))
    assert proofs.where(M.folded(F.col("hash"), F.col("steps")) == F.col("root")).count() == 28
