import math
import random

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import hard_negatives as M

SCHEMA = "vec_id long, embedding array<float>, label int, number string, block string, v string"


def plain(rows, every=50):
    used = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        used.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    out = []
    for k, (anchor_id, label, v) in enumerate(used):
        if anchor_id % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), i, other, j) for j, (i, other, w) in enumerate(used)]  # noqa: B905
        scored.sort()
        for score, positive_id, *_ in [x for x in scored if x[2] == label and x[3] != k][:5]:
            good = [x for x in scored if x[2] != label and 50 * -score <= 100 * -x[0] <= 95 * -score][:3]
            out += [(anchor_id, positive_id, rank, x[1], -score, -x[0]) for rank, x in enumerate(good, 1)]
    return sorted(out)


def run(spark, rows, tmp_path, name):
    spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA).repartition(3).write.parquet(str(tmp_path / name / "embeddings.parquet"))
    return sorted(map(tuple, M.op12_hard_negatives(spark, str(tmp_path / name)).collect()))


def test_against_plain_version(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_ROWS", 150)
    monkeypatch.setattr(M, "BLOCK_ANCHORS", 3)
    rng = random.Random(5)
    common = [0.5, 0.25, -0.125, 0.75]
    rows = [(i, common if rng.random() < 0.3 else [rng.uniform(-1, 1) for _ in range(4)], rng.randrange(4)) for i in range(700)]
    rows += [(1000, None, 1), (1001, [0.1, None, 0.2, 0.3], 1), (1002, [0.1, float("nan"), 0.2, 0.3], 1), (1003, [float("inf"), 0.0, 0.0, 0.0], 1), (1004, [0.1, 0.2, 0.3, 0.4], None), (None, [0.9, 0.9, 0.9, 0.9], 1)]
    rows += [(1050, [0.0, 0.0, 0.0, 0.0], 2), (1100, [0.3, 0.4], 2), (1101, [], 3), (-50, [0.5, 0.5, 0.5, 0.5], 1), (rows[100][0], rows[100][1], rows[100][2]), (1150, common, 9)]
    got = run(spark, rows, tmp_path, "many")
    assert got == plain(rows) and len(got) > 50


def test_small_tables(spark, tmp_path):
    for name, rows in (("none", []), ("no anchor", [(1, [1.0], 1)]), ("alone", [(50, [1.0], 1), (51, [0.8], 2)]), ("pair", [(50, [1.0], 1), (51, [1.0], 1), (52, [0.8], 2)])):
        assert run(spark, rows, tmp_path, name.replace(" ", "")) == plain(rows), name


def test_scores_are_exact_at_any_size(spark):
    rng = np.random.default_rng(1)
    for most in (1 << 8, 1 << 27, 1 << 30, 1 << 40):
        a, b = rng.integers(-most, most, (5, 64)), rng.integers(-most, most, (7, 64))
        want = [[max(M.INT64.min, min(M.INT64.max, sum(int(x) * int(y) for x, y in zip(r, s, strict=True)))) for s in b] for r in a]
        assert M.scores(a, b).tolist() == want
    assert M.limits(7, 50, 95) == (4, 6) and M.limits(-7, 50, 95) == (-3, -7) and M.limits(0, 50, 95) == (0, 0)


def test_other_anchors_and_counts(spark):
    rows = spark.createDataFrame([(i, i % 2, [10 - i, 1]) for i in range(8)], "vec_id long, label long, v array<long>")
    got = M.mine(rows, F.col("vec_id") == 0, n_positives=1, n_negatives=2, low=10, high=100).collect()
    assert [(r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in sorted(got)] == [(2, 1, 3, 81, 71), (2, 2, 5, 81, 51)]
