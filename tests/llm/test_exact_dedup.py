import hashlib
import random
import re

import numpy as np

from ledgerloom.llm.exact_dedup import PerfectHash, drop_duplicates, exact_duplicates

SCHEMA = "doc_id long, text string, keep_id string"


def brute(rows):
    digest = [hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest() for _, t in rows]
    out = []
    for (i, _), d in zip(rows, digest, strict=True):
        ids = [j for (j, _), e in zip(rows, digest, strict=True) if e == d]
        keep = min((j for j in ids if j is not None), default=None)
        out.append((i, keep, len(ids), i == keep, d))
    return sorted(out, key=str)


def test_hash_is_perfect_and_minimal():
    words = np.random.default_rng(1).integers(0, 2**63, (5000, 4)).astype(np.uint64)
    words[:50, :3] = words[0, :3]  # keys that share most of their bits
    mph = PerfectHash.load(PerfectHash.build(words).dump())
    assert sorted(mph.slots(words)) == list(range(5000))
    assert len(PerfectHash.build(words[:0]).slots(words)) == 5000


def test_against_brute_force(spark):
    rng = random.Random(3)
    texts = ["a b", "a  b", "a\tb", "A b", "", None, " ", "é", "x" * 50_000, "hot"]
    rows = [(i, rng.choice([*texts, "hot", "hot", f"u{i}"])) for i in range(200)] + [(7, "a b"), (7, "a b"), (None, "hot"), (None, "only here")]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA).repartition(5)
    for split in (None, -1, 50, 500):
        assert sorted(map(tuple, exact_duplicates(frame, split).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_groups_and_large_ids_beside_null(spark):
    big = 9007199254740993
    rows = [(big + 2 * i, "hot") for i in range(1500)] + [(big - 1, "one"), (None, "two"), (big - 3, "three"), (None, "hot")]
    frame = spark.createDataFrame([(i, t, "") for i, t in rows], SCHEMA).repartition(3)
    for split in (None, 0, big + 100):
        assert sorted(map(tuple, exact_duplicates(frame, split).collect()), key=str) == brute(rows)
    assert {(r.doc_id, r.text) for r in drop_duplicates(frame).collect()} == {(big, "hot"), (big - 1, "one"), (None, "two"), (big - 3, "three")}
