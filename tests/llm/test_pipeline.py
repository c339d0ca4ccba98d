import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from ledgerloom.llm.common import public_path
from ledgerloom.llm.packing import Chunks
from tests.llm.test_quality_rules import plain

pipeline = pytest.importorskip("corpus_pipeline")


def documents(spark):
    rng = random.Random(5)
    line = lambda n: [f"tok{rng.randrange(3000)}" for _ in range(n)]
    rows = [" ".join(line(rng.randint(60, 160))) for _ in range(40)]
    rows += ["too short", "", None, "LOUD " * 80]
    rows += [rows[0], rows[0].replace(" ", "\n"), rows[1]]  # equal texts
    near = rows[2].split(" ")
    rows += [" ".join([*near[:30], "other", *near[31:]]), " ".join([*near, "more"])]
    rows += [f"{rows[3]} mail me@here.example.com", " ".join(line(5000))]
    whole = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(rows)]
    whole.append(whole[5])  # a repeated row
    return whole, spark.createDataFrame(whole, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)


def test_stages(spark):
    rows, docs = documents(spark)
    columns, run = docs.columns, {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, "")
        run[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
            docs = spark.createDataFrame(run[name], docs.schema)
    kept = [r for r in rows if plain(r[1])[-1]]
    assert sorted(map(tuple, run["quality rules"])) == sorted(kept)
    first = {}
    for r in sorted(kept):
        first.setdefault(" ".join(r[1].split()), r)
    assert sorted(map(tuple, run["exact dedup"])) == sorted(first.values())

    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    alone, sets = [], []
    for r in sorted(first.values()):
        s = shingles(r[1])
        if all(100 * len(s & o) < 75 * len(s | o) for o in sets):
            alone.append(r)
        sets.append(s)
    assert sorted(map(tuple, run["n-gram Jaccard join"])) == alone
    clean = {r.doc_id: r for r in run["personal data"]}
    assert set(clean) == {r[0] for r in alone}
    for r in alone:
        assert clean[r[0]].text == r[1].replace("me@here.example.com", "<EMAIL>") and clean[r[0]].n_chars == len(clean[r[0]].text)
    chunks, seen = Chunks(public_path("word_bpe_49k.json")), defaultdict(int)
    for p in run["packing"]:
        ids = np.frombuffer(chunks.ids([clean[p.doc_id].text])[0], "<u4")
        assert p.doc_tokens == len(ids) and zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
        seen[p.doc_id] += p.length
    assert seen == {i: len(chunks.ids([r.text])[0]) // 4 for i, r in clean.items()}


def test_empty(spark):
    docs = documents(spark)[1].limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
        docs = docs.limit(0)
        if "text" not in docs.columns:
            break
