import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from ledgerloom.llm import suffix_dedup as M

SCHEMA = "doc_id long, text string, uid long, head string"


def covered(rows):
    """For each row the words that lie in a run of 50 which stands in two places."""
    places = {}
    words = [(t or "").split() for _, t in rows]
    for i, w in enumerate(words):
        for k in range(len(w) - M.PASSAGE + 1):
            places.setdefault(tuple(w[k : k + M.PASSAGE]), []).append((i, k))
    out = [set() for _ in rows]
    for found in places.values():
        if len(found) > 1:
            for i, k in found:
                out[i].update(range(k, k + M.PASSAGE))
    return out


def test_minimisers():
    rng = np.random.default_rng(1)
    for n in (0, 49, 50, 51, 130, 700):
        h = rng.integers(0, 2 if n == 700 else 2**63, n).astype(np.uint64)
        g = M.grams(h, M.HEAD) if n >= M.HEAD else h[:0]
        want = {i for j in range(n - M.PASSAGE + 1) for i in range(j, j + M.SPAN) if g[i] == g[j : j + M.SPAN].min()}
        at, heads = M.minimisers(h)
        assert at.tolist() == sorted(want) and (heads == g[at]).all()


def test_planted_passages(spark, monkeypatch):
    monkeypatch.setattr(M, "SLICE_ROWS", 15)  # many slices, so that their ends matter
    monkeypatch.setattr(M, "HOT_ROWS", 5)
    rng = random.Random(1)
    line = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passages = [line(n) for n in (50, 51, 64, 120, 400)]
    short = line(49)
    rows = []
    for i in range(70):
        words = line(rng.randint(0, 150))
        if i % 2:
            p = passages[i % 5] if i % 3 else passages[1]  # one is in a third of all rows
            words += p + line(rng.randint(0, 80))
        elif i % 5 == 0:
            words += short + line(20)
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(100, None), (101, ""), (102, rows[3][1]), (None, rows[5][1]), (1, rows[1][1])]
    frame = spark.createDataFrame([(*r, 5, "clash") for r in rows], SCHEMA).repartition(6)
    got, want = {}, {}
    for r in M.repeated_passages(frame).collect():
        got.setdefault(r.doc_id, []).append({k for s in r.spans for k in range(s["start"], s["end"])})
        assert all(any(c["start"] >= s["start"] and c["end"] <= s["end"] for s in r.spans) for c in r.cut_spans)
    for (i, _), c in zip(rows, covered(rows), strict=True):
        if c:
            want.setdefault(i, []).append(c)
    assert set(got) == set(want)
    for i in want:
        assert sorted(map(sorted, got[i])) == sorted(map(sorted, want[i])), i


def test_first_place_is_not_cut(spark):
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))
    frame = spark.createDataFrame([(i, f"x{i} {text} y{i}") for i in range(9)], "doc_id long, text string")
    rows = M.repeated_passages(frame).collect()
    assert len(rows) == 9 and sum(not r.cut_spans for r in rows) >= 1
    assert M.repeated_passages(frame.limit(0)).count() == 0


def planted(rng, n_docs, n_shared):
    """Rows that share a passage and go on differently, and rows that share only its second half."""
    line = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = line(n_shared)
    rows = [(i, " ".join(line(rng.randint(0, 60)) + shared + line(rng.randint(0, 60)))) for i in range(n_docs)]
    return rows + [(1000 + i, " ".join(line(60) + shared[n_shared // 2 :] + line(60))) for i in range(n_docs)]


@pytest.mark.parametrize(("n_shared", "slice_rows"), [(60, 50_000), (60, 30), (130, 40)])
def test_every_window_and_every_later_copy_is_found(spark, monkeypatch, n_shared, slice_rows):
    monkeypatch.setattr(M, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(M, "HOT_ROWS", slice_rows // 2)
    rows = planted(random.Random(n_shared), 80, n_shared)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r.doc_id: r for r in M.repeated_passages(frame).collect()}
    of = lambda spans: {k for s in spans for k in range(s["start"], s["end"])}
    places, later = {}, {}
    for i, text in sorted((r for r in rows if r[0] in found), key=lambda r: found[r[0]].uid):
        words = text.split()
        for k in range(len(words) - M.PASSAGE + 1):
            if places.setdefault(tuple(words[k : k + M.PASSAGE]), (i, k)) != (i, k):
                later.setdefault(i, set()).update(range(k, k + M.PASSAGE))
    for (i, _), want in zip(rows, covered(rows), strict=True):
        assert (i in found) == bool(want)
        assert not want or (of(found[i].spans) == want and of(found[i].cut_spans) == later.get(i, set()) and found[i].other_ids)
    assert sum(not r.cut_spans for r in found.values()) == 1 or n_shared > 100


def test_a_text_that_repeats_itself_keeps_its_beginning(spark):
    frame = spark.createDataFrame([(1, "ha " * 200), (2, "ha " * 200)], "doc_id long, text string").coalesce(1)
    first, second = sorted(M.repeated_passages(frame).collect(), key=lambda r: r.uid)
    spans = lambda x: [(s["start"], s["end"]) for s in x]
    assert spans(first.spans) == spans(second.spans) == [(0, 200)]
    assert spans(first.cut_spans) == [(50, 200)] and spans(second.cut_spans) == [(0, 200)]


@pytest.mark.parametrize("ids", [range(6), [3, None, 3, 3, None, 1]])
def test_what_is_cut_does_not_depend_on_the_layout(spark, ids):
    rng = random.Random(8)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))
    rows = [(i, f"a{k} {text} b{k}") for k, i in enumerate(ids)]
    results = []
    for order, parts in ((rows, 1), (rows[::-1], 1), (rows[3:] + rows[:3], 3)):
        frame = spark.createDataFrame(order, "doc_id long, text string").coalesce(1) if parts == 1 else spark.createDataFrame(order, "doc_id long, text string").repartition(parts)
        found = M.repeated_passages(frame).collect()
        results.append(sorted((str(r.doc_id), str(r.spans), str(r.cut_spans)) for r in found))
        uncut = [r for r in found if not r.cut_spans]
        assert len(uncut) == 1 and uncut[0].uid == min(r.uid for r in found)
        assert uncut[0].doc_id == (None if None in ids else min(ids))
    assert results[0] == results[1] == results[2]


def test_groups_of_heads_give_what_the_whole_slice_gives(monkeypatch):
    rng = np.random.default_rng(3)
    rows = pd.DataFrame([(h, int(rng.integers(20)), int(rng.integers(900))) for h in range(-6, 6) for _ in range(rng.choice([1, 9, 40]))], columns=["head", "uid", "at"])
    rows = rows.drop_duplicates(["uid", "at"]).sort_values(["head", "uid", "at"], ignore_index=True)
    around = (1 + (rng.random((len(rows), M.LEFT + M.RIGHT)) < 0.02)).astype(np.uint32)
    columns = {"head": rows["head"], "hot": (rows["head"] == -6) | (rows["head"] == 5), "right": M._blobs(around[:, M.LEFT :]), "left": M._blobs(around[:, : M.LEFT]), "uid": rows["uid"], "doc_id": rows["uid"], "at": rows["at"].astype("int32"), "n_words": np.full(len(rows), 1000, np.int32)}
    batch = pa.RecordBatch.from_pydict({k: pa.array(v) if not isinstance(v, pa.Array) else v for k, v in columns.items()})
    found = []
    for size in (10**6, 1, 15):
        monkeypatch.setattr(M, "GROUP_ROWS", size)
        out = pa.Table.from_batches(list(M._slice(iter([batch.slice(i, 10) for i in range(0, len(rows), 10)])))).to_pylist()
        found.append((sorted(str(r) for r in out if r["key"] is not None), {(r["uid"], r["earlier"], k) for r in out if r["key"] is None for k in range(r["start"], r["end"])}))
    assert found[0] == found[1] == found[2] and all(found[0])


def test_large_ids_beside_null_and_a_long_text(spark):
    rng = random.Random(4)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    long = " ".join(f"v{rng.randrange(10**6)}" for _ in range(40_000))
    ids = [9007199254740993, None, 9007199254740995, 9007199254740997]
    frame = spark.createDataFrame([(i, f"a{k} {text} {long if k > 1 else ''}") for k, i in enumerate(ids)], "doc_id long, text string").coalesce(1)
    rows = M.repeated_passages(frame).collect()
    assert {r.doc_id for r in rows} == set(ids) and all(set(r.other_ids) <= set(ids) for r in rows)
    assert sorted((r.spans[0]["start"], r.spans[-1]["end"]) for r in rows) == [(1, 61), (1, 61), (1, 40_061), (1, 40_061)]


def test_islands():
    rng = np.random.default_rng(5)
    uid, earlier, start = rng.integers(0, 4, 200), rng.random(200) < 0.5, rng.integers(0, 300, 200)
    end = start + rng.integers(1, 9, 200)
    at, a, b = M._islands(uid, earlier, start, end)
    cells = lambda rows: {(u, e, k) for u, e, i, j in rows for k in range(i, j)}
    islands = list(zip(uid[at], earlier[at], a, b, strict=True))
    assert cells(islands) == cells(zip(uid, earlier, start, end, strict=True))
    assert all(x[:2] != y[:2] or x[3] < y[2] for x, y in zip(islands, islands[1:], strict=False))
