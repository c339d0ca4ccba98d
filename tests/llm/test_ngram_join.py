import random

import numpy as np
import pytest

from ledgerloom.llm import ngram_join as M
from ledgerloom.llm.common import WordHashes

SCHEMA = "doc_id long, text string, key string, n long"


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [d for j, (d, _) in enumerate(rows) if find(j) == find(i) and d is not None]
        out.append((doc, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str)


def near_copies(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    common = [rng.choice(words) for _ in range(40)]
    rows = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 6, 9, 40, 120]))]
        if rng.random() < 0.4:
            base = base[:10] + common + base[10:]
        for _ in range(rng.randint(1, 9)):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(text))
                text[at : at + rng.randint(0, 1)] = [rng.choice(words)]
            rows.append((len(rows), rng.choice([" ", "  ", "\t", "\n"]).join(text)))
    hot = [rng.choice(words) for _ in range(60)]  # a third of all rows
    for k in range(len(rows) // 2):
        rows.append((len(rows), " ".join(hot[:k % 60] + [f"x{k}"] + hot[k % 60 + 1 :])))
    rows += [(len(rows), "UPPER case five words here"), (len(rows) + 1, "upper CASE five words here"), (len(rows) + 2, "É a b c d"), (len(rows) + 3, "é a b c d")]
    rows += [(900, None), (901, ""), (902, " \n"), (3, rows[3][1]), (None, rows[3][1]), (None, "only here without an id")]
    return rows


@pytest.mark.parametrize("seed", [1])
def test_against_brute_force(spark, seed, monkeypatch):
    rows = near_copies(seed)
    frame = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], SCHEMA).repartition(7)
    assert sorted(map(tuple, M.similar_documents(frame).select("doc_id", "n_shingles", "component_id").collect()), key=str) == brute(rows)


def test_chains_are_followed(spark):
    """Neighbours of a chain are similar, its ends are not."""
    words = [f"c{i}" for i in range(200)]
    rows = [(i, " ".join(words[8 * i : 8 * i + 100])) for i in range(12)]
    assert {c for *_, c in brute(rows)} == {0}
    assert sorted(map(tuple, M.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()), key=str) == brute(rows)


def test_similar_sets_share_prefix_tokens_in_every_order():
    rng = np.random.default_rng(1)
    for bits in (0, 3):
        for _ in range(200):
            base = np.unique(rng.integers(0, 2**63, rng.integers(1, 400)).astype(np.uint64))
            a = base[rng.random(len(base)) < 0.95]
            b = np.unique(np.concatenate([base[rng.random(len(base)) < 0.9], rng.integers(0, 2**63, rng.integers(0, 40)).astype(np.uint64)]))
            common = np.unique(M.numbers(base[rng.random(len(base)) < 0.3], bits))
            orders = M.Orders(bits, common, rng.integers(1, 30, len(common)).astype(np.uint8))
            if len(a) and len(b) and 7 * len(np.intersect1d(a, b)) >= 3 * (len(a) + len(b)):
                for x, y in zip(orders.prefixes(a, range(M.ORDERS)), orders.prefixes(b, range(M.ORDERS)), strict=True):
                    assert len(np.intersect1d(x, y))


def test_tokens_are_counted_exactly(spark, monkeypatch):
    monkeypatch.setattr(M, "PART_TOKENS", 50)
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 900, 60).astype(np.uint64)) for _ in range(50)]
    frame = spark.createDataFrame([(i, i, s.tobytes()) for i, s in enumerate(sets)], "h long, key long, tokens binary").repartition(3)
    everything = spark.sparkContext.broadcast(M.filter_bits("h", frame))
    shared, bits = M.shared_tokens(frame, sum(map(len, sets)), everything)
    token, n = np.unique(np.concatenate(sets), return_counts=True)
    assert bits > 0
    assert {r.number: r.n for r in shared.collect()} == dict(zip(M.numbers(token[n > 1], bits).tolist(), n[n > 1].tolist(), strict=True))
    orders = M.global_orders(shared, bits)
    assert orders.levels(M.numbers(token, bits)).tolist() == np.where(n > 1, np.log2(n).astype(int), 0).tolist()


def test_very_common_tokens_are_counted_exactly(spark):
    rng = np.random.default_rng(4)
    sets = [np.unique(np.append(rng.integers(10, 1 << 40, 5), [1] if i % 2 else [1, 2]).astype(np.uint64)) for i in range(1020)]
    frame = spark.createDataFrame([(i, i, s.tobytes()) for i, s in enumerate(sets)], "h long, key long, tokens binary").coalesce(1)
    everything = spark.sparkContext.broadcast(M.filter_bits("h", frame))
    shared, bits = M.shared_tokens(frame, sum(map(len, sets)), everything)
    assert {r.number: r.n for r in shared.collect()} == dict(zip(M.numbers(np.array([1, 2], np.uint64), bits).tolist(), [1020, 510], strict=True))


def test_large_groups_are_held_against_one_member(spark, monkeypatch):
    monkeypatch.setattr(M, "LARGE", 2)
    monkeypatch.setattr(M, "AGREE", 6)
    monkeypatch.setattr(M, "BLOCK", 3)
    rows = near_copies(3)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, M.similar_documents(frame).select("doc_id", "n_shingles", "component_id").collect()), key=str) == brute(rows)


def test_large_ids_beside_null(spark):
    rows = [(9007199254740995, "one two three four five six"), (None, "one two three four five six"), (9007199254740993, "other words in this text here"), (9007199254740997, "one two three four five six")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {(r.doc_id, r.component_id) for r in M.similar_documents(frame).collect()}
    assert got == {(9007199254740995, 9007199254740995), (None, 9007199254740995), (9007199254740997, 9007199254740995), (9007199254740993, 9007199254740993)}
    kept = {r.doc_id for r in M.drop_near_duplicates(frame).collect()}
    assert kept == {9007199254740995, 9007199254740993}


def test_empty_table(spark):
    assert M.similar_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_text_has_whole_set():
    assert len(M.shingle_set(" ".join(map(str, range(30_000))), WordHashes())) == 29_996


def test_sets_of_many_texts_are_those_of_each():
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abC") for _ in range(rng.choice([0, 1, 2, 4, 5, 6, 9, 30]))) for _ in range(200)] + ["", "one", "é é é é é é é é"]
    for part in (texts, texts[:1], [], ["", ""], ["a b"], texts[::-1]):
        tokens, n = M.shingle_sets(part, WordHashes())
        ends = np.cumsum(n)
        assert [tokens[e - k : e].tolist() for e, k in zip(ends, n, strict=True)] == [M.shingle_set(t, WordHashes()).tolist() for t in part]


def test_parities_of_links_are_near():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(base[rng.random(400) < p]) for p in rng.uniform(0.7, 1, 60)]
    parity = M.parities(np.concatenate(sets), np.array([len(s) for s in sets]))
    assert parity.shape == (60, M.PARITY // 64)
    for a, p in zip(sets, parity, strict=True):
        for b, q in zip(sets, parity, strict=True):
            assert sum(int(x).bit_count() for x in (p ^ q).view(np.uint64)) <= len(np.setxor1d(a, b))


def test_near_copies_that_are_no_links_are_told_by_their_parities(spark, monkeypatch):
    """Each text has two changed words of 60, so that most pairs share many shingles, but few pairs are similar enough."""
    rng, base, rows = random.Random(7), [f"b{i}" for i in range(60)], []
    for k in range(150):
        text = list(base)
        for at in rng.sample(range(4, 56), 2):
            text[at] = f"x{k}-{at}"
        rows.append((k, " ".join(text)))
    held, verified = [], M.verified
    monkeypatch.setattr(M, "verified", lambda pairs, *a: (held.append(pairs.count()), verified(pairs, *a))[1])
    found = M.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found), key=str) == brute(rows)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(56)} for _, t in rows]
    links = sum(100 * len(a & b) >= 75 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert held[-1] < 3 * links < 150 * 149 / 4, (held, links)
