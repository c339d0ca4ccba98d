import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from ledgerloom.llm import packing as M
from ledgerloom.llm.common import public_path

FILE = public_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def chunks():
    return M.Chunks(FILE)


def test_chunks_give_the_ids_of_whole_texts(chunks):
    rng = random.Random(1)
    for _ in range(1500):
        text = "".join(rng.choice(["a", "B", " ", "\n", "\t", "\x0b", "\x1c", " ", " ", "it's", "'", "a1b22,", "x", "`{~", "@[", "ßünür", "ñÿ÷x", "å7", "Foo-Bar!?", "\x7f", "\x00", "é", "́", "É", "ΑΣ", "漢", "12", "!?", "<|endoftext|>", "<|startoftext|>", "<|STARTOFTEXT|>", "the "]) for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(chunks.ids([text])[0], "<u4").tolist() == [*chunks.tokenizer.encode(text, add_special_tokens=False).ids, 2], repr(text)


def check(rows, docs, window=4096):
    """rows: PIECES; docs: the ids of each doc_id, as often as it comes."""
    seqs, pieces = defaultdict(list), defaultdict(list)
    for doc, start, length, crc, n, seq, offset in rows:
        seqs[seq].append((offset, length))
        pieces[doc].append((start, length, crc, n))
    for found in seqs.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at and length > 0
            at += length
        assert at <= window and (at == window or at & (at - 1) == 0)
    assert set(pieces) == set(docs)
    for doc, copies in docs.items():
        ids, found = copies[0], sorted(pieces[doc])
        assert sum(x[1] for x in found) == len(ids) * len(copies)
        covered = np.zeros(len(ids), int)
        for start, length, crc, n in found:
            assert n == len(ids) and crc == zlib.crc32(ids[start : start + length].tobytes())
            covered[start : start + length] += 1
        assert (covered == len(copies)).all()


def test_pack_small_windows():
    rng = np.random.default_rng(2)
    for window in (8, 64):
        docs = [rng.integers(0, 50, n).astype("<u4") for n in [1, 1, 7, 8, 9, 200, 3, *rng.integers(1, 40, 60)]]
        found = M.pack(docs, window)
        check([(d, s, k, zlib.crc32(docs[d][s : s + k].tobytes()), len(docs[d]), w, o) for d, s, k, w, o in found], {i: [d] for i, d in enumerate(docs)}, window)


def test_neighbours_are_those_of_bm25():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 30, rng.integers(1, 20)) for _ in range(40)]
    index, mean = M.Index(docs), np.mean([len(d) for d in docs])
    df = {t: sum(t in d for d in docs) for t in range(30)}
    idf = {t: np.log(1 + (40 - k + 0.5) / (k + 0.5)) for t, k in df.items()}
    for seed in range(40):
        terms = sorted(set(docs[seed].tolist()), key=lambda t: (-idf[t], t))[: M.QUERY_TERMS]
        score = [sum(idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in terms if (tf := (d == t).sum())) for d in docs]
        got = index.neighbours(seed).tolist()
        assert set(got) == {i for i, s in enumerate(score) if s > 0}
        assert all(score[a] >= score[b] - 1e-9 for a, b in zip(got, got[1:], strict=False))


def test_every_id_lies_in_one_piece(spark, chunks):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(500)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 50, 400]))) for _ in range(60)] + ["", None, "x " * 20_000, "hot text", "hot text"]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(0, texts[0], "again", 2), (None, "no id", "", 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string, n long").repartition(4)
    docs = defaultdict(list)
    for i, t, *_ in rows:
        docs[i].append(np.frombuffer(chunks.ids([t or ""])[0], "<u4"))
    for tokens in (1_000_000, 20_000):
        got = M.packed(frame, FILE, tokens).collect()
        check([tuple(r)[:7] for r in got], docs)
        assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    assert M.packed(frame.limit(0), FILE).count() == 0


def test_large_ids_beside_null(spark):
    ids = [9007199254740993, None, 9007199254740995]
    frame = spark.createDataFrame([(i, "some text") for i in ids], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in M.packed(frame, FILE).collect()} == set(ids)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        M.Chunks(public_path("byte_bpe_50k.json"))


def test_new_chunks_of_many_texts_are_learnt_together(monkeypatch):
    fresh, calls, learn = M.Chunks(FILE), [], M.Chunks._learn
    monkeypatch.setattr(M.Chunks, "_learn", lambda self, new: (calls.append(len(new)), learn(self, new)))
    texts = [f"zorbl{i}x grün{chr(97 + i % 26)}q{i}, «ñ{i}» it's" for i in range(300)] + ["", "the the"]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in fresh.ids(texts)] == [[*fresh.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert len(calls) == 1
