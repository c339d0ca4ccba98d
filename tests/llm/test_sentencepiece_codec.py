import random

import sentencepiece

from ledgerloom.llm import sentencepiece_codec as M
from ledgerloom.llm.common import public_path

FILE = public_path("piece_bpe_32k.model")


def test_ids_and_texts_are_the_library_s():
    ours, theirs = M.Encoder(M.Model.load(FILE)), sentencepiece.SentencePieceProcessor(model_file=FILE)
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "b", " ", "  ", "\n", "\t", "c", "é", "漢", "<s>", "</s>", "▁", "the ", "<0x0A>", "quick"]) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for text, a, b, c in zip(texts, *ours.run(texts), theirs.encode(texts), strict=True):
        assert a == c, text
        assert b == theirs.decode(c), text


def test_unigram_model_is_rebuilt():
    pieces = [("<unk>", 0.0, M.UNKNOWN), ("▁", -2.0, M.NORMAL), ("▁a", -1.0, M.NORMAL), ("a", -3.0, M.NORMAL), ("b", -3.0, M.NORMAL), ("ab", -2.5, M.NORMAL)]
    core = M.tokenizer(M.Model(pieces, M.UNIGRAM, squeeze_blanks=False))
    assert core.encode("ab a", add_special_tokens=False).ids == [2, 4, 2]


def test_texts_are_encoded_in_stretches(monkeypatch):
    monkeypatch.setattr(M, "BATCH_CHARS", 10)
    texts = ["a" * 4, "b" * 30, "", "c" * 6, "d" * 5]
    parts = list(M._in_parts(texts))
    assert sum(parts, []) == texts and all(len(p) == 1 or sum(map(len, p)) <= 10 for p in parts)
    assert list(M._in_parts([])) == []


def test_rows(spark):
    texts = [None, "", " two  blanks ", "word " * 30_000, "é漢\n\x00", "a b"]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(5, "a b", "y"), (None, "a b", None)], "doc_id long, text string, ids string")
    got = M.codec(frame, FILE).collect()
    assert len(got) == 8 and all(r.parity for r in got)
    for r in got:
        if r.doc_id is not None:
            assert r.decoded == (texts[r.doc_id] or "")
    summed = M.digest(frame, FILE).collect()
    assert len(summed) == 8 and all(r.parity and r.round_trip for r in summed)
    assert sorted(r.n_tokens for r in summed) == sorted(len(r.ids) for r in got)
    assert M.digest(frame.limit(0), FILE).count() == 0


def test_large_ids_beside_null(spark):
    ids = [9007199254740993, None, 9007199254740995]
    frame = spark.createDataFrame([(i, "some text") for i in ids], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in M.digest(frame, FILE).collect()} == set(ids)


def test_marks_are_put_without_the_librarys_normaliser():
    model = M.Model.load(FILE)
    ours, whole = M.Encoder(model), M.tokenizer(model)
    texts = ["", " ", "a  b ", "▁x ▁", "é漢\n\x00  z", "word " * 50]
    assert ours.core.normalizer is None and ours.run(texts)[0] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    model.squeeze_blanks = True
    assert M.Encoder(model).core.normalizer is not None
