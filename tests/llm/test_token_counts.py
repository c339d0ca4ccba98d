import random

import pytest
import sentencepiece

from ledgerloom.llm import token_counts as M
from ledgerloom.llm.common import public_path

FILE = public_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def transducer():
    return M.Transducer(M.Model.load(FILE))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=FILE)


def texts(seed, n, most):
    rng = random.Random(seed)
    parts = ["a", "b", " ", "  ", "\n", "\t", "c", "é", "漢", "<s>", "</s>", "▁", "the ", "<0x0A>", "\x00", "ing", "tion", "aa", "bb", "1", "22", ".", "....", "==", "Ü", "ß", "\U0001f600", "ab" * 9, " " * 17]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_counts_equal_the_library(transducer, library):
    for text in texts(1, 3000, 60):
        assert transducer.count(text) == len(library.encode(text)), text


def test_chunks_give_the_same_counts(transducer, library, monkeypatch):
    for size in (1, 5, 37):
        monkeypatch.setattr(M, "CHUNK_CHARS", size)
        for text in texts(size, 300, 120):
            assert transducer.count(text) == len(library.encode(text)), text


def test_every_state_goes_to_the_start_at_a_word_s_end(transducer):
    transducer.total([" word", " another"])
    assert all(transducer.run(k, M.MARK) == (transducer.start, 1) for k, s in enumerate(list(transducer.states)) if not s[-1][1].endswith(M.MARK))


def test_maps_compose_associatively(transducer):
    parts = [transducer.chunk_map(x) for x in (" the", "re is", "n't", " any x", " ", " a b", "c")]
    left = right = None
    for p in parts:
        left = p if left is None else transducer.compose(left, p)
    for p in reversed(parts):
        right = p if right is None else transducer.compose(p, right)
    assert left == right


def test_states_start_anew(transducer, library, monkeypatch):
    monkeypatch.setattr(M, "STATES", 20)
    for text in texts(9, 200, 60):
        assert transducer.count(text) == len(library.encode(text)), text


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        M.Transducer(M.Model([("<unk>", 0.0, 2), ("▁", -2.0, 1)]))


def test_nulls_empty_and_long_texts(spark, library):
    rows = [None, "", " ", "word " * 40_000, "x" * 30_000, "a b", "ab" * 100_000]
    frame = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(rows)] + [(6, rows[6], None), (None, "a b", None), (9007199254740993, "a", None)], "doc_id long, text string, n_tokens string")
    got = M.token_counts(frame.coalesce(1), FILE).collect()
    assert len(got) == 10 and {r.doc_id for r in got} >= {None, 9007199254740993}
    for r in got:
        if r.doc_id is not None and r.doc_id < 10:
            t = rows[r.doc_id] or ""
            assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(library.encode(t)))
        assert r.over_limit == (r.n_tokens > 4096)
    assert M.token_counts(frame.limit(0), FILE).count() == 0
