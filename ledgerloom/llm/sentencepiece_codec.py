"""SentencePiece models run by the tokenizers library.

``Model.parse`` reads the protobuf of a model file. ``tokenizer`` rebuilds it:
the normaliser (a character map if the model has one, the blank put first,
the word marker for blanks), the pieces with their scores as a unigram model
or as merges in order of score, and bytes for characters without a piece.
Batches of whole texts are encoded and decoded by the library, and every text
is held against the sentencepiece library.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import public_path, release, small_batches, table, text_of

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Threads of the libraries in each Python worker: Spark's tasks are the threads.
THREADS = 1
#: Characters that are encoded at once.
BATCH_CHARS = 500_000


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of a protobuf message: varints as int, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + size]
            at += size


@dataclass
class Model:
    """The parts of a model file that encoding needs. Defaults are those of the format."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    char_map: bytes = b""
    dummy_prefix: bool = True
    squeeze_blanks: bool = True
    mark_blanks: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        model = cls()
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                model.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
            elif number == 2:
                model.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                model.char_map = spec.get(2, b"")
                model.dummy_prefix, model.squeeze_blanks, model.mark_blanks = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        return model

    @classmethod
    def load(cls, model_file: str) -> Model:
        with open(model_file, "rb") as f:
            return cls.parse(f.read())

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    @property
    def has_bytes(self) -> bool:
        return any(p[2] == BYTE for p in self.pieces)

    def merges(self) -> list[tuple[str, str]]:
        """All pairs of pieces that make a piece, in the order in which the model would merge them."""
        ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        pairs = [(-self.pieces[i][1], i, ids[p[:k]], p[:k], p[k:]) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        return [(a, b) for *_, a, b in sorted(pairs)]


def tokenizer(model: Model):
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unknown, model.has_bytes)
    elif model.kind == BPE:
        core = models.BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, model.merges(), unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.has_bytes)
    else:
        raise ValueError("only unigram and BPE models are supported")
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.char_map)] if model.char_map else []
    steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")] * model.squeeze_blanks
    steps += [normalizers.Prepend(MARK)] * model.dummy_prefix + [normalizers.Replace(" ", MARK)] * model.mark_blanks
    out.normalizer = normalizers.Sequence(steps)
    out.decoder = decoders.Sequence([decoders.ByteFallback(), decoders.Fuse(), decoders.Replace(MARK, " "), *[decoders.Strip(" ", 1, 0)] * model.dummy_prefix])
    return out


class Encoder:
    """A model in the tokenizers library. Where normalising is no more than putting marks, texts come marked, as the library would keep track of every byte for that."""

    def __init__(self, model: Model):
        self.core = tokenizer(model)
        self.marks = model.mark_blanks and not model.char_map and not model.squeeze_blanks
        self.prefix = MARK if model.dummy_prefix else ""
        if self.marks:
            self.core.normalizer = None

    def run(self, texts: list[str]) -> tuple[list[list[int]], list[str]]:
        """The ids of each text, and what they decode to."""
        if self.marks:
            texts = [self.prefix + t.replace(" ", MARK) if t else t for t in texts]
        ids = [e.ids for e in self.core.encode_batch_fast(texts, add_special_tokens=False)]
        return ids, self.core.decode_batch(ids, skip_special_tokens=False)


def _in_parts(texts: list[str]) -> Iterator[list[str]]:
    """texts in stretches of about BATCH_CHARS; a longer text is a stretch of its own."""
    begin = size = 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text) > BATCH_CHARS:
            yield texts[begin:i]
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield texts[begin:]


def _coded(model_file: str, row):
    """An iterator function for a pandas UDF: row(text, ids, decoded, parity) gives the fields of a text's result."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece

        ours, theirs = Encoder(Model.load(model_file)), sentencepiece.SentencePieceProcessor(model_file=model_file)
        for batch in batches:
            found = []
            for texts in _in_parts(list(batch)):
                ids, decoded = ours.run(texts)
                found += [row(t, a, d, a == b) for t, a, d, b in zip(texts, ids, decoded, theirs.encode(texts, num_threads=THREADS), strict=True)]
            yield pd.DataFrame(found) if found else pd.DataFrame(columns=list(row("", [], "", True)))
        del ours, theirs
        release()

    return run


def codec(docs: DataFrame, model_file: str) -> DataFrame:
    """For each row of docs its ids and what came of them, without a shuffle.

    doc_id, ids (array of int), decoded (the text again, with a blank where
    it has a word marker), parity (the sentencepiece library gives the same
    ids). Null and empty texts have no ids and decode to the empty text. Rows
    are encoded on their own: repeated rows and null ids come out as they
    went in, whatever other columns docs has. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    run = _coded(model_file, lambda text, ids, decoded, parity: {"ids": ids, "decoded": decoded, "parity": parity})
    return docs.select("doc_id", F.pandas_udf(run, "ids array<int>, decoded string, parity boolean")(text_of()).alias("r")).select("doc_id", "r.*")


def digest(docs: DataFrame, model_file: str) -> DataFrame:
    """``codec`` with its large columns summed up where they are made: doc_id, n_tokens, ids_crc32, decoded_crc32, round_trip (decoding gave the text, word markers as blanks), parity. An empty table gives no rows, an empty text no ids and the checksums of nothing, 0."""
    small_batches(docs.sparkSession)

    def row(text: str, ids: list[int], decoded: str, parity: bool) -> dict:
        return {
            "n_tokens": len(ids), "ids_crc32": zlib.crc32(array("I", ids).tobytes()), "decoded_crc32": zlib.crc32(decoded.encode("utf-8", "surrogatepass")),
            "round_trip": decoded == text or decoded == text.replace(MARK, " "), "parity": parity,
        }

    result = F.pandas_udf(_coded(model_file, row), "n_tokens long, ids_crc32 long, decoded_crc32 long, round_trip boolean, parity boolean")
    return docs.select("doc_id", result(text_of()).alias("r")).select("doc_id", "r.*")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), public_path("piece_bpe_32k.model"))
