"""Packing by lexical retrieval.

Documents are tokenised once and dealt into shards by a lexical signature, so
that documents that share rare tokens tend to share a shard. Each shard is a
BM25 inverted index over its documents. A seed document opens a window, the
index returns its unused neighbours, best first, and those that still fit fill
the window; the best one that doesn't fit is cut, and its rest opens the next
window. So every window is full, but for the end of a shard, which becomes
windows whose lengths are powers of two.

The work is one shuffle of token ids. A shard has about SHARD_TOKENS tokens
whatever the corpus, as shards are ranges of (signature, row): a signature
that a third of all rows share is cut like any other.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import keep, mix64, public_path, release, small_batches, table, text_of

WINDOW, END = 4096, 2
SHARD_TOKENS = 1_000_000
#: BM25's parameters, and the seed's rarest terms that are looked up: windows are full in any case, and common terms cost most and tell least.
K1, B, QUERY_TERMS = 1.2, 0.75, 24
LETTERS = "a-zß-öø-ÿ"
PLAIN = re.compile(f"[{LETTERS}0-9!-&(-/:-@\\[-`{{-~]+")
#: The parts of plain chunks, which are joined by line ends.
WORDS = re.compile(f"[{LETTERS}]+|[0-9]|\\n|[^{LETTERS}0-9\\n]+")
#: No id: stands between the ids of two chunks.
BETWEEN = np.uint32(0xFFFFFFFF)
#: Characters of texts whose new chunks are learnt in one go; a longer text is learnt on its own.
GROUP_CHARS = 1 << 19
#: Bytes of chunks, the words in them and their ids that a task remembers, and what an entry takes besides.
CACHE_BYTES, ENTRY_BYTES = 75_000_000, 150
#: Texts by which a tokenizer is tried before its ids are put together from parts.
PROBES = ("", "Two  WORDS\n\tand more", "it's a-b_c (x1y22) e.g. 3.14!?", "ÄÖÜ straße déjà-vu, größe", "漢字 \u00a0 x", "a<|endoftext|>b")
#: Ids from here on are rarer tokens, of which signatures are made.
RARE = 2000


class Chunks(dict):
    """The ids of chunks between blanks, as bytes. A tokenizer that splits there in any case gives a text the ids of its chunks."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads here
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        # The same model for words that are told apart already, in the characters that it has for bytes.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.characters = {b: level(bytes([195, b]).decode())[0][0][1] for b in range(128, 192)} | {b: level(bytes([b, 128]).decode())[0][0][0] for b in (194, 195)} | {32: " "}
        suffix, vocabulary = self.tokenizer.model.end_of_word_suffix, self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.size = 0
        for text in PROBES:  # what is taken for granted below
            if np.frombuffer(self.ids([text])[0], "<u4").tolist() != [*self.tokenizer.encode(text, add_special_tokens=False).ids, END]:
                raise ValueError("the tokenizer doesn't lower case, or splits words otherwise")

    def _learn_words(self, words: list[bytes]) -> None:
        """Plain words, many in one call: each ends with the only id of its own that ends a word."""
        for i in range(0, len(words), 5000):
            part = words[i : i + 5000]
            text = b" ".join(part)
            text = text.decode() if text.isascii() else text.decode("latin-1").translate(self.characters)
            ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cut, blob = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist(), ids.tobytes()
            if len(cut) != len(part) or cut[-1] != len(blob):
                raise ValueError("the tokenizer doesn't mark where words end")
            self.update(zip(part, map(blob.__getitem__, map(slice, [0, *cut], cut)), strict=False))

    def _learn(self, chunks: set[bytes]) -> None:
        if self.size > CACHE_BYTES:
            self.clear()
            self.size = 0
        before = len(self)
        # Characters of this range stay as they are in the normaliser; without an apostrophe they split into letters, single digits and the rest.
        plain, other = [], []
        for t in b"\n".join(chunks).decode().split("\n") if chunks else []:
            (plain if PLAIN.fullmatch(t) and "<|" not in t else other).append(t)
        if plain:
            self[b"\n"] = BETWEEN.tobytes()  # no chunk has one
            parts = list(map(str.encode, WORDS.findall("\n".join(plain))))
            self._learn_words(sorted({*filterfalse(self.__contains__, parts)}, key=bytes.isascii))
            blob = b"".join(map(self.__getitem__, parts))
            cut = (4 * np.flatnonzero(np.frombuffer(blob, "<u4") == BETWEEN)).tolist()
            self.update(zip(map(str.encode, plain), map(blob.__getitem__, map(slice, [0, *[c + 4 for c in cut]], [*cut, len(blob)])), strict=True))
            self.size += len(blob)
        found = self.tokenizer.encode_batch_fast(other, add_special_tokens=False)
        self.update((t.encode(), np.array(e.ids, "<u4").tobytes()) for t, e in zip(other, found, strict=True))
        self.size += ENTRY_BYTES * (len(self) - before) + sum(map(len, chunks)) + 4 * sum(len(e.ids) for e in found)

    def ids(self, texts: list[str]) -> list[bytes]:
        out, end, begin = [], np.uint32(END).tobytes(), 0
        while begin < len(texts):
            held, size, stop = [], 0, begin
            while stop < len(texts) and size <= GROUP_CHARS:
                text = texts[stop]
                # The tokenizer lowers A-Z anyway; only its special tokens, which begin with <|, are told apart before.
                held.append((text.encode() if "<|" in text else text.encode().lower()).split())
                size, stop = size + len(text), stop + 1
            flat = list(chain.from_iterable(held))
            found = list(map(self.get, flat))
            if new := {c for c, x in zip(flat, found, strict=True) if x is None}:
                self._learn(set(flat) if self.size > CACHE_BYTES else new)
                found = [self[c] if x is None else x for c, x in zip(flat, found, strict=True)]
            at = 0
            for chunks in held:
                out.append(b"".join(found[at : at + len(chunks)]) + end)
                at += len(chunks)
            begin = stop
        return out


def tokenised(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """uid, doc_id, signature, n, ids (little-endian 32-bit) of each row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        chunks = Chunks(tokenizer_file)
        for texts in batches:
            ids, signature = chunks.ids(list(texts)), []
            for blob in ids:
                terms = np.frombuffer(blob, "<u4")
                rare = terms[terms >= RARE]
                signature.append(int(mix64(rare if len(rare) else terms).min() >> np.uint64(1)))
            yield pd.DataFrame({"signature": pd.Series(signature, dtype="int64"), "n": pd.Series([len(x) // 4 for x in ids], dtype="int64"), "ids": ids})
        del chunks
        release()

    coded = F.pandas_udf(run, "signature long, n long, ids binary")(text_of())
    return docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", coded.alias("r")).select("uid", "doc_id", "r.*")


class Index:
    """BM25 over the documents of a shard."""

    def __init__(self, docs: list[np.ndarray]):
        lengths = np.array([len(d) for d in docs], float)
        found = [np.unique(d, return_counts=True) for d in docs]
        self.terms = [t for t, _ in found]
        term = np.concatenate(self.terms)
        tf = np.concatenate([c for _, c in found]).astype(float)
        doc = np.repeat(np.arange(len(docs)), [len(t) for t in self.terms])
        norm = K1 * (1 - B + B * lengths / lengths.mean())
        order = np.argsort(term, kind="stable")
        self.vocabulary, starts = np.unique(term[order], return_index=True)
        self.starts = np.append(starts, len(term))
        df = np.diff(self.starts)
        self.idf = np.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
        self.doc = doc[order]
        self.weight = (tf * (K1 + 1) / (tf + norm[doc]))[order] * np.repeat(self.idf, df)
        self.n = len(docs)

    def neighbours(self, seed: int) -> np.ndarray:
        """Documents that share a query term with the seed, best first; equal scores by position."""
        at = np.searchsorted(self.vocabulary, self.terms[seed])
        best = at[np.argsort(-self.idf[at], kind="stable")[:QUERY_TERMS]]
        lists = [slice(self.starts[t], self.starts[t + 1]) for t in best]
        scores = np.bincount(np.concatenate([self.doc[x] for x in lists]), np.concatenate([self.weight[x] for x in lists]), self.n)
        hits = np.flatnonzero(scores)
        return hits[np.argsort(-scores[hits], kind="stable")]


def pack(docs: list[np.ndarray], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, window, offset) of each piece. All windows are full but those that end a shard."""
    index, n = Index(docs), len(docs)
    used, pieces = np.zeros(n, bool), []
    number = offset = cursor = 0
    rest: tuple[int, int] | None = None  # of a document that was cut: where it goes on

    def put(d: int, start: int, length: int) -> None:
        nonlocal number, offset
        pieces.append((d, start, length, number, offset))
        offset += length
        if offset == window:
            number, offset = number + 1, 0

    while True:
        if rest is None:
            while cursor < n and used[cursor]:
                cursor += 1
            if cursor == n:
                break
            rest = (cursor, 0)
            used[cursor] = True
        seed, start = rest
        rest = None
        while len(docs[seed]) - start >= window - offset:  # a long seed fills windows on its own
            room = window - offset
            put(seed, start, room)
            start += room
        if start < len(docs[seed]):
            put(seed, start, len(docs[seed]) - start)
        if not offset:
            continue
        spare = None
        for d in index.neighbours(seed).tolist():
            if used[d]:
                continue
            if len(docs[d]) <= window - offset:
                used[d] = True
                put(d, 0, len(docs[d]))
                if not offset:
                    break
            elif spare is None:
                spare = d
        if offset and spare is not None:
            used[spare] = True
            room = window - offset
            put(spare, 0, room)
            rest = (spare, room)
    return _end_in_powers(pieces, window)


def _end_in_powers(pieces: list[tuple], window: int) -> list[tuple]:
    """The last window, if it isn't full, as windows whose lengths are powers of two."""
    if not pieces or pieces[-1][4] + pieces[-1][2] == window:
        return pieces
    number = pieces[-1][3]
    last = [p for p in pieces if p[3] == number]
    total = sum(p[2] for p in last)
    sizes = [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]
    out, offset = [p for p in pieces if p[3] != number], 0
    for d, start, length, *_ in last:
        while length:
            part = min(length, sizes[0] - offset)
            out.append((d, start, part, number, offset))
            start, length, offset = start + part, length - part, offset + part
            if offset == sizes[0]:
                sizes, number, offset = sizes[1:], number + 1, 0
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed(docs: DataFrame, tokenizer_file: str, shard_tokens: int = SHARD_TOKENS, with_ids: bool = True) -> DataFrame:
    """A row for each piece (PIECES, and ids as array of int unless they aren't wanted).

    Null and empty texts are documents of the end token alone. Rows are
    packed on their own: repeated rows and null ids are packed as often as
    they come. An empty table gives no rows. Only doc_id and text are read.
    """
    ids = keep(tokenised(docs, tokenizer_file))
    total = ids.agg(F.sum("n")).first()[0] or 0
    n_shards = max(1, math.ceil(total / shard_tokens))

    names = [c.split()[0] for c in PIECES.split(", ")]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [rows for rows in batches if len(rows)]
        if not held:
            return
        doc_ids = pa.concat_arrays([rows.column("doc_id") for rows in held])  # in Arrow, where null and the largest ids have their place
        texts = [np.frombuffer(x.as_buffer(), "<u4") for rows in held for x in rows.column("ids")]
        shard = TaskContext.get().partitionId()
        found = pack(texts)
        for i in range(0, len(found), 1000):
            part = found[i : i + 1000]
            cut = [texts[d][s : s + k] for d, s, k, *_ in part]
            columns = [[p[1] for p in part], [p[2] for p in part], [zlib.crc32(x.tobytes()) for x in cut], [len(texts[p[0]]) for p in part], [(shard << 32) + p[3] for p in part], [p[4] for p in part]]
            arrays = [doc_ids.take(pa.array([p[0] for p in part])), *[pa.array(c, pa.int64()) for c in columns]]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in cut], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)
        del held, texts
        release()

    shards = ids.repartitionByRange(n_shards, "signature", "uid").sortWithinPartitions("signature", "uid")
    return shards.mapInArrow(fill, PIECES + ", ids array<int>" * with_ids)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"), with_ids=False)
