"""Token counts by a finite-state transducer compiled from a model's pieces.

A byte-pair model merges the best pair of neighbours until none is left. Two
facts make it a finite-state machine. What is merged on one side of a place
doesn't depend on the other side, so a text's pieces are the one sequence in
which each piece stays whole on its own and no two neighbours merge across
their border. And as pieces are short, the last piece of a prefix follows from
the last pieces of a few shorter prefixes. A state is therefore the list of
places where a piece may have begun that isn't at its end: what has been read
of it, the last piece before it, and how many tokens fewer were out there. A
transition on a character goes to the next state and is annotated with the
tokens it emits; it is a difference, and negative where the character joins
pieces. States and transitions are compiled from the pieces when a text first
reaches them; the library isn't asked.

Where no piece goes on from a word to a blank, every state goes to the same
one on the first blank after a word. So a chunk of text is a map of states to
states that is known but for its beginning: its text up to such a blank, the
tokens emitted from there, and the state it ends in. Maps compose
associatively; a long text's chunks are mapped on their own and composed
pairwise, as in a parallel prefix scan.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import release, small_batches, table, text_of
from ledgerloom.llm.sentencepiece_codec import BPE, MARK, NORMAL, UNUSED, USER, Model, public_path

CHUNK_CHARS = 1 << 16
#: What one task keeps before it starts anew: states, pairs of pieces, and characters of words whose way through the states is known.
STATES, BORDERS, WORD_CHARS = 200_000, 200_000, 25_000_000
UNIT = re.compile(r" +[^ ]*")


def split_units(text: str) -> list[str]:
    """The units of a text before which a blank is put, each without its first blank."""
    if "  " in text or text[:1] == " " or text[-1:] == " ":
        return [u[1:] for u in UNIT.findall(" " + text)]
    return text.split(" ")


@dataclass(frozen=True)
class ChunkMap:
    """head: the text before the first blank that follows a word; from there, the tokens that are emitted and the end state. Without such a blank all is head."""

    head: str
    emitted: int
    end: int | None


class Transducer:
    """For one byte-pair model with byte fallback whose normaliser only marks blanks."""

    def __init__(self, model: Model):
        plain = model.kind == BPE and model.dummy_prefix and model.mark_blanks and not model.squeeze_blanks and not model.char_map and model.has_bytes
        self.score = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER, UNUSED)}
        if not plain or MARK not in self.score or any(MARK in p.lstrip(MARK) for p in self.score) or any(kind == USER for *_, kind in model.pieces):
            raise ValueError("only byte-pair models with byte fallback, an identity normaliser and no piece across words are supported")
        self.begins = {p[:k] for p in self.score for k in range(1, len(p))}
        self.borders: dict[tuple[str, str], bool] = {}
        self.built: dict[str, tuple[bool, list, list]] = {}
        self.words: dict[str, int] = {}
        self.word_chars = 0
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.moves: list[dict[str, tuple[int, int]]] = []
        self.start = self.number(((MARK, "", -1), ("", MARK, 0)))  # the mark before a text, as before every word

    def bound(self) -> None:
        """Start anew with what has grown too large. Not while states are in use."""
        if len(self.states) > STATES:
            self.clear()
        if len(self.borders) > BORDERS:
            self.borders.clear()
            self.built.clear()
        if self.word_chars > WORD_CHARS:
            self.words.clear()
            self.word_chars = 0

    def number(self, state: tuple) -> int:
        if (known := self.numbers.get(state)) is None:
            known = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        return known

    def build(self, piece: str) -> tuple[bool, list, list]:
        """How the model merges the piece's characters (best score first, then the leftmost): whether all become one, and the (score, part) that each merge leaves at the left and at the right end."""
        if (known := self.built.get(piece)) is None:
            parts, score = list(piece), self.score
            left, right = [(0.0, parts[0])], [(0.0, parts[-1])]
            while found := [(-score[ab], i) for i in range(len(parts) - 1) if (ab := parts[i] + parts[i + 1]) in score]:
                worth, i = min(found)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                left.append((-worth, parts[0]))
                right.append((-worth, parts[-1]))
            known = self.built[piece] = (len(parts) == 1, left, right)
        return known

    def apart(self, a: str, b: str) -> bool:
        """Whether b is built whole and apart from the piece a before it (empty: nothing that merges). The merges of both sides go by score; one across the border would have to come before the next of either side."""
        if (known := self.borders.get((a, b))) is None:
            known, left, _ = self.build(b)
            if known and a:
                right, score, i, j = self.build(a)[2], self.score, 0, 0
                while True:
                    next_a = right[i + 1][0] if i + 1 < len(right) else -math.inf
                    next_b = left[j + 1][0] if j + 1 < len(left) else -math.inf
                    across = score.get(right[i][1] + left[j][1])
                    if across is not None and across > next_a and across >= next_b:
                        known = False
                        break
                    if next_a == next_b == -math.inf:
                        break
                    if next_a >= next_b:
                        i += 1
                    else:
                        j += 1
            self.borders[a, b] = known
        return known

    def compile(self, state: int, c: str) -> tuple[int, int]:
        """The transition on c: the next state and the tokens emitted."""
        places, score, begins = self.states[state], self.score, self.begins
        if c == MARK and places[-1][1][-1:] != MARK:
            move = (self.start, 1)
        elif c not in score:  # its bytes are tokens, and nothing merges with them
            move = (self.number((("", "", 0),)), len(c.encode("utf-8", "surrogatepass")))
        else:
            piece, emitted, open_ = None, 0, []
            for begun, before, behind in places:
                text = begun + c
                if piece is None and text in score and self.apart(before, text):
                    piece, emitted = text, behind + 1
                if text in begins:
                    open_.append((text, before, behind))
            move = (self.number((*[(t, before, behind - emitted) for t, before, behind in open_], ("", piece, 0))), emitted)
        self.moves[state][c] = move
        return move

    def run(self, state: int, text: str) -> tuple[int, int]:
        moves, total = self.moves, 0
        for c in text:
            try:
                state, emitted = moves[state][c]
            except KeyError:
                state, emitted = self.compile(state, c)
            total += emitted
        return state, total

    def total(self, units: list[str]) -> int:
        """Tokens of units (blanks and the word after them, without the first blank), each from the same state to the next unit's first blank."""
        try:
            return sum(map(self.words.__getitem__, units))
        except KeyError:
            for u in set(units).difference(self.words):
                self.words[u] = 1 + self.run(self.start, u.replace(" ", MARK))[1]
                self.word_chars += len(u) + 100  # what the entry takes besides
            return sum(map(self.words.__getitem__, units))

    def chunk_map(self, chunk: str) -> ChunkMap:
        """chunk: text whose blanks aren't marked yet."""
        if (found := re.search("(?<=[^ ]) ", chunk)) is None:
            return ChunkMap(chunk, 0, None)
        units = split_units(chunk[found.start() + 1 :])
        end, emitted = self.run(self.start, units[-1].replace(" ", MARK))
        return ChunkMap(chunk[: found.start()], self.total(units[:-1]) + 1 + emitted, end)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """The map of a's text followed by b's."""
        if a.end is None:
            return self.chunk_map(a.head + b.head) if b.end is None else self._with_head(self.chunk_map(a.head + b.head), b)
        end, emitted = self.run(a.end, b.head.replace(" ", MARK))
        return ChunkMap(a.head, a.emitted + emitted + b.emitted, end if b.end is None else b.end)

    def _with_head(self, head: ChunkMap, b: ChunkMap) -> ChunkMap:
        return ChunkMap(head.head, head.emitted + b.emitted, b.end)

    def count(self, text: str) -> int:
        if not text:
            return 0
        self.bound()
        text = text.replace(MARK, " ")  # the model takes both for the same
        if len(text) <= CHUNK_CHARS:
            return self.total(split_units(text))
        maps = [self.chunk_map(text[i : i + CHUNK_CHARS]) for i in range(0, len(text), CHUNK_CHARS)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return 1 + self.run(self.start, maps[0].head.replace(" ", MARK))[1] + maps[0].emitted


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row, from whole texts and without a shuffle.

    Null and empty texts have no bytes and no tokens. Rows are counted on
    their own, so repeated rows and null ids come out as they went in,
    whatever other columns docs has. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        transducer = Transducer(Model.load(model_file))
        for texts in batches:
            yield pd.Series([transducer.count(x) for x in texts], dtype="int64")
        del transducer
        release()

    n_tokens = F.pandas_udf(count, "long")(text_of())
    return docs.select("doc_id", F.octet_length(text_of()).cast("long").alias("n_bytes"), n_tokens.alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_path("piece_bpe_32k.model"))
