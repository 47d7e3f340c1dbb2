"""SentencePiece encoding and decoding by a streaming Viterbi search.

The text is read in parts through an automaton that finds the pieces ending at each character. Only the boundaries that a
piece could still start at, as many as the longest piece has characters, stay alive; as soon as the best paths to all of
them pass one boundary, the pieces up to there are committed and forgotten. Where no piece of the vocabulary can cross a
boundary, as before a word's space mark, that is so by itself, so the search runs from one such boundary to the next, and
the ids that it gave for short stretches are remembered.

A model of scores (unigram) takes the segmentation with the largest sum of piece scores. A model of merges (BPE) has one
segmentation of each prefix, and that is known by its neighbours: a sequence of pieces is what merging gives if and only
if merging gives back each two neighbours of it. So there is one path to each boundary, along the only piece whose
predecessor it can follow, and the search needs no other change. Both give the ids of the sentencepiece library.

Defined results: of equal sums the last piece that differs is the longer one; characters without a piece become their
UTF-8 bytes' pieces, or the unknown piece if the model has no byte pieces. Null texts have null ids, empty texts no ids. Decoding gives the encoded text; U+2581, which stands for a
space inside the model, decodes as a space. The model must leave texts as they are (identity normalization).
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True, eq=False)
class Vocabulary:
    """Pieces with id and score, and what characters without a piece become."""

    pieces: dict[str, tuple[int, float]]
    bytes: tuple[int, ...]
    unknown: int
    prefix: bool = True
    merges: bool = False

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)

    @property
    def unknown_score(self) -> float:
        """Below every piece that was trained; pieces that the user defined have scores far below."""
        return min((s for _, s in self.pieces.values() if s > -1e8), default=0.0) - UNKNOWN_PENALTY


def load(path: str = MODEL) -> Vocabulary:
    """The vocabulary of a model file, read on the driver."""
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
    by_byte = {int(m.id_to_piece(i)[1:-1], 16): i for i in range(m.get_piece_size()) if m.is_byte(i)}
    pieces = {m.id_to_piece(i): (i, m.get_score(i)) for i in plain}
    # The scores of merges are their negated ranks, those of a unigram model logarithms.
    merges = all(s == int(s) for _, s in pieces.values())
    return Vocabulary(pieces, tuple(by_byte[b] for b in range(256)) if len(by_byte) == 256 else (), m.unk_id(), merges=merges)


class Encoder:
    """Encodes texts; remembers the ids of a bounded number of short stretches."""

    MOST, SHORT = 500_000, 32

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v, self.longest, self.lost = vocabulary, vocabulary.longest, vocabulary.unknown_score
        # No piece has a space mark after another character: no path crosses the boundary before one.
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in vocabulary.pieces)
        self.stretch = re.compile(f"{SPACE}*[^{SPACE}]*")
        self.known, self.spelled = _Known(self), _Spelled(vocabulary)
        self.neighbours: dict[tuple[str, str], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for p in vocabulary.pieces:
            self.automaton.add_word(p, (p, len(p)))
        self.automaton.make_automaton()

    def merged(self, text: str) -> list[str]:
        """What merging makes of a short text: of all neighbours that join to a piece, the one of best score first."""
        pieces, none = self.v.pieces, -np.inf

        def joined(i: int) -> float:
            return piece[1] if (piece := pieces.get(parts[i] + parts[i + 1])) else none

        parts = list(text)
        scores = [joined(i) for i in range(len(parts) - 1)]
        while scores and (best := max(scores)) != none:
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = joined(at - 1)
            if at < len(scores):
                scores[at] = joined(at)
        return parts

    def follows(self, before: str, piece: str) -> bool:
        """Whether a piece can come after another one, or first, where `before` is empty."""
        key = (before, piece)
        if (known := self.neighbours.get(key)) is None:
            if len(self.neighbours) > self.MOST:
                self.neighbours.clear()
            known = self.neighbours[key] = self.merged(before + piece) == ([before, piece] if before else [piece])
        return known

    def stream(self, text: str | Iterable[str], window: int | None = None) -> Iterator[list[int]]:
        """Ids of the best path through a text or its parts, committed once no path that is alive avoids them.

        Positions count from the last committed boundary. The longest piece's characters and `window` more (by default
        as many again) are held before the paths are compared, so memory is bounded whatever the text's length.
        """
        window = self.longest if window is None else window
        most = self.longest + window
        parts = (text[i : i + most] for i in range(0, len(text), most)) if isinstance(text, str) else text
        held, extend = "", self.follow if self.v.merges else self.add
        last, best = [""], [0.0]  # by boundary: the last piece of the best path to it, and that path's sum
        for part in parts:
            held += part
            extend(held, last, best)
            while len(held) >= most and (met := self.met(last)):
                yield self.ids(last, met)
                held, last, best = held[met:], last[met:], best[met:]
        yield self.ids(last, len(held))

    def ending(self, held: str, done: int) -> Iterator[tuple[int, tuple[str, int]]]:
        """(end, (piece, its length)) of the pieces in held that end after `done` characters, and some that end before.

        Of the pieces that end at one boundary the longest comes first.
        """
        begin = max(0, done - self.longest + 1)
        found = self.automaton.iter(held[begin:])
        return ((begin + end, x) for end, x in found) if begin else found

    def follow(self, held: str, last: list[str], best: list[float]) -> None:
        """Extend `last` to all of `held`, for merges: each boundary takes the one piece ending there that can follow the piece before it."""
        known, at = self.neighbours, len(last)
        for end, (piece, n) in self.ending(held, at - 1):
            e = end + 1
            if e < at:
                continue  # it has its piece
            last += held[at - 1 : e - 1]  # characters without a piece
            at = e
            before = last[e - n]
            if (fits := known.get((before, piece))) is None:
                fits = self.follows(before, piece)
            if fits:
                last.append(piece)
                at = e + 1
        last += held[at - 1 :]

    def add(self, held: str, last: list[str], best: list[float]) -> None:
        """Extend `last` and `best` to all of `held`, for scores: each boundary takes the piece of the largest sum, of equals the longest."""
        pieces = self.v.pieces

        def close(e: int) -> None:
            """Fix all boundaries up to e: a character without a piece may stand for itself."""
            for i in range(len(last), e + 1):
                score, piece = found.pop(i, (-np.inf, ""))
                if held[i - 1] not in pieces and best[i - 1] + self.lost > score:
                    score, piece = best[i - 1] + self.lost, held[i - 1]
                best.append(score)
                last.append(piece)

        found: dict[int, tuple[float, str]] = {}
        done = len(last) - 1
        for end, (piece, n) in self.ending(held, done):
            e = end + 1
            if e <= done:
                continue
            close(e - 1)
            if (score := best[e - n] + pieces[piece][1]) > found.get(e, (-np.inf, ""))[0]:
                found[e] = score, piece
        close(len(held))

    def met(self, last: list[str]) -> int:
        """The boundary that the best paths to all alive boundaries, those at which a piece can still begin, have in common."""
        alive = set(range(max(0, len(last) - self.longest), len(last)))
        while len(alive) > 1:
            e = max(alive)
            alive.discard(e)
            alive.add(e - len(last[e]))
        return alive.pop()

    def ids(self, last: list[str], end: int) -> list[int]:
        """Ids of the best path to a boundary."""
        out = []
        while end:
            out.append(last[end])
            end -= len(last[end])
        return [i for x in reversed(out) for i in self.spelled[x]]

    def encode(self, text: str) -> np.ndarray:
        text = text.replace(" ", SPACE)
        if self.v.prefix and text:
            text = SPACE + text
        if not self.cuts:
            return np.concatenate([np.array(x, np.int32) for x in self.stream(text)])
        if len(self.known) > self.MOST:
            self.known.clear()
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.stretch.findall(text))), np.int32)


class _Spelled(dict):
    """The ids of pieces, and of characters without one."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__((p, (i,)) for p, (i, _) in vocabulary.pieces.items())
        self.v = vocabulary

    def __missing__(self, char: str) -> tuple[int, ...]:
        return tuple(self.v.bytes[b] for b in char.encode()) if self.v.bytes else (self.v.unknown,)


class _Known(dict):
    """The ids of stretches, searched when first asked for; of short ones they are kept."""

    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.encoder = encoder

    def __missing__(self, stretch: str) -> bytes:
        found = b"".join([array("i", ids).tobytes() for ids in self.encoder.stream(stretch)])
        if len(stretch) <= self.encoder.SHORT:
            self[stretch] = found
        return found


class Decoder:
    """Decodes ids to texts."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        table = {i: p.replace(SPACE, " ").encode() for p, (i, _) in vocabulary.pieces.items()} | {i: bytes([b]) for b, i in enumerate(vocabulary.bytes)}
        self.table, self.prefix = table | {vocabulary.unknown: " ⁇ ".encode()}, vocabulary.prefix

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def coders(vocabulary: Vocabulary) -> tuple[Encoder, Decoder]:
    """Made once in each Python worker: its tasks share the broadcast vocabulary, and so what the encoder remembers."""
    return Encoder(vocabulary), Decoder(vocabulary)


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "ids") -> DataFrame:
    """df with the ids of column text as array<int>; row by row, without a shuffle. A column named out is replaced."""
    return _map(df, vocabulary, text, [(out, "array<int>")], lambda column, coder, _: [pa.array([None if x is None else coder.encode(x) for x in column.to_pylist()], pa.list_(pa.int32()))])


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "text") -> DataFrame:
    """df with the text that column ids stands for. A column named out is replaced."""
    return _map(df, vocabulary, ids, [(out, "string")], lambda column, _, coder: [pa.array([None if x is None else coder.decode(x) for x in column.to_pylist()], pa.string())])


def encode_checked(df: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """df with n_ids, ids and round_trip: whether decoding gives the text back."""

    def apply(column: pa.Array, encoder: Encoder, decoder: Decoder) -> list[pa.Array]:
        texts = column.to_pylist()
        found = [None if x is None else encoder.encode(x) for x in texts]
        same = [None if x is None else decoder.decode(i.tolist()) == x.replace(SPACE, " ") for x, i in zip(texts, found, strict=True)]
        return [pa.array([None if i is None else len(i) for i in found], pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(same, pa.bool_())]

    return _map(df, vocabulary, text, [("n_ids", "long"), ("ids", "array<int>"), ("round_trip", "boolean")], apply)


def _map(df: DataFrame, vocabulary: Vocabulary, column: str, new: list[tuple[str, str]], apply) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)  # one model file
    rest = [c for c in df.columns if c not in dict(new)]
    own = "_".join(["__column", *rest])  # the name of no other column
    source = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{column}`").alias(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = coders(shared.value)
        for batch in by_bytes(batches, own, 2 << 20) if pa.types.is_string(source_type) else _halves(batches):
            cells = apply(batch.column(own), encoder, decoder)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cells], [*rest, *[n for n, _ in new]])

    source_type = pa.string() if dict(df.dtypes)[column] == "string" else pa.list_(pa.int32())
    schema = source.drop(own).schema
    for name, kind in new:
        schema = schema.add(name, {"array<int>": T.ArrayType(T.IntegerType())}.get(kind, kind))
    return source.mapInArrow(run, schema)


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            yield batch.slice(start, 1000)
