"""Removal of repeated passages: words in a run of `window` words that occurs anywhere else are cut out.

1. Every window picks one phrase of `seed` words in it, the one of least hash; equal windows pick equal phrases. Phrases
   that are picked just once lie in no repeated window.
2. Documents are dealt to shards. In each shard the windows that pick a repeated phrase are counted by hash, once for each
   shard, and summed over all shards: the sums confirm the repeated windows. One shard that has a repeated phrase gives its
   words.
3. Each shard gets the hashes of the confirmed windows that it counted, and the words of the repeated phrases that its windows
   pick. It compiles an Aho-Corasick automaton from these and streams its documents through it. Only windows around a hit are
   hashed and looked up; those whose hash is confirmed and whose words equal the shard's first window of that hash are
   cut out. Work and memory are linear in a shard's words.

Counts go over the whole corpus, automata are each shard's own: a shard's confirmed windows are all windows of its
documents that occur elsewhere, in any shard, so a phrase that no confirmed window of the shard picks can't be a hit in
its documents. All documents are streamed, each through the automaton of its shard.

A shard holds a bounded number of bytes of text, or one document, and what a window sends is one row for each shard that
has it, so hot passages cost no more than others. Windows are told apart by 64-bit hashes.

Defined results: null and empty texts have no words and keep the hash of the empty string; shorter texts than a window
lose nothing; repeated rows lose all that a window covers, for each one's windows start in the other. Rows with null ids
come back with null ids, and rows that share an id come back each for itself. Columns of the input other than id and text
are not used. A shard, or a document, of 2**28 words or more is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import discard
from .common import by_bytes, hashed_words, materialize, mix, own_ids, sequence_hashes, unique_ids, utf8

WINDOW = 35
SEED = 8
SHARD_BYTES = 6 << 20
"""Text that a shard holds, about."""
BLOCK = 1 << 18
"""Windows whose words are compared at once."""
_PLACE = np.uint64((1 << 28) - 1)


class Words:
    """The words of some texts in one array, and which runs of `window` words lie in one text."""

    def __init__(self, texts: pa.Array, window: int) -> None:
        self.texts, self.window = texts, window
        self.words, self.lengths = hashed_words(texts)
        if len(self.words) > int(_PLACE):
            raise ValueError(f"a shard has {len(self.words)} words")
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.row = np.repeat(np.arange(len(texts)), self.lengths)
        self.valid = np.zeros(0, bool)
        if len(self.words) >= window:
            self.valid = self.row[: len(self.row) - window + 1] == self.row[window - 1 :]

    def picks(self, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all phrases, and by window the place of the one that it picks."""
        phrase = sequence_hashes(self.words, seed, 1)
        if not len(self.valid):
            return phrase, np.zeros(0, np.int64)
        least = (phrase & ~_PLACE) | np.arange(len(phrase), dtype=np.uint64)
        span, width = self.window - seed + 1, 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = span - width
        if rest:
            least = np.minimum(least[:-rest], least[rest:])
        return phrase, (least & _PLACE).astype(np.int64)

    def hashes(self, at: np.ndarray) -> np.ndarray:
        """The hashes of the windows at some places."""
        out = np.empty(len(at), np.uint64)
        factors = mix(np.arange(self.window, dtype=np.uint64), 3) | np.uint64(1)
        for i in range(0, len(at), BLOCK):
            part = at[i : i + BLOCK]
            total = np.zeros(len(part), np.uint64)
            for j in range(self.window):
                total += self.words[part + j] * factors[j]
            out[i : i + BLOCK] = mix(total, 2)
        return out

    def text(self, places: np.ndarray, n: int) -> list[str]:
        """The n words from each place on, between spaces, as Latin-1 text; places ascend."""
        out, held, words = [], -1, []
        for a in places.tolist():
            row = int(self.row[a])
            if row != held:
                held, words = row, self.texts[row].as_buffer().to_pybytes().split()
            begin = a - int(self.starts[row])
            out.append(f" {b' '.join(words[begin : begin + n]).decode('latin-1')} ")
        return out


def _rows(**columns) -> pa.Table:
    return pa.table({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})


def _phrases(window: int, seed: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            x = Words(batch.column("text"), window)
            phrase, picked = x.picks(seed)
            at = np.unique(picked[x.valid])
            shard = np.asarray(batch.column("shard"), np.int64)[x.row[at]]
            phrase = phrase[at].view(np.int64)
            order = np.lexsort((shard, phrase))
            phrase, shard = phrase[order], shard[order]
            first = np.flatnonzero(np.r_[True, (phrase[1:] != phrase[:-1]) | (shard[1:] != shard[:-1])][: len(phrase)])
            yield from _rows(phrase=phrase[first], shard=shard[first], n=np.diff(np.r_[first, len(phrase)])).to_batches()

    return apply


_WINDOWS = "shard long, hash long, n long, phrase long, words string"


def _windows(window: int, seed: int):
    """(shard, hash, n) of the windows that pick a repeated phrase, and (phrase, words) of those that the shard is to give."""

    def apply(docs: pa.Table, phrases: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        if not docs.num_rows or not phrases.num_rows:
            return _rows(shard=none, hash=none, n=none, phrase=none, words=pa.array([], pa.string()))
        docs = docs.combine_chunks()
        x = Words(docs.column("text").chunk(0), window)
        phrase, picked = x.picks(seed)
        at = np.flatnonzero(x.valid)
        at = at[np.isin(phrase[picked[at]], phrases.column("phrase").to_numpy().view(np.uint64))]
        hashes, n = np.unique(x.hashes(at), return_counts=True)
        wanted = phrases.filter(phrases.column("gives")).column("phrase").to_numpy().view(np.uint64)
        places = np.unique(picked[at])
        given, where = np.unique(phrase[places], return_index=True)
        where = np.sort(places[where[np.isin(given, wanted)]])
        words = x.text(where, seed)
        shard = np.full(len(hashes), docs.column("shard")[0].as_py(), np.int64)
        counted = _rows(shard=shard, hash=hashes.view(np.int64), n=n.astype(np.int64))
        return pa.concat_tables([counted, _rows(phrase=phrase[where].view(np.int64), words=pa.array(words, pa.string()))], promote_options="default")

    return apply


def _hits(x: Words, phrases: list[str]) -> np.ndarray:
    """Whether an Aho-Corasick automaton finds one of the phrases at each place of the texts."""
    out = np.zeros(len(x.words), bool)
    automaton = ahocorasick.Automaton()
    for phrase in phrases:
        automaton.add_word(phrase, len(phrase))
    if not len(automaton):
        return out
    automaton.make_automaton()
    for row, text in enumerate(x.texts):
        words = text.as_buffer().to_pybytes().split()
        # Phrases begin and end with a space, so a hit begins with a word's first byte.
        at = np.array([end - n + 2 for end, n in automaton.iter(f" {b' '.join(words).decode('latin-1')} ")], np.int64)
        if len(at):
            lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
            out[x.starts[row] + np.searchsorted(np.cumsum(lengths) - lengths + 1, at)] = True
    return out


def covered(x: Words, repeated: np.ndarray, phrases: list[str], seed: int) -> np.ndarray:
    """Whether each word lies in a window around a phrase whose hash is among the sorted ones in `repeated`."""
    window, marks = x.window, np.zeros(len(x.words) + 1, np.int64)
    if not len(repeated) or not x.valid.any():
        return marks[:-1] > 0
    # Windows that hold a phrase that was found: they start up to window - seed words before it.
    hits = np.flatnonzero(_hits(x, phrases))
    near = np.zeros(len(x.words) + 1, np.int64)
    np.add.at(near, np.maximum(hits - (window - seed), 0), 1)
    np.subtract.at(near, hits + 1, 1)
    at = np.flatnonzero(x.valid & (np.cumsum(near)[: len(x.valid)] > 0))
    hashes = x.hashes(at)
    k = np.minimum(np.searchsorted(repeated, hashes), len(repeated) - 1)
    known = repeated[k] == hashes
    at, k = at[known], k[known]
    first = np.zeros(len(repeated), np.int64)
    first[k[::-1]] = at[::-1]
    for i in range(0, len(at), BLOCK):
        mine, theirs = at[i : i + BLOCK], first[k[i : i + BLOCK]]
        same = np.ones(len(mine), bool)
        for step in range(window):
            same &= x.words[mine + step] == x.words[theirs + step]
        np.add.at(marks, mine[same], 1)
        np.subtract.at(marks, mine[same] + window, 1)
    return np.cumsum(marks)[:-1] > 0


def _cut(window: int, seed: int):
    def apply(docs: pa.Table, repeated: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _rows(id=pa.array([], pa.int64()), n_words=pa.array([], pa.int64()), n_removed=pa.array([], pa.int64()), kept_sha256=pa.array([], pa.string()), kept=pa.array([], pa.string()))
        docs = docs.combine_chunks()
        texts = docs.column("text").chunk(0)
        x = Words(texts, window)
        hashes = repeated.column("hash").drop_null().to_numpy().view(np.uint64)
        gone = covered(x, np.unique(hashes), repeated.column("words").drop_null().to_pylist(), seed)
        kept, removed = [], []
        for row, text in enumerate(texts):
            drop = gone[x.starts[row] : x.starts[row] + x.lengths[row]]
            words = text.as_buffer().to_pybytes().split()
            removed.append(int(drop.sum()))
            kept.append(b" ".join(words if not removed[-1] else [w for w, d in zip(words, drop.tolist(), strict=True) if not d]))
        digests = [hashlib.sha256(b).hexdigest() for b in kept]
        return _rows(id=docs.column("id"), n_words=x.lengths, n_removed=pa.array(removed, pa.int64()), kept_sha256=digests, kept=pa.array(kept, pa.binary()).cast(pa.string()))

    return apply


def remove_repeated(df: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED, shard_bytes: int = SHARD_BYTES, with_text: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept]) of every row: the words left when repeated windows are cut out.

    Windows are judged on the input. `kept` is the words left, joined by single spaces.
    """
    docs = df.select(F.col(id).cast("long").alias("id"), utf8(F.col(text)).alias("text"))
    docs, keys = unique_ids(docs)
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_bytes))
    docs = docs.withColumn("shard", F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(shards)))

    # Sums are made before the rows that they choose are joined to them, so that what all shards have meets in no one task.
    picked = materialize(docs.select("text", "shard").mapInArrow(_phrases(window, seed), "phrase long, shard long, n long"), "picked")
    again = picked.groupBy("phrase").agg(F.sum("n").alias("all"), F.min("shard").alias("giver")).where("all > 1").select(F.col("phrase").alias("of"), "giver")
    phrases = picked.join(again, F.col("phrase") == F.col("of")).select("phrase", "shard", (F.col("shard") == F.col("giver")).alias("gives")).distinct()
    phrases = materialize(phrases, "phrases")
    discard(picked)

    windows = materialize(docs.groupBy("shard").cogroup(phrases.groupBy("shard")).applyInArrow(_windows(window, seed), _WINDOWS), "windows")
    counted = windows.where("hash is not null").select("shard", "hash", "n")
    twice = counted.groupBy("hash").agg(F.sum("n").alias("all")).where("all > 1").select(F.col("hash").alias("of"))
    confirmed = counted.join(twice, F.col("hash") == F.col("of"), "left_semi").select("shard", "hash", F.lit(None).cast("string").alias("words"))
    given = windows.where("words is not null").select(F.col("phrase").alias("of"), "words")
    words = phrases.join(given, F.col("phrase") == F.col("of")).select("shard", F.lit(None).cast("long").alias("hash"), "words")
    repeated = confirmed.unionByName(words).toDF("of", "hash", "words")
    schema = "id long, n_words long, n_removed long, kept_sha256 string, kept string"
    out = docs.groupBy("shard").cogroup(repeated.groupBy("of")).applyInArrow(_cut(window, seed), schema)
    out = own_ids(out, keys).withColumnRenamed("id", id)
    return out if with_text else out.drop("kept")
