"""Quality rules with the frequency of lines across the documents of a host.

1. One pass over the texts measures each document and hashes its normalised lines: words in lower case (A to Z), joined by
   single spaces. What it gives, a few bytes a line, is stored; all later steps read that and no text.
2. The distinct documents of a host that hold a line are counted. A document counts once, however many exact copies it has:
   copies are for deduplication, they make no line boilerplate.
3. Lines above both limits, a number of documents and a share of the host's, are removed.
4. A document is rejected if a base rule fails, or if it is depleted: too few words, or too small a share of them, are left.

Counts are partial sums before they are shuffled, and rows meet only a (host, line) or a (host, text) that is stored, so
the adaptive planner can split the hot ones. Lines and repeated windows are told apart by 64-bit hashes, texts by 128 bits.

Defined results: null and empty texts have no words and fail the base rule; a null host is a host of its own; repeated rows
and rows with null or repeated ids come back each for itself. Lines without a word are no lines. Other columns of the
input are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, hashed_words, materialize, mix, sequence_hashes, utf8

MOST = 10
"""Lines in more distinct documents of a host than this are removed, if they are in"""
PER = 1000
"""more than one in so many of them too."""
LEAST_WORDS = 10
"""Documents with fewer words, at first or after the removal, are rejected,"""
LEAST_LEFT = 20
"""and those of whose words less than so many in a hundred are left."""
MOST_REPEATED = 20
"""Documents with more than so many in a hundred words in repeated windows are rejected."""
WINDOW = 5

_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False
_SOLID[0x80:0xC0] = False  # continuation bytes begin no code point
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_MEASURED = "id {id}, host string, content binary, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<long>"


def line_hashes(text: bytes) -> tuple[int, dict[int, int]]:
    """Lines equal to an earlier one, and the words of all lines by the hash of the normalised line."""
    again, seen, words = 0, set(), {}
    for line in text.split(b"\n"):
        own = line.split()
        if own:
            if line in seen:
                again += 1
            seen.add(line)
            h = xxhash.xxh3_64_intdigest(b" ".join(own).lower())
            words[h] = words.get(h, 0) + len(own)
    return again, words


def repeated_words(words: np.ndarray, lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each text, its words that lie in windows found twice or more in it; words are all texts' word hashes."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    hashes = sequence_hashes(words, window, 3)
    if not len(hashes):
        return np.zeros(len(lengths), np.int64)
    at = np.flatnonzero(row[: len(hashes)] == row[window - 1 :])
    _, number, times = np.unique(mix(hashes[at] ^ mix(row[at].astype(np.uint64), 31)), return_inverse=True, return_counts=True)
    at = at[times[number] > 1]
    marks = np.zeros(len(words) + 1, np.int32)
    marks[at] += 1
    np.subtract.at(marks, at + window, 1)
    return np.bincount(row[np.cumsum(marks)[:-1] > 0], minlength=len(lengths))


def _content(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text"):
        column = batch.column("text")
        words, lengths = hashed_words(column)
        cells: dict[str, list] = {k: [] for k in ("content", "word_chars", "n_symbols", "n_dup_lines", "lines", "line_words")}
        for text in column:
            data = text.as_buffer()
            view, data = np.frombuffer(data, np.uint8), data.to_pybytes()
            again, own = line_hashes(data)
            values = _content(data), np.count_nonzero(_SOLID[view]), np.count_nonzero(_SYMBOL[view]), again, np.fromiter(own, np.uint64, len(own)).view(np.int64), np.fromiter(own.values(), np.int64, len(own))
            for into, x in zip(cells.values(), values, strict=True):
                into.append(x)
        kinds = {"content": pa.binary(), "lines": pa.list_(pa.int64()), "line_words": pa.list_(pa.int64())}
        made = {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in cells.items()} | {"n_words": pa.array(lengths, pa.int64()), "n_repeat_words": pa.array(repeated_words(words, lengths), pa.int64())}
        names = ["content", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words"]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("host"), *(made[n] for n in names)], ["id", "host", *names])


def measured(df: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(id, host, content, the measures, lines, line_words) of every row, stored. content is a hash of the text."""
    rows = df.select(F.col(id).alias("id"), F.col(host).cast("string").alias("host"), utf8(F.col(text)).alias("text"))
    return materialize(rows.mapInArrow(_measure, _MEASURED.format(id=df.schema[id].dataType.simpleString())), "measured")


def frequent_lines(rows: DataFrame, most: int = MOST, per: int = PER) -> DataFrame:
    """(host, content, gone, removed) of the distinct texts of measured rows that hold lines above the limits.

    gone are the hashes of these lines, removed their words.
    """
    texts = rows.where(F.size("lines") > 0).groupBy("host", "content").agg(F.first("lines").alias("lines"), F.first("line_words").alias("words"))
    texts = materialize(texts, "texts")
    hosts = materialize(texts.groupBy("host").agg(F.count("*").alias("texts")), "hosts").withColumnRenamed("host", "of")
    counts = texts.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > most)
    above = counts.join(hosts, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") * per > F.col("texts")).select("of", F.col("line").alias("above"))
    above = materialize(above, "frequent-lines")
    lines = texts.select("host", "content", F.explode(F.arrays_zip("lines", "words")).alias("x")).select("host", "content", "x.lines", "x.words")
    met = lines.join(above, F.col("host").eqNullSafe(F.col("of")) & (F.col("lines") == F.col("above")))
    return materialize(met.groupBy("host", "content").agg(F.collect_list("lines").alias("gone"), F.sum("words").alias("removed")), "depleted")


def line_rules(df: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", most: int = MOST, per: int = PER) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_left) of every row."""
    rows = measured(df, id, text, host)
    gone = frequent_lines(rows, most, per).select(F.col("host").alias("of"), F.col("content").alias("text"), "removed")
    joined = rows.drop("lines", "line_words").join(gone, F.col("host").eqNullSafe(F.col("of")) & (F.col("content") == F.col("text")), "left")
    left = F.col("n_words") - F.coalesce("removed", F.lit(0))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    kept = ~failed & (left >= LEAST_WORDS) & (100 * left >= LEAST_LEFT * F.col("n_words"))
    return joined.select(F.col("id").alias(id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), left.alias("n_left"))


def _drop_lines(text: bytes, gone: set[int]) -> bytes:
    return b"\n".join(x for x in text.split(b"\n") if not (w := x.split()) or xxhash.xxh3_64_intdigest(b" ".join(w).lower()) not in gone)


def without_frequent_lines(df: DataFrame, text: str = "text", host: str = "source", most: int = MOST, per: int = PER) -> DataFrame:
    """df with `text_left`, the text without the lines above the limits; null stays null."""
    gone = frequent_lines(measured(df.withColumn("__id", F.lit(0)), "__id", text, host), most, per)

    @F.udf("binary", useArrow=True)
    def content(x):
        return None if x is None else _content(bytes(x))

    @F.udf("binary", useArrow=True)
    def cut(x, lines):
        return x if x is None or lines is None else _drop_lines(bytes(x), {h & (2**64 - 1) for h in lines})

    keyed = df.withColumn("__key", content(F.col(text).cast("binary")))
    found = gone.select(F.col("host").alias("__of"), F.col("content").alias("__content"), F.col("gone").alias("__gone"))
    joined = keyed.join(found, F.col(host).cast("string").eqNullSafe(F.col("__of")) & (F.col("__key") == F.col("__content")), "left")
    return joined.select(*df.columns, cut(F.col(text).cast("binary"), "__gone").cast("string").alias("text_left"))
