"""Language identification by compression against per-language raw-content zstandard dictionaries.

A text is reduced to lower-case letters and single spaces, cut into blocks, and each block is compressed with every
language's dictionary. The language with the fewest bytes in all wins; a narrow margin to the second rejects the text.

Defined results: null texts and texts without a letter get language `und`, score 0, and are rejected; a tie goes to the
language with more training texts, then to the smaller name, and is rejected; without any labelled text every result is
`und`. Columns of the input that have the names of the results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
LEVEL = 6
BLOCK = 2048
DICTIONARY_BYTES = 160 << 10
"""Bound of one language's dictionary."""
SLICE_CHARS = 1000
"""Most characters that one training text gives to a dictionary."""
MAX_LANGUAGES = 256
"""Bound of what is broadcast: this many dictionaries."""
MIN_MARGIN = 0.003
"""Least relative lead of the best language over the second."""

RESULT = "struct<lang_pred:string,score:double,margin:double,accepted:boolean>"


@dataclass(frozen=True)
class LanguageModel:
    """Dictionaries by language, most frequent language first."""

    dictionaries: dict[str, bytes] = field(default_factory=dict)
    level: int = LEVEL
    block: int = BLOCK


def letters(text: F.Column) -> F.Column:
    """Lower-case letters and single spaces."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", dictionary_bytes: int = DICTIONARY_BYTES, seed: int = 7) -> LanguageModel:
    """Dictionaries from a bounded sample of the labelled texts.

    Each language's distinct texts are sampled by a seeded hash, about three times as many as fill `dictionary_bytes`;
    each gives one slice of at most SLICE_CHARS characters. What reaches the driver is bounded by MAX_LANGUAGES such
    samples; more languages raise ValueError.
    """
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text rlike '\\\\p{L}'")
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "text"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h", 0.02).alias("d"), F.avg(F.least(F.length("text"), F.lit(SLICE_CHARS))).alias("chars"))
    counts = {r["lang"]: r for r in sizes.limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return LanguageModel()
    # The hash is uniform over distinct texts, so copies of one text fall together and count once.
    shares = {k: min(1.0, 3 * dictionary_bytes / max(1.0, r["chars"]) / max(1, r["d"])) for k, r in counts.items()}
    share = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])[F.col("lang")]
    unit = F.pmod(F.shiftrightunsigned("h", 11), F.lit(1 << 30)) / F.lit(float(1 << 30))
    start = F.lit(1) + F.pmod(F.col("h"), F.greatest(F.lit(1), F.length("text") - SLICE_CHARS))
    piece = letters(F.substring("text", start.cast("int"), F.lit(SLICE_CHARS)))
    sample = rows.where(unit < share).groupBy("lang", "h").agg(F.min(piece).alias("piece"))
    pieces: dict[str, list] = {}
    for r in sample.collect():
        pieces.setdefault(r["lang"], []).append((r["h"], r["piece"].encode()))
    out = {}
    for name in sorted(counts, key=lambda k: (-counts[k]["n"], k)):
        taken, size = [], 0
        for _, piece_bytes in sorted(pieces.get(name, [])):
            if size + len(piece_bytes) + 1 <= dictionary_bytes:
                taken.append(piece_bytes)
                size += len(piece_bytes) + 1
        out[name] = b" ".join(taken)
    # zstandard takes no shorter dictionary: a language with fewer bytes of letters can't be predicted.
    return LanguageModel({k: v for k, v in out.items() if len(v) >= 8})


class Classifier:
    """The compressors of a model; made once in each Python worker."""

    def __init__(self, model: LanguageModel) -> None:
        self.block = model.block
        self.compressors = []
        for name, content in model.dictionaries.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=model.level)
            self.compressors.append((name, zstandard.ZstdCompressor(level=model.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))

    def sizes(self, data: bytes) -> list[int]:
        blocks = [data[i : i + self.block] for i in range(0, len(data), self.block)]
        return [sum(len(c.compress(b)) for b in blocks) for _, c in self.compressors]

    def classify(self, reduced: str | None, min_margin: float = MIN_MARGIN) -> tuple[str, float, float, bool]:
        if not reduced or reduced == " " or not self.compressors:
            return UNKNOWN, 0.0, 0.0, False
        sizes = self.sizes(reduced.encode())
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.compressors[0][0], 1.0, 1.0, True
        lead = min(s for i, s in enumerate(sizes) if i != best) - sizes[best]
        margin = lead / max(1, sizes[best])
        return self.compressors[best][0], 1 - 2.0 ** -(1 + lead / 4), margin, lead > 0 and margin >= min_margin


def predict(df: DataFrame, model: LanguageModel, text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """df with lang_pred, score (0 to 1), margin and accepted; row by row, without a shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most MAX_LANGUAGES dictionaries
    held: list[Classifier] = []

    def apply(reduced: pd.Series) -> pd.DataFrame:
        if not held:
            held.append(Classifier(shared.value))
        return pd.DataFrame([held[0].classify(x, min_margin) for x in reduced], columns=["lang_pred", "score", "margin", "accepted"])

    result = F.pandas_udf(apply, RESULT)(letters(F.col(text)))
    names = ["lang_pred", "score", "margin", "accepted"]
    rest = [c for c in df.columns if c not in names]
    return df.select(*[F.col(f"`{c}`") for c in rest], result.alias("__language")).select(*[F.col(f"`{c}`") for c in rest], *[F.col(f"__language.{n}") for n in names])
