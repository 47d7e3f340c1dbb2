"""The corpus pipeline: documents to token ids, one operator of spindrift.llm a stage.

Each stage is written as Parquet to the shared folder and read again by the next. All but the last keep the columns of
documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import langid, mixing, partenum, pii, viterbi
from spindrift.llm.common import materialize, own_ids, table, unique_ids, word_count


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain; dictionaries are learned from the documents' own labels.

    Texts that are null or without a letter, and texts with a narrow margin, go.
    """
    model = langid.train(docs)
    return langid.predict(docs.select(*docs.columns, F.col("text").alias("__text")), model, "__text").where("accepted").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near duplicates: 5-word shingles, similarity of 0.8 or more.

    Rows that share an id are documents of their own. Of them and of those without an id, which come after all others,
    any one stays.
    """
    keyed, keys = unique_ids(docs, "doc_id")
    groups = partenum.jaccard_components(keyed, partenum.Threshold(5, 4, 5))
    others = groups.where("component_id <> doc_id").select("doc_id")
    return own_ids(keyed.join(others, "doc_id", "left_anti"), keys, "doc_id").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind of the data in place of personal data, and n_chars of the new text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents that it doesn't take go.

    Rows that have an id and a size in common, null ids too, all come as often as the one that is taken most.
    """
    copies = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    taken = mixing.mix(docs).groupBy(F.col("doc_id").alias("__id"), F.col("size").alias("__size")).agg(F.max(copies).alias("__copies")).where("__copies > 0")
    again = docs.join(taken, F.col("doc_id").eqNullSafe(F.col("__id")) & (word_count(F.col("text")) == F.col("__size")))
    return again.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids and whether they decode to the text."""
    return viterbi.encode_checked(docs.select("doc_id", "lang", "source", "text"), viterbi.load()).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: Compression and knapsack results can't be told in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
