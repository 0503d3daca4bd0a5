"""A training-data pipeline over `documents`: each stage reads what the one before kept and is written as Parquet."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soundtable.llm import bpe, decontamination, exact_dedup, language_id, simhash
from soundtable.llm.common import discard, load, write_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in no known language go (no letters, empty, null). The source stands for the host; it and the id may be null, rows may
    repeat; an empty table stays empty."""
    model = language_id.train(spark, docs, F.col("text"), F.col("lang"), F.col("doc_id"))
    return language_id.keep_identified(spark, docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null: empty) the row with the largest doc_id stays, a null one only where there is no other; rows that repeat
    id and text share their fate; an empty table stays empty."""
    return exact_dedup.drop_exact_copies(spark, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a five-word-shingle similarity of 0.8 or more, the one with the smallest doc_id stays (nulls last); null and
    empty texts link with none; an empty table stays empty."""
    return simhash.drop_near_copies(spark, docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of `benchmark` go, and rows of the same id and text with them; null and empty texts stay. Either
    table may be empty."""
    return decontamination.drop_contaminated(spark, docs, load(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids, n_tokens, decoded_ok): the encoded documents, and whether decoding gives the text back. A null text has no ids."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = docs.select("doc_id", "lang", "source", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sum"))
    encoded = bpe.encode(rows, ranks, public_tokenizers.PATTERN, keep=("doc_id", "lang", "source", "sum"), decoded=True)
    return encoded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.sha2("decoded", 256) == F.col("sum")).alias("decoded_ok"))


STAGES = [("language_id", language), ("exact_dedup", exact), ("simhash_near_dedup", near), ("decontaminate", decontaminate), ("bpe", tokens)]

#: SQL can express neither the language model, nor the fingerprints, nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over `documents`: (doc_id, lang, source, ids, n_tokens, decoded_ok) of each document that stays.

    Each stage is written to the shared folder and read again by the next; its table goes when the next one is written. An
    empty table gives an empty result. Ids may be null or repeat: rows are told apart by id and text, equal ones share
    their fate.
    """
    docs, before = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = write_table(spark, stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
