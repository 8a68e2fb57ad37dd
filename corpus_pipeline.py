"""The training-corpus pipeline: each stage calls one operator of ``ledgerlens.llm`` and works on what the stage before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. :func:`run` writes each stage's result as Parquet in
the shared checkpoint folder and reads it again for the next, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import exact_dedup as _dedup, mixing as _mixing, pieces as _pieces, quality_rules as _rules, simhash as _simhash
from ledgerlens.llm.common import shared_folder, table

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the proven cutoffs reject go."""
    return _rules.kept_rows(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, that with the largest doc_id."""
    return _dedup.deduplicated(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-equal fingerprints stays."""
    return _simhash.representatives(docs, shingle=3, max_bits=3)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a row for each time."""
    return _mixing.mixed_rows(docs)


def sentencepiece_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, and whether the ids decode to the text again (a null text counts as empty)."""
    return _pieces.round_trip(docs, _pieces.read_model(PIECE_MODEL))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("mixing sources to target weights", source_mixing),
    ("SentencePiece encoding and decoding", sentencepiece_round_trip),
]

# SQL can't express the fingerprints and the encoding; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path := f"{folder}/{n}")
        docs = spark.read.parquet(path)
    return docs
