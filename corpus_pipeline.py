"""From raw documents to packed training sequences: five stages, each over all its predecessor kept.

Each stage is a function of (spark, docs, folder of the tables) and is written as Parquet before the
next one reads it. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from budgetstar.llm import decontaminate, exact_dedup, near_join, packing, toxicity
from budgetstar.sources.shared import cut_lineage

TOKENIZER, END_ID = "word_bpe_49k.json", 1


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine trained on the labelled ones takes for toxic go."""
    machine = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, machine)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z in either case) the one with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts linked by a similarity of 0.8 the one with the largest doc_id stays."""
    return near_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all that is left, in sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), END_ID)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
ORACLE_SQL = None  # SQL expresses neither the trained machine nor the tokenizer


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
