"""The corpus pipeline: from raw documents to packed sequences, one operator a stage.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.llm import decontaminate, packing, quality, simhash, substrings
from loglattice.llm.common import materialise, step, table
from loglattice.llm.tokens import default_tokenizer


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, trained on the labelled ones, scores 0.5 or more."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), "quality", F.lit(True))
    return quality.keep_good(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a similarity of 0.8 over shingles of five words."""
    return simhash.remove_near_duplicates(docs, words=5, similarity=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of 13 words or more that a document with a smaller doc_id has."""
    return substrings.remove_repeats(docs, min_words=13)


def cut_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of 10 words of benchmark items; documents that are mostly such go."""
    return decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, default_tokenizer(), end_id=2, capacity=1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("simhash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", cut_benchmarks),
    ("best-fit packing", pack_sequences),
]

#: Tokenizers, learned rules and automata are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`. The tables that a stage writes on its way go when its documents are
    written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with step(spark):
            docs = materialise(stage(spark, docs, sf_dir), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
