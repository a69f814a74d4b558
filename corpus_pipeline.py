"""documents to packed sequences: quality rules, line dedup, near duplicates, mixing, packing."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path[:0] = [p for p in [os.path.dirname(os.path.abspath(__file__))] if p not in sys.path]

from lodefield.llm import jaccard, linededup, mixing, packing, quality  # noqa: E402
from lodefield.llm.queries import vocabulary  # noqa: E402
from lodefield.llm.shared import cut, ready  # noqa: E402


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    ready(spark)
    return quality.keep_good(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go from its documents' texts; n_chars follows."""
    ready(spark)
    return linededup.clean_texts(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the one of the smallest doc_id stays."""
    ready(spark)
    return jaccard.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the weights of the mix, its budget such that every source is taken once at least: rows are repeated,
    none is lost."""
    ready(spark)
    return mixing.mixed_in(docs, entropy=0.9, repeats=4.0, least_once=True, marks=False)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 ids."""
    ready(spark)
    return packing.pack_documents(docs, vocabulary())


STAGES = [("quality rules", keep_good), ("line dedup", drop_lines), ("near duplicates", one_of_each), ("mixing", mix), ("packing", pack)]

#: Tokenizing and hashing can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, "stage")
    return docs
