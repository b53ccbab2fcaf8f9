"""A corpus pipeline: five stages, each over all documents that the one before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; ``run`` writes each result as
Parquet and hands it on. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spatialq.llm import decontam, mixing, nbsvm, near, tokens
from spatialq.llm.common import table, written
from spatialq.llm.queries import tokenizer_path

#: Token shares that the mixture aims at; no document's rate falls below 1, so that what
#: the filters kept stays and the rarer domains are repeated.
MIX_WEIGHTS = {"en": 0.55, "de": 0.17, "fr": 0.17, "es": 0.11}


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, judged on their whole texts."""
    rows, y = nbsvm.training_rows(docs, table(spark, sf_dir, "labels"), "quality", 2000)
    return nbsvm.accepted(docs, nbsvm.fit(rows, y))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact or near copies."""
    return near.deduplicated(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontam.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their rates, so that token shares of the domains meet the weights."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"), MIX_WEIGHTS, low=1.0)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending order of doc_id, read back: one row a document and copy."""
    return tokens.token_table(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("minhash near-dedup", one_of_each_group),
    ("benchmark decontamination", without_benchmarks),
    ("mixing to target weights", mixed_domains),
    ("token output", token_output),
]

#: The classifier, the sketches and the tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage{i}")
    return docs
