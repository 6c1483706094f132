"""A corpus pipeline over ``documents``: drop poor texts, exact copies and near copies, cut out benchmark passages,
and mix the sources to their target weights.

Each stage reads the rows that the one before has kept and returns the columns of ``documents``; the last one
returns a row for each copy in the mix, with its output shard and order. Stages that drop rows carry whole texts;
no stage needs anything of another but its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from narrata.llm import decontaminate, exact, mixing, quality, similar, simhash
from narrata.llm.tables import table
from narrata.plans.storage import Workspace


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.keep_one(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: first by fingerprints, then by 5-word similarity of 0.8 or more."""
    return similar.keep_one(simhash.keep_one(docs))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; ``n_chars`` follows the text."""
    return decontaminate.remove_items(docs, table(spark, sf_dir, "benchmark"), length_col="n_chars")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, a row for each copy of a document."""
    return mixing.mix(docs)


STAGES = [("quality", quality_stage), ("exact", exact_stage), ("near", near_stage), ("benchmark", benchmark_stage), ("mixing", mixing_stage)]

#: Fitted models, fingerprints and keyed draws are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again as the next one's documents."""
    work, docs = Workspace(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = work.table(name, stage(spark, docs, sf_dir))
        work.drop(*(n for n, _ in STAGES[:k]))
    return docs
