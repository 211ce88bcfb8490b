"""The corpus pipeline: quality, near-duplicates, benchmark leaks, personal data, and the mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next.
Of odd rows: a null text or an empty one is a document like any other for the quality classifier and has size 0 in the mix; it
is nobody's near-duplicate and holds neither benchmark items nor personal data. Rows without a doc_id stay in near_duplicates,
rows of one doc_id become one there. An empty table stays empty; columns that documents doesn't have are passed on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspan.llm import decontaminate, jaccard, mixing, pii, quality
from loomspan.llm.common import materialize, tidy


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id: five words a shingle, similarity 0.8."""
    return jaccard.first_of_each(docs, shingle=5, num=80, den=100)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates, addresses and secrets replaced by pseudonyms; n_chars follows."""
    return pii.pseudonymise(docs, pii.key_of(spark), length="n_chars")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights: a row for each copy that is taken, numbered in mix_copy."""
    return mixing.mix(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("pii", pseudonymised),
    ("mixing", mixed),
]

#: The classifier and the pseudonyms can't be stated in SQL.
ORACLE_SQL: str | None = None


@tidy
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. The tables between them are removed at the end."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
