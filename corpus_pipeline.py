"""The pipeline over ``documents``: classify, deduplicate exactly and nearly, mix, pack.

Each stage reads what the one before it kept, as Parquet in the shared folder, and all
but the last return the columns of ``documents``.  A stage begins by removing the tables
that the stages before left in the shared folder: their results are written by then.

Cases: null, empty and blank texts are scored, deduplicated (null as empty) and packed like
any others; rows with null ids or ids that repeat are rows of their own, except that exact
deduplication leaves one row of each text and near deduplication one of each class; an
empty table gives no pieces; further columns of ``documents``, whatever their names, are
carried to the last stage.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import grace, mil, mixing, packing, probminhash, queries
from corpusloom.llm.shared import LEFT, bounded_batches, removed, scratch, swept

_left: list[str] = []  # tables of the stages before


def stage(f):
    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        swept(spark, docs, _left)
        before = len(LEFT)
        result = f(spark, docs, sf_dir)
        _left.extend(LEFT[before:])
        return result

    return run_stage


@stage
def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least the threshold; the network learns from their labels."""
    return mil.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return grace.kept_rows(docs)


@stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return probminhash.kept_rows(docs)


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says."""
    return mixing.mixed(docs)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences."""
    return packing.pack_documents(docs, queries.vocabulary_path())


STAGES = [
    ("quality classifier", classify),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("mixing", mix),
    ("packing", pack),
]

#: A trained classifier and sequence packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, step) in enumerate(STAGES):
        if k:
            before, path = path, scratch(spark, f"stage-{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                removed(spark, before)
        docs = step(spark, docs, sf_dir)
    return docs
