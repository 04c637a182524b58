"""A corpus pipeline of five stages over ``documents``.

Each stage takes what the one before kept, in the columns of ``documents``; the
last one adds its rates. Every stage is written as Parquet and read again, and
tables of stages that are done are deleted; the last one's rows are the result
and stay in the folder that driver and executors share.

Defined results, stage by stage: null text counts as empty, and an empty text is
scored like any other; rows with a null id are never a group's row to go, and of
equal texts a row with an id stays before one without; of equal texts with equal
largest ids one row stays (the one with the largest hash of its columns); of near
copies with one id, the row with the smallest hash of its text stays; extra
columns of ``documents`` come along, also under the names of the new ones, which
then get a "_" in front; empty tables give an empty result; without labels every
document scores the same.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontaminate, exact_dedup, mixing, ngram_join, quality, scratch
from quillon.sources.tables import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Per thread of work and folder, the tables that the last stage wrote on its way.
_OWNERS: ContextVar[dict[str, scratch.Owner]] = ContextVar("owners")


def _stage(fn: Stage) -> Stage:
    """A stage deletes what the one before wrote on its way: its rows are stored by then. No other tables are touched."""

    @functools.wraps(fn)
    def step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        owners = _OWNERS.get(None)
        if owners is None:
            _OWNERS.set(owners := {})
        owner = owners.setdefault(sf_dir, scratch.Owner())
        owner.purge(spark)
        with owner():
            return fn(spark, docs, sf_dir)

    return step


#: Token shares of the mixture, after rejected documents are gone.
TARGETS = {"good": 0.94, "low": 0.01, "toxic": 0.05}


@_stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels"), "quality"))


@_stage
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact_dedup.keep_rows(docs)


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest doc_id stays."""
    return ngram_join.keep_rows(docs)


@_stage
def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, with the rate at which the mixture takes it.

    The rows are weighted: each comes once, whatever its mix_copies (0 too), and
    TARGETS hold for token shares weighted by mix_rate or mix_copies, not for rows.
    """
    return mixing.mix(docs, table(spark, sf_dir, "labels"), TARGETS)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", clean_of_benchmark),
    ("mixing sources to target weights", mixed),
]

#: Classifiers and fitted rates have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    root = f"{scratch.shared_dir(spark)}/quillon-pipeline-{uuid.uuid4().hex}"
    own = _OWNERS.set({})
    try:
        for k, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
            docs = spark.read.parquet(f"{root}/{k}")
            if k:
                scratch.delete(spark, f"{root}/{k - 1}")
        for owner in _OWNERS.get().values():
            owner.purge(spark)
    finally:
        _OWNERS.reset(own)
    return docs
