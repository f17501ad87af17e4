"""Corpus pipeline: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import decision_list, group_join, mixing, packing, stream_dedup
from ledgerloom.llm.common import materialize, release, tables_made

#: Tables of the stage before, whose result has been written when the next one begins.
_before: list[str] = []


def stage(f: Callable) -> Callable:
    """A stage gives back the disk of the one before, and leaves its own tables to the next."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _before)
        with tables_made() as made:
            out = f(spark, docs, sf_dir)
        _before.extend(made)
        return out

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go."""
    return decision_list.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays."""
    return stream_dedup.drop_copies(docs)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words, Jaccard 0.8."""
    return group_join.drop_near_duplicates(docs, words=5, percent=80)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by probabilities raked to source, language and topic shares.

    Four fifths of the tokens stay; the shares are moved towards the observed ones
    just so far that a draw of that size meets them.
    """
    return mixing.sample_to_weights(docs, keep_share=0.8)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, each with its sequence and place."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: Learned rules, similarity joins and packing have no SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        docs = materialize(apply(spark, docs, sf_dir), name)
    return docs
