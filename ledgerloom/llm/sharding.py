"""Sharding: weighted rendezvous hashing of stable record keys, native Spark only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import dense_number, materialize

N_SHARDS = 8


def rendezvous_shard(key: Column, weights: Sequence[float], seed: int = 17) -> Column:
    """Shard of ``key``: the smallest of the shards' exponential clocks.

    Shard ``j`` draws u from a hash of (key, j) and rings at ``-ln(u) / weight``;
    its chance to ring first is its share of the weights.  A clock depends on its
    own shard only, so a new shard takes rows and no row moves between old ones.
    A null key is one more key.  Equal clocks (chance 2^-53) go to the lower shard.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    known = F.coalesce(key.cast("string"), F.lit("\x00null"))
    clocks = []
    for j, weight in enumerate(weights):
        bits = F.shiftrightunsigned(F.xxhash64(known, F.lit(seed), F.lit(j)), 11)
        uniform = (bits + F.lit(0.5)) / F.lit(float(1 << 53))
        clocks.append(F.struct((-F.log(uniform) / F.lit(float(weight))).alias("at"), F.lit(j).alias("shard")))
    return clocks[0]["shard"] if len(clocks) == 1 else F.least(*clocks)["shard"]


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], shard: str = "shard") -> DataFrame:
    """``df`` with a shard column; a narrow operation, nothing is shuffled.

    An existing column of that name is replaced.  An empty table stays empty.
    """
    return df.withColumn(shard, rendezvous_shard(F.col(key), weights))


def shard_documents(docs: DataFrame, weights: Sequence[float] = (1.0,) * N_SHARDS, new_weight: float = 1.0) -> DataFrame:
    """One row per document: its shard, its place there, and its shard after growth.

    Returns doc_id, size (UTF-8 bytes + 1; a null text has 1), text_crc32 (null: 0),
    law 'key', shard, slot (from 0 without a gap in each shard), grown_shard.
    Equal texts may lie in different shards: the key alone decides.  Repeated rows
    each get a slot; null ids share one shard but not one task.  Texts are read
    once; only the narrow columns are shuffled.
    """
    narrow = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        rendezvous_shard(F.col("doc_id"), weights).alias("shard"),
        rendezvous_shard(F.col("doc_id"), [*weights, new_weight]).alias("grown_shard"),
    )
    kept = materialize(narrow.withColumn("_row", F.monotonically_increasing_id()), "shards")
    placed = dense_number(kept, ["shard"], ["doc_id", "size", "text_crc32", "_row"], "slot")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
