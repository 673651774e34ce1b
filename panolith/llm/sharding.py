"""Sharding by jump consistent hashing (Lamping and Veach).

A key's shard follows from the key and the number of shards alone, without a ring table;
appending a shard moves only the rows that the new shard takes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panolith.session import spill

SMALL_ROWS = 1 << 17


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key, for all keys at once."""
    if shards < 1:
        raise ValueError("shards must be positive")
    key = keys.astype(np.uint64).copy()
    b = np.zeros(len(key), np.int64)
    j = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        b[live] = j[live]
        k = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        key[live] = k
        step = float(1 << 31) / ((k >> np.uint64(33)).astype(np.float64) + 1.0)
        j[live] = ((b[live] + 1) * step).astype(np.int64)
        live = live[j[live] < shards]
    return b


def stable_keys(ids: np.ndarray) -> np.ndarray:
    """Spread integer ids over 64 bits (the finaliser of splitmix64)."""
    z = ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _deal(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(shards, np.int64)
    for batch in batches:
        ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
        key = stable_keys(ids)
        shard, grown = jump_hash(key, shards), jump_hash(key, shards + 1)
        order = np.argsort(shard, kind="stable")
        counts = np.bincount(shard, minlength=shards)
        nth = np.empty(len(ids), np.int64)
        nth[order] = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
        nth += seen[shard]
        seen += counts
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard.astype(np.int32)), pa.array(grown.astype(np.int32)), pa.array(nth)], names=[*batch.schema.names, "shard", "grown_shard", "nth"])


def shard_documents(docs: DataFrame, shards: int = 16, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Law ``key``: doc_id and the shard count decide.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard. Slots are dealt without
    moving rows: each input partition numbers its rows by shard, and a prefix sum over the
    (partition, shard) counts gives the offset of each. A null doc_id counts as key 0, a null
    text as empty. Repeated rows each get a slot. Equal texts have no say in this law.
    """
    lean = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"), F.spark_partition_id().alias("part"))
    dealt, _ = spill(lean.mapInArrow(lambda it: _deal(it, shards), "doc_id long, size long, text_crc32 long, part int, shard int, grown_shard int, nth long"), "shards")
    counts = dealt.groupBy("part", "shard").agg(F.max("nth").alias("last"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets, _ = spill(counts.select("part", "shard", F.coalesce(F.sum(F.col("last") + 1).over(before), F.lit(0)).alias("base")), "shard-offsets")
    if offsets.count() <= SMALL_ROWS:  # partitions x shards; beyond it, an ordinary join
        offsets = F.broadcast(offsets)
    return dealt.join(offsets, ["part", "shard"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("nth")).alias("slot"), "grown_shard")
