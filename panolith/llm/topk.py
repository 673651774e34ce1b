"""Exact top-k inner-product search by MaxScore.

Each shard of the table keeps its vectors as postings, one list per dimension, with the
bounds of what a dimension can add. For a query the dimensions fall into essential ones and
the rest: a row that gets its least possible share from every essential dimension could not
reach the k-th best score even with the best of all others. Essential postings are summed
for all rows of the shard; the others are probed, largest bound first, only for rows that
are still competitive. Shards return their k best and the results are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panolith.session import spill

BLOCK_QUERIES = 2048
SHARD_ROWS = 4096


class Shard:
    """Postings of some integer vectors: ``postings[d]`` is dimension d of every row.

    ``rows`` tells rows apart that share an id (by default the ids do).
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None):
        self.ids, self.rows = ids, ids if rows is None else rows
        self.postings = np.ascontiguousarray(vectors.T).astype(np.float64)  # exact below 2**53
        self.high, self.low = self.postings.max(1), self.postings.min(1)

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but row ``own``; ties go to the smaller id."""
        most = np.maximum(query * self.high, query * self.low)
        least = np.minimum(query * self.high, query * self.low)
        order = np.argsort(least - most, kind="stable")  # widest first
        others = self.rows != own
        seeds = np.flatnonzero(others)
        if len(seeds) <= k:
            return self._best(seeds, query @ self.postings[:, seeds], k)
        # Any k rows give a lower bound of the k-th best score; good ones lead in the widest dimensions.
        lead = order[:2]
        guess = query[lead] @ self.postings[lead]
        guess[~others] = -np.inf
        seeds = np.argpartition(-guess, 4 * k if 4 * k < len(guess) else k)[: 4 * k]
        seeds = seeds[others[seeds]]
        scores = np.sort(query @ self.postings[:, seeds])
        bar = scores[-k] if len(scores) >= k else -np.inf
        # Essential: as few leading dimensions as leave the rest unable to reach the bar alone.
        floor = np.cumsum(least[order])
        rest = most[order].sum() - np.cumsum(most[order])
        split = int(np.argmax(floor + rest < bar)) + 1 if (floor + rest < bar).any() else len(order)
        sums = query[order[:split]] @ self.postings[order[:split]]
        alive = np.flatnonzero((sums + rest[split - 1] >= bar) & others)
        sums = sums[alive]
        for at in range(split, len(order), 8):
            if len(alive) > k:
                bar = max(bar, np.partition(sums + np.sum(least[order[at:]]), -k)[-k])
            keep = sums + rest[at - 1] >= bar
            alive, sums = alive[keep], sums[keep]
            probe = order[at : at + 8]
            sums = sums + query[probe] @ self.postings[np.ix_(probe, alive)]
        return self._best(alive, sums, k)

    def _best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        pick = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][pick], scores[pick].astype(np.int64)


def _vectors(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _search(block: tuple[np.ndarray, np.ndarray, np.ndarray], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ids, queries = block
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD_ROWS):
                part = batch.slice(at, SHARD_ROWS)
                shard = Shard(part.column(1).to_numpy(zero_copy_only=False), _vectors(part.column(2)), part.column(0).to_numpy(zero_copy_only=False))
                found = [shard.top(q, own, k) for own, q in zip(rows, queries)]
                times = [len(f[0]) for f in found]
                columns = [np.repeat(rows, times), np.repeat(ids, times), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["row", "query_id", "vec_id", "score"])

    return run


def integer_vectors(vectors: DataFrame, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, v: floor(scale * x) of each component, for the rows that take part."""
    v = F.col(embedding)
    sound = F.col(vec_id).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", block: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose id is divisible by ``every``.

    Vectors that are null or hold null or non-finite components take no part; shorter vectors
    count as ending in zeros. Rows that share an id are rows of their own: each asks, and each
    is a candidate for the others. Ties go to the smaller id. Queries go out in blocks of fixed
    size, each against all rows. Raises where components are so large that a score could pass
    2**53, beyond which sums would not be exact.
    """
    whole = integer_vectors(vectors, scale, vec_id, embedding)
    width, largest = whole.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    width, largest = max(1, width or 0), largest or 0
    if width * largest * largest >= 1 << 53:
        raise ValueError("components are too large for exact scores")
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v")))
    ready, _ = spill(whole.select(F.monotonically_increasing_id().alias("row"), "vec_id", padded.alias("v")), "vectors")
    queries, _ = spill(ready.where(F.pmod("vec_id", F.lit(every)) == 0), "queries")
    n = queries.count()
    blocks = -(-n // block)
    numbered = queries.withColumn("b", F.pmod(F.xxhash64("row"), F.lit(max(blocks, 1))))
    spark, found = vectors.sparkSession, []
    for b in range(blocks):
        rows = numbered.where(F.col("b") == b).orderBy("row").toPandas()  # about ``block`` rows
        part = (rows["row"].to_numpy(np.int64), rows["vec_id"].to_numpy(np.int64), np.array(rows["v"].tolist(), np.float64))
        if not len(part[0]):
            continue
        held = spark.sparkContext.broadcast(part)
        hits, _ = spill(_scan(ready, held, k), "hits")
        found.append(hits)
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    merged = found[0]
    for f in found[1:]:
        merged = merged.unionByName(f)
    best = W.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scan(ready: DataFrame, held, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _search(held.value, k)(batches)

    return ready.mapInArrow(run, "row long, query_id long, vec_id long, score long")
