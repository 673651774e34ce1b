"""What two sets can have in common at most, told before they meet."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITMAP = 4096
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * MIX[0]
    z = (z ^ (z >> np.uint64(27))) * MIX[1]
    return z ^ (z >> np.uint64(31))


def lists(rows: np.ndarray, some: np.ndarray) -> pa.Array:
    """Rows as lists; an empty list where ``some`` is false."""
    size = np.where(some, rows.shape[1], 0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(rows[some].reshape(-1).view(np.int64)))


def bitmaps(sets: list[np.ndarray], size: int = BITMAP) -> np.ndarray:
    """(sets, words): for each set a bitmap of ``size`` bits in which every element sets the one it hashes to."""
    grid = np.zeros((len(sets), size), bool)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    elements = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    grid[owner, (_mixed(elements) & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(grid, axis=1, bitorder="little").view("<u8")


def bitmapped(rows: DataFrame) -> DataFrame:
    """uid, bits: a bitmap of BITMAP bits in which each shingle of the set sets the one it hashes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [np.asarray(x, np.int64).view(np.uint64) for x in part.column(1).to_numpy(zero_copy_only=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), lists(bitmaps(sets), np.ones(len(sets), bool))], names=["uid", "bits"])

    return rows.mapInArrow(run, "uid long, bits array<long>")


def shareable(some: DataFrame, sets: DataFrame) -> DataFrame:
    """uid, n, r: how many of a document's shingles any other of ``some`` (uid, n) has, which bounds
    what it can have in common with one of them."""
    rows = sets.join(some.select("uid"), "uid", "left_semi").select("uid", F.explode("s").alias("s"))
    alone = rows.groupBy("s").agg(F.count("*").alias("m"), F.min("uid").alias("uid")).where("m = 1").groupBy("uid").agg(F.count("*").alias("u"))
    return some.join(alone, "uid", "left").select("uid", "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("r"))


def may_share(least: Fraction, shareable: bool = True) -> str:
    """SQL: whether x and y (n, r, bits) can be of that Jaccard similarity. They share no more than
    either has in common with anything (r, where it is known), and bits that differ are at most the shingles that only
    one of both has; so no pair is lost."""
    bits = "aggregate(zip_with(x.bits, y.bits, (p, q) -> bit_count(p ^ q)), 0, (p, q) -> p + q)"
    shared = f"least(x.r, y.r) * {least.denominator + least.numerator} >= (x.n + y.n) * {least.numerator}"
    return f"{shared if shareable else 'true'} AND {bits} * {least.denominator + least.numerator} <= (x.n + y.n) * {least.denominator - least.numerator}"
