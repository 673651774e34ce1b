"""Exact dedup by two-pass Bloom filtering.

Pass 1 puts every 64-bit text hash into a filter of two bit planes: ``once`` (the position
was hit) and ``again`` (it was hit twice or more). Planes merge by saturating addition, so
the merge order does not matter. Pass 2 looks every hash up in the ``again`` plane: a hash
whose positions are all set may be repeated, any other is certainly unique. Only rows that
may be repeated shuffle; the rest pass straight through.

The planes are bounded: hash space is cut into ``slices`` so that no plane is larger than
``max_bits``, and each slice broadcasts its own plane. False positives only cost shuffle;
the groups themselves are settled on SHA-256.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panolith.session import spill

PROBES = 4
SEGMENT = 1 << 16  # bits of a plane that travel as one row


def _positions(h: np.ndarray, bits: int) -> np.ndarray:
    """PROBES positions per hash by double hashing, as one (n, PROBES) array."""
    a = h.astype(np.uint64)
    b = (a ^ (a >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    b = (b ^ (b >> np.uint64(33))) | np.uint64(1)
    steps = np.arange(PROBES, dtype=np.uint64)
    return (a[:, None] + steps[None, :] * b[:, None]) % np.uint64(bits)


def _planes(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The positions that a partition hits, by segment: first hits and further hits."""

    def out(pos: np.ndarray, hits: np.ndarray) -> pa.RecordBatch:
        seg = (pos // SEGMENT).astype(np.int64)
        cut = np.flatnonzero(np.diff(seg, prepend=-1))
        ends = np.append(cut[1:], len(seg))
        low, twice = (pos % SEGMENT).astype("<u2"), hits > 1
        return pa.RecordBatch.from_arrays(
            [
                pa.array(seg[cut]),
                pa.array([low[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()),
                pa.array([low[a:b][twice[a:b]].tobytes() for a, b in zip(cut, ends)], pa.binary()),
            ],
            names=["segment", "once", "again"],
        )

    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        held.append(_positions(h, bits).ravel())
        size += held[-1].size
        if size > 1 << 22:
            yield out(*np.unique(np.concatenate(held), return_counts=True))
            held, size = [], 0
    if size:
        yield out(*np.unique(np.concatenate(held), return_counts=True))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the rows of each segment (adjacent here) and return its ``again`` plane packed."""
    now, count = None, np.zeros(SEGMENT, np.uint8)

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(count > 1, bitorder="little").tobytes()], pa.binary())], names=["segment", "plane"])

    for batch in batches:
        for seg, once, again in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if seg != now:
                if now is not None and (count > 1).any():
                    yield done()
                now, count = seg, np.zeros(SEGMENT, np.uint8)
            for hit in (once, again):  # each list holds a position once
                p = np.frombuffer(hit, "<u2")
                count[p] = np.minimum(count[p] + 1, 2)
    if now is not None and (count > 1).any():
        yield done()


def repeated_filter(hashes: DataFrame, rows: int, bits_per_row: int = 16, max_bits: int = 1 << 28) -> list[tuple[int, np.ndarray]]:
    """The ``again`` planes of a frame with one long column: for each slice (bits, packed plane).

    A plane has at most ``max_bits`` bits (32 MiB by default), however many rows there are.
    """
    need = max(rows, 1) * bits_per_row
    slices = max(1, math.ceil(need / max_bits))
    bits = max(SEGMENT, 1 << math.ceil(math.log2(max(1, need / slices))))
    column = hashes.columns[0]
    found = []
    for i in range(slices):
        part = hashes if slices == 1 else hashes.where(F.pmod(F.shiftright(column, 40), F.lit(slices)) == i)
        planes = (
            part.mapInArrow(lambda it: _planes(it, bits), "segment long, once binary, again binary")
            .repartition("segment")
            .sortWithinPartitions("segment")
            .mapInArrow(_merge, "segment long, plane binary")
        )
        whole = np.zeros(bits // 8, np.uint8)
        for row in planes.toLocalIterator():  # at most bits / SEGMENT rows, of 8 KiB each
            at = row["segment"] * SEGMENT // 8
            whole[at : at + SEGMENT // 8] = np.frombuffer(row["plane"], np.uint8)
        found.append((bits, whole))
    return found


def _maybe_repeated(keyed: DataFrame, h: str, **bounds: int):
    """A column function: false only where the text of hash ``h`` is certainly unique in ``keyed``."""
    spark = keyed.sparkSession
    planes = repeated_filter(keyed.select(h), keyed.count(), **bounds)
    shared = [(bits, spark.sparkContext.broadcast(plane)) for bits, plane in planes]

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        u = h.to_numpy(np.int64)
        at = (u >> 40) % len(shared)
        out = np.zeros(len(u), bool)
        for i, (bits, plane) in enumerate(shared):
            mine = np.flatnonzero(at == i)
            p = _positions(u[mine].view(np.uint64), bits)
            out[mine] = ((plane.value[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).all(1)
        return pd.Series(out)

    return maybe


def _group(rows: DataFrame, sha: str, doc_id: str, row: str) -> DataFrame:
    """sha, keep (struct of the id and row number that stay), n (rows) of each text."""
    return rows.groupBy(sha).agg(F.max(F.struct(F.col(doc_id).alias("id"), F.col(row).alias("row"))).alias("keep"), F.count("*").alias("n"))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **bounds: int) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty. Of equal texts the row with the largest doc_id stays (null
    ids come first; of rows that share the largest id exactly one stays). An empty table
    gives an empty result. Other columns are ignored, whatever their names.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lean = docs.select(F.col(doc_id).alias("doc_id"), F.sha2(whole, 256).alias("sha"), F.xxhash64(whole).alias("h"))
    maybe = _maybe_repeated(lean, "h", **bounds)
    flagged, _ = spill(lean.select("doc_id", "sha", maybe("h").alias("maybe"), F.monotonically_increasing_id().alias("row")), "exact")
    straight = flagged.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    again = flagged.where("maybe")
    groups, _ = spill(_group(again, "sha", "doc_id", "row"), "exact-groups")
    settled = again.join(groups, "sha").select("doc_id", F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("keep.row")).alias("kept"), F.col("sha").alias("text_sha256"))
    return straight.unionByName(settled)


def drop_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **bounds: int) -> DataFrame:
    """The documents that stay, with all their columns; only possibly repeated rows shuffle.

    What may be repeated is decided by the text alone; those rows are numbered once, in a copy
    in the shared folder. No column of ``docs`` is touched, whatever its name.
    """
    columns = docs.columns
    taken = {c.lower() for c in columns}
    h, sha, row = (next(n for k in range(len(taken) + 1) if (n := name + "_" * k) not in taken) for name in ("h", "sha", "row"))
    whole = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.withColumn(h, F.xxhash64(whole))
    maybe = _maybe_repeated(keyed, h, **bounds)
    again, _ = spill(keyed.where(maybe(h)).withColumns({sha: F.sha2(whole, 256), row: F.monotonically_increasing_id()}).drop(h), "repeats")
    keep = _group(again, sha, doc_id, row).select(F.col("keep.row").alias(row))
    return keyed.where(~maybe(h)).select(columns).unionByName(again.join(keep, row, "left_semi").select(columns))
