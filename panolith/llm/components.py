"""Connected components by alternating large-star and small-star (Kiveris et al.).

Everything stays distributed: each round is joins and minima over tables in the shared
folder, and nothing but two sums per round reaches the driver. Edges contract locally within
each partition first, so that what shuffles is about one edge per node and partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panolith.session import forget, spill

LOCAL_EDGES = 200_000


def star_forest(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Each node that is not the least of its component, with that least node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, top)
        return top

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent if root(x) != x}


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        forest = star_forest(iter(pairs))
        return pa.RecordBatch.from_arrays([pa.array(list(forest), pa.int64()), pa.array(list(forest.values()), pa.int64())], names=["child", "parent"])

    held: list[tuple[int, int]] = []
    for batch in batches:
        held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        if len(held) >= LOCAL_EDGES:
            yield out(held)
            held = []
    if held:
        yield out(held)


def _contracted(edges: DataFrame) -> DataFrame:
    return edges.mapInArrow(_contract, "child long, parent long")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("child", "parent").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, rounds: int = 60, native: bool = False) -> DataFrame:
    """node, component (the least node reachable) for every node of ``edges`` (two long columns).

    ``native`` leaves out the local contraction, the only step in Python. Nodes without an edge
    to another node are left out. At most ``LOCAL_EDGES`` contracted edges are kept in one
    partition, where nothing shuffles, and without ``native`` one task settles them. Raises if
    ``rounds`` do not suffice; rounds grow with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    contracted = (lambda x: x) if native else _contracted
    a, b = edges.columns
    first = edges.select(F.greatest(F.col(a), F.col(b)).cast("long").alias("child"), F.least(F.col(a), F.col(b)).cast("long").alias("parent")).where("child <> parent")
    now, path = spill(contracted(first).distinct(), "edges")
    state = _state(now)
    few = state[0] <= LOCAL_EDGES  # edges never grow in number from here on

    def held(frame: DataFrame, tag: str) -> tuple[DataFrame, str]:
        frame, path = spill(frame, tag)
        return (frame.coalesce(1) if few else frame), path

    if few:
        now = now.coalesce(1)
        if not native and state[0]:
            now, path = held(_contracted(now), "edges")
            rounds = 0
    for _ in range(rounds):
        if not state[0]:
            break
        # Large star: a parent that has a parent gives way to its least one.
        least, least_path = held(now.groupBy("child").agg(F.min("parent").alias("least")), "least")
        up = least.select(F.col("child").alias("parent"), F.col("least").alias("above"))
        large, large_path = held(now.join(up, "parent", "left").select("child", F.coalesce("above", "parent").alias("parent")).distinct(), "large")
        # Small star: all parents of a child, and the child, go under its least parent.
        least2, least2_path = held(large.groupBy("child").agg(F.min("parent").alias("least")), "least")
        others = large.join(least2, "child").where("parent <> least").select(F.col("parent").alias("child"), F.col("least").alias("parent"))
        small = least2.select("child", F.col("least").alias("parent")).unionByName(others)
        after, after_path = held(contracted(small).distinct(), "edges")
        forget(spark, path, least_path, large_path, least2_path)
        was, state = state, _state(after)
        now, path = after, after_path
        if state == was:
            break
    else:
        if rounds:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("parent").alias("node")).distinct()
    return now.select(F.col("child").alias("node"), F.col("parent").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
