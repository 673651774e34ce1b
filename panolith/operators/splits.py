"""Near-duplicate groups of images and splits that keep groups whole."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panolith.functions.geometry import hamming
from panolith.operators.manifests import numbered
from panolith.session import Scratch, forget, spill

SPLITS = ("train", "val", "test")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _parts(bits: list[int], n: int) -> list[int]:
    """Masks of ``n`` runs of about as many of the given bits."""
    edges = [round(len(bits) * i / n) for i in range(n + 1)]
    return [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(edges, edges[1:])]


def hamming_links(hashes: DataFrame, most: int = 5, hot: int = 1024) -> DataFrame:
    """Links (a, b) between ids whose 64-bit hashes are within ``most`` differing bits, in a form that is linear in copies.

    Ids of equal hashes are one class, named by its least id: links lead from it to each of its
    copies, and between the names of every two classes so near. Multi-index hashing: of
    ``most`` + 2 bands two at least agree, so classes meet under each pair of bands. A key that
    over ``hot`` classes share is split by ``most`` + 1 runs of its remaining bits, of which one
    must agree too. A pair counts under the first key that it has in common.
    """
    pairs = [x | y for x, y in combinations(_parts(list(range(64)), most + 2), 2)]
    finer = [m | p for m in pairs for p in _parts([b for b in range(64) if not m >> b & 1], most + 1)]
    first_pair, first_finer = (F.array(*[F.lit(_signed(m)).cast("long") for m in masks]) for masks in (pairs, finer))

    def keyed(rows: DataFrame, masks: Column, at: Column) -> DataFrame:
        return rows.select("id", "hash", F.explode(F.transform(at, lambda t: F.struct(t.alias("t"), F.col("hash").bitwiseAND(F.element_at(masks, t + 1)).alias("k")))).alias("x")).select("id", "hash", "x.t", "x.k")

    def met(rows: DataFrame, masks: Column, parent: int) -> DataFrame:
        """Pairs of one key, if it is the first of those under the same parent key and the parent the first too."""
        a, b = rows.alias("a"), rows.alias("b")
        near = a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.k") == F.col("b.k")) & (F.col("a.hash") < F.col("b.hash")) & (hamming(F.col("a.hash"), F.col("b.hash")) <= most))
        d = F.col("a.hash").bitwiseXOR(F.col("b.hash"))
        first = lambda masks, n, from_: F.array_position(F.transform(F.slice(masks, from_ + 1, F.lit(n)), lambda m: d.bitwiseAND(m) == 0), F.lit(True)) - 1
        own = F.col("a.t") if parent == 1 else F.floor(F.col("a.t") / parent).cast("int")
        told = near.where(first(first_pair, len(pairs), F.lit(0)) == own)
        if parent > 1:
            told = told.where(first(masks, parent, own * parent) == F.col("a.t") - own * parent)
        return told.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"))

    with Scratch(hashes.sparkSession) as held:
        classes = held(hashes.where("hash IS NOT NULL").groupBy("hash").agg(F.min("id").alias("id")), "hash-classes")
        copies = hashes.join(classes.withColumnRenamed("id", "a"), "hash").where("id <> a").select("a", F.col("id").alias("b")).distinct()
        whole = keyed(classes, first_pair, F.sequence(F.lit(0), F.lit(len(pairs) - 1)))
        crowded = held(whole.groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("t", "k"), "hash-crowded")
        out = copies.unionByName(met(whole.join(crowded, ["t", "k"], "left_anti"), first_pair, 1))
        if not crowded.isEmpty():
            n = most + 1
            split = keyed(whole.join(crowded, ["t", "k"]).select("id", "hash", "t"), first_finer, F.sequence(F.col("t") * n, F.col("t") * n + n - 1))
            out = out.unionByName(met(split, first_finer, n))
        return held.result(out, "hash-links")


def build_groups(hashes: DataFrame, most: int = 5, rounds: int = 50) -> DataFrame:
    """id, group_id: the transitive closure of the links; a group's id is its least member.

    Labels spread along links and jump to their label's label, so rounds grow with the
    logarithm of a chain's length; each round is a table in the shared folder.
    """
    spark = hashes.sparkSession
    links, links_path = spill(hamming_links(hashes, most), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels, path = spill(hashes.select("id", F.col("id").alias("label")), "labels")
    for _ in range(rounds):
        seen = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(seen, labels.id == seen.a, "left").select("id", F.least("label", F.coalesce("near", "label")).alias("label"))
        lower, lower_path = spill(lower, "lower")
        jump = lower.select(F.col("id").alias("label"), F.col("label").alias("further"))
        after, after_path = spill(lower.join(jump, "label").select("id", F.col("further").alias("label")), "labels")
        changed = after.join(labels.withColumnRenamed("label", "was"), "id").where("label <> was").isEmpty()
        forget(spark, path, lower_path)
        labels, path = after, after_path
        if changed:
            break
    else:
        raise RuntimeError("groups did not settle")
    forget(spark, links_path)
    return labels.withColumnRenamed("label", "group_id")


RUN = 1 << 16  # groups of one size in a row that are settled together


def _runs_of_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """first, size, k: runs of equal sizes in rows (i, size) of a sorted partition."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at, size = (c.to_numpy() for c in batch.columns)
        begin = np.flatnonzero(np.concatenate([[True], (size[1:] != size[:-1]) | (at[1:] != at[:-1] + 1)]))
        k = np.diff([*begin, len(size)])
        yield pa.RecordBatch.from_arrays([pa.array(at[begin]), pa.array(size[begin]), pa.array(k)], names=["first", "size", "k"])


def fill(now: list[int], size: int, k: int, want: list[float]) -> list[int]:
    """How many of ``k`` groups of one size each split takes if one after another goes where most is missing.

    The level that all splits end at tells nearly all of it; the last few go one by one.
    """
    missing = [w - n for w, n in zip(want, now)]
    took = [0] * len(want)
    open_ = sorted(range(len(want)), key=lambda i: -missing[i])
    for n in range(len(want), 0, -1):
        level = (sum(missing[i] for i in open_[:n]) - k * size) / n
        if n == 1 or missing[open_[n - 1]] >= level:
            took = [max(0, int((missing[i] - level) // size) - 1) if i in open_[:n] else 0 for i in range(len(want))]
            break
    for _ in range(k - sum(took)):
        took[max(range(len(want)), key=lambda i: want[i] - (now[i] + took[i] * size))] += 1
    return took


def _fold(want: list[float]):
    """first, size, k, took and the sizes before each run, from runs in order: a few numbers are carried along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = [0] * len(want)
        for batch in batches:
            before, taken = [], []
            for _, size, k in zip(*(c.to_pylist() for c in batch.columns)):
                took = fill(now, size, k, want)
                before.append(now)
                taken.append(took)
                now = [n + t * size for n, t in zip(now, took)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.list_(pa.int64())), pa.array(taken, pa.list_(pa.int64()))], names=["first", "size", "k", "before", "took"])

    return run


def _spread(want: list[float]):
    """i, s (number of the split) for every group of each run, runs side by side in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, size, k, before, took in zip(*(c.to_pylist() for c in batch.columns)):
                split = np.repeat(np.arange(len(want)), took)
                nth = np.concatenate([np.arange(t) for t in took])
                left = np.array(want)[split] - (np.array(before)[split] + nth * size)
                order = np.lexsort((split, -left))
                yield pa.RecordBatch.from_arrays([pa.array(first + np.arange(k)), pa.array(split[order])], names=["i", "s"])

    return run


def place_groups(sizes: DataFrame, ratios: dict[str, float], seed: int, held: Scratch) -> DataFrame:
    """group_id, split: groups (group_id, size) in an order drawn by hash go one after another where
    most is missing to the target (ties: in the order of SPLITS).

    The order is that of ranges with their counts. Where sizes repeat in a row, as they do where
    most groups are single images, a run is one step: what carries over from run to run are three
    sums, in a scan over the runs; inside the runs groups are placed side by side.
    """
    total = sizes.agg(F.sum("size")).first()[0] or 0
    want = [ratios[s] * total for s in SPLITS]
    drawn = sizes.select("group_id", F.col("size").cast("long").alias("size"), F.sha1(F.concat_ws("|", F.lit(str(seed)), F.col("group_id").cast("string"))).alias("draw"))
    placed = held(numbered(drawn, ["draw", "group_id"], "i").select("group_id", "i", "size"), "split-order")
    runs = placed.select("i", "size").repartitionByRange("i").sortWithinPartitions("i").mapInArrow(_runs_of_sizes, "first long, size long, k long")
    runs = held(runs.select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("k") - 1, F.lit(RUN).cast("long"))).alias("first"), "size", (F.col("first") + F.col("k")).alias("end")).select("first", "size", F.least(F.lit(RUN), F.col("end") - F.col("first")).cast("long").alias("k")), "split-runs")
    folded = held(runs.repartition(1).sortWithinPartitions("first").mapInArrow(_fold(want), "first long, size long, k long, before array<long>, took array<long>"), "split-folded")
    spread = folded.repartition("first").mapInArrow(_spread(want), "i long, s long")
    return held(placed.join(spread, "i").select("group_id", F.element_at(F.array(*map(F.lit, SPLITS)), (F.col("s") + 1).cast("int")).alias("split")), "split-placed")


def assign_groups(groups: DataFrame, objects: DataFrame, subset: DataFrame, ratios: dict[str, float] | None = None, min_test: int = 10, seed: int = 42) -> DataFrame:
    """group_id, split: whole groups go to splits.

    :func:`place_groups`, then, class after class by name, train groups richest in the class
    (ties: least id) move to test until it has ``min_test`` instances there; raises where that
    cannot be. Each move brings an instance at least, so of each class no more than twice
    ``min_test`` candidates can matter: those, ranked per class in the cluster, are all that
    reaches the driver.
    """
    ratios = ratios or {"train": 0.70, "val": 0.15, "test": 0.15}
    spark = groups.sparkSession
    with Scratch(spark) as held:
        sizes = held(groups.groupBy("group_id").agg(F.count("*").alias("size")), "split-sizes")
        placed = place_groups(sizes, ratios, seed, held)
        counts = objects.join(F.broadcast(subset.select("name").distinct()), "name").join(groups.select(F.col("id").alias("pid"), "group_id"), "pid").groupBy("group_id", "name").agg(F.count("*").alias("n"))
        where = held(counts.join(placed, "group_id"), "split-classes")
        have = {r["name"]: r["n"] for r in where.where("split = 'test'").groupBy("name").agg(F.sum("n").alias("n")).collect()}
        rank = F.row_number().over(W.partitionBy("name").orderBy(F.desc("n"), "group_id"))
        able = where.where("split = 'train'").withColumn("r", rank).where(F.col("r") <= 2 * min_test)
        ids = held(able.select("group_id").distinct(), "split-able")
        classes: dict[int, dict[str, int]] = {}
        for r in where.join(F.broadcast(ids), "group_id", "left_semi").collect():
            classes.setdefault(r["group_id"], {})[r["name"]] = r["n"]
        moved: set[int] = set()
        for name in sorted(r["name"] for r in subset.select("name").distinct().collect()):
            left = sorted((-own[name], g) for g, own in classes.items() if name in own and g not in moved)
            while have.get(name, 0) < min_test:
                if not left:
                    raise ValueError(f"class {name} cannot have {min_test} instances in test")
                g = left.pop(0)[1]
                moved.add(g)
                for other, n in classes[g].items():
                    have[other] = have.get(other, 0) + n
        moves = spark.createDataFrame([(g, "test") for g in sorted(moved)], "group_id long, moved string")
        return held.result(placed.join(F.broadcast(moves), "group_id", "left").select("group_id", F.coalesce("moved", "split").alias("split")), "splits")


def make_splits(hashes: DataFrame, panoramas: DataFrame, objects: DataFrame, subset: DataFrame, most: int = 5, **rules) -> DataFrame:
    """id, group_id, split for every panorama; raises if one has no hash."""
    if not panoramas.join(hashes, panoramas.pid == hashes.id, "left_anti").isEmpty():
        raise ValueError("panoramas without a hash")
    groups = build_groups(hashes.join(panoramas.select(F.col("pid").alias("id")), "id", "left_semi"), most)
    return groups.join(assign_groups(groups, objects, subset, **rules), "group_id").select("id", "group_id", "split")


def split_warnings(splits: DataFrame, objects: DataFrame, subset: DataFrame, ratios: dict[str, float] | None = None, drift: float = 0.05) -> DataFrame:
    """Text of each ratio that drifts by over five points, and of each class absent from val."""
    ratios = ratios or {"train": 0.70, "val": 0.15, "test": 0.15}
    share = splits.agg(*[(F.count_if(F.col("split") == s) / F.count("*")).alias(s) for s in SPLITS])
    off = share.select(F.explode(F.array(*[F.when(F.abs(F.col(s) - ratios[s]) > drift, F.lit(f"ratio of {s} drifts")) for s in SPLITS])).alias("warning")).where("warning IS NOT NULL")
    in_val = objects.join(splits.where("split = 'val'").select(F.col("id").alias("pid")), "pid", "left_semi").select("name").distinct()
    absent = subset.select("name").join(in_val, "name", "left_anti").select(F.concat(F.lit("no instance in val: "), F.col("name")).alias("warning"))
    return off.unionByName(absent)


def leaks(splits: DataFrame) -> DataFrame:
    """Panoramas and groups that are in more than one split: none in a sound split."""
    def over(key: str, kind: str) -> DataFrame:
        return splits.groupBy(key).agg(F.countDistinct("split").alias("n")).where("n > 1").select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"))

    return over("id", "panorama").unionByName(over("group_id", "group"))


def assert_no_leak(splits: DataFrame) -> None:
    first = leaks(splits).first()
    if first is not None:
        raise ValueError(f"{first['kind']} {first['key']} is in more than one split")


def donor_pool(splits: DataFrame) -> DataFrame:
    """Only train panoramas may donate."""
    return splits.where("split = 'train'").select("id")
