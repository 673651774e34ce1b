"""Training curves, run tables and verifier reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panolith.session import Scratch


def prefer_split(split: DataFrame, generic: DataFrame) -> DataFrame:
    """Run rows (arm, seed, headline, dets): of a run with both split files those, else the generic
    pair; runs that lack either file are left out."""
    s = split.select("arm", "seed", F.col("headline").alias("h1"), F.col("dets").alias("d1"))
    g = generic.select("arm", "seed", F.col("headline").alias("h2"), F.col("dets").alias("d2"))
    both = F.col("h1").isNotNull() & F.col("d1").isNotNull()
    out = g.join(s, ["arm", "seed"], "full").select("arm", "seed", F.when(both, F.col("h1")).otherwise(F.col("h2")).alias("headline"), F.when(both, F.col("d1")).otherwise(F.col("d2")).alias("dets"))
    return out.where("headline IS NOT NULL AND dets IS NOT NULL")


def plateaued(curves: DataFrame, by: list[str], last: int = 5, tolerance: float = 0.30) -> DataFrame:
    """Relative loss drop over the last ``last`` epochs, and whether it is within the tolerance;
    null for a curve of at most ``last`` epochs."""
    order = W.partitionBy(by).orderBy("epoch")
    marked = curves.withColumns({"then": F.lag("loss", last).over(order), "r": F.row_number().over(W.partitionBy(by).orderBy(F.desc("epoch")))}).where("r = 1")
    drop = (F.col("then") - F.col("loss")) / F.nullif(F.col("then"), F.lit(0.0))
    return marked.select(*by, drop.alias("drop"), (drop <= tolerance).alias("plateaued"))


def epoch_report(curves: DataFrame, by: list[str]) -> DataFrame:
    """Epochs, best epoch (first of the best), best and last value and their gap, loss drop over
    the last fifth, and whether validation ran (over one different rounded value)."""
    n = F.count("*").over(W.partitionBy(by))
    order = W.partitionBy(by).orderBy("epoch")
    r = curves.withColumns({"n": n, "i": F.row_number().over(order)}).withColumn("from", F.greatest(F.lit(1), F.col("n") - F.greatest(F.lit(1), F.floor(F.col("n") / 5))))
    per = r.groupBy(by).agg(
        F.max("n").alias("epochs"), F.min_by("epoch", F.struct(-F.col("map"), F.col("epoch"))).alias("best_epoch"), F.max("map").alias("best"), F.max_by("map", "epoch").alias("last"),
        F.max(F.when(F.col("i") == F.col("from"), F.col("loss"))).alias("then"), F.max_by("loss", "epoch").alias("now"), (F.countDistinct(F.round("map", 4)) > 1).alias("has_val"),
    )
    return per.withColumns({"gap": F.col("best") - F.col("last"), "late_drop": (F.col("then") - F.col("now")) / F.nullif(F.col("then"), F.lit(0.0))}).drop("then", "now")


def tallies(status: DataFrame) -> DataFrame:
    return status.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("done", "failed", "running")])


def upsert(status: DataFrame, news: DataFrame, key: str = "run_id") -> DataFrame:
    """Rows of ``news`` replace those of their key."""
    return status.join(news.select(key), key, "left_anti").unionByName(news)


def valid_rate(predictions: DataFrame, accept: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """n, top1 accuracy, share of hits confident enough, mean probability of the intended class."""
    hit = F.col("pred") == F.col("intended")
    return predictions.groupBy(by or []).agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("top1_acc"), F.avg((hit & (F.col("conf") >= accept)).cast("double")).alias("accept_rate"), F.avg("p_intended").alias("mean_p"))


def confusion(pairs: DataFrame) -> DataFrame:
    """y, p, n of every pair of labels that occurs."""
    return pairs.groupBy("y", "p").agg(F.count("*").alias("n"))


def recalls(pairs: DataFrame) -> DataFrame:
    """y, n, recall, and the accuracy over all."""
    right = F.count_if(F.col("y") == F.col("p"))
    per = pairs.groupBy("y").agg(F.count("*").alias("n"), right.alias("hits"))
    return per.select("y", "n", (F.col("hits") / F.col("n")).alias("recall"), (F.sum("hits").over(W.partitionBy()) / F.sum("n").over(W.partitionBy())).alias("accuracy"))


def weighted_accuracy(rows: DataFrame, by: str = "kind") -> DataFrame:
    """Accuracy of each kind weighted by n, and its population deviation over rows."""
    return rows.groupBy(by).agg(F.sum("n").alias("n"), (F.sum(F.col("acc") * F.col("n")) / F.sum("n")).alias("accuracy"), F.stddev_pop("acc").alias("std"))


def to_centroids(vectors: DataFrame, by: str = "label") -> DataFrame:
    """vec_id, cluster, distance of each vector to the mean of its cluster.

    Means are formed component by component, so a large cluster never meets in one row.
    """
    parts = vectors.select(by, F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy(by, "i").agg(F.avg("x").alias("m")).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))
    joined = vectors.join(F.broadcast(means), by)
    squares = F.aggregate(F.zip_with("embedding", "centroid", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return joined.select("vec_id", F.col(by).alias("cluster"), F.sqrt(squares).alias("distance"))


def extremes(distances: DataFrame, near: int = 9, far: int = 15) -> DataFrame:
    """The ``near`` nearest rows of each cluster and the ``far`` farthest of all."""
    r = F.row_number().over(W.partitionBy("cluster").orderBy("distance", "vec_id"))
    nearest = distances.withColumn("r", r).where(F.col("r") <= near).select(F.lit("near").alias("kind"), "cluster", "vec_id", "distance")
    farthest = distances.orderBy(F.desc("distance"), "vec_id").limit(far).select(F.lit("far").alias("kind"), "cluster", "vec_id", "distance")
    return nearest.unionByName(farthest)


GRID = 1 << 20  # steps of a unit: sums over vectors are exact, whatever their order


def _on_grid(vectors: DataFrame) -> DataFrame:
    """vec_id, x: vectors in whole steps of the grid, those with a missing or unbounded component left out."""
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v.cast("double")) < F.lit(float(1 << 20))))
    return vectors.where(sound).select("vec_id", F.transform("embedding", lambda v: F.floor(v.cast("double") * GRID)).alias("x"))


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(rows, centres): squared distances, a centre at a time."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)


def _partial_sums(centres: np.ndarray):
    """init, cluster, n, inertia, s of what a task holds, for all starts at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inits, k, d = centres.shape
        n, inertia, sums = np.zeros((inits, k), np.int64), np.zeros((inits, k)), np.zeros((inits, k, d), np.int64)
        for batch in batches:
            whole = _matrix(batch.column(0))
            for x in (whole[lo : lo + 4096] for lo in range(0, len(whole), 4096)):
                for i in range(inits):
                    far = _distances(x.astype(float), centres[i])
                    near = far.argmin(axis=1)
                    n[i] += np.bincount(near, minlength=k)
                    inertia[i] += np.bincount(near, far[np.arange(len(x)), near], minlength=k)
                    np.add.at(sums[i], near, x)
        at = np.argwhere(n > 0)
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(n[n > 0]), pa.array(inertia[n > 0]), pa.array(list(sums[n > 0]), pa.list_(pa.int64()))], names=["init", "cluster", "n", "inertia", "s"])

    return run


def _summed(points: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The means of what is nearest to each centre (the centre itself where nothing is), and the
    inertia of each start."""
    partial = points.select("x").mapInArrow(_partial_sums(centres), "init long, cluster long, n long, inertia double, s array<long>")
    parts = partial.select("init", "cluster", "n", "inertia", F.posexplode("s").alias("i", "s"))
    means, inertia = centres.copy(), np.zeros(len(centres))
    # As many rows as there are components of centres.
    for r in parts.groupBy("init", "cluster", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("inertia").alias("inertia")).collect():
        means[r.init, r.cluster, r.i] = r.s / r.n
        inertia[r.init] += r.inertia if r.i == 0 else 0.0
    return means, inertia


def cluster(vectors: DataFrame, k: int = 20, seed: int = 42, rounds: int = 50, n_init: int = 10) -> DataFrame:
    """vec_id, cluster, distance to its centre: k-means over the whole table, the best of ``n_init`` starts.

    A start's centres are the ``k`` vectors of least sha1 of (seed, start, vec_id). Lloyd rounds of
    all starts go through the table together, until no centre moves or ``rounds`` are over; a centre
    with nothing near it stays. The least inertia to six decimals wins, then the first start.
    Centres are all that goes out to tasks, and their components all that comes back. Vectors are
    held on a grid of 2**-20; those with a missing or unbounded component are left out.
    """
    spark = vectors.sparkSession
    with Scratch(spark) as held:
        points = held(_on_grid(vectors), "cluster-points")
        draw = F.sha1(F.concat_ws("|", F.lit(str(seed)), F.col("init").cast("string"), F.col("vec_id").cast("string")))
        order = F.row_number().over(W.partitionBy("init").orderBy(draw, "vec_id"))
        starts = points.crossJoin(F.broadcast(spark.range(n_init).withColumnRenamed("id", "init"))).withColumn("r", order).where(F.col("r") <= k)
        first = {(r.init, r.r - 1): r.x for r in starts.select("init", "r", "x").collect()}
        if not first:
            return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0.0).alias("distance")).limit(0)
        k = min(k, 1 + max(c for _, c in first))
        centres = np.array([[first[i, c] for c in range(k)] for i in range(n_init)], float)
        for _ in range(rounds):
            means, _ = _summed(points, centres)
            if (means == centres).all():
                break
            centres = means
        inertia = np.round(_summed(points, centres)[1] / GRID**2, 6)
        best = centres[int(inertia.argmin())]

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    far = _distances(_matrix(batch.column(1)).astype(float), best)
                    near = far.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near.astype(np.int32)), pa.array(np.sqrt(far[np.arange(len(near)), near]) / GRID)], names=["vec_id", "cluster", "distance"])

        kind = points.schema["vec_id"].dataType.simpleString()
        return held.result(points.mapInArrow(placed, f"vec_id {kind}, cluster int, distance double"), "clusters")


def rare_first(distances: DataFrame) -> DataFrame:
    """cluster, n: the smallest clusters first."""
    return distances.groupBy("cluster").agg(F.count("*").alias("n")).orderBy("n", "cluster")
