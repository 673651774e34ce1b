"""Tile detections to panorama detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panolith.functions import geometry as G
from panolith.operators import cells
from panolith.operators.cells import BOX, by_confidence, dealt_once, meet, most_boxes, outside, units_of
from panolith.session import Scratch


def outside_ignores(dets: DataFrame, ignores: DataFrame) -> DataFrame:
    """Detections whose centre lies in no ignore box of their panorama, bounds included.

    Ignore boxes (corners in panorama units) of all tiles of a panorama hold for all its
    detections; centres and boxes meet by grid cell.
    """
    return outside(dets, ignores)


def _suppressed(boxes: DataFrame, threshold: float, parts: int, held: Scratch) -> DataFrame:
    """The _uid of those that go, of boxes that all meet: edges from the earlier to the later one, in rounds."""
    met = meet(boxes, boxes.withColumnRenamed("_uid", "uid"), threshold, parts, ("pid", "cat"), ("uid", "ord", "conf"), corners=True).where("iou IS NOT NULL")
    rank = lambda *c: F.struct(-F.col(c[0]), F.col(c[1]), F.col(c[2]))
    pairs = met.where(rank("b.conf", "b.ord", "b.uid") < rank("conf", "ord", "_uid"))
    edges = held(pairs.select("pid", F.col("b.uid").alias("hi"), F.col("_uid").alias("lo")), "nms-edges")
    gone = edges.select(F.col("lo").alias("_uid")).limit(0)
    while not edges.isEmpty():
        # An edge holds if no edge leads to its upper box; what it leads to goes. Boxes of a
        # panorama are in one task where panoramas are not crowded.
        dealt = edges.repartition("pid") if parts == 1 else edges
        first = dealt.join(dealt.select("pid", F.col("lo").alias("hi")).distinct(), ["pid", "hi"], "left_anti")
        now = held(first.select("pid", F.col("lo").alias("_uid")).distinct(), "nms-gone")
        gone = gone.unionByName(now.select("_uid"))
        low, high = (now.select("pid", F.col("_uid").alias(c)) for c in ("lo", "hi"))
        edges = held(edges.join(low, ["pid", "lo"], "left_anti").join(high, ["pid", "hi"], "left_anti").select("pid", "hi", "lo"), "nms-edges")
    return gone


def nms(dets: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Greedy suppression within (pid, cat): highest confidence first (ties by ord), IoU of ``threshold`` or more goes.

    Boxes of one class that overlap enough are edges from the earlier to the later one. In each
    round, boxes that no edge leads to are kept and what they lead to goes, with its edges, until
    no edge is left: the same boxes as one after another, without an order over all of a group.
    Crowded panoramas go by slices of falling confidence, each as large as all before it: a slice
    first loses what kept boxes of earlier slices suppress, so that pairs grow with what is kept.
    """
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    extra = [c for c in dets.columns if c not in ("pid", "cat", "conf", "ord", *BOX)]
    spark = dets.sparkSession
    with Scratch(spark) as held, dealt_once(spark):
        most = most_boxes(dets)
        parts = units_of(most)
        own = held(dets.select("pid", "cat", "ord", "conf", *BOX, *extra).withColumn("_uid", F.monotonically_increasing_id()), "nms-boxes")
        lean = own.select("pid", "cat", "_uid", "ord", "conf", *BOX)
        if parts == 1:
            return held.result(own.join(_suppressed(lean, threshold, parts, held), "_uid", "left_anti").drop("_uid"), "nms")
        shares = [cells.UNIT_BOXES / most]
        while shares[-1] < 0.5:
            shares.append(2 * shares[-1])
        kept = lean.limit(0)
        for some in by_confidence(lean, shares):
            with Scratch(spark) as here:
                left = here(meet(some, kept.select("pid", "cat", "ord", *BOX), threshold, parts, ("pid", "cat"), ("ord",), corners=True).where("iou IS NULL").select(lean.columns), "nms-open")
                now = held(left.join(_suppressed(left, threshold, parts, here), "_uid", "left_anti").select(lean.columns), "nms-kept")
            kept = kept.unionByName(now)
        return held.result(own.join(kept.select("_uid"), "_uid", "left_semi").drop("_uid"), "nms")


def reconstruct(tile_dets: DataFrame, ignores: DataFrame, threshold: float = 0.5, size: int = G.PANORAMA) -> DataFrame:
    """Tile detections (with x_off, y_off) mapped to the panorama, filtered by ignores (tile pixels), suppressed."""
    box = G.det_to_panorama(F.struct(*BOX), F.col("x_off"), F.col("y_off"), size=size)
    mapped = tile_dets.withColumn("p", box).select("pid", "cat", "ord", "conf", *[F.col(f"p.{c}").alias(c) for c in BOX])
    corners = G.ignore_to_panorama(F.struct("x1", "y1", "x2", "y2"), F.col("x_off"), F.col("y_off"), size)
    placed = ignores.select("pid", corners.alias("i")).select("pid", "i.*")
    return nms(outside_ignores(mapped, placed), threshold)


def of_split(dets: DataFrame, splits: DataFrame, split: str) -> DataFrame:
    """Detections of panoramas in a split; others are dropped."""
    return dets.join(splits.where(F.col("split") == split).select(F.col("id").alias("pid")), "pid", "left_semi")


def at_confidence(dets: DataFrame, conf: float) -> DataFrame:
    return dets if conf <= 0 else dets.where(F.col("conf") >= conf)


def outside_signs(dets: DataFrame, signs: DataFrame) -> DataFrame:
    """Detections whose centre is in no sign of the panorama: hallucinations."""
    corners = signs.select("pid", (F.col("cx") - F.col("w") / 2).alias("x1"), (F.col("cy") - F.col("h") / 2).alias("y1"), (F.col("cx") + F.col("w") / 2).alias("x2"), (F.col("cy") + F.col("h") / 2).alias("y2"))
    return outside_ignores(dets, corners)
