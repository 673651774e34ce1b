"""Boxes and points of a panorama that meet by grid cell."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panolith.functions import geometry as G

BOX = ("cx", "cy", "w", "h")
CELLS = 16  # of the grid along a panorama's side; boxes meet in the cells they share
FINE = 64  # of the grid along the side of a crowded panorama
UNIT_BOXES = 50_000  # of a panorama, beyond which it is dealt to several tasks
SLACK = 1e-9  # of a side, for rounding


def cell(edge: Column | str, cells: int = CELLS) -> Column:
    """The row or column of the grid; what lies outside goes to the border."""
    edge = F.col(edge) if isinstance(edge, str) else edge
    return F.least(F.greatest(F.floor(edge * cells), F.lit(0)), F.lit(cells - 1))


def in_cells(cornered: DataFrame) -> DataFrame:
    """Each row (x1, y1, x2, y2) once for every cell (i, j) of the grid that it touches."""
    return cornered.withColumn("i", F.explode(F.sequence(cell("x1"), cell("x2")))).withColumn("j", F.explode(F.sequence(cell("y1"), cell("y2"))))


def with_corners(boxes: DataFrame) -> DataFrame:
    return boxes.withColumns({"x1": F.col("cx") - F.col("w") / 2, "x2": F.col("cx") + F.col("w") / 2, "y1": F.col("cy") - F.col("h") / 2, "y2": F.col("cy") + F.col("h") / 2})


def overlaps(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("pid",), own_a: Sequence[str] = ("cat", "ord"), own_b: Sequence[str] = ("cat", "ord")) -> DataFrame:
    """keys, a, b (structs of the named columns and the box) and iou: every pair of boxes with equal
    keys and a common area, once.

    Both sides are dealt by (keys, grid cell), so a crowded panorama is not one task's and
    boxes far apart never meet; a pair counts in the cell of the upper left corner of what it shares.
    """
    left = in_cells(with_corners(a)).select(*keys, "i", "j", F.struct(*own_a, *BOX).alias("a"), F.col("x1").alias("ax"), F.col("y1").alias("ay"), F.col("x2").alias("ax2"), F.col("y2").alias("ay2"))
    right = in_cells(with_corners(b)).select(*keys, "i", "j", F.struct(*own_b, *BOX).alias("b"), F.col("x1").alias("bx"), F.col("y1").alias("by"), F.col("x2").alias("bx2"), F.col("y2").alias("by2"))
    x, y = F.greatest("ax", "bx"), F.greatest("ay", "by")
    apart = (x >= F.least("ax2", "bx2")) | (y >= F.least("ay2", "by2"))
    met = left.join(right, [*keys, "i", "j"]).where(~apart & (cell(x) == F.col("i")) & (cell(y) == F.col("j")))
    return met.select(*keys, "a", "b", G.iou(F.col("a"), F.col("b")).alias("iou"))


def most_boxes(*boxes: DataFrame) -> int:
    """How many boxes the fullest panorama holds."""
    pids = boxes[0].select("pid")
    for more in boxes[1:]:
        pids = pids.unionByName(more.select("pid"))
    return pids.groupBy("pid").count().agg(F.max("count")).first()[0] or 0


def units_of(most: int) -> int:
    return 1 if most <= UNIT_BOXES else min(FINE, 1 << math.ceil(math.log2(math.sqrt(most / UNIT_BOXES))))


def units(*boxes: DataFrame) -> int:
    """Into how many parts along its side a panorama is dealt: one, unless some panorama holds over UNIT_BOXES."""
    return units_of(most_boxes(*boxes))


def by_confidence(dets: DataFrame, shares: Sequence[float]) -> list[DataFrame]:
    """The rows in slices of falling confidence, cut near these shares of all (from the top), equal confidences together."""
    bounds = dets.approxQuantile("conf", [1 - s for s in shares], 0.001) if shares else []
    falling, slices, above = -F.col("conf"), [], None
    for bound in sorted(set(bounds), reverse=True):
        upto = falling <= -bound
        slices.append(upto | falling.isNull() if above is None else upto & (falling > -above))
        above = bound
    slices.append(F.lit(True) if above is None else falling > -above)
    return [dets.where(s) for s in slices]


@contextmanager
def dealt_once(spark: SparkSession) -> Iterator[None]:
    """Joins of the actions run inside take sides as they are dealt, if that is by some of the join's keys."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    was = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def meet(one: DataFrame, many: DataFrame, least: float, parts: int, keys: Sequence[str] = ("pid",), own: Sequence[str] = ("cat", "ord"), corners: bool = False) -> DataFrame:
    """Rows of ``one``, each with every box of ``many`` of equal keys and an IoU of ``least`` or more as b (a
    struct of ``own``) and iou, and once with nulls if there is none; also its part (pi, pj) of the panorama.

    An IoU of ``least`` bounds how far apart centres can be: (1 - least) / (2 least) of the sides of
    either box. So each row of ``one`` is in one cell of the grid, and only boxes of ``many`` are
    in several. Both are dealt by panorama (and by its part, where ``parts`` is over one) a single
    time; cells are told within a task. With ``corners``, areas come from corners. To be run within :func:`dealt_once`.
    """
    dealt, cells = (["pid"], CELLS) if parts == 1 else (["pid", "pi", "pj"], FINE)
    far = 0.5 / least - 0.5
    edges = {"x1": F.col("cx") - F.col("w") / 2, "x2": F.col("cx") + F.col("w") / 2, "y1": F.col("cy") - F.col("h") / 2, "y2": F.col("cy") + F.col("h") / 2, "s": F.col("w") * F.col("h")}
    if corners:
        edges["s"] = (edges["x2"] - edges["x1"]) * (edges["y2"] - edges["y1"])
    real = (F.col("w") > 0) & (F.col("h") > 0) & (F.abs(F.col("cx") + F.col("cy") + F.col("w") + F.col("h")) < float("inf"))
    reach = {a: (F.col(c) - F.col(side) * far - SLACK, F.col(c) + F.col(side) * far + SLACK) for a, c, side in (("i", "cx", "w"), ("j", "cy", "h"))}

    def spread(rows: DataFrame, names: Sequence[str], grid: int) -> DataFrame:
        for name, (low, high) in zip(names, reach.values()):
            rows = rows.withColumn(name, F.explode(F.sequence(cell(low, grid), cell(high, grid))))
        return rows

    left = one.withColumns({"pi": cell("cx", parts), "pj": cell("cy", parts)}).repartition(*dealt)
    left = left.withColumns({"i": F.when(real, cell("cx", cells)), "j": cell("cy", cells), **{f"_{k}": v for k, v in edges.items()}})
    lean = many.where(real).select(*dict.fromkeys((*keys, *own, *BOX)))
    right = spread((spread(lean, ("pi", "pj"), parts) if parts > 1 else lean).repartition(*dealt), ("i", "j"), cells)
    joined = [*keys, *dealt[1:], "i", "j"]
    right = right.select(*[F.col(k).alias(f"b_{k}") for k in joined], *[F.col(c).alias(f"own_{c}") for c in own], *[v.alias(f"b_{k}") for k, v in edges.items()])
    # Corners and areas are columns, so that the join's condition is small code. NaN is out already.
    shared = "greatest(0D, least(_x2, b_x2) - greatest(_x1, b_x1)) * greatest(0D, least(_y2, b_y2) - greatest(_y1, b_y1))"
    iou = f"({shared}) / (_s + b_s - ({shared}))"
    met = left.join(right.hint("merge"), F.expr(" AND ".join([f"{k} = b_{k}" for k in joined] + [f"{iou} >= {least!r}D"])), "left")
    return met.select(*one.columns, "pi", "pj", F.struct(*[F.col(f"own_{c}").alias(c) for c in own]).alias("b"), F.expr(iou).alias("iou"))


def outside(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Rows of ``points`` (pid, cx, cy) in no box (pid, x1, y1, x2, y2) of their panorama, bounds included."""
    p = points.withColumns({"_i": cell("cx"), "_j": cell("cy")}).alias("p")
    q = in_cells(boxes.select("pid", "x1", "y1", "x2", "y2").where("x1 <= x2 AND y1 <= y2")).alias("q")
    inside = (F.col("p.pid") == F.col("q.pid")) & (F.col("_i") == F.col("q.i")) & (F.col("_j") == F.col("q.j")) & F.col("cx").between(F.col("q.x1"), F.col("q.x2")) & F.col("cy").between(F.col("q.y1"), F.col("q.y2"))
    return p.join(q, inside, "left_anti").drop("_i", "_j")
