"""Tiles of panoramas and what happens to objects in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panolith.functions import geometry as G
from panolith.functions import names as N


def grid_array(width: int = G.PANORAMA, height: int = G.PANORAMA, size: int = G.TILE, overlap: int = G.OVERLAP) -> Column:
    """The tiles of one panorama size as a literal array of x1, y1, x2, y2."""
    return F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), (x, y, x + size, y + size))]) for x, y in G.tile_grid(width, height, size, overlap)])


def object_tiles(objects: DataFrame, width: int = G.PANORAMA, height: int = G.PANORAMA, size: int = G.TILE, overlap: int = G.OVERLAP) -> DataFrame:
    """Objects with every tile they overlap and their visibility there; no join, no shuffle."""
    box = F.struct("x1", "y1", "x2", "y2")
    met = F.filter(F.transform(grid_array(width, height, size, overlap), lambda t: F.struct(t.alias("tile"), G.clip(box, t).alias("clip"))), lambda m: m["clip"]["vf"] > 0)
    return objects.select("*", F.explode(met).alias("m")).select("*", F.col("m.tile").alias("tile"), F.col("m.clip.vf").alias("vf"), F.col("m.clip.box").alias("clip")).drop("m")


def tile_objects(objects: DataFrame, subset: DataFrame, other_id: int | None = None, never_other: DataFrame | None = None, keep: float = G.KEEP_VISIBLE, drop: float = G.DROP_VISIBLE, **grid) -> DataFrame:
    """pid, x_off, y_off, kind (label, other, ignore), class_id, cx, cy, w, h (tile units) and ignore corners.

    Objects in the subset and visible enough are labels, barely visible ones are dropped, the
    rest is ignored; with ``other_id`` visible objects outside the subset become that class,
    but for those named in ``never_other``.
    """
    known = objects.join(F.broadcast(subset.select("name", F.col("id").alias("class_id"))), "name", "left")
    may = F.lit(True)
    if never_other is not None:
        known = known.join(F.broadcast(never_other.select("name").withColumn("barred", F.lit(True))), "name", "left")
        may = F.col("barred").isNull()
    size = float(grid.get("size", G.TILE))
    kind = G.visibility_class(F.col("vf"), F.col("class_id").isNotNull(), keep, drop, other=other_id is not None)
    kind = F.when((kind == "other") & ~may, "ignore").otherwise(kind)
    cut = object_tiles(known, **grid).withColumn("kind", kind).where("kind <> 'drop'")
    x1, y1, x2, y2 = (F.col(f"clip.{a}") - F.col(f"tile.{o}") for a, o in (("x1", "x1"), ("y1", "y1"), ("x2", "x1"), ("y2", "y1")))
    return cut.select("pid", F.col("tile.x1").cast("int").alias("x_off"), F.col("tile.y1").cast("int").alias("y_off"), "kind", F.when(F.col("kind") == "other", F.lit(other_id)).otherwise(F.col("class_id")).cast("int").alias("class_id"), ((x1 + x2) / 2 / size).alias("cx"), ((y1 + y2) / 2 / size).alias("cy"), ((x2 - x1) / size).alias("w"), ((y2 - y1) / size).alias("h"), x1.alias("ix1"), y1.alias("iy1"), x2.alias("ix2"), y2.alias("iy2"))


def tile_name(pid: Column, x: Column, y: Column) -> Column:
    return F.concat_ws("_", pid.cast("string"), x.cast("string"), y.cast("string"))


def kept_tiles(panoramas: DataFrame, cut: DataFrame, fraction: float = 0.1, every: bool = False, **grid) -> DataFrame:
    """tile, pid, x_off, y_off, labels: tiles with a label, and a fraction of the others drawn by name.

    ``every`` keeps all tiles, as evaluation does. Labels of the class ``other`` count.
    """
    tiles = panoramas.select("pid", F.explode(grid_array(**grid)).alias("t")).select("pid", F.col("t.x1").cast("int").alias("x_off"), F.col("t.y1").cast("int").alias("y_off"))
    labels = cut.where("kind IN ('label', 'other')").groupBy("pid", "x_off", "y_off").agg(F.count("*").alias("n"))
    named = tiles.join(labels, ["pid", "x_off", "y_off"], "left").select(tile_name(F.col("pid"), F.col("x_off"), F.col("y_off")).alias("tile"), "pid", "x_off", "y_off", F.coalesce("n", F.lit(0)).cast("long").alias("labels"))
    return named if every else named.where((F.col("labels") > 0) | N.keep_negative(F.col("tile"), fraction))


def labelable(objects: DataFrame, keep: float = G.KEEP_VISIBLE, **grid) -> DataFrame:
    """Objects that some tile shows well enough, by a higher-order function over the literal grid."""
    box = F.struct("x1", "y1", "x2", "y2")
    return objects.where(F.exists(grid_array(**grid), lambda t: G.clip(box, t)["vf"] >= keep))


def labelable_counts(objects: DataFrame, keep: float = G.KEEP_VISIBLE, **grid) -> DataFrame:
    """n and n_excluded: the objects that evaluation counts, and those that no tile shows well enough."""
    box = F.struct("x1", "y1", "x2", "y2")
    shown = F.exists(grid_array(**grid), lambda t: G.clip(box, t)["vf"] >= keep)
    return objects.agg(F.count_if(shown).alias("n"), F.count_if(~shown).alias("n_excluded"))


def lookalikes(objects: DataFrame, subset: DataFrame) -> DataFrame:
    """Categories outside the subset that share their leading letters with a tail class."""
    families = subset.where("tier = 'tail'").select(N.letters(F.col("name")).alias("letters")).distinct()
    outside = objects.select("name").distinct().join(F.broadcast(subset.select("name")), "name", "left_anti")
    return outside.withColumn("letters", N.letters(F.col("name"))).join(F.broadcast(families), "letters", "left_semi").select("name")
