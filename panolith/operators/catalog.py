"""Class catalogs and data-set reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panolith.functions import geometry as G
from panolith.functions import names as N
from panolith.operators.quantiles import at_ranks


def class_counts(objects: DataFrame, by: str = "name", image: str = "pid") -> DataFrame:
    """instances and distinct images of each class."""
    return objects.groupBy(by).agg(F.count("*").alias("instances"), F.countDistinct(image).alias("images"))


def catalog(objects: DataFrame, by: str = "name", image: str = "pid") -> DataFrame:
    """Class counts with their rank: most instances first, then by name.

    Classes are few (one row each), which bounds the ordered windows here and below.
    """
    order = W.orderBy(F.desc("instances"), by)
    return class_counts(objects, by, image).withColumn("rank", F.row_number().over(order))


def with_shares(counts: DataFrame, by: str = "name") -> DataFrame:
    """Percentage of instances and its running sum down the catalog order."""
    order = W.orderBy(F.desc("instances"), by).rowsBetween(W.unboundedPreceding, W.currentRow)
    total = F.sum("instances").over(W.partitionBy())
    return counts.withColumns({"pct_instances": F.round(F.col("instances") * 100.0 / total, 3), "cum_pct": F.round(F.sum("instances").over(order) * 100.0 / total, 3)})


def split_counts(panoramas: DataFrame) -> DataFrame:
    return panoramas.groupBy("split_orig").agg(F.count("*").alias("n_panoramas"))


def split_pivot(objects: DataFrame, panoramas: DataFrame, splits: tuple[str, ...] = ("train", "test", "other")) -> DataFrame:
    """Instances of each class, one column for each split."""
    joined = objects.join(panoramas.select("pid", "split_orig"), "pid")
    return joined.groupBy("name").agg(*[F.count_if(F.col("split_orig") == s).alias(s) for s in splits])


def empty_images(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Images and images without an annotation in each split (left outer, so the empty ones count)."""
    per = images.join(annotations.groupBy("pid").agg(F.count("*").alias("n")), "pid", "left")
    return per.groupBy("split_orig").agg(F.count("*").alias("images"), F.count_if(F.coalesce("n", F.lit(0)) == 0).alias("empty"))


def thresholds(counts: DataFrame) -> DataFrame:
    """Classes over and under the usual support thresholds."""
    n = F.col("instances")
    return counts.agg(*[F.count_if(n >= t).alias(f"ge_{t}") for t in (100, 80, 50)], *[F.count_if(n < t).alias(f"lt_{t}") for t in (10, 5)])


def family_rollup(counts: DataFrame) -> DataFrame:
    """Class counts added up by family and prefix."""
    named = counts.withColumns({"family": N.family(F.col("name")), "prefix": N.prefix(F.col("name"))})
    return named.groupBy("family", "prefix").agg(F.count("*").alias("classes"), F.sum("instances").alias("instances"))


def size_bins(objects: DataFrame) -> DataFrame:
    """Objects in each size bin, degenerate boxes left out, with percentages."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    per = objects.where((w > 0) & (h > 0)).groupBy(G.size_bin(w * h).alias("bin")).agg(F.count("*").alias("n"))
    return per.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()), 4))


def head_ratio(counts: DataFrame, top: int = 10) -> DataFrame:
    """Largest class over the upper median, and the share of the ``top`` classes."""
    ordered = counts.withColumn("r", F.row_number().over(W.orderBy(F.desc("instances"), "name"))).withColumn("n", F.count("*").over(W.partitionBy()))
    median = F.max(F.when(F.col("r") == F.floor(F.col("n") / 2) + 1, F.col("instances")))
    return ordered.agg(F.max("instances").alias("head"), median.alias("upper_median"), F.round(F.max("instances") / median, 4).alias("ratio"), F.round(F.sum(F.when(F.col("r") <= top, F.col("instances")).otherwise(0)) * 100.0 / F.sum("instances"), 4).alias("top_pct"))


def index_percentiles(rows: DataFrame, value: Column, percents: tuple[int, ...] = (10, 50, 90)) -> DataFrame:
    """The element at k * n div 100 of the sorted values, not interpolated; minimum and maximum.

    Found by radix selection: neither all rows nor all different values meet in one task.
    """
    n = F.col("n")
    found = at_ranks(rows, [], value, {"min": F.lit(0), "max": n - 1} | {f"p{k}": F.floor(n * k / 100) for k in percents})
    return found.select("min", "max", *[f"p{k}" for k in percents])


def histogram(rows: DataFrame, value: Column, high: float, bins: int) -> DataFrame:
    """Fixed-width bins from 0 to ``high``; a value at ``high`` falls in the last one, beyond it nowhere."""
    v = value
    return rows.where((v >= 0) & (v <= high)).groupBy(F.least(F.floor(v * bins / high), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))


def resolutions(images: DataFrame, top: int = 3) -> DataFrame:
    """The commonest resolutions, each with the number of different ones."""
    per = images.groupBy("width", "height").agg(F.count("*").alias("n"))
    return per.withColumn("different", F.count("*").over(W.partitionBy())).orderBy(F.desc("n"), "width", "height").limit(top)


def coco_counts(annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """Instances and images of each category name; annotations to ignore do not count."""
    used = annotations.where(~F.coalesce("ignore", F.lit(False)))
    return class_counts(used.join(F.broadcast(categories), "category_id"), "name", "image_id")


def catch_all(counts: DataFrame, factor: int = 3) -> DataFrame:
    """The largest class and whether it is over ``factor`` times the second, a sign of a catch-all."""
    two = counts.orderBy(F.desc("instances"), "name").limit(2).agg(F.max("instances").alias("first"), F.min("instances").alias("second"))
    return two.withColumn("suspicious", F.col("first") > F.col("second") * factor)
