"""Balanced class subsets over three bands of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TIERS = ("head", "mid", "tail")


def pick_evenly(ordered: DataFrame, k: int, band: str = "band", rank: str = "i", size: str = "n") -> DataFrame:
    """The rows of each band at ``k`` evenly spaced ranks, rounded half to even.

    A band of at most ``k`` rows stays whole; where roundings meet, the lowest unused ranks
    fill up. ``rank`` counts from 0.
    """
    spread = F.transform(F.sequence(F.lit(0), F.lit(max(k, 1) - 1)), lambda g: F.bround(g * (F.col(size) - 1) / F.lit(max(k - 1, 1)), 0).cast("long"))
    wanted = F.array_distinct(spread)
    unused = F.array_except(F.sequence(F.lit(0).cast("long"), F.col(size).cast("long") - 1), wanted)
    full = F.concat(wanted, F.slice(unused, 1, F.lit(k) - F.size(wanted)))
    return ordered.where((F.col(size) <= k) | F.array_contains(full, F.col(rank).cast("long")))


def select_subset(counts: DataFrame, n_classes: int = 20, min_instances: int = 80) -> DataFrame:
    """name, id, instances, tier: as many classes of the head, the middle and the tail.

    Raises if fewer than three classes are eligible. Works on one row per class.
    """
    eligible = counts.where(F.col("instances") >= min_instances)
    enough = eligible.agg(F.when(F.count("*") >= 3, True).otherwise(F.raise_error(F.lit("fewer than three eligible classes")).cast("boolean")).alias("enough"))
    order = W.orderBy(F.desc("instances"), "name")
    banded = eligible.crossJoin(F.broadcast(enough)).where("enough").withColumns({"rank": F.row_number().over(order), "band": F.ntile(3).over(order)})
    inside = W.partitionBy("band")
    ranked = banded.withColumns({"i": F.row_number().over(inside.orderBy("rank")) - 1, "n": F.count("*").over(inside)})
    chosen = pick_evenly(ranked, max(1, round(n_classes / 3)))
    tier = F.element_at(F.array(*map(F.lit, TIERS)), F.col("band"))
    return chosen.select("name", (F.row_number().over(W.orderBy("rank")) - 1).alias("id"), "instances", tier.alias("tier"))


def select_subset_coco(train: DataFrame, evaluation: DataFrame, n_classes: int = 20, min_instances: int = 80, min_eval: int = 10) -> DataFrame:
    """The same over the sum of both counts, where the evaluation side has enough by itself."""
    both = train.select("name", "instances", F.lit(0).cast("long").alias("e")).unionByName(evaluation.select("name", "instances", F.col("instances").alias("e")))
    merged = both.groupBy("name").agg(F.sum("instances").alias("instances"), F.sum("e").alias("e"))
    return select_subset(merged.where(F.col("e") >= min_eval).select("name", "instances"), n_classes, min_instances)


def remove_other(subset: DataFrame) -> DataFrame:
    return subset.where(F.col("name") != "other")


def add_other(subset: DataFrame, objects: DataFrame) -> DataFrame:
    """Appends the class ``other``, with the instances outside the subset; leaves one that is there."""
    base = remove_other(subset)
    outside = objects.join(F.broadcast(base.select("name")), "name", "left_anti").agg(F.count("*").alias("instances"))
    last = base.agg(F.coalesce(F.max("id") + 1, F.lit(0)).cast("int").alias("id"))
    other = outside.crossJoin(last).select(F.lit("other").alias("name"), "id", "instances", F.lit("distractor").alias("tier"))
    return base.unionByName(other)
