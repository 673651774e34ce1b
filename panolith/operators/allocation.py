"""Budgets of synthetic instances and their water-filling over classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def train_counts(train_objects: DataFrame, subset: DataFrame) -> DataFrame:
    """class_id, train_count; classes of the subset without a training instance count zero."""
    counts = train_objects.groupBy("name").agg(F.count("*").alias("n"))
    return subset.select("name", F.col("id").alias("class_id")).join(counts, "name", "left").select("class_id", F.coalesce("n", F.lit(0)).cast("long").alias("train_count"))


def budget(counts: DataFrame, k: float) -> DataFrame:
    """One row: K times all training instances, rounded half to even."""
    return counts.agg(F.bround(F.lit(k) * F.coalesce(F.sum("train_count"), F.lit(0)), 0).cast("long").alias("budget"))


def water_fill(counts: DataFrame, budget_: DataFrame, alpha: float | None = None, g_max: int | None = None) -> DataFrame:
    """class_id, train_count, alloc, budget: units go one by one to the class of least effective count.

    A class takes at most int(alpha * count) and ``g_max`` units; a budget beyond all caps
    stays unspent. Dealing one by one fills all classes to one level, so the level is found by
    halving, and the units that do not make up a whole level go by class id. Nothing is as
    large as the budget: the work is some sixty sums over one row per class.
    """
    whole = counts.crossJoin(F.broadcast(budget_))
    cap = F.greatest(F.lit(0).cast("long"), F.col("budget"))
    if alpha is not None:
        cap = F.least(cap, F.floor(F.col("train_count") * F.lit(float(alpha))))
    if g_max is not None:
        cap = F.least(cap, F.lit(g_max).cast("long"))
    one = whole.withColumn("cap", cap).agg(F.collect_list(F.struct("class_id", "train_count", "cap")).alias("classes"), F.max("budget").alias("budget"))
    zero = F.lit(0).cast("long")

    def taken(c, level):
        return F.least(c["cap"], F.greatest(level - c["train_count"], zero))

    def spent(level):
        return F.aggregate("classes", zero, lambda acc, c: acc + taken(c, level))

    def halve(state, _):
        middle = F.floor((state["low"] + state["high"] + 1) / 2)
        fits = spent(middle) <= F.col("budget")
        return F.struct(F.when(fits, middle).otherwise(state["low"]).alias("low"), F.when(fits, state["high"]).otherwise(middle - 1).alias("high"))

    top = F.aggregate("classes", zero, lambda acc, c: F.greatest(acc, c["train_count"] + c["cap"]))
    level = F.aggregate(F.sequence(F.lit(1), F.lit(52)), F.struct(zero.alias("low"), top.alias("high")), halve)["low"]
    leveled = one.withColumn("level", level).withColumn("left", F.col("budget") - spent(F.col("level")))
    rows = leveled.select("budget", "level", "left", F.explode("classes").alias("c")).withColumn("base", taken(F.col("c"), F.col("level")))
    more = (F.col("c.train_count") <= F.col("level")) & (F.col("base") < F.col("c.cap"))
    nth = F.row_number().over(W.partitionBy(more).orderBy("c.class_id"))
    return rows.select("c.class_id", "c.train_count", (F.col("base") + F.when(more & (nth <= F.col("left")), 1).otherwise(0)).cast("long").alias("alloc"), F.greatest("budget", zero).alias("budget"))


def build_allocation(train_objects: DataFrame, subset: DataFrame, k: float = 0.5, alpha: float | None = 3.0, g_max: int | None = None) -> DataFrame:
    """Counts, budget, and allocation, with the part of the budget that was spent."""
    counts = train_counts(train_objects, subset)
    filled = water_fill(counts, budget(counts, k), alpha, g_max)
    return filled.withColumn("b_effective", F.sum("alloc").over(W.partitionBy()))


def fills_floor(allocation: DataFrame) -> DataFrame:
    """The level that filled classes reach: the largest sum of real and synthetic instances among them."""
    return allocation.where("alloc > 0").agg(F.max(F.col("train_count") + F.col("alloc")).alias("level"))
