"""Exact order statistics of many groups at once, by radix selection.

Values get 64-bit keys of the same order. Sixteen bits at a time, rows are counted by the bits
they begin with; each rank wanted then lies in one of these ranges and is looked for inside it.
Counts add up in the tasks before they shuffle, so no group, however large, comes together
anywhere, and nothing is sorted but counts: at most 65,536 of a range.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from panolith.session import Scratch

DIGIT = 16


@F.pandas_udf(LongType())
def order_key(values: pd.Series) -> pd.Series:
    """A signed long for each double, in the same order (NaN last)."""
    bits = values.to_numpy(np.float64).view(np.int64)
    return pd.Series(bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)))


def _group(by: list[str]) -> Column:
    """One string for the values of ``by``, nulls told apart."""
    return F.to_json(F.struct(*[F.col(c) for c in by])) if by else F.lit("")


def at_ranks(rows: DataFrame, by: list[str], value: Column, ranks: dict[str, Column]) -> DataFrame:
    """by, and for each name the value at that rank (from 0) of the group's sorted values, as a double.

    ``ranks`` are columns over n, the group's number of values; beyond the last one there is null.
    Null values do not count, and a group of nulls alone gives no row.
    """
    with Scratch(rows.sparkSession) as held:
        plain = rows.select(*by, value.cast("double").alias("_v")).where("_v IS NOT NULL").withColumn("_g", _group(by))
        keyed = held(plain.select("_g", "_v", order_key("_v").alias("_k")), "quantile-keys")
        groups = held(plain.groupBy("_g").agg(*[F.first(c).alias(c) for c in by], F.count("*").alias("n")), "quantile-groups")
        names = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), r.cast("long").alias("rank")) for k, r in ranks.items()])).alias("x")
        wanted = groups.select("_g", names).select("_g", "x.name", "x.rank", F.lit(0).cast("long").alias("prefix"))
        for low in range(64 - DIGIT, -1, -DIGIT):
            own = F.shiftright("_k", low)
            above = F.shiftright("_k", low + DIGIT) if low + DIGIT < 64 else F.lit(0).cast("long")
            open_ = wanted.select("_g", "prefix").distinct()
            counts = keyed.select("_g", "_v", above.alias("prefix"), own.alias("digit")).join(open_, ["_g", "prefix"], "left_semi").groupBy("_g", "prefix", "digit").agg(F.count("*").alias("m"), F.min("_v").alias("_v"))
            order = W.partitionBy("_g", "prefix").orderBy("digit").rowsBetween(W.unboundedPreceding, W.currentRow)
            ranges = counts.withColumn("upto", F.sum("m").over(order))
            found = wanted.join(ranges, ["_g", "prefix"]).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("m")))
            wanted = held(found.select("_g", "name", (F.col("rank") - F.col("upto") + F.col("m")).alias("rank"), F.col("digit").alias("prefix"), "_v"), "quantile-ranks")
            last, wanted = wanted, wanted.drop("_v")
        told = last.groupBy("_g").agg(*[F.max(F.when(F.col("name") == k, F.col("_v"))).alias(k) for k in ranks])
        return held.result(groups.join(told, "_g", "left").select(*by, "n", *ranks), "quantiles")


def quantiles(rows: DataFrame, by: list[str], value: Column, at: dict[str, float]) -> DataFrame:
    """by, and for each name its quantile, linear between the two neighbours of q (n - 1)."""
    place = {k: F.lit(q) * (F.col("n") - 1) for k, q in at.items()}
    ranks = {f"{k}_lower": F.floor(p) for k, p in place.items()} | {f"{k}_upper": F.ceil(p) for k, p in place.items()}
    found = at_ranks(rows, by, value, ranks)
    share = {k: p - F.floor(p) for k, p in place.items()}
    return found.select(*by, *[(F.col(f"{k}_lower") * (1 - s) + F.col(f"{k}_upper") * s).alias(k) for k, s in share.items()])
