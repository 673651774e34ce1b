"""Detection-domain views over the test tables, as frames and as SQL for the oracle.

Integer arithmetic throughout, so that both engines see the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PER_PANORAMA, CLASSES, SIZE = 15, 25, 2048  # orders of a panorama: the number of panoramas grows with the tables
PREFIXES = ("w", "i", "p", "il", "pn")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panorama_of(order: str):
    return F.floor(F.col(order) / PER_PANORAMA)


def class_name(cat):
    return F.concat(F.element_at(F.array(*map(F.lit, PREFIXES)), (cat % 5 + 1).cast("int")), cat.cast("string"))


def objects(spark: SparkSession, sf_dir: str, crowd: int | None = None) -> DataFrame:
    """pid, cat, name, x1, y1, x2, y2 (pixels), ord: signs on panoramas (``crowd`` of them, if given), long-tailed over 25 classes."""
    t = table(spark, sf_dir, "lineitem")
    cat = F.floor(F.sqrt((F.col("l_partkey") * 7919 + F.col("l_suppkey") * 31) % 625))
    side = F.lit(8.0) + F.col("l_quantity") * 2
    rows = t.select(
        (panorama_of("l_orderkey") if crowd is None else F.col("l_orderkey") % crowd).alias("pid"), cat.alias("cat"), class_name(cat).alias("name"), side.alias("side"),
        ((F.col("l_partkey") * 37) % 1940).cast("double").alias("x1"), ((F.col("l_orderkey") * 53 + F.col("l_linenumber") * 97) % 1940).cast("double").alias("y1"),
        ((((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")) * 100 + F.col("l_quantity").cast("long")).alias("ord"),
    )
    return rows.select("pid", "cat", "name", "x1", "y1", (F.col("x1") + F.col("side")).alias("x2"), (F.col("y1") + F.col("side")).alias("y2"), "ord")


OBJECTS = """objects AS (
  SELECT pid, cat, ['w', 'i', 'p', 'il', 'pn'][cat % 5 + 1] || cat AS name, x1, y1, x1 + side AS x2, y1 + side AS y2, ord
  FROM (SELECT l_orderkey // 15 AS pid, CAST(floor(sqrt((l_partkey * 7919 + l_suppkey * 31) % 625)) AS BIGINT) AS cat,
               8 + 2 * l_quantity AS side, CAST((l_partkey * 37) % 1940 AS DOUBLE) AS x1,
               CAST((l_orderkey * 53 + l_linenumber * 97) % 1940 AS DOUBLE) AS y1,
               (((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS ord
        FROM lineitem))"""


def panoramas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, path, split_orig (by the first order of each)."""
    orders = table(spark, sf_dir, "orders").groupBy(panorama_of("o_orderkey").alias("pid")).agg(F.min(F.struct("o_orderkey", "o_orderstatus"))["o_orderstatus"].alias("status"))
    split = F.when(F.col("status") == "P", "train").when(F.col("status") == "O", "test").otherwise("other")
    return orders.select("pid", F.concat(split, F.lit("/"), F.col("pid").cast("string"), F.lit(".jpg")).alias("path"), split.alias("split_orig"))


PANOS = """panoramas AS (
  SELECT pid, split_orig || '/' || pid || '.jpg' AS path, split_orig
  FROM (SELECT o_orderkey // 15 AS pid, CASE arg_min(o_orderstatus, o_orderkey) WHEN 'P' THEN 'train' WHEN 'O' THEN 'test' ELSE 'other' END AS split_orig
        FROM orders GROUP BY o_orderkey // 15))"""


def normalised(objects_: DataFrame) -> DataFrame:
    """Adds cx, cy, w, h in panorama units."""
    return objects_.withColumns({"cx": (F.col("x1") + F.col("x2")) / 2 / SIZE, "cy": (F.col("y1") + F.col("y2")) / 2 / SIZE, "w": (F.col("x2") - F.col("x1")) / SIZE, "h": (F.col("y2") - F.col("y1")) / SIZE})


GTS = "gts AS (SELECT pid, cat, name, ord, (x1 + x2) / 2 / 2048 AS cx, (y1 + y2) / 2 / 2048 AS cy, (x2 - x1) / 2048 AS w, (y2 - y1) / 2048 AS h FROM objects)"


def ground_truth(spark: SparkSession, sf_dir: str, crowd: int | None = None) -> DataFrame:
    return normalised(objects(spark, sf_dir, crowd)).select("pid", "cat", "name", "ord", "cx", "cy", "w", "h")


def detections(spark: SparkSession, sf_dir: str, run: int = 0, crowd: int | None = None) -> DataFrame:
    """pid, cat, ord, conf, cx, cy, w, h: jittered objects, some missing, some of a wrong class, with tied confidences."""
    draw = F.pmod(F.col("ord") % 1000003 * 31 + run * 7919, F.lit(1000003))
    moved = objects(spark, sf_dir, crowd).withColumn("draw", draw).where("draw % 10 >= 2")
    dx, dy = F.col("draw") % 7 - 3, F.floor(F.col("draw") / 7) % 7 - 3
    shifted = moved.withColumns({"x1": F.col("x1") + dx, "x2": F.col("x2") + dx, "y1": F.col("y1") + dy, "y2": F.col("y2") + dy, "cat": F.when(F.col("draw") % 20 == 5, (F.col("cat") + 1) % CLASSES).otherwise(F.col("cat"))})
    return normalised(shifted).select("pid", "cat", "ord", ((F.col("draw") % 100) / 100.0).alias("conf"), "cx", "cy", "w", "h")


def dets_sql(run: int = 0, name: str = "dets") -> str:
    return f"""{name} AS (
  SELECT pid, CASE WHEN hh % 20 = 5 THEN (cat + 1) % 25 ELSE cat END AS cat, ord, CAST(hh % 100 AS DOUBLE) / 100.0 AS conf,
         (x1 + dx + x2 + dx) / 2 / 2048 AS cx, (y1 + dy + y2 + dy) / 2 / 2048 AS cy, (x2 - x1) / 2048 AS w, (y2 - y1) / 2048 AS h
  FROM (SELECT *, hh % 7 - 3 AS dx, (hh // 7) % 7 - 3 AS dy
        FROM (SELECT *, (ord % 1000003 * 31 + {run * 7919}) % 1000003 AS hh FROM objects)) WHERE hh % 10 >= 2)"""


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, hash: 64 sign bits of embeddings, planted in triples at two bits from each other."""
    base = F.col("vec_id") - F.col("vec_id") % 3
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    bits = F.lit(0).cast("long")
    for i in range(64):
        one = F.lit(-(1 << 63) if i == 63 else 1 << i).cast("long")
        bits = bits.bitwiseXOR(F.when(F.element_at("embedding", i + 1) > 0, one).otherwise(F.lit(0).cast("long")))
    whole = e.select("vec_id", bits.alias("hash"))
    first = whole.where(F.col("vec_id") % 3 == 0).select(F.col("vec_id").alias("base"), "hash")
    return e.select("vec_id", base.alias("base")).join(first, "base").select(F.col("vec_id").alias("id"), F.col("hash").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("vec_id") % 3).cast("int"))).alias("hash"))


HASHES = """signs AS (
  SELECT vec_id, list_sum(list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN CASE WHEN i = 63 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << i) END ELSE 0 END)) AS hash
  FROM embeddings),
hashes AS (
  SELECT e.vec_id AS id, xor(CAST(s.hash AS BIGINT), CAST(1 << (e.vec_id % 3) AS BIGINT)) AS hash
  FROM embeddings e JOIN signs s ON s.vec_id = e.vec_id - e.vec_id % 3)"""
