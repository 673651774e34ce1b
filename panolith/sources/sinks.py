"""Writers: idempotent, resumable and keyed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panolith.session import forget, spill


def write_once(df: DataFrame, path: str, force: bool = False) -> None:
    """Leaves a result that is there unless forced."""
    df.write.mode("overwrite" if force else "ignore").parquet(path)


def write_runs(df: DataFrame, path: str) -> None:
    """AP reports and detections by arm, seed and split; only the partitions at hand are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("arm", "seed", "split").parquet(path)


def append_missing(df: DataFrame, path: str, keys: list[str]) -> int:
    """Appends rows whose key is not there yet, one of each key, and tells how many; safe to repeat after a failure."""
    spark = df.sparkSession
    try:
        held = spark.read.parquet(path).select(keys)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        held = None
    new, copy = spill((df if held is None else df.join(held, keys, "left_anti")).dropDuplicates(keys), "append")
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    forget(spark, copy)
    return n


def write_tiles(tiles: DataFrame, labels: DataFrame, ignores: DataFrame, path: str) -> None:
    """Tiles as a training set: images and an index as tables, and for each tile a folder of label
    lines (class and box, six decimals) and, where it has any, of ignored boxes as JSON."""
    tiles.select("tile", "content").write.mode("overwrite").parquet(f"{path}/images")
    tiles.select("tile", F.col("pid").alias("panorama_id"), "x_off", "y_off", "size").write.mode("overwrite").parquet(f"{path}/index")
    lines = labels.select("tile", F.format_string("%d %.6f %.6f %.6f %.6f", "class_id", "cx", "cy", "w", "h").alias("value"))
    lines.repartition("tile").write.mode("overwrite").partitionBy("tile").text(f"{path}/labels")
    boxes = ignores.groupBy("tile").agg(F.to_json(F.collect_list(F.array("x1", "y1", "x2", "y2"))).alias("value"))
    boxes.write.mode("overwrite").partitionBy("tile").text(f"{path}/ignores")


def nan_safe_json(df: DataFrame) -> DataFrame:
    """One column of JSON; NaN and infinities become null."""
    finite = [F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*finite), {"ignoreNullFields": "false"}).alias("json"))


def class_count_csv(df: DataFrame, path: str) -> None:
    """Shares with three decimals, one header."""
    shown = [F.format_string("%.3f", c).alias(c) if c in ("pct_instances", "cum_pct") else F.col(c) for c in df.columns]
    df.select(shown).coalesce(1).write.mode("overwrite").csv(path, header=True)


def training_union(*parts: DataFrame) -> DataFrame:
    """Real and synthetic rows together."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def markdown(df: DataFrame) -> str:
    """A table of all rows, for reports: their rows are classes, arms or seeds."""
    line = lambda cells: "| " + " | ".join("n/a" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, df.toLocalIterator())]) + "\n"
