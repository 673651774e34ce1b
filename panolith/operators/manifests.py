"""Which sources, donors and places synthetic tiles take.

Draws are hashes of (seed, key): the same on any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panolith.functions import geometry as G
from panolith.session import spill


def draw(seed: int, *key: Column | str) -> Column:
    """A non-negative integer below 10**9 that the seed and the key decide, by SHA-1."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in key])
    return F.conv(F.substring(F.sha1(text), 1, 12), 16, 10).cast("long") % 1_000_000_000


def index_instances(labels: DataFrame, single_only: bool = True) -> DataFrame:
    """class_id, tile, box: instances that may serve as sources; by default of tiles with exactly one label."""
    if not single_only:
        return labels.select("class_id", "tile", "cx", "cy", "w", "h")
    counted = labels.withColumn("n", F.count("*").over(W.partitionBy("tile")))
    return counted.where("n = 1").select("class_id", "tile", "cx", "cy", "w", "h")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the place of each row (from 0) in the order of ``order``.

    Sorted by ranges, each range counted, and the counts summed up: no task holds all rows.
    """
    at, k = "__range", "__k"
    ranged, _ = spill(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({at: F.spark_partition_id(), k: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    counts = ranged.groupBy(at).agg(F.count("*").alias("n"))
    before = counts.select(at, (F.sum("n").over(W.orderBy(at)) - F.col("n")).alias("before"))  # a row for each range
    return ranged.join(F.broadcast(before), at).withColumn(name, F.col("before") + F.col(k)).drop(at, k, "before")


def _pool(index: DataFrame, by: list[str]) -> DataFrame:
    """The instances with their place i among those of the same ``by``."""
    placed = numbered(index, [*by, "tile", "cx", "cy", "w", "h"], "i")
    if not by:
        return placed
    first = placed.groupBy(by).agg(F.min("i").alias("first"))  # a row for each class
    return placed.join(F.broadcast(first), by).withColumn("i", F.col("i") - F.col("first")).drop("first")


def select_sources(allocation: DataFrame, index: DataFrame, seed: int = 42) -> DataFrame:
    """ord, class_id, tile, box: alloc[c] draws with replacement from the class's pool, classes ascending.

    A starved class (allocated, without a pool) gives no rows; see :func:`starved`.
    """
    pool = _pool(index, ["class_id"])
    size = index.groupBy("class_id").agg(F.count("*").alias("n"))
    wanted = allocation.where("alloc > 0").select("class_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("alloc") - 1)).alias("k"))
    picked = wanted.join(F.broadcast(size), "class_id").withColumn("i", draw(seed, "class_id", "k") % F.col("n"))
    return picked.join(pool, ["class_id", "i"]).select("class_id", "k", "tile", "cx", "cy", "w", "h")


def starved(allocation: DataFrame, index: DataFrame) -> DataFrame:
    return allocation.where("alloc > 0").join(index.select("class_id").distinct(), "class_id", "left_anti").select("class_id", "alloc")


def assign_placements(sources: DataFrame, recipients: DataFrame, seed: int = 42, jitter: float = 0.2, most: float = 0.9, margin: float = 0.15) -> DataFrame:
    """Adds a recipient tile and a jittered place: size by +-20 % up to 0.9, centre inside the margins."""
    places = numbered(recipients.select(F.col("tile").alias("recipient")), ["recipient"], "j")
    n = recipients.count()

    def unit(name: str) -> Column:
        return draw(seed, F.lit(name), "class_id", "k") / 1e9

    scale = (unit("jitter") * 2 - 1) * jitter + 1
    w, h = F.least(F.col("w") * scale, F.lit(most)), F.least(F.col("h") * scale, F.lit(most))
    placed = sources.withColumns({"j": draw(seed, F.lit("recipient"), "class_id", "k") % n, "pw": w, "ph": h, "pcx": unit("cx") * (1 - 2 * margin) + margin, "pcy": unit("cy") * (1 - 2 * margin) + margin})
    return placed.join(places, "j").drop("j")


def assign_placements_realistic(sources: DataFrame, donors: DataFrame, seed: int = 42) -> DataFrame:
    """Adds the tile and the box of a donor drawn among all classes."""
    pool = _pool(donors, []).select(F.col("i").alias("j"), F.col("tile").alias("recipient"), F.col("cx").alias("pcx"), F.col("cy").alias("pcy"), F.col("w").alias("pw"), F.col("h").alias("ph"))
    n = donors.count()
    return sources.withColumn("j", draw(seed, F.lit("donor"), "class_id", "k") % n).join(pool, "j").drop("j")


def kept_labels(labels: DataFrame, pastes: DataFrame, most: float = 0.3) -> DataFrame:
    """Labels of recipient tiles that no paste covers by an IoU over ``most``."""
    per = pastes.groupBy(F.col("recipient").alias("tile")).agg(F.collect_list(F.struct(F.col("pcx").alias("cx"), F.col("pcy").alias("cy"), F.col("pw").alias("w"), F.col("ph").alias("h"))).alias("p"))
    covered = F.exists("p", lambda p: G.iou(F.struct("cx", "cy", "w", "h"), p) > most)
    return labels.join(per, "tile", "left").where(~F.coalesce(covered, F.lit(False))).drop("p")


def completeness(sources: DataFrame, written: DataFrame) -> DataFrame:
    """class_id, allocated, realized, complete."""
    a = sources.groupBy("class_id").agg(F.count("*").alias("allocated"))
    b = written.groupBy("class_id").agg(F.count("*").alias("realized"))
    return a.join(b, "class_id", "left").select("class_id", "allocated", F.coalesce("realized", F.lit(0)).cast("long").alias("realized"), (F.coalesce("realized", F.lit(0)) >= F.col("allocated")).alias("complete"))


def still_to_write(sources: DataFrame, written: DataFrame) -> DataFrame:
    """Resume: sources whose tile is not there yet."""
    return sources.join(written, ["class_id", "k"], "left_anti")


def positional(sources: DataFrame, tiles: DataFrame) -> DataFrame:
    """Tile number i belongs to source number i."""
    return tiles.join(sources, "ord")


def round_robin(rows: DataFrame, limit: int, by: str = "class_id", order: str = "ord") -> DataFrame:
    """The first ``limit`` rows taking turns over classes."""
    turn = F.row_number().over(W.partitionBy(by).orderBy(order))
    return rows.withColumn("turn", turn).where(F.col("turn") <= limit).orderBy("turn", by).limit(limit).drop("turn")


def stratified_split(rows: DataFrame, fraction: float, seed: int = 42, by: str = "class_id", key: str = "ord") -> DataFrame:
    """Adds part (train or val): of each class the rounded fraction goes to val, one at least;
    a class of a single row stays in train."""
    size = F.count("*").over(W.partitionBy(by))
    place = F.row_number().over(W.partitionBy(by).orderBy(draw(seed, by, key), key))
    val = F.greatest(F.lit(1), F.bround(size * F.lit(fraction), 0))
    return rows.withColumn("part", F.when((size >= 2) & (place <= val), "val").otherwise("train"))


def every_nth(rows: DataFrame, step: int, limit: int, order: str = "ord") -> DataFrame:
    """The first ``limit`` of the rows at places 0, step, 2 step, ... of the order."""
    first = rows.orderBy(order).limit((limit - 1) * step + 1)  # only these can be among them
    return numbered(first, [order], "r").where(F.col("r") % step == 0).orderBy("r").limit(limit).drop("r")


def first_sources(sources: DataFrame, limit: int, order: str = "ord") -> DataFrame:
    """A trial run: the first ``limit`` sources in their order."""
    return sources.orderBy(order).limit(limit)


def first_present(rows: DataFrame, present: DataFrame, n: int, by: str = "class_id", order: str = "ord", key: str = "tile") -> DataFrame:
    """The first ``n`` rows of each class whose tile is there."""
    there = rows.join(present.select(key), key, "left_semi")
    return there.withColumn("r", F.row_number().over(W.partitionBy(by).orderBy(order))).where(F.col("r") <= n).drop("r")


def usable_crops(crops: DataFrame, limit: int = 40, least: int = 6, order: str = "ord") -> DataFrame:
    """Of the first ``limit`` crops those whose shorter side has ``least`` pixels; the limit comes first."""
    return crops.orderBy(order).limit(limit).where(F.least("width", "height") >= least)
