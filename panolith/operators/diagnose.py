"""What becomes of objects, and where false positives come from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panolith.functions import geometry as G
from panolith.operators.cells import BOX, dealt_once, meet, units
from panolith.operators.detect import at_confidence
from panolith.operators.metrics import matched
from panolith.session import Scratch

HIT, NEAR = 0.5, 0.3



def greedy_hits(gts: DataFrame, dets: DataFrame, threshold: float = HIT) -> DataFrame:
    """pid, cat, ord (detection), gi: same-class matches; on equal IoU the last object wins."""
    return matched(dets, gts, threshold, last=True).where("gi IS NOT NULL").select("pid", "cat", "ord", "gi")


def _best(one: DataFrame, many: DataFrame, least: float, own: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``one`` (pid, cat, ord and the columns ``own``) with the best box of ``many`` on the panorama
    (best: neg, ord, cat) and the best IoU of one of their own class (own_iou); nulls below ``least``."""
    parts = units(one, many)
    rows = one.select(*dict.fromkeys(("pid", "cat", "ord", *BOX, *own))).withColumn("uid", F.monotonically_increasing_id())
    met = meet(rows, many, least, parts)
    place = ["pid"] if parts == 1 else ["pid", "pi", "pj"]
    b = F.when(F.col("iou").isNotNull(), F.struct((-F.col("iou")).alias("neg"), F.col("b.ord").alias("ord"), F.col("b.cat").alias("cat")))
    same = F.when(F.col("cat") == F.col("b.cat"), F.col("iou"))
    return met.groupBy(*place, "uid").agg(*[F.first(c).alias(c) for c in ("cat", "ord", *own)], F.min(b).alias("best"), F.max(same).alias("own_iou"))


def classify_objects(gts: DataFrame, dets: DataFrame, threshold: float = HIT, near: float = NEAR, own: tuple[str, ...] = ()) -> DataFrame:
    """pid, cat, ord, outcome (HIT, CLS, LOC, MISS), confused, and the columns ``own`` of the objects.

    HIT: matched, or some detection of the class overlaps enough though used elsewhere. CLS:
    the best detection of any class overlaps enough and is of another class (first on ties by
    ord). LOC: some detection of the class overlaps by ``near``. MISS: the rest.

    A detection matters from the lower of both bounds on, so only those meet. An object that is matched has a
    detection of its class that overlaps by ``threshold``, so that matching decides nothing here.
    """
    spark = gts.sparkSession
    with Scratch(spark) as held, dealt_once(spark):
        seen = _best(gts, dets, min(threshold, near), own)
        mine, best = F.coalesce("own_iou", F.lit(0.0)), F.coalesce(-F.col("best.neg"), F.lit(0.0))
        outcome = F.when(mine >= threshold, "HIT").when((best >= threshold) & (F.col("best.cat") != F.col("cat")), "CLS").when(mine >= near, "LOC").otherwise("MISS")
        return held.result(seen.select("pid", "cat", "ord", outcome.alias("outcome"), F.when(outcome == "CLS", F.col("best.cat")).alias("confused"), *own), "outcomes")


def decompose(gts: DataFrame, dets: DataFrame, subset: DataFrame, **rules) -> DataFrame:
    """One row per tail object: outcome, size in pixels to one decimal, band. Detections of all classes count."""
    tail = F.broadcast(subset.where("tier = 'tail'").select(F.col("id").cast("long").alias("cat")))
    sized = gts.join(tail, "cat", "left_semi").withColumns({"size_px": F.round(F.greatest("w", "h") * G.PANORAMA, 1), "band": G.size_band("w", "h")})
    return classify_objects(sized, dets, own=("size_px", "band"), **rules)


def tail_fp_precision(gts: DataFrame, dets: DataFrame, subset: DataFrame, threshold: float = HIT) -> DataFrame:
    """tp, fp, precision of tail detections on panoramas that have objects (0 without any)."""
    tail = F.broadcast(subset.where("tier = 'tail'").select(F.col("id").cast("long").alias("cat")))
    own = dets.join(tail, "cat", "left_semi").join(gts.select("pid").distinct(), "pid", "left_semi")
    m = matched(own, gts.join(tail, "cat", "left_semi"), threshold, last=True)
    counted = m.agg(F.count("gi").alias("tp"), F.count_if(F.col("gi").isNull()).alias("fp"))
    return counted.withColumn("precision", F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.lit(0.0)))


def classify_tail_fps(gts: DataFrame, dets: DataFrame, subset: DataFrame, threshold: float = HIT, near: float = NEAR) -> DataFrame:
    """kind (on_sign, on_bg, ambiguous), fires_on (the class of the sign under an on_sign one), n.

    A false positive of a tail class is on a sign if an object of any class overlaps by
    ``threshold``, on background if none overlaps by ``near``, and ambiguous between.
    """
    tail = F.broadcast(subset.where("tier = 'tail'").select(F.col("id").cast("long").alias("cat")))
    own = dets.join(tail, "cat", "left_semi").join(gts.select("pid").distinct(), "pid", "left_semi")
    spark = gts.sparkSession
    with Scratch(spark) as held, dealt_once(spark):
        wrong = matched(own, gts.join(tail, "cat", "left_semi"), threshold, last=True, own=BOX).where("gi IS NULL")
        judged = held.result(_best(wrong, gts, min(threshold, near)).select("cat", "ord", F.col("best").alias("b")), "judged")
    over = F.coalesce(-F.col("b.neg"), F.lit(0.0))
    kind = F.when(over >= threshold, "on_sign").when(over < near, "on_bg").otherwise("ambiguous")
    return judged.select(kind.alias("kind"), F.when(over >= threshold, F.col("b.cat")).alias("fires_on")).groupBy("kind", "fires_on").agg(F.count("*").alias("n"))


def rates(outcomes: DataFrame, by: list[str], floor: float = 0.0) -> DataFrame:
    """HIT, MISS, CLS and LOC in percent of all objects (at least one)."""
    total = F.greatest(F.lit(1), F.count("*"))
    return outcomes.groupBy(by).agg(*[F.round(F.count_if(F.col("outcome") == o) * 100.0 / total, 4).alias(o.lower()) for o in ("HIT", "MISS", "CLS", "LOC")])


def seed_metrics(gts: DataFrame, dets: DataFrame, subset: DataFrame, operating: float = 0.25, **rules) -> DataFrame:
    """HIT, MISS, CLS and LOC of tail objects in percent, for all detections and for confident ones (suffix _op)."""
    kinds = ("HIT", "MISS", "CLS", "LOC")
    floor = decompose(gts, dets, subset, **rules).select("pid", "cat", "ord", "outcome")
    sure = decompose(gts, at_confidence(dets, operating), subset, **rules).select("pid", "cat", "ord", F.col("outcome").alias("outcome_op"))
    total = F.greatest(F.lit(1), F.count("*"))
    share = [F.round(F.count_if(F.col(c) == k) * 100.0 / total, 4).alias(k.lower() + c.removeprefix("outcome")) for c in ("outcome", "outcome_op") for k in kinds]
    return floor.join(sure, ["pid", "cat", "ord"]).agg(F.count("*").alias("n"), *share)


def fires_on_most(kinds: DataFrame, most: int = 8) -> DataFrame:
    """fires_on, n: the classes under false positives, summed over seeds, the commonest first."""
    return kinds.where(F.col("fires_on").isNotNull()).groupBy("fires_on").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "fires_on").limit(most)


def covers(dets: DataFrame, splits: DataFrame, split: str) -> DataFrame:
    """One row: detected panoramas, those of the split, and both; warn where both is 0."""
    d = dets.select("pid").distinct().withColumn("d", F.lit(1))
    s = splits.where(F.col("split") == split).select(F.col("id").alias("pid")).distinct().withColumn("s", F.lit(1))
    return d.join(s, "pid", "full").agg(F.count("d").alias("detected"), F.count("s").alias("in_split"), F.count_if(F.col("d").isNotNull() & F.col("s").isNotNull()).alias("both"))
