"""Generation in rounds: only what a scan rejects is made again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panolith.operators.cells import outside
from panolith.session import Scratch

COUNTERS = ("tiles", "attempts", "regenerated", "rejected", "scan_fired", "scan_detections")


def retry_rounds(items: DataFrame, kept: DataFrame, make: Callable[[DataFrame, int], DataFrame], scan: Callable[[DataFrame, int], DataFrame], key: str = "tile", tries: int = 3) -> tuple[DataFrame, dict[str, int]]:
    """What ``make`` gives for each item, with ``tries``; and the telemetry of the scan.

    ``items`` have one row for each ``key``. ``make(pending, attempt)`` adds what is made, and
    ``scan(made, attempt)`` gives the detections on it (key, cx, cy); both are frames to frames, so
    that a model runs wherever they put it. A detection whose centre is in no ``kept`` box
    (key, x1, y1, x2, y2, bounds included) is a hallucination: the item comes again, ``tries``
    times at most, and is left out after that. Each round is a table, and reads no item that
    passed before. ``scan_detections`` above 0 shows that the scanner is alive.
    """
    counters = dict.fromkeys(COUNTERS, 0)
    boxes = kept.withColumnRenamed(key, "pid")
    with Scratch(items.sparkSession) as held:
        pending, done = held(items, "retry-items"), None
        waiting = counters["tiles"] = pending.count()
        for attempt in range(tries):
            made = held(make(pending, attempt), "retry-made")
            seen = held(scan(made, attempt).select(F.col(key).alias("pid"), "cx", "cy"), "retry-seen")
            wrong = held(outside(seen, boxes).select(F.col("pid").alias(key)).distinct(), "retry-wrong")
            sound = made.join(wrong, key, "left_anti").withColumn("tries", F.lit(attempt + 1))
            done = sound if done is None else done.unionByName(sound)
            again = pending.join(wrong, key, "left_semi")
            fired = again.count()
            counters["attempts"] += waiting
            counters["scan_detections"] += seen.count()
            counters["scan_fired"] += fired
            counters["regenerated"] += waiting - fired if attempt else 0
            waiting = fired
            if not waiting:
                break
            pending = held(again, "retry-items")
        counters["rejected"] = waiting
        return held.result(done, "retried"), counters


def carried(before: dict[str, int] | None, now: dict[str, int]) -> dict[str, int]:
    """Counters of a resumed run on top of those of the runs before it."""
    return {k: int((before or {}).get(k, 0)) + v for k, v in now.items()}
