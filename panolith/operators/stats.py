"""Summaries over seeds, paired intervals and the panorama bootstrap."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panolith.functions import geometry as G
from panolith.operators.manifests import numbered
from panolith.operators.metrics import STEPS, average_precision, scored
from panolith.session import Scratch, arrow_batches, spill

#: Two-sided 95 % points of Student's t for 1 to 12 degrees of freedom, then the normal's.
T95 = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179)
Z95 = 1.96


def aggregate_runs(runs: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """n, mean and sample deviation of each value over seeds, to four decimals.

    Missing values are left out; one value has deviation 0, none has null for both.
    """
    out = [F.count("*").alias("n")]
    for v in values:
        x = F.when(~F.isnan(v), F.col(v))
        out += [F.round(F.avg(x), 4).alias(f"{v}_mean"), F.when(F.count(x) > 0, F.round(F.coalesce(F.stddev_samp(x), F.lit(0.0)), 4)).alias(f"{v}_std")]
    return runs.groupBy(by).agg(*out)


def t95(n: Column) -> Column:
    """The t factor for n values."""
    table = F.array(*map(F.lit, T95))
    return F.when((n >= 2) & (n <= len(T95) + 1), F.try_element_at(table, (n - 1).cast("int"))).otherwise(Z95)


def paired(treatment: DataFrame, baseline: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, seed, delta: differences on the seeds that both have."""
    a, b = treatment.select(*keys, "seed", F.col(value).alias("t")), baseline.select("seed", F.col(value).alias("b"))
    return a.join(b, "seed").where("t IS NOT NULL AND b IS NOT NULL AND NOT isnan(t) AND NOT isnan(b)").select(*keys, "seed", (F.col("t") - F.col("b")).alias("delta"))


def paired_ci(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """n, mean, low, high, median, n_positive; with one seed the interval is the mean itself."""
    n, mean = F.count("delta"), F.avg("delta")
    half = F.when(n > 1, t95(n) * F.stddev_samp("delta") / F.sqrt(n)).otherwise(0.0)
    return deltas.groupBy(keys).agg(n.alias("n"), mean.alias("mean"), (mean - half).alias("low"), (mean + half).alias("high"), F.median("delta").alias("median"), F.count_if(F.col("delta") > 0).alias("n_positive"))


def percentile(column: str, q: float) -> Column:
    """Exact, with linear interpolation between neighbours."""
    return F.percentile(column, F.lit(q))


BLOCK = 100  # replicas that are worked on side by side
PARTS = 4  # of the replicas, that take a class in different tasks
TILE = 1 << 18  # weights, or places of rows in replicas, that are worked on at once
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = np.uint64(0x9E3779B97F4A7C15)
SLOTS = 1 << 16  # drawn at once
PANORAMAS = 1 << 20  # counted in one task


def _mixed(z: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    z = (z ^ (z >> np.uint64(30))) * _MIX[0]
    z = (z ^ (z >> np.uint64(27))) * _MIX[1]
    return z ^ (z >> np.uint64(31))


def drawn(replica: np.ndarray, slots: np.ndarray, n: int, seed: int) -> np.ndarray:
    """(replicas, slots): which of ``n`` panoramas each slot of each replica draws, by hash."""
    own = _mixed(np.full(1, seed, np.uint64) * _STEP + replica.astype(np.uint64))
    return (_mixed(own[:, None] + slots.astype(np.uint64)[None, :] * _STEP) % np.uint64(n)).astype(np.int64)


def bootstrap_weights(pids: DataFrame, replicas: int, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """pid, block, w: how often each panorama is drawn in each replica of the block, a byte each.

    As many panoramas are drawn as there are, with replacement: slot s of replica b draws number
    hash(seed, b, s) mod n, whatever the partitioning. A task counts a block of replicas for a
    range of at most PANORAMAS panoramas, drawing slots a few at a time.
    """
    own = numbered(pids.distinct(), ["pid"], "i")
    n = own.count()
    spark = pids.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, lo in zip(*(c.to_pylist() for c in batch.columns)):
                replica = np.arange(b * block, min((b + 1) * block, replicas))
                hi = min(lo + PANORAMAS, n)
                counts = np.zeros((hi - lo) * block, np.uint32)
                for at in range(0, n, SLOTS):
                    i = drawn(replica, np.arange(at, min(at + SLOTS, n)), n, seed) - lo
                    lane = np.broadcast_to(np.arange(len(replica))[:, None], i.shape)
                    inside = (i >= 0) & (i < hi - lo)
                    counts += np.bincount(i[inside] * block + lane[inside], minlength=len(counts)).astype(np.uint32)
                if len(counts) and counts.max() > 255:
                    raise OverflowError("a panorama was drawn over 255 times in one replica")
                rows = counts.astype(np.uint8).reshape(hi - lo, block)
                for first in range(0, hi - lo, 10_000):
                    part = rows[first : first + 10_000]
                    values = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((np.arange(len(part) + 1) * block).astype(np.int32)), pa.py_buffer(part.tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo + first, lo + first + len(part))), pa.array(np.full(len(part), b)), values], names=["i", "block", "w"])

    blocks = -(-replicas // block)
    tasks = spark.range(blocks).crossJoin(spark.range(-(-n // PANORAMAS)).select((F.col("id") * PANORAMAS).alias("lo"))).select(F.col("id").alias("block"), "lo")
    counted = tasks.repartition(max(1, min(blocks * -(-n // PANORAMAS), 4096)), "block", "lo").mapInArrow(run, "i long, block long, w binary")
    # Sizes are guessed from the few rows that go into the kernel: unhinted, all weights would be broadcast.
    return counted.hint("merge").join(own, "i").select("pid", "block", "w")


def _packed(dtype: str):
    """cat, arm, seed, conf, ord, pid (of the first row), data from sorted rows (.., code): the codes of rows
    of one class and run that follow each other in a batch, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).fill_null(x) for c, x in ((0, 0), (1, ""), (2, 0))]
            codes = [keys[0].to_numpy(), keys[1].dictionary_encode().indices.to_numpy(zero_copy_only=False), keys[2].to_numpy(), batch.column(1).is_null().to_numpy(zero_copy_only=False)]
            begin = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in codes], axis=0)]))
            code = batch.column(6).to_numpy().astype(dtype)
            first = batch.take(pa.array(begin))
            data = [code[lo:hi].tobytes() for lo, hi in zip(begin, [*begin[1:], batch.num_rows])]
            yield pa.RecordBatch.from_arrays([*first.columns[:6], pa.array(data, pa.binary())], names=["cat", "arm", "seed", "conf", "ord", "pid", "data"])

    return run


def replica_weights(replicas: np.ndarray, n: int, seed: int) -> np.ndarray:
    """(replicas, panoramas): how often each of ``n`` panoramas is drawn in each replica."""
    at = np.empty((len(replicas), n), np.int64)
    for lo in range(0, n, SLOTS):
        at[:, lo : lo + SLOTS] = drawn(replicas, np.arange(lo, min(lo + SLOTS, n)), n, seed)
    at += np.arange(len(replicas))[:, None] * n
    counts = np.bincount(at.ravel(), minlength=at.size).reshape(at.shape)
    return counts.astype(np.min_scalar_type(counts.max(initial=0)))


def _aps(codes: np.ndarray, weights: np.ndarray, n_gt: np.ndarray) -> np.ndarray:
    """The AP of detections by falling confidence (code: panorama * 2 + tp) in each replica; nan without objects.

    Hits never fall along the rows, so the rows at or beyond a recall are those from some place on;
    precision rises at hits alone, so that other rows take nothing away from its maximum.
    """
    lanes = np.arange(len(weights))[:, None]
    steps = np.arange(STEPS) * 0.01
    some = np.maximum(n_gt, 1)[:, None]
    need = np.maximum(np.floor(steps * some).astype(np.int64) - 1, 0)
    for _ in range(3):  # the least number of hits at each recall, as the division rounds
        need += need / some < steps
    far = int(max(need.max(), len(codes) * int(weights.max(initial=0)))) + 1
    best, hits, seen = np.zeros(need.shape), np.zeros((len(weights), 1), np.int64), np.zeros((len(weights), 1), np.int64)
    tile = max(1, TILE // len(weights))
    for lo in range(0, len(codes), tile):
        part = codes[lo : lo + tile]
        drawn_ = np.take(weights, part >> 1, axis=1)
        all_ = np.cumsum(drawn_, axis=1, dtype=np.int64) + seen
        h = np.cumsum(drawn_ * (part & 1).astype(weights.dtype), axis=1, dtype=np.int64) + hits
        precision = np.zeros((len(weights), len(part) + 1))
        np.divide(h, np.maximum(all_, 1), out=precision[:, :-1])
        place = np.searchsorted((h + lanes * far).ravel(), need + lanes * far) - lanes * len(part)
        place[:, 0] = 0
        best = np.maximum(best, np.maximum.reduceat(precision.ravel(), (place + lanes * (len(part) + 1)).ravel()).reshape(best.shape))
        hits, seen = h[:, -1:], all_[:, -1:]
    beyond = np.maximum.accumulate(best[:, ::-1], axis=1)
    return np.where(n_gt > 0, beyond.sum(axis=1) / STEPS, np.nan)


def _replica_ap(runs: list[tuple], replicas: int, parts: int, n: int, seed: int, dtype: str):
    """arm, seed, cat, first (replica), ap (of each replica from there on) from a partition's packed codes, sorted
    by class and part of the replicas, in these the objects first and then each run's detections by falling confidence.

    Codes of a class wait in a temporary file; weights are drawn again for each class, a few replicas
    at a time, and are never written or sent.
    """

    def of_class(cat: int, part: int, file, ends: dict[tuple, tuple]) -> Iterator[pa.RecordBatch]:
        file.flush()
        codes = np.memmap(file, dtype, "r")
        objects = codes[slice(*ends[(None, None)])]
        last = (part + 1) * replicas // parts
        side = max(1, TILE // n)
        for lo in range(part * replicas // parts, last, side):
            weights = replica_weights(np.arange(lo, min(lo + side, last)), n, seed)
            n_gt = np.zeros(len(weights), np.int64)
            tile = max(1, TILE // len(weights))
            for at in range(0, len(objects), tile):
                n_gt += np.take(weights, objects[at : at + tile] >> 1, axis=1).sum(axis=1, dtype=np.int64)
            aps = [list(_aps(codes[slice(*ends.get(r, (0, 0)))], weights, n_gt)) for r in runs]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in (([r[0] for r in runs], pa.string()), ([r[1] for r in runs], pa.int64()), ([cat] * len(runs), pa.int64()), ([lo] * len(runs), pa.int64()), (aps, pa.list_(pa.float64())))], names=["arm", "seed", "cat", "first", "ap"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, file, ends, at = None, None, {}, 0
        for batch in batches:
            for cat, part, arm, s, data in zip(*(batch.column(c).to_pylist() for c in ("cat", "part", "arm", "seed")), batch.column("data")):
                if (cat, part) != group:
                    if group is not None:
                        yield from of_class(*group, file, ends)
                        file.close()
                    group, file, ends, at = (cat, part), tempfile.TemporaryFile(), {}, 0
                got = file.write(data.as_buffer()) // np.dtype(dtype).itemsize
                ends[arm, s] = (ends.get((arm, s), (at,))[0], at + got)
                at += got
        if group is not None:
            yield from of_class(*group, file, ends)
            file.close()

    return run


def bootstrap_aps(rows: DataFrame, gts: DataFrame, replicas: int = 1000, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """arm, seed, cat, replica, ap50 (null without objects): every run's AP in every replica.

    ``rows`` (arm, seed, pid, cat, ord, conf, tp) are matched once: matches never cross
    panoramas, so a replica only weighs rows. Rows and objects get their panorama's number, are sorted once
    and packed to a few bytes each; a task takes a class for a part of the replicas (``block`` of
    them or more, PARTS parts at most), draws the weights by itself and adds up hits. What is shuffled
    grows with the rows and not with rows times replicas.
    """
    spark = gts.sparkSession
    with Scratch(spark) as held:
        own = held(numbered(gts.select("pid").distinct(), ["pid"], "i"), "bootstrap-panoramas")
        n = own.count()
        cat, none = F.col("cat").cast("long").alias("cat"), F.lit(None)
        objects = held(gts.select("pid", cat).join(own.hint("merge"), "pid").select("cat", none.cast("string").alias("arm"), none.cast("long").alias("seed"), none.cast("double").alias("conf"), F.col("i").alias("ord"), "pid", (F.col("i") * 2).alias("code")), "bootstrap-objects")
        runs = [tuple(r) for r in rows.select("arm", F.col("seed").cast("long")).distinct().collect()]  # a row for each run
        known = rows.select("arm", F.col("seed").cast("long").alias("seed"), cat, "conf", "ord", "pid", "tp").join(F.broadcast(objects.select("cat").distinct()), "cat", "left_semi")
        found = held(known.join(own.hint("merge"), "pid").select("cat", "arm", "seed", "conf", "ord", "pid", (F.col("i") * 2 + F.col("tp").cast("long")).alias("code")), "bootstrap-found")
        order = ["cat", "arm", "seed", F.desc("conf"), "ord", "pid"]
        dtype = "<i4" if n < 1 << 30 else "<i8"
        schema = "cat long, arm string, seed long, conf double, ord long, pid long, data binary"
        packed = held(objects.unionByName(found).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_packed(dtype), schema), "bootstrap-packed")
        parts = min(PARTS, -(-replicas // block))
        tasks = min(2 * parts * max(1, packed.select("cat").distinct().count()), 400)  # by number: few bytes are much work here
        dealt = packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(tasks, "cat", "part").sortWithinPartitions("cat", "part", *order[1:])
        ap = dealt.select("cat", "part", "arm", "seed", "data").mapInArrow(_replica_ap(runs, replicas, parts, n, seed, dtype), "arm string, seed long, cat long, first long, ap array<double>")
        flat = ap.select("arm", "seed", "cat", "first", F.posexplode("ap").alias("lane", "ap50"))
        out = flat.select("arm", "seed", "cat", (F.col("first") + F.col("lane")).alias("replica"), F.when(~F.isnan("ap50"), F.col("ap50")).alias("ap50"))
        with arrow_batches(spark, 256):
            return held.result(out, "bootstrap-ap")


def bootstrap_deltas(treatment: DataFrame, baseline: DataFrame, gts: DataFrame, tail: list[int] | None = None, replicas: int = 200, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """replica, macro (and tail): the difference in macro AP of each replica, means over seeds.

    Runs (pid, cat, seed, ord, conf, box) resampled by panorama; several metrics come from one
    pass. A class without objects in a replica is left out, a run without any counts as 0.
    """
    truth_rows = gts.select("pid", "cat", "ord", "cx", "cy", "w", "h")
    with Scratch(gts.sparkSession) as held:
        runs = []
        for arm, frame in (("t", treatment), ("b", baseline)):
            for s in [r[0] for r in frame.select("seed").distinct().orderBy("seed").collect()]:
                matched = scored(frame.where(F.col("seed") == s), truth_rows)
                runs.append(held(matched.select(F.lit(arm).alias("arm"), F.lit(s).cast("long").alias("seed"), "pid", "cat", "ord", "conf", "tp"), "bootstrap-rows"))
        rows = runs[0]
        for r in runs[1:]:
            rows = rows.unionByName(r)
        ap = bootstrap_aps(rows, gts, replicas, seed, block)
    metrics = {"macro": F.avg("ap50")} | ({"tail": F.avg(F.when(F.col("cat").isin(*tail), F.col("ap50")))} if tail else {})
    per_run = ap.groupBy("arm", "seed", "replica").agg(*[m.alias(k) for k, m in metrics.items()])
    side = lambda arm, k: F.avg(F.when(F.col("arm") == arm, F.coalesce(k, F.lit(0.0))))
    return per_run.groupBy("replica").agg(*[(side("t", k) - side("b", k)).alias(k) for k in metrics])


def bootstrap_delta(treatment: DataFrame, baseline: DataFrame, gts: DataFrame, tail: list[int] | None = None, replicas: int = 200, seed: int = 0, level: float = 0.95, block: int = BLOCK) -> DataFrame:
    """One row: mean, low and high of the difference in macro AP (and over ``tail`` classes) over replicas."""
    per = bootstrap_deltas(treatment, baseline, gts, tail, replicas, seed, block)
    edge = (1 - level) / 2
    return per.agg(*[x.alias(f"{k}_{n}") for k in per.columns[1:] for n, x in (("mean", F.avg(k)), ("low", percentile(k, edge)), ("high", percentile(k, 1 - edge)))])


def class_report(report: DataFrame, baseline: str) -> DataFrame:
    """cat, ap of the baseline arm, best other arm, its ap and the gain, means over seeds."""
    per = report.groupBy("cat", "arm").agg(F.avg(F.when(~F.isnan("ap50"), F.col("ap50"))).alias("ap"))
    base = per.where(F.col("arm") == baseline).select("cat", F.col("ap").alias("base_ap"))
    best = per.where(F.col("arm") != baseline).groupBy("cat").agg(F.min_by("arm", F.struct(-F.coalesce("ap", F.lit(-1.0)), F.col("arm"))).alias("best_arm"), F.max("ap").alias("best_ap"))
    return base.join(best, "cat").withColumn("gain", F.col("best_ap") - F.col("base_ap"))


def area_bucket_ap(dets: DataFrame, gts: DataFrame, size: int = G.PANORAMA) -> DataFrame:
    """AP of each size bucket over all classes at once."""
    rows = scored(dets, gts, size=size)
    truth, _ = spill(gts.groupBy(G.size_bucket(G.px_area("w", "h", size)).alias("bucket")).agg(F.count("*").alias("n_gt")), "truth")
    return average_precision(rows, truth, ["bucket"])


def class_pivot(report: DataFrame, baseline: str, arms: list[str]) -> DataFrame:
    """cat, a column of mean AP over seeds for each arm, best (of the arms but the baseline; the
    first named wins ties, an absent AP counts as -1) and its gain over the baseline."""
    ap = F.avg(F.when(~F.isnan("ap50"), F.col("ap50")))
    wide = report.groupBy("cat").pivot("arm", arms).agg(ap)
    content = [a for a in arms if a != baseline]
    top = F.greatest(*[F.coalesce(a, F.lit(-1.0)) for a in content]) if len(content) > 1 else F.coalesce(content[0], F.lit(-1.0))
    best = F.coalesce(*[F.when(F.coalesce(a, F.lit(-1.0)) == top, F.lit(a)) for a in content])
    return wide.withColumn("best", best).withColumn("gain", F.nullif(top, F.lit(-1.0)) - F.col(baseline))


def tail_wins(pivot: DataFrame, tail: DataFrame) -> DataFrame:
    """best, n, improved: in how many tail classes each arm is best, and in how many of them it gains."""
    own = pivot.join(F.broadcast(tail.select(F.col("id").cast("long").alias("cat"))), "cat", "left_semi")
    return own.groupBy("best").agg(F.count("*").alias("n"), F.count_if(F.col("gain") > 0).alias("improved"))


def allocation_report(allocation: DataFrame, subset: DataFrame, counts: DataFrame) -> DataFrame:
    """class_id, name, tier, real, synthetic, total of each class, by its real instances."""
    joined = allocation.join(F.broadcast(subset.select(F.col("id").alias("class_id"), "name", "tier")), "class_id").join(counts, "class_id", "left")
    real = F.coalesce("train_count", F.lit(0)).cast("long")
    return joined.select("class_id", "name", "tier", real.alias("real"), F.col("alloc").alias("synthetic"), (real + F.col("alloc")).alias("total"))


def mean_by(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The mean of a score (such as structural similarity) at each strength."""
    return rows.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
