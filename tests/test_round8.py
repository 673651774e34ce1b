"""What the findings of round 8 asked for, small."""

import pathlib
import random

import pytest
from panolith import session
from panolith.operators import cells, detect, metrics, stats
from pyspark.sql import functions as F


def test_average_precision_has_no_frame_that_every_row_reads_to_its_end(spark):
    """Frames that end at the last row are read anew for each row: quadratic in the detections of one confidence."""
    rng = random.Random(5)
    rows = [(p, o, rng.choice([0.1, 0.5, 0.5, 0.9]), rng.random() < 0.6) for p in range(6) for o in range(40)]
    found = spark.createDataFrame([("a", *r) for r in rows], "k string, pid long, ord long, conf double, tp boolean")
    ap = metrics.average_precision(found, spark.createDataFrame([("a", 200), ("b", 0), ("c", 3)], "k string, n_gt long"), ["k"])
    assert "unboundedfollowing" not in ap._jdf.queryExecution().executedPlan().toString().lower()
    hits, curve = 0, []
    for i, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[1], r[0])), 1):
        hits += r[3]
        curve.append((hits / 200, hits / i))
    want = sum(max((p for x, p in curve if x >= t * 0.01), default=0) for t in range(101)) / 101
    assert {r.k: r.ap50 for r in ap.collect()} == {"a": pytest.approx(want), "b": None, "c": 0.0}


def test_what_the_bootstrap_writes_does_not_grow_with_the_replicas(spark, monkeypatch):
    """All but the APs themselves, that is."""
    write, sizes = session.spill, []

    def seen(df, tag):
        out, path = write(df, tag)
        if tag != "bootstrap-ap":
            sizes[-1] += sum(f.stat().st_size for f in pathlib.Path(path.removeprefix("file:")).glob("*.parquet"))
        return out, path

    monkeypatch.setattr(session, "spill", seen)
    gts = spark.range(600).select((F.col("id") % 120).alias("pid"), (F.col("id") % 2).alias("cat")).repartition(1)
    rows = gts.select(F.lit("t").alias("arm"), F.lit(0).alias("seed"), "pid", "cat", F.col("pid").alias("ord"), (F.col("pid") / 120).alias("conf"), (F.col("pid") % 3 == 0).alias("tp"))
    for replicas in (10, 400):
        sizes.append(0)
        assert stats.bootstrap_aps(rows, gts, replicas=replicas).count() == 2 * replicas
    assert 0 < sizes[1] < 1.2 * sizes[0]


@pytest.fixture
def written(spark, monkeypatch):
    """Rows of every table that is written, by its tag."""
    write, rows = session.spill, {}

    def seen(df, tag):
        out, path = write(df, tag)
        rows.setdefault(tag, []).append(out.count())
        return out, path

    monkeypatch.setattr(session, "spill", seen)
    return rows


def _stack(spark, n, **more):
    """Boxes in one place that all overlap, each its own twin's best."""
    at = spark.range(n).select(F.lit(0).cast("long").alias("pid"), F.lit(0).cast("long").alias("cat"), F.col("id").alias("ord"), (0.5 + F.col("id") * 0.0001).alias("cx"), F.lit(0.5).alias("cy"), F.lit(0.3).alias("w"), F.lit(0.3).alias("h"))
    return at.withColumns(more)


def test_a_crowd_is_matched_by_slices_of_the_detections(spark, monkeypatch, written):
    monkeypatch.setattr(cells, "UNIT_BOXES", 1)
    got = metrics.match(_stack(spark, 8, conf=F.col("ord") / 8), _stack(spark, 8)).collect()
    assert len(got) == 8 and all(r.gi == r.ord for r in got)
    assert max(written["match-told"]) < 8 * 8 / 2 and sum(written["match-told"]) < 8 * 8 * 0.7


def test_a_crowd_is_suppressed_by_what_is_kept_before(spark, monkeypatch, written):
    monkeypatch.setattr(cells, "UNIT_BOXES", 25)
    got = detect.nms(_stack(spark, 200, conf=F.col("ord") / 200))
    assert [r.ord for r in got.collect()] == [199]
    assert sum(written["nms-edges"]) < 200 * 200 / 2 / 10
