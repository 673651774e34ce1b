"""What the findings of round 3 asked for, small."""

import random

import pytest

from panolith.operators import cells, detect, diagnose, metrics
from panolith.plans import derive as D
from panolith.plans import queries_detect, queries_files
from panolith.sources import readers
from test_domain import DET, _iou, _one_after_another

GT = "pid long, cat long, ord long, cx double, cy double, w double, h double"


def _boxes(seed=4):
    rng = random.Random(seed)
    box = lambda: (rng.uniform(-0.02, 1.02), rng.uniform(0.4, 0.6), rng.choice([0.05, 0.08, 0.3]), rng.choice([0.05, 0.08, 0.2]))
    gts = [(p, c, i, *box()) for p in range(2) for c in range(2) for i in range(40)]
    dets = [(p, c, 100 + i, rng.randrange(6) / 5, *box()) for p in range(2) for c in range(2) for i in range(80)]
    return gts, dets + [(0, 0, 990, 0.5, float("nan"), 0.5, 0.1, 0.1), (0, 0, 991, 0.5, 0.5, 0.5, 0.0, 0.1)]


@pytest.mark.parametrize("least,parts", [(0.5, 1), (0.3, 1), (0.3, 4), (0.6, 4)])
def test_boxes_are_dealt_once_and_no_pair_is_missed(spark, least, parts):
    gts, dets = _boxes()
    with cells.dealt_once(spark):
        met = cells.meet(spark.createDataFrame(dets, DET), spark.createDataFrame(gts, GT), least, parts)
        plan = met._jdf.queryExecution().executedPlan().toString()
        rows = met.collect()
    assert plan.count("Exchange ") == 2  # one for each side
    want = {(*d[:3], g[1], g[2]) for d in dets for g in gts if d[0] == g[0] and _iou(d[4:], g[3:]) >= least}
    got = [(r.pid, r.cat, r.ord, r.b.cat, r.b.ord) for r in rows if r.iou is not None]
    assert sorted(got) == sorted(want) and want
    assert {(r.pid, r.cat, r.ord) for r in rows} == {d[:3] for d in dets}  # those without a pair stay


@pytest.mark.parametrize("last", [False, True])
def test_dealt_panoramas_match_as_one_after_another(spark, monkeypatch, last):
    monkeypatch.setattr(cells, "UNIT_BOXES", 10)
    gts, dets = _boxes(7)
    d, g = spark.createDataFrame(dets, DET), spark.createDataFrame(gts, GT)
    got = {(r.pid, r.cat, r.ord): r.gi for r in metrics.match(d, g, last=last).collect()}
    real = [x for x in dets if x[2] < 990]
    want = _one_after_another(real, gts, last)
    assert got == {**want, (0, 0, 990): None, (0, 0, 991): None}
    told = {(r.pid, r.cat, r.ord): r.outcome for r in diagnose.classify_objects(g, d).collect()}
    hits = {(p, c, o) for (p, c, _), o in want.items() if o is not None}
    assert len(told) == len(gts) and all(told[k] == "HIT" for k in hits)


def test_crowded_panoramas_are_the_orders_remainders(spark, tmp_path):
    spark.createDataFrame([(7, 1_190_000, 59_000, 7, 3.0)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [r.pid for r in D.ground_truth(spark, str(tmp_path), queries_detect.CROWD).collect()] == [7]


def test_dealt_panoramas_suppress_as_one_after_another(spark, monkeypatch):
    monkeypatch.setattr(cells, "UNIT_BOXES", 10)
    dets = [x for x in _boxes(9)[1] if x[2] < 990]
    kept = []
    for x in sorted(dets, key=lambda x: (-x[3], x[2])):
        if all(x[:2] != k[:2] or _iou(x[4:], k[4:]) < 0.5 for k in kept):
            kept.append(x)
    got = detect.nms(spark.createDataFrame(dets, DET)).collect()
    assert sorted((r.pid, r.cat, r.ord) for r in got) == sorted(x[:3] for x in kept) and len(kept) < len(dets)


@pytest.mark.parametrize("name,reader", [("scanned_annotations", "annotations"), ("scanned_coco", "coco")])
def test_nested_files_grow_in_number(spark, monkeypatch, name, reader):
    seen, read = [], getattr(readers, reader)
    monkeypatch.setattr(readers, reader, lambda s, path: seen.append(path) or read(s, path))
    getattr(queries_files, name)(spark, "/root/testdata/sf0.1")
    files = spark.read.text(seen[0]).select("_metadata.file_path").distinct().count()
    assert files == -(-10_000 // queries_files.PER_FILE)
