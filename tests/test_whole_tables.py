"""Queries without SQL work on all panoramas."""

from conftest import SMALL, plain
from panolith.operators import metrics, splits
from panolith.plans import derive as D
from panolith.plans import queries_runs, queries_tiles


def test_bootstrap_takes_all_panoramas_and_a_thousand_replicas(spark):
    r = queries_runs.bootstrap_contrast(spark, SMALL).first()
    assert r.macro_low < r.macro_mean < r.macro_high and r.tail_low < r.tail_mean < r.tail_high
    first = queries_runs.bootstrap_replicas(spark, SMALL).agg({"macro": "avg"}).first()[0]  # the first 40 of them
    assert abs(r.macro_mean - first) < 0.01


def test_headlines_take_all_panoramas(spark):
    t = queries_runs.tiers(spark, SMALL)
    want = [tuple(metrics.headline(metrics.ap_by_size(D.detections(spark, SMALL, r), D.ground_truth(spark, SMALL), t), t).first()) for r in (0, 1)]
    got = sorted(queries_runs.headline_by_run(spark, SMALL).collect(), key=lambda r: r.seed)
    assert [plain(tuple(r)[:-1]) for r in got] == [plain(tuple(None if v is None else round(v, 6) for v in x)) for x in want]


def test_splits_take_the_objects_of_all_images(spark, monkeypatch):
    large = "/root/testdata/sf0.1"
    monkeypatch.setattr(splits, "make_splits", lambda h, images, o, *a, **k: None)
    _, o = queries_tiles._splits(spark, large)
    ids = {r.id for r in D.hashes(spark, large).select("id").collect()}
    pids = [r.pid for r in D.objects(spark, large).select("pid").collect()]
    assert max(ids) >= 500 and o.count() == sum(p in ids for p in pids)  # those of images that have a hash
