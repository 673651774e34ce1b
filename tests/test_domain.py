"""Hand-computed expectations on small inputs."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panolith.functions import geometry as G
from panolith.functions import names as N
from panolith.operators import allocation, detect, diagnose, metrics, quantiles, runs, splits, stats, subset, tiling
from panolith.session import Scratch


def one(df):
    return df.first()


def test_boxes(spark):
    r = one(spark.range(1).select(G.xyxy_to_yolo(F.lit(0.0), F.lit(20.0), F.lit(20.0), F.lit(40.0), F.lit(100), F.lit(100)).alias("b"))).b
    assert tuple(r) == pytest.approx((0.1, 0.3, 0.2, 0.2))
    with pytest.raises(Exception, match="extent"):
        spark.range(1).select(G.xyxy_to_yolo(*[F.lit(1.0)] * 4, F.lit(0), F.lit(1)).alias("b")).collect()
    odd = spark.createDataFrame([((None,) * 8,)], "b struct<xmin:double,ymin:double,xmax:double,ymax:double,x:double,y:double,w:double,h:double>")
    with pytest.raises(Exception, match="box form"):
        odd.select(G.parse_bbox(F.col("b"))).collect()


def test_grid():
    assert len(G.tile_grid(2048, 2048)) == 16
    assert G.offsets(2048) == [0, 512, 1024, 1408]
    assert G.offsets(600) == [0]
    assert G.offsets(1152) == [0, 512]
    with pytest.raises(ValueError):
        G.offsets(2048, 640, 640)


def test_sizes_at_the_border(spark):
    r = one(spark.range(1).select(G.size_bucket(F.lit(9216)).alias("bucket"), G.size_bin(F.lit(9216)).alias("bin"), G.size_bucket(F.lit(1024)).alias("low")))
    assert (r.bucket, r.bin, r.low) == ("large", "medium", "medium")


def test_names(spark):
    r = one(spark.range(1).select(N.budget_tag(F.lit(0.5)).alias("t"), N.parse_run_dir(F.lit("copy_paste_bm050_seed7_smoke")).alias("p"), N.parse_run_dir(F.lit("no run")).alias("q"), N.sign_shape(F.lit("il80")).alias("s"), N.duration(F.lit(75)).alias("d"), N.sha1_mod_1000(F.lit("a")).alias("m")))
    assert r.t == "bm050" and tuple(r.p) == ("copy_paste", "bm050", 7, True) and r.q is None and r.s == "circle" and r.d == "1m15s" and r.m == 152
    with pytest.raises(Exception, match="range"):
        spark.range(1).select(N.budget_tag(F.lit(10.0))).collect()


def counts(spark, n):
    return spark.createDataFrame([(f"c{i:02d}", v) for i, v in enumerate(n)], "name string, instances long")


def test_pick_evenly_and_bands(spark):
    got = subset.select_subset(counts(spark, range(1000, 1000 - 14 * 10, -10)), 9, 80).orderBy("id").collect()
    assert [r.tier for r in got] == ["head"] * 3 + ["mid"] * 3 + ["tail"] * 3
    assert [r.name for r in got[:3]] == ["c00", "c02", "c04"]
    assert [r.id for r in got] == list(range(9))
    with pytest.raises(Exception, match="three"):
        subset.select_subset(counts(spark, [100, 90]), 9, 80).collect()


@pytest.mark.parametrize(
    ("n", "b", "alpha", "g_max", "want"),
    [({0: 100, 1: 10, 2: 50}, 80, None, None, {0: 0, 1: 60, 2: 20}), ({0: 100, 1: 10, 2: 50}, 80, 3.0, None, {0: 0, 1: 30, 2: 50}), ({0: 10, 1: 10}, 100, 2.0, None, {0: 20, 1: 20}), ({0: 5, 1: 5}, 100, None, 8, {0: 8, 1: 8}), ({0: 5}, 0, None, None, {0: 0}), ({0: 5, 1: 0}, 3, 3.0, None, {0: 3, 1: 0}), ({0: 1, 1: 1, 2: 1}, 4, None, None, {0: 2, 1: 1, 2: 1})],
)
def test_water_fill(spark, n, b, alpha, g_max, want):
    c = spark.createDataFrame(list(n.items()), "class_id long, train_count long")
    got = allocation.water_fill(c, spark.createDataFrame([(b,)], "budget long"), alpha, g_max)
    assert {r.class_id: r.alloc for r in got.collect()} == want


def test_water_fill_against_one_by_one(spark):
    import random

    rng = random.Random(3)
    for _ in range(4):
        n = {c: rng.randint(0, 30) for c in range(6)}
        b, alpha = rng.randint(1, 80), rng.choice([0.5, 1.5, 3.0])
        got = dict.fromkeys(n, 0)
        for _ in range(b):
            able = [c for c in n if got[c] < int(alpha * n[c])]
            if not able:
                break
            got[min(able, key=lambda c: (n[c] + got[c], c))] += 1
        c = spark.createDataFrame(list(n.items()), "class_id long, train_count long")
        assert {r.class_id: r.alloc for r in allocation.water_fill(c, spark.createDataFrame([(b,)], "budget long"), alpha).collect()} == got


def test_groups_are_transitive(spark):
    h = spark.createDataFrame([(1, 0), (2, 1), (3, 3), (9, 255)], "id long, hash long")
    assert {r.id: r.group_id for r in splits.build_groups(h, 1).collect()} == {1: 1, 2: 1, 3: 1, 9: 9}


def test_leaks(spark):
    bad = spark.createDataFrame([(1, 1, "train"), (1, 1, "test"), (2, 1, "train")], "id long, group_id long, split string")
    with pytest.raises(ValueError):
        splits.assert_no_leak(bad)
    splits.assert_no_leak(bad.limit(0))


def test_impossible_support(spark):
    groups = spark.createDataFrame([(i, i) for i in range(4)], "id long, group_id long")
    objects = spark.createDataFrame([(0, "A")], "pid long, name string")
    with pytest.raises(ValueError):
        splits.assign_groups(groups, objects, spark.createDataFrame([("A",)], "name string"), min_test=5)


def test_object_in_tile(spark):
    o = spark.createDataFrame([(1, "A", 700.0, 700.0, 740.0, 740.0), (1, "Z", 800.0, 800.0, 900.0, 900.0)], "pid long, name string, x1 double, y1 double, x2 double, y2 double")
    s = spark.createDataFrame([("A", 0, "tail")], "name string, id int, tier string")
    rows = {(r.kind, r.x_off, r.y_off): r for r in tiling.tile_objects(o, s).collect()}
    label = rows["label", 512, 512]
    assert (label.cx, label.cy, label.w, label.h) == pytest.approx((0.325, 0.325, 0.0625, 0.0625))
    z = rows["ignore", 512, 512]
    assert (z.ix1, z.iy1, z.ix2, z.iy2) == (288, 288, 388, 388)


DET = "pid long, cat long, ord long, conf double, cx double, cy double, w double, h double"


def test_seam_is_one_detection(spark):
    d = spark.createDataFrame([(1, 0, 1, 0.9, 0.1, 0.5, 0.05, 0.05, 1024, 512), (1, 0, 2, 0.7, 0.9, 0.5, 0.05, 0.05, 512, 512)], DET + ", x_off int, y_off int")
    none = spark.createDataFrame([], "pid long, x1 double, y1 double, x2 double, y2 double, x_off int, y_off int")
    got = detect.reconstruct(d, none).collect()
    assert len(got) == 1 and got[0].conf == 0.9
    over = spark.createDataFrame([(1, 50.0, 300.0, 80.0, 340.0, 1024, 512)], none.schema)
    assert detect.reconstruct(d, over).count() == 0


def test_ap_perfect_missed_and_absent(spark):
    g = spark.createDataFrame([(1, 0, 1, 0.2, 0.2, 0.05, 0.05), (1, 1, 2, 0.7, 0.7, 0.05, 0.05)], "pid long, cat long, ord long, cx double, cy double, w double, h double")
    d = spark.createDataFrame([(1, 0, 1, 0.9, 0.2, 0.2, 0.05, 0.05)], DET)
    s = spark.createDataFrame([(0, "head"), (1, "tail"), (2, "tail")], "id long, tier string")
    r = metrics.ap_by_size(d, g, s)
    ap = {(x.cat, x.bucket): x.ap50 for x in r.collect()}
    assert ap[0, "all"] == pytest.approx(1.0) and ap[1, "all"] == 0.0 and ap[2, "all"] is None
    h = metrics.headline(r, s).first()
    assert h.ap_tail == 0.0 and h.ap_macro == pytest.approx(0.5)


def test_outcomes(spark):
    g = spark.createDataFrame([(1, 0, 1, 0.2, 0.2, 0.1, 0.1), (1, 0, 2, 0.5, 0.5, 0.1, 0.1), (1, 0, 3, 0.8, 0.8, 0.1, 0.1), (1, 0, 4, 0.2, 0.8, 0.1, 0.1)], "pid long, cat long, ord long, cx double, cy double, w double, h double")
    d = spark.createDataFrame([(1, 0, 1, 0.9, 0.2, 0.2, 0.1, 0.1), (1, 5, 2, 0.9, 0.5, 0.5, 0.1, 0.1), (1, 0, 3, 0.9, 0.85, 0.8, 0.1, 0.1)], DET)
    got = {r.ord: (r.outcome, r.confused) for r in diagnose.classify_objects(g, d).collect()}
    assert got == {1: ("HIT", None), 2: ("CLS", 5), 3: ("LOC", None), 4: ("MISS", None)}


def test_intervals(spark):
    d = spark.createDataFrame([("a", 0, 0.1), ("a", 1, 0.3), ("b", 0, 0.2)], "arm string, seed int, delta double")
    got = {r.arm: r for r in stats.paired_ci(d, ["arm"]).collect()}
    assert got["a"].mean == pytest.approx(0.2) and got["a"].high - got["a"].mean == pytest.approx(12.706 * 0.1)
    assert got["b"].low == got["b"].high == 0.2
    s = stats.aggregate_runs(spark.createDataFrame([("x", 0.2), ("x", 0.4), ("y", 0.5)], "arm string, ap double"), ["arm"], ["ap"])
    assert {r.arm: (r.ap_mean, r.ap_std) for r in s.collect()} == {"x": (0.3, 0.1414), "y": (0.5, 0.0)}
    q = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (5.0,)], "v double")
    assert [r[0] for x in (0.025, 0.5, 0.95) for r in q.agg(stats.percentile("v", x)).collect()] == pytest.approx([0.075, 1.5, 4.55])


def test_bootstrap_clear_win(spark):
    g = spark.createDataFrame([(p, 0, p, 0.5, 0.5, 0.1, 0.1) for p in range(4)], "pid long, cat long, ord long, cx double, cy double, w double, h double")
    t = spark.createDataFrame([(p, 0, p, 0.9, 0.5, 0.5, 0.1, 0.1, 0) for p in range(4)], DET + ", seed int")
    b = spark.createDataFrame([(0, 0, 9, 0.9, 0.1, 0.1, 0.05, 0.05, 0)], DET + ", seed int")
    r = stats.bootstrap_delta(t, b, g, replicas=10).first()
    assert (r.macro_low, r.macro_high) == pytest.approx((1.0, 1.0))


def test_bootstrap_against_brute_force(spark):
    rng = random.Random(3)
    rows = [("t", s, rng.randrange(9), c, i, rng.choice([0.2, 0.5, 0.5, 0.9, rng.random()]), rng.random() < 0.6) for s in (0, 1) for c in (0, 1, 5) for i in range(40)]
    objects = [(p, c) for p in range(7) for c in (0, 0, 1, 2) if rng.random() < 0.7]
    replicas, seed = 7, 11
    got = {(r.seed, r.cat, r.replica): r.ap50 for r in stats.bootstrap_aps(spark.createDataFrame(rows, "arm string, seed int, pid long, cat long, ord long, conf double, tp boolean"), spark.createDataFrame(objects, "pid long, cat long"), replicas, seed, block=3).collect()}
    pids = sorted({p for p, _ in objects})
    want = {}
    for b in range(replicas):
        sample = [pids[i] for i in stats.drawn(np.array([b]), np.arange(len(pids)), len(pids), seed)[0]]
        for s in (0, 1):
            for c in sorted({c for _, c in objects}):
                n = sum(sample.count(p) for p, k in objects if k == c)
                own = sorted(((-x[5], x[4], x[2], x[6]) for x in rows if x[1] == s and x[3] == c for _ in range(sample.count(x[2]))))
                curve, hits = [], 0
                for i, x in enumerate(own, 1):
                    hits += x[3]
                    curve.append((hits / n if n else 0, hits / i))
                want[s, c, b] = sum(max((p for r, p in curve if r >= t * 0.01), default=0) for t in range(101)) / 101 if n else None
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    drawn = stats.drawn(np.arange(50), np.arange(200), 10, 1)
    assert np.bincount(drawn.ravel(), minlength=10).min() > 800  # of 1,000 expected


def _one_after_another(dets, gts, last):
    out = {}
    for d in sorted(dets, key=lambda x: (-x[3], x[2])):
        taken = {g for (p, c, _), g in out.items() if (p, c) == d[:2]}
        scored = [(-_iou(d[4:], g[3:]), -g[2] if last else g[2], g[2]) for g in gts if g[:2] == d[:2] and g[2] not in taken and _iou(d[4:], g[3:]) >= 0.5]
        out[d[:3]] = min(scored)[2] if scored else None
    return out


def _iou(a, b):
    w = min(a[0] + a[2] / 2, b[0] + b[2] / 2) - max(a[0] - a[2] / 2, b[0] - b[2] / 2)
    h = min(a[1] + a[3] / 2, b[1] + b[3] / 2) - max(a[1] - a[3] / 2, b[1] - b[3] / 2)
    inter = max(w, 0) * max(h, 0)
    return inter / (a[2] * a[3] + b[2] * b[3] - inter)


@pytest.mark.parametrize("last", [False, True])
def test_crowds_match_and_suppress_as_one_after_another(spark, last):
    rng = random.Random(8)
    box = lambda: (0.5 + rng.randrange(12) / 100, 0.5 + rng.randrange(12) / 100, 0.1, 0.1)
    gts = [(p, c, i, *box()) for p in range(2) for c in range(2) for i in range(25)]
    dets = [(p, c, 100 + i, rng.randrange(6) / 5, *box()) for p in range(2) for c in range(2) for i in range(60)]
    d, g = spark.createDataFrame(dets, DET), spark.createDataFrame(gts, "pid long, cat long, ord long, cx double, cy double, w double, h double")
    got = {(r.pid, r.cat, r.ord): r.gi for r in metrics.match(d, g, last=last).collect()}
    assert got == _one_after_another(dets, gts, last) and len({v for v in got.values() if v is not None}) > 20
    kept = []
    for x in sorted(dets, key=lambda x: (-x[3], x[2])):
        if all(x[:2] != k[:2] or _iou(x[4:], k[4:]) < 0.5 for k in kept):
            kept.append(x)
    assert sorted((r.pid, r.cat, r.ord) for r in detect.nms(d).collect()) == sorted(x[:3] for x in kept)
    twice = metrics.match(spark.createDataFrame([dets[0]] * 2 + [(None, 0, 1, 0.5, 0.5, 0.5, 0.1, 0.1)], DET), spark.createDataFrame([(*dets[0][:2], 7, *dets[0][4:])], g.schema)).collect()
    assert sorted((r.gi is None for r in twice)) == [False, True, True]  # one of two equal rows, none without a panorama


@pytest.mark.parametrize("hot", [1024, 3])
def test_hash_links_against_all_pairs(spark, hot):
    rng = random.Random(2)
    base = [rng.getrandbits(63) for _ in range(6)]
    rows = [(i, rng.choice(base) ^ sum(1 << b for b in rng.sample(range(63), rng.choice([0, 0, 1, 2, 3, 4])))) for i in range(200)] + [(500, None)]
    got = [(r.a, r.b) for r in splits.hamming_links(spark.createDataFrame(rows, "id long, hash long"), hot=hot).collect()]
    first = {}
    for i, h in rows:
        if h is not None:
            first.setdefault(h, i)
    want = {(min(a, b), max(a, b)) for x, a in first.items() for y, b in first.items() if x < y and (x ^ y).bit_count() <= 5}
    want |= {(first[h], i) for i, h in rows if h is not None and first[h] != i}
    assert sorted(got) == sorted(want)


def test_runs_fill_splits_as_one_after_another(spark):
    rng = random.Random(4)
    for sizes in ([1] * 300, [rng.choice([1, 1, 1, 2, 3, 40]) for _ in range(200)], [7], [5, 5, 5, 1, 1]):
        ratios = {"train": 0.70, "val": 0.15, "test": 0.15}
        with Scratch(spark) as held:
            got = {r.group_id: r.split for r in splits.place_groups(spark.createDataFrame(list(enumerate(sizes)), "group_id long, size long"), ratios, 42, held).collect()}
        now, total = dict.fromkeys(ratios, 0), sum(sizes)
        for g in sorted(range(len(sizes)), key=lambda g: hashlib.sha1(f"42|{g}".encode()).hexdigest()):
            best = max(ratios, key=lambda s: ratios[s] * total - now[s])
            assert got[g] == best
            now[best] += sizes[g]


def test_plateau(spark):
    c = spark.createDataFrame([("flat", e, 1.0) for e in range(10)] + [("falls", e, 3.0 - 0.2 * e) for e in range(10)] + [("short", e, 1.0) for e in range(4)], "arm string, epoch int, loss double")
    assert {r.arm: r.plateaued for r in runs.plateaued(c, ["arm"]).collect()} == {"flat": True, "falls": False, "short": None}


def test_valid_rate(spark):
    p = spark.createDataFrame([(7, 7, 0.9, 0.9), (7, 7, 0.4, 0.4), (3, 7, 0.8, 0.1)], "pred int, intended int, conf double, p_intended double")
    r = runs.valid_rate(p).first()
    assert (r.top1_acc, r.accept_rate, r.mean_p) == pytest.approx((2 / 3, 1 / 3, 1.4 / 3))


def test_quantiles_of_many_groups(spark):
    rng = random.Random(6)
    rows = [(g, None if rng.random() < 0.05 else rng.choice([0.0, -0.0, -1.5, 1e300, -1e300, 5e-324, rng.gauss(0, 1), rng.gauss(0, 1e9)])) for g in ("a", "b", None) for _ in range(60)] + [("nulls", None), ("one", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in quantiles.quantiles(df, ["g"], F.col("v"), {"low": 0.025, "mid": 0.5, "high": 1.0}).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for g, r in got.items():
        own = np.array([v for x, v in rows if x == g and v is not None])
        assert (r.low, r.mid, r.high) == pytest.approx(tuple(np.quantile(own, [0.025, 0.5, 1.0])))
    n = F.col("n")
    ranked = quantiles.at_ranks(df.where("g = 'a'"), [], F.col("v"), {"first": F.lit(0), "last": n - 1, "beyond": n}).first()
    own = sorted(v for x, v in rows if x == "a" and v is not None)
    assert (ranked["first"], ranked["last"], ranked["beyond"]) == (own[0], own[-1], None)
    assert quantiles.quantiles(df.limit(0), ["g"], F.col("v"), {"mid": 0.5}).count() == 0


def test_clusters_of_several_starts(spark):
    rng = random.Random(7)
    rows = [(i, [10.0 * (i % 3) + rng.random(), rng.random()]) for i in range(60)] + [(100, None), (101, [1.0, float("nan")])]
    out = runs.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 3).collect()
    assert len(out) == 60 and len({(r.vec_id % 3, r.cluster) for r in out}) == 3 and max(r.distance for r in out) < 1.5
    assert runs.cluster(spark.createDataFrame(rows[60:], "vec_id long, embedding array<double>"), 3).count() == 0
    few = runs.cluster(spark.createDataFrame(rows[:2], "vec_id long, embedding array<double>"), 5).collect()
    assert sorted(r.distance for r in few) == [0.0, 0.0]
