import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from panolith.functions import kernels as K
from panolith.operators import catalog
from panolith.sources import readers, sinks
from panolith.streaming import ingest


def test_annotations(spark, tmp_path):
    box = {"xmin": 1, "ymin": 2, "xmax": 3, "ymax": 4}
    raw = {"types": ["pn", "i5", "w57"], "imgs": {"1": {"id": 1, "path": "train/1.jpg", "objects": [{"category": c, "bbox": box} for c in ("pn", "pn", "i5", "?")]}, "2": {"path": "test/2.jpg", "objects": [{"category": "pn", "bbox": box}]}}}
    (tmp_path / "a.json").write_text(json.dumps(raw))
    o = readers.objects_of(readers.annotations(spark, str(tmp_path / "a.json")))
    got = {r["category"]: (r["instances"], r["images"]) for r in catalog.class_counts(o, "category", "id").collect()}
    assert got == {"pn": (3, 2), "i5": (1, 1)}
    assert readers.find_annotation_file(spark, str(tmp_path)).endswith("a.json")


def test_labels_and_ignores(spark, tmp_path):
    (tmp_path / "t0.txt").write_text("3 .5 .5 .1 .1\nshort\n")
    (tmp_path / "t0.ignore.json").write_text("[[1, 2, 3, 4]]")
    rows = readers.yolo_labels(spark, str(tmp_path)).collect()
    assert [(r.tile, r.class_id, r.cx) for r in rows] == [("t0", 3, 0.5)]
    tiles = spark.createDataFrame([("t0",), ("t1",)], "tile string")
    assert {r.tile: r.ignores for r in readers.ignore_boxes(spark, str(tmp_path), tiles).collect()} == {"t0": [[1.0, 2.0, 3.0, 4.0]], "t1": []}


def test_jsonl_and_curve(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert readers.jsonl(spark, str(tmp_path / "p.jsonl"), "a int").count() == 2
    (tmp_path / "r.csv").write_text("epoch, train/box_loss\n1, 0.5\n2, nan\n")
    got = readers.training_curve(spark, str(tmp_path / "r.csv"), {"epoch": ("epoch",), "loss": ("box_loss",), "map": ("mAP",)}).collect()
    assert [(r.epoch, r.loss, r["map"]) for r in got] == [(1.0, 0.5, None), (2.0, None, None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.5), (2, float("nan"))], "k int, v double")
    where = str(tmp_path / "t")
    assert sinks.append_missing(df, where, ["k"]) == 2
    assert sinks.append_missing(df, where, ["k"]) == 0
    assert sinks.append_missing(spark.createDataFrame([(2, 0.0), (3, 0.0)], df.schema), where, ["k"]) == 1
    assert sorted(r.json for r in sinks.nan_safe_json(df).collect()) == ['{"k":1,"v":1.5}', '{"k":2,"v":null}']
    sinks.write_once(df, str(tmp_path / "u"))
    sinks.write_once(df.limit(0), str(tmp_path / "u"))
    assert spark.read.parquet(str(tmp_path / "u")).count() == 2


def test_ingest_takes_files_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"k": 1}\n{"k": 2}\n')
    go = lambda: ingest.ingest_new(spark, str(src), "k int", str(tmp_path / "out"), str(tmp_path / "state"), ["k"])
    go()
    (src / "2.json").write_text('{"k": 3}\n')
    go()
    go()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_kernels():
    rng = np.random.default_rng(0)
    image = rng.integers(0, 255, (64, 80, 3), dtype=np.uint8)
    kept = K.perturb_background(image, [(10, 10, 30, 30)], np.random.default_rng(1))
    assert (kept[10:30, 10:30] == image[10:30, 10:30]).all() and (kept != image).any()
    painted = K.paint_out(image, (0, 0, 10, 10))
    assert (painted[:10, :10] == painted[0, 0]).all()
    hard = np.full((200, 200, 3), 255, np.uint8)
    hard[50:150, 50:150] = 0
    soft = K.degrade(hard, 40, np.random.default_rng(1))
    assert soft.shape == (40, 40, 3) and soft.dtype == np.uint8
    assert K.lapvar(soft) < K.lapvar(K.resample(hard, 40, 40, "area"))
    assert K.degrade(hard, 32, rng, (0, 0), (0, 0), (100, 100)).shape == (32, 32, 3)
    plain = np.repeat(image[..., :1], 3, 2)
    assert np.abs(K.jpeg_loss(plain, 100).astype(int) - plain).max() <= 3 and K.lapvar(K.jpeg_loss(plain, 10)) < K.lapvar(plain)
    ramp = K.feather_alpha(40, 60)
    assert ramp[20, 20] == 1 and ramp[0, 20] == pytest.approx(1 / 5) and ramp[3, 20] == pytest.approx(4 / 5) and ramp[4, 20] == 1
    assert K.feather_alpha(5, 5)[0, 0] == pytest.approx(0.5)
    assert K.draw_real_box([("t0", [0.5, 0.5, 0.1, 0.12])], rng) == (0.5, 0.5, 0.1, 0.12)
    with pytest.raises(ValueError):
        K.draw_real_box([], rng)
    assert K.ssim(image, image) == pytest.approx(1) and K.ssim(image, 255 - image) < 0.5
    pasted = K.paste(np.zeros((50, 50, 3), np.uint8), hard, 45, 45, 10, 10)
    assert pasted.shape == (50, 50, 3)
    assert K.best_of([1, 2, 3], lambda c: (c / 10, c == 2)) == 2
    assert K.best_of([1, 3, 2], lambda c: (c / 10, False)) == 3
    assert K.regenerate(lambda i: i, lambda x: x == 1) == (1, 2, True)


@pytest.mark.parametrize(("shape", "status", "reason"), [("block", "ok", ""), ("speck", "rejected", "area_small"), ("cross", "rejected", "solidity"), ("full", "ok", ""), ("none", "rejected", "empty")])
def test_masks(shape, status, reason):
    m = np.zeros((40, 40), bool)
    if shape == "block":
        m[5:35, 5:35] = True
        m[15:20, 15:20] = False
    elif shape == "speck":
        m[18:23, 18:23] = True
    elif shape == "cross":
        m[15:25, :] = m[:, 15:25] = True
    elif shape == "full":
        m[:] = True
    got = K.filter_mask(m)
    assert got["status"] == status and reason in got["reason"]
    if shape == "block":
        assert got["mask"].sum() == 900 and got["solidity"] == 1


def test_regions_connect_by_corners():
    m = np.zeros((6, 6), bool)
    m[0, 0] = m[1, 1] = m[2, 2] = m[5, 0] = m[5, 1] = True
    assert K.largest_component(m).sum() == 3


def test_silhouettes_fade_inwards():
    block = np.zeros((9, 9), bool)
    block[2:7, 2:7] = True
    soft = K.feather_mask(block)
    assert soft[4, 4] == 1 and soft[2, 4] == pytest.approx(0.955 / 2) and soft[3, 3] == pytest.approx(0.955) and soft[0, 0] == 0
    assert K.feather_mask(np.ones((4, 4))).min() == 1  # the border is no edge
    circle, triangle = K.shape_alpha("circle", 40, 60), K.shape_alpha("triangle", 41, 41)
    assert circle[0, 0] == 0 and circle[20, 30] == 1 and circle[20, 3] > 0 and triangle[0, 0] == 0 and triangle[38, 20] == 1 and triangle[40, 0] > 0
    assert (K.shape_alpha("rectangle", 5, 7) == 1).all() and (K.shape_alpha("circle", 1, 1) > 0).all()


def test_copy_paste_replaces_the_label_it_covers():
    source = np.full((64, 64, 3), 222, np.uint8)
    ground = np.full((640, 640, 3), 10, np.uint8)
    labels = [(3, 0.5, 0.5, 0.1, 0.1), (4, 0.1, 0.1, 0.05, 0.05)]
    out, left = K.copy_paste(ground, labels, source, 7, (0.5, 0.5, 0.1, 0.1))
    assert [x[0] for x in left] == [4, 7] and left[1][1:] == pytest.approx((0.5, 0.5, 0.1, 0.1)) and out[320, 320, 0] == 222 and out[0, 0, 0] == 10
    soft, _ = K.copy_paste(ground, [], source, 7, (0.5, 0.5, 0.1, 0.1), "circle")
    assert soft[289, 289, 0] == 10 and soft[320, 320, 0] == 222
    band = np.zeros((64, 64), np.uint8)
    band[20:40] = 255
    cut, _ = K.copy_paste(ground, [], source, 7, (0.5, 0.5, 0.1, 0.1), "circle", band)
    assert cut[294, 320, 0] == 10 and cut[318, 320, 0] == 222
    _, edge = K.copy_paste(ground, [], source, 7, (0.0, 1.0, 0.1, 0.1))
    assert edge[0][1:] == pytest.approx((0.05, 0.95, 0.1, 0.1)) and K.copy_paste(ground, [], source[:0], 7, (0, 0, 1, 1)) is None


def test_signs_are_kept_and_the_rest_is_perturbed():
    rng = np.random.default_rng(0)
    image = rng.integers(0, 255, (80, 80, 3), dtype=np.uint8)
    box = (20, 20, 60, 60)
    out = K.perturb_outside_signs(image, [box], np.random.default_rng(1))
    assert (out[40, 40] == image[40, 40]).all() and (out[20, 20] != image[20, 20]).any()
    band = np.zeros((40, 40), np.uint8)
    band[10:20] = 255
    out = K.perturb_outside_signs(image, [box], np.random.default_rng(1), mask=band)
    assert (out[32:38, 20:60] == image[32:38, 20:60]).all() and (out[50, 20:60] != image[50, 20:60]).any()


def test_hash_of_images(spark):
    rng = np.random.default_rng(3)
    a = K.resample(rng.integers(20, 230, (12, 12, 3), dtype=np.uint8), 64, 64)
    b = np.clip(a.astype(int) + 2, 0, 255).astype(np.uint8)
    c = K.resample(rng.integers(20, 230, (12, 12, 3), dtype=np.uint8), 64, 64)
    df = spark.createDataFrame([(1, bytearray(a.tobytes())), (2, bytearray(b.tobytes())), (3, None), (4, bytearray(c.tobytes()))], "id long, content binary")
    got = {r.id: r.h for r in df.select("id", K.image_hash(F.col("content"), F.lit(64), F.lit(64)).alias("h")).collect()}

    def apart(x, y):
        return bin((x ^ y) & (2**64 - 1)).count("1")

    assert apart(got[1], got[2]) <= 2 and got[3] is None and apart(got[1], got[4]) > 16
    ramp = np.repeat(((np.mgrid[0:64, 0:64][1] * 2) % 256).astype(np.uint8)[..., None], 3, 2)
    assert apart(K.phash(ramp), K.phash(ramp + 2)) <= 5


def test_tiles_are_cut_and_painted(spark):
    image = np.full((1280, 1280, 3), 128, np.uint8)
    image[10:20, 10:20] = 0
    pano = spark.createDataFrame([(5, 1280, 1280, bytearray(image.tobytes()))], "pid long, height int, width int, content binary")
    tiles = spark.createDataFrame([(5, 0, 0, 640, [(0.0, 0.0, 40.0, 40.0)]), (5, 640, 512, 640, None)], "pid long, x_off int, y_off int, size int, ignores array<struct<x1:double,y1:double,x2:double,y2:double>>")
    got = {r.tile: np.frombuffer(r.content, np.uint8).reshape(640, 640, 3) for r in K.cut_tiles(pano, tiles).collect()}
    assert set(got) == {"5_0_0", "5_640_512"} and got["5_0_0"][15, 15, 0] == 120 and got["5_640_512"].min() == 128
    with pytest.raises(Exception, match="recorded size"):
        K.cut_tiles(pano.withColumn("width", F.lit(1000)), tiles).collect()


def test_pastes_as_tables(spark):
    ground, sign = np.full((64, 64, 3), 10, np.uint8), np.full((64, 64, 3), 200, np.uint8)
    rows = [(1, 7, "circle", [0.5, 0.5, 0.25, 0.25], 64, 64, bytearray(ground.tobytes()), [(3, 0.5, 0.5, 0.25, 0.25)], 64, 64, bytearray(sign.tobytes()), [8, 8, 40, 40], None)]
    schema = f"ord long, class_id long, shape string, place array<double>, height int, width int, content binary, labels array<{K.LABEL}>, s_height int, s_width int, s_content binary, s_box array<int>, mask binary"
    for arm in K.PASTES:
        r = K.generate_pastes(spark.createDataFrame(rows, schema), arm).first()
        image = np.frombuffer(r.content, np.uint8).reshape(64, 64, 3)
        assert [x.class_id for x in r.labels] == [7] and image[32, 32, 0] == 200 and (image[25, 25, 0] == 10) == (arm == "copy_paste_mask")


def test_generate_and_predict(spark):
    image = np.full((8, 8, 3), 100, np.uint8)
    t = spark.createDataFrame([("t0", 8, 8, bytearray(image.tobytes()), [[1, 1, 3, 3]])], "tile string, height int, width int, content binary, boxes array<array<int>>")
    assert K.generate(t, "real_duplicate").first().content == image.tobytes()
    assert K.generate(t, "bg_photometric").first().content == K.generate(t, "bg_photometric").first().content
    p = spark.createDataFrame([(1, 0, 512, bytearray(b"x"))], "pid long, x_off int, y_off int, content binary")
    got = K.predict_by_panorama(p, lambda: lambda images: [[(3, 0.9, 0.5, 0.5, 0.1, 0.1)] for _ in images]).collect()
    assert [(r.pid, r.y_off, r.cat, r.conf) for r in got] == [(1, 512, 3, 0.9)]
