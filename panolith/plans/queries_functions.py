"""Queries on scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from panolith.functions import geometry as G
from panolith.functions import names as N
from panolith.plans import derive as D
from panolith.plans.register import query

O = f"WITH {D.OBJECTS}"


@query(f"""{O} SELECT ord, x1, y1, x2, y2, (x1 + x2) / 2 / 2048 AS cx, (y1 + y2) / 2 / 2048 AS cy, (x2 - x1) / 2048 AS w, (y2 - y1) / 2048 AS h FROM objects""")
def parsed_boxes(spark, d):
    o = D.objects(spark, d)
    odd = F.col("ord") % 2 == 1
    none = F.lit(None).cast("double")
    raw = F.struct(*[F.when(odd, F.col(c)).otherwise(none).alias(n) for c, n in (("x1", "xmin"), ("y1", "ymin"), ("x2", "xmax"), ("y2", "ymax"))], *[F.when(~odd, v).otherwise(none).alias(n) for v, n in ((F.col("x1"), "x"), (F.col("y1"), "y"), (F.col("x2") - F.col("x1"), "w"), (F.col("y2") - F.col("y1"), "h"))])
    boxes = o.select("ord", G.parse_bbox(raw).alias("b"))
    return boxes.select("ord", "b.*", G.xyxy_to_yolo(F.col("b.x1"), F.col("b.y1"), F.col("b.x2"), F.col("b.y2"), F.lit(D.SIZE), F.lit(D.SIZE)).alias("y")).select("ord", "x1", "y1", "x2", "y2", "y.*")


_PATHS = """paths AS (SELECT p_partkey, ['train', 'Test', 'other', 'val', 'misc'][p_partkey % 5 + 1] || ['/', chr(92), '-'][p_partkey % 3 + 1] || p_partkey || '.jpg' AS path FROM part)"""


@query(f"""WITH {_PATHS} SELECT p_partkey, CASE WHEN contains(path, '/') AND split_part(path, '/', 1) IN ('train', 'test', 'other') THEN split_part(path, '/', 1) ELSE 'unknown' END AS strict,
  CASE WHEN contains(q, '/train/') THEN 'train' WHEN contains(q, '/test/') THEN 'test' WHEN contains(q, '/val/') THEN 'val' WHEN contains(q, '/other/') THEN 'other' ELSE 'unknown' END AS loose
  FROM (SELECT *, '/' || lower(replace(path, chr(92), '/')) AS q FROM paths)""")
def splits_of_paths(spark, d):
    k = F.col("p_partkey")
    head = F.element_at(F.array(*map(F.lit, ("train", "Test", "other", "val", "misc"))), (k % 5 + 1).cast("int"))
    mark = F.element_at(F.array(F.lit("/"), F.lit("\\"), F.lit("-")), (k % 3 + 1).cast("int"))
    path = F.concat(head, mark, k.cast("string"), F.lit(".jpg"))
    return D.table(spark, d, "part").select("p_partkey", N.split_from_path(path).alias("strict"), N.split_of(path).alias("loose"))


_fam = "CASE name[1:1] " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in N.FAMILIES.items()) + " ELSE 'other/misc' END"


@query(f"""WITH n AS (SELECT p_partkey, ['w57', 'il80', 'i5', 'pn', '5abc', 'Ph4.5', 'p-x1', '?'][p_partkey % 8 + 1] AS name FROM part)
  SELECT p_partkey, CASE WHEN regexp_extract(name, '^([^0-9]+)', 1) = '' THEN name ELSE regexp_extract(name, '^([^0-9]+)', 1) END AS prefix,
  CASE WHEN regexp_extract(name, '^([A-Za-z]+)', 1) = '' THEN name ELSE regexp_extract(name, '^([A-Za-z]+)', 1) END AS letters, {_fam} AS family,
  CASE WHEN name LIKE 'w%' THEN 'triangle' WHEN name LIKE 'il%' THEN 'circle' WHEN name LIKE 'i%' THEN 'rectangle' ELSE 'circle' END AS shape FROM n""")
def names_of_categories(spark, d):
    name = F.element_at(F.array(*map(F.lit, ("w57", "il80", "i5", "pn", "5abc", "Ph4.5", "p-x1", "?"))), (F.col("p_partkey") % 8 + 1).cast("int"))
    return D.table(spark, d, "part").select("p_partkey", N.prefix(name).alias("prefix"), N.letters(name).alias("letters"), N.family(name).alias("family"), N.sign_shape(name).alias("shape"))


@query(f"""{O}, {D.GTS} SELECT ord, a AS area, CASE WHEN a < 1024 THEN 'small' WHEN a < 9216 THEN 'medium' ELSE 'large' END AS bucket,
  CASE WHEN a < 1024 THEN 'small' WHEN a > 9216 THEN 'large' ELSE 'medium' END AS bin,
  CASE WHEN s < 16 THEN '<16' WHEN s < 24 THEN '16-24' WHEN s < 32 THEN '24-32' WHEN s < 48 THEN '32-48' WHEN s < 96 THEN '48-96' ELSE '>=96' END AS band
  FROM (SELECT ord, w * h * 4194304 AS a, greatest(w, h) * 2048 AS s FROM gts)""")
def object_sizes(spark, d):
    g = D.ground_truth(spark, d).withColumn("area", G.px_area("w", "h"))
    return g.select("ord", "area", G.size_bucket("area").alias("bucket"), G.size_bin("area").alias("bin"), G.size_band("w", "h").alias("band"))


_IOU = "greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"


@query(f"""{O}, p AS (SELECT a.ord AS a, b.ord AS b, {_IOU} AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s
  FROM objects a JOIN objects b ON a.pid = b.pid AND a.cat = b.cat AND a.ord < b.ord)
  SELECT a, b, round(i / (s - i), 6) AS iou, round(i / (s - i), 6) AS iou_corners FROM p WHERE i > 0""")
def box_overlaps(spark, d):
    o = D.normalised(D.objects(spark, d))
    a, b = o.alias("a"), o.alias("b")
    met = a.join(b, (F.col("a.pid") == F.col("b.pid")) & (F.col("a.cat") == F.col("b.cat")) & (F.col("a.ord") < F.col("b.ord")))
    box = lambda x: F.struct(*[F.col(f"{x}.{c}").alias(c) for c in ("cx", "cy", "w", "h")])
    both = met.select(F.col("a.ord").alias("a"), F.col("b.ord").alias("b"), G.iou(box("a"), box("b")).alias("iou"), G.iou_xyxy(G.to_xyxy(box("a")), G.to_xyxy(box("b"))).alias("iou_corners"))
    return both.where("iou > 0").select("a", "b", F.round("iou", 6).alias("iou"), F.round("iou_corners", 6).alias("iou_corners"))


@query(f"""{O} SELECT ord, round(vf, 6) AS vf, CASE WHEN vf <= 0.2 THEN 'drop' WHEN cat < 12 AND vf >= 0.6 THEN 'label' ELSE 'ignore' END AS plain,
  CASE WHEN vf <= 0.2 THEN 'drop' WHEN cat < 12 AND vf >= 0.6 THEN 'label' WHEN cat >= 12 AND vf >= 0.6 THEN 'other' ELSE 'ignore' END AS with_other
  FROM (SELECT ord, cat, greatest(0.0, least(x2, 1152) - greatest(x1, 512)) * greatest(0.0, least(y2, 1152) - greatest(y1, 512)) / ((x2 - x1) * (y2 - y1)) AS vf FROM objects)""")
def visibility_in_a_tile(spark, d):
    tile = F.struct(*[F.lit(v).alias(n) for n, v in (("x1", 512.0), ("y1", 512.0), ("x2", 1152.0), ("y2", 1152.0))])
    o = D.objects(spark, d).withColumn("vf", G.clip(F.struct("x1", "y1", "x2", "y2"), tile)["vf"])
    inside = F.col("cat") < 12
    return o.select("ord", F.round("vf", 6).alias("vf"), G.visibility_class(F.col("vf"), inside).alias("plain"), G.visibility_class(F.col("vf"), inside, other=True).alias("with_other"))


@query(f"""{O} SELECT ord, (512 + cx * 640) / 2048 AS cx, (1024 + cy * 640) / 2048 AS cy, w * 640 / 2048 AS w, h * 640 / 2048 AS h,
  (512 + ix1) / 2048 AS ix1, (1024 + iy1) / 2048 AS iy1, greatest(0, least(640, round_even((cx - w / 2) * 640, 0)))::INTEGER AS px1, greatest(0, least(480, round_even((cy + h / 2) * 480, 0)))::INTEGER AS py2
  FROM (SELECT ord, (x1 + x2) / 2 / 2048 AS cx, (y1 + y2) / 2 / 2048 AS cy, (x2 - x1) / 2048 AS w, (y2 - y1) / 2048 AS h, x1 AS ix1, y1 AS iy1 FROM objects)""")
def tile_to_panorama(spark, d):
    o = D.normalised(D.objects(spark, d))
    box, px = F.struct("cx", "cy", "w", "h"), F.struct("x1", "y1", "x2", "y2")
    x, y = F.lit(512), F.lit(1024)
    out = o.select("ord", G.det_to_panorama(box, x, y).alias("p"), G.ignore_to_panorama(px, x, y).alias("i"), G.yolo_to_px(box, 640, 480).alias("c"))
    return out.select("ord", "p.*", F.col("i.x1").alias("ix1"), F.col("i.y1").alias("iy1"), F.col("c.x1").alias("px1"), F.col("c.y2").alias("py2"))


@query("""WITH m AS (SELECT p_partkey, sha1(p_name || p_partkey) AS s FROM part)
  SELECT p_partkey, CAST(('0x' || s[1:10])::BIGINT AS HUGEINT) * 0 + ((((('0x' || s[1:10])::BIGINT % 1000 * 776 + ('0x' || s[11:20])::BIGINT) % 1000 * 776 + ('0x' || s[21:30])::BIGINT) % 1000 * 776 + ('0x' || s[31:40])::BIGINT) % 1000) < 100 AS kept FROM m""".replace("CAST(('0x' || s[1:10])::BIGINT AS HUGEINT) * 0 + ", ""))
def kept_negatives(spark, d):
    return D.table(spark, d, "part").select("p_partkey", N.keep_negative(F.concat("p_name", F.col("p_partkey").cast("string")), 0.1).alias("kept"))


@query("""WITH k AS (SELECT p_partkey, (p_partkey % 300 + 1) / 100.0 AS k, ['zero_aug', 'copy_paste', 'da_only'][p_partkey % 3 + 1] AS arm, p_partkey % 7 AS seed, p_partkey % 2 = 1 AS smoke FROM part),
  t AS (SELECT *, printf('bm%03d', CAST(round_even(k * 100, 0) AS INTEGER)) AS tag FROM k)
  SELECT p_partkey, tag, CAST(round_even(k * 100, 0) AS DOUBLE) / 100.0 AS parsed, arm || '_' || tag || '_seed' || seed || CASE WHEN smoke THEN '_smoke' ELSE '' END AS run, arm, seed::INTEGER AS seed, smoke, 'tt_' || arm || '_seed' || seed AS rid, arm || '_' || tag AS shown FROM t""")
def run_names(spark, d):
    i = F.col("p_partkey")
    k = (i % 300 + 1) / 100.0
    arm = F.element_at(F.array(*map(F.lit, ("zero_aug", "copy_paste", "da_only"))), (i % 3 + 1).cast("int"))
    named = D.table(spark, d, "part").select("p_partkey", N.budget_tag(k).alias("tag"), arm.alias("a"), (i % 7).alias("s"), (i % 2 == 1).alias("z"))
    built = named.withColumns({"run": N.experiment_name(F.col("a"), F.col("s"), F.col("tag"), F.col("z")), "rid": N.run_id(F.lit("tt"), F.col("a"), F.col("s")), "shown": N.display_arm(F.col("a"), F.col("tag"))})
    return built.select("p_partkey", "tag", N.parse_budget_tag(F.col("tag")).alias("parsed"), "run", N.parse_run_dir(F.col("run")).alias("p"), "rid", "shown").select("p_partkey", "tag", "parsed", "run", "p.arm", "p.seed", "p.smoke", "rid", "shown")


@query("""WITH n AS (SELECT p_partkey, p_partkey % 9000 + 1 AS n FROM part),
  s AS (SELECT p_partkey, n, greatest(1, ceil(n / 16.0))::BIGINT AS per FROM n), e AS (SELECT *, greatest(1, round_even(1000.0 / per, 0)::BIGINT) AS epochs FROM s)
  SELECT p_partkey, per, epochs, epochs * per AS realized, round(abs(epochs * per - 1000) / 1000.0, 6)::DOUBLE AS deviation, abs(epochs * per - 1000) / 1000.0 <= 0.02 AS within_tol,
  printf('%.4f', n / 7.0) AS shown, CASE WHEN n >= 3600 THEN printf('%dh%02dm', n // 3600, n % 3600 // 60) ELSE printf('%dm%02ds', n // 60, n % 60) END AS took,
  (n % 11 - 5 > 0 OR n % 11 - 3 < 0) AS excludes FROM e""")
def step_plans(spark, d):
    t = D.table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 9000 + 1).alias("n")).withColumn("per", N.steps_per_epoch(F.col("n"), F.lit(16)))
    e = t.withColumn("epochs", N.epochs_for_budget(F.lit(1000), F.col("per"))).withColumn("realized", F.col("epochs") * F.col("per"))
    off = F.abs(F.col("realized") - 1000) / 1000.0
    n = F.col("n")
    return e.select("p_partkey", "per", "epochs", "realized", F.round(off, 6).alias("deviation"), (off <= 0.02).alias("within_tol"), N.number(n / 7.0).alias("shown"), N.duration(n).alias("took"), N.ci_excludes_zero(n % 11 - 5, n % 11 - 3).alias("excludes"))
