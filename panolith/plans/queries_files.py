"""Queries on sources and sinks: derived tables are written as files of each kind and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panolith.operators import catalog
from panolith.plans import derive as D
from panolith.plans.queries_catalog import OC
from panolith.plans.register import query
from panolith.session import shared_dir
from panolith.sources import keyed, readers, sinks, zips

O = f"WITH {D.OBJECTS}"


#: Panoramas of one nested file: a reader parses a file in one task, so files grow in number and not in size.
PER_FILE = 256


def _file_of(pid: str):
    return F.floor(F.col(pid) / PER_FILE)


def _folder(spark, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def _marked(spark, d):
    """Objects of which some have no category, or an unknown one."""
    o = F.col("ord")
    return D.objects(spark, d).withColumn("category", F.when(o % 17 == 0, "?").when(o % 19 != 0, F.col("name")))


@query(f"{O} SELECT pid::VARCHAR AS id, name AS category, x1, y1, x2, y2 FROM objects WHERE ord % 17 <> 0 AND ord % 19 <> 0")
def scanned_annotations(spark, d):
    box = F.struct(F.col("x1").alias("xmin"), F.col("y1").alias("ymin"), F.col("x2").alias("xmax"), F.col("y2").alias("ymax"))
    per = _marked(spark, d).groupBy("pid").agg(F.collect_list(F.struct(box.alias("bbox"), "category")).alias("objects"))
    img = F.struct(F.format_string("train/%d.jpg", "pid").alias("path"), F.when(F.col("pid") % 2 == 0, F.col("pid").cast("string")).alias("id"), "objects")
    files = per.groupBy(_file_of("pid").alias("file")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("pid").cast("string"), img))).alias("imgs"))
    path = _folder(spark, "annotations")
    files.select("file", F.to_json(F.struct("imgs")).alias("value")).write.partitionBy("file").text(path)
    b = F.col("bbox")
    return readers.objects_of(readers.annotations(spark, path)).select("id", "category", b.xmin.alias("x1"), b.ymin.alias("y1"), b.xmax.alias("x2"), b.ymax.alias("y2"))


@query(f"WITH {D.PANOS} SELECT pid::VARCHAR AS id, path, split_orig FROM panoramas")
def scanned_json_lines(spark, d):
    rows = D.panoramas(spark, d).select(F.to_json(F.struct(F.col("pid").cast("string").alias("id"), "path", "split_orig")).alias("value"))
    path = _folder(spark, "jsonl")
    rows.unionByName(rows.select(F.lit("  ").alias("value"))).write.text(path)
    return readers.jsonl(spark, path, readers.PANORAMA).select("id", "path", "split_orig")


@query(f"{O} SELECT cat AS category_id, name, pid AS image_id, x1 AS x, x2 - x1 AS w, pid || '.jpg' AS file_name FROM objects WHERE ord % 13 <> 0")
def scanned_coco(spark, d):
    o = D.objects(spark, d).withColumn("file", _file_of("pid"))
    notes = o.groupBy("file").agg(F.collect_list(F.struct(F.col("pid").alias("image_id"), F.col("cat").alias("category_id"), F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("bbox"), F.when(F.col("ord") % 13 == 0, True).alias("ignore"))).alias("annotations"))
    pictures = o.select("file", "pid").distinct().groupBy("file").agg(F.collect_list(F.struct(F.col("pid").alias("id"), F.lit(2048).alias("width"), F.lit(2048).alias("height"), F.format_string("%d.jpg", "pid").alias("file_name"))).alias("images"))
    kinds = o.select("file", "cat", "name").distinct().groupBy("file").agg(F.collect_list(F.struct(F.col("cat").alias("id"), "name")).alias("categories"))
    path = _folder(spark, "coco")
    notes.join(pictures, "file").join(kinds, "file").select("file", F.to_json(F.struct("images", "annotations", "categories")).alias("value")).write.partitionBy("file").text(path)
    images, annotations, categories = readers.coco(spark, path)
    named = F.broadcast(categories.distinct().select(F.col("id").alias("category_id"), "name"))
    valid = annotations.where(~F.coalesce("ignore", F.lit(False))).join(named, "category_id").join(images.select(F.col("id").alias("image_id"), "file_name"), "image_id")
    return valid.select("category_id", "name", "image_id", F.col("bbox")[0].alias("x"), F.col("bbox")[2].alias("w"), "file_name")


TILED = """labels_f AS (SELECT 't' || (l_orderkey % 40) AS tile, CAST(l_partkey % 9 AS INTEGER) AS class_id, (l_partkey % 100) / 100.0::DOUBLE AS cx, (l_suppkey % 100) / 100.0::DOUBLE AS cy, 0.25::DOUBLE AS w, 0.125::DOUBLE AS h, l_linenumber AS k FROM lineitem)"""


def _tiled(spark, d):
    t = D.table(spark, d, "lineitem")
    return t.select(F.concat(F.lit("t"), (F.col("l_orderkey") % 40).cast("string")).alias("tile"), (F.col("l_partkey") % 9).cast("int").alias("class_id"), ((F.col("l_partkey") % 100) / 100.0).alias("cx"), ((F.col("l_suppkey") % 100) / 100.0).alias("cy"), F.lit(0.25).alias("w"), F.lit(0.125).alias("h"), F.col("l_linenumber").alias("k"))


def _written_tiles(spark, d) -> str:
    rows, path = _tiled(spark, d), _folder(spark, "tiles")
    numbers = spark.range(48).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("tile"), F.encode(F.col("id").cast("string"), "UTF-8").alias("content"), F.col("id").alias("pid"), F.lit(0).alias("x_off"), F.lit(512).alias("y_off"), F.lit(640).alias("size"))
    boxes = rows.where("k = 1 AND class_id < 5").select("tile", *[F.col(c).alias(n) for c, n in (("cx", "x1"), ("cy", "y1"), ("w", "x2"), ("h", "y2"))])
    sinks.write_tiles(numbers, rows.where("k <> 7"), boxes, path)
    return path


@query(f"WITH {TILED} SELECT tile, class_id, cx, cy, w, h FROM labels_f WHERE k <> 7")
def scanned_labels(spark, d):
    return readers.yolo_labels(spark, _written_tiles(spark, d) + "/labels")


@query(f"""WITH {TILED}, t AS (SELECT 't' || i AS tile FROM range(0, 48) r(i))
  SELECT tile, (SELECT count(*) FROM labels_f l WHERE l.tile = t.tile AND k <> 7) AS labels, (SELECT count(*) FROM labels_f l WHERE l.tile = t.tile AND k = 1 AND class_id < 5) AS ignores FROM t""")
def loaded_tiles(spark, d):
    path = _written_tiles(spark, d)
    t = readers.tiles(spark, f"{path}/images", f"{path}/labels", f"{path}/ignores")
    return t.select("tile", F.size("labels").cast("long").alias("labels"), F.size("ignores").cast("long").alias("ignores"))


@query("""WITH c AS (SELECT event_id % 12 AS epoch, count(*) AS n, sum(user_id) AS u FROM events GROUP BY 1)
  SELECT epoch::DOUBLE AS epoch, CASE WHEN epoch NOT IN (3, 7) THEN n::DOUBLE END AS box_loss, u::DOUBLE AS map, NULL::DOUBLE AS other FROM c""")
def scanned_curve(spark, d):
    c = D.table(spark, d, "events").groupBy((F.col("event_id") % 12).alias("epoch")).agg(F.count("*").alias("n"), F.sum("user_id").alias("u"))
    path = _folder(spark, "curve")
    c.select("epoch", F.when(F.col("epoch") == 3, " ").when(F.col("epoch") == 7, "nan").otherwise(F.col("n").cast("string")).alias("train/box_loss"), F.col("u").alias("metrics/mAP50(B)")).write.csv(path, header=True)
    return readers.training_curve(spark, path, {"epoch": ("epoch",), "box_loss": ("train/box_loss",), "map": ("metrics/mAP50",), "other": ("absent",)})


@query(f"""{OC}, s AS (SELECT name, instances, round(instances * 100.0 / sum(instances) OVER (), 3)::DOUBLE AS pct FROM counts)
  SELECT name, instances::VARCHAR AS instances, printf('%.3f', pct) AS pct_instances FROM s""")
def written_class_counts(spark, d):
    path = _folder(spark, "counts")
    sinks.class_count_csv(catalog.with_shares(catalog.catalog(D.objects(spark, d))), path)
    return spark.read.csv(path, header=True).select("name", "instances", "pct_instances")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END AS x, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal / 2 END AS y FROM supplier")
def json_without_nan(spark, d):
    k, v = F.col("s_suppkey"), F.col("s_acctbal")
    rows = D.table(spark, d, "supplier").select("s_suppkey", F.when(k % 3 == 0, float("nan")).otherwise(v).alias("x"), F.when(k % 5 == 0, float("-inf")).otherwise(v / 2).alias("y"))
    return sinks.nan_safe_json(rows).select(F.from_json("json", "s_suppkey long, x double, y double").alias("r")).select("r.*")


@query("""SELECT o_custkey, CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 2 END AS run, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY o_custkey""")
def resumed_writes(spark, d):
    """The first run is cut short after half of its customers; the second does the rest, the third finds nothing to do."""
    per, path = D.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last")), _folder(spark, "resumed")
    sinks.append_missing(per.where("o_custkey % 2 = 0").withColumn("run", F.lit(1)), path, ["o_custkey"])
    sinks.append_missing(per.withColumn("run", F.lit(2)), path, ["o_custkey"])
    sinks.append_missing(per.withColumn("run", F.lit(3)), path, ["o_custkey"])
    return spark.read.parquet(path)


@query("""WITH s AS (SELECT o_orderkey AS run_id, o_orderstatus AS status, CAST(o_orderkey % 4 AS INTEGER) AS tries FROM orders)
  SELECT run_id, CASE WHEN run_id % 10 = 0 THEN 'done' ELSE status END AS status, tries + CASE WHEN run_id % 10 = 0 THEN 1 ELSE 0 END AS tries,
    (SELECT sum(tries) + count(*) FILTER (WHERE run_id % 10 = 0) FROM s) AS carried FROM s""")
def merged_statuses(spark, d):
    """Two runs into a table by key, news on top of them, the news once more as after a failure; the tries of all runs are carried over."""
    k = F.col("o_orderkey")
    rows = D.table(spark, d, "orders").select(k.alias("run_id"), F.col("o_orderstatus").alias("status"), (k % 4).cast("int").alias("tries"))
    table = keyed.KeyedTable(spark, _folder(spark, "statuses"), "run_id", 16)
    for name, part in (("first", rows.where("run_id % 3 = 0")), ("rest", rows)):
        todo = table.missing(part)
        table.merge(todo, {"tries": todo.agg(F.coalesce(F.sum("tries"), F.lit(0))).first()[0]}, name)
    news = rows.where("run_id % 10 = 0").select("run_id", F.lit("done").alias("status"), (F.col("tries") + 1).alias("tries"))
    for _ in range(2):
        table.merge(news, {"tries": news.count()}, "news")
    return table.read().withColumn("carried", F.lit(table.counters()["tries"]).cast("long"))


@query("SELECT r_regionkey, r_name FROM region")
def writes_that_stay(spark, d):
    rows, path = D.table(spark, d, "region"), _folder(spark, "once")
    sinks.write_once(rows, path)
    sinks.write_once(rows.where("r_regionkey > 1"), path)  # is left out: the result is there
    return spark.read.parquet(path)


@query("""SELECT event_type AS arm, CAST(user_id % 5 AS INTEGER) AS seed, CASE WHEN user_id % 2 = 0 THEN 'test' ELSE 'val' END AS split, count(*) AS n FROM events
  WHERE NOT (event_type = 'click' AND user_id % 5 = 0) OR value > 10 GROUP BY 1, 2, 3""")
def rewritten_runs(spark, d):
    e = D.table(spark, d, "events").select(F.col("event_type").alias("arm"), (F.col("user_id") % 5).cast("int").alias("seed"), F.when(F.col("user_id") % 2 == 0, "test").otherwise("val").alias("split"), "value")
    path = _folder(spark, "runs")
    sinks.write_runs(e, path)
    sinks.write_runs(e.where("arm = 'click' AND seed = 0 AND value > 10"), path)  # replaces these runs alone
    return readers.run_reports(spark, path).groupBy("arm", "seed", "split").agg(F.count("*").alias("n"))


@query(f"{O} SELECT source, count(*) AS n FROM (SELECT 'real' AS source FROM objects WHERE cat < 12 UNION ALL SELECT 'synthetic' FROM objects WHERE cat >= 6) GROUP BY 1")
def training_rows(spark, d):
    o = D.objects(spark, d)
    both = sinks.training_union(o.where("cat < 12").select(F.lit("real").alias("source"), "ord"), o.where("cat >= 6").select("ord", F.lit("synthetic").alias("source")))
    return both.groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT 'pages/' || page_id || '.html' AS name, octet_length(encode(html)) AS size, sha256(html) AS sha256 FROM pages WHERE page_id % 3 = 0 AND html IS NOT NULL AND page_id % 2 = 0")
def zipped_pages(spark, d):
    """Pages in archives; of these every third, as a run wants them that has fetched the odd ones before."""
    k = F.col("page_id")
    pages = D.table(spark, d, "pages").where("html IS NOT NULL").select(k, F.format_string("pages/%d.html", k).alias("name"), F.col("html").cast("binary").alias("content"))
    paths = zips.write_archives(pages, _folder(spark, "archives"))
    names = [r[0] for r in pages.where(k % 3 == 0).select("name").collect()]
    got = zips.members(spark, paths, names, done=pages.where(k % 2 == 1), partition_bytes=1 << 20)
    return got.select("name", "size", F.sha2("content", 256).alias("sha256"))
