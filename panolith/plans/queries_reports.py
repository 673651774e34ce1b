"""Queries on reconstruction, reports over arms, trial runs and clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panolith.functions import kernels
from panolith.operators import detect, diagnose, manifests, runs, splits, stats
from panolith.plans import derive as D
from panolith.plans.queries_detect import ALL, CLASSIFY, OD, TIERS, tiers
from panolith.plans.queries_tiles import LINKS
from panolith.plans.register import query

ARMS = ("zero_aug", "copy_paste", "bg_photometric")
REPORT = "r AS (SELECT l_partkey % 25 AS cat, ['zero_aug', 'copy_paste', 'bg_photometric'][l_suppkey % 3 + 1] AS arm, l_discount AS ap50 FROM lineitem WHERE NOT (l_partkey % 25 = 4 AND l_suppkey % 3 = 1))"
PIVOT = f"""{REPORT}, per AS (SELECT cat, avg(ap50) FILTER (WHERE arm = 'zero_aug') AS zero_aug, avg(ap50) FILTER (WHERE arm = 'copy_paste') AS copy_paste, avg(ap50) FILTER (WHERE arm = 'bg_photometric') AS bg_photometric FROM r GROUP BY cat),
  piv AS (SELECT *, CASE WHEN coalesce(copy_paste, -1) >= coalesce(bg_photometric, -1) THEN 'copy_paste' ELSE 'bg_photometric' END AS best,
    greatest(coalesce(copy_paste, -1), coalesce(bg_photometric, -1)) - zero_aug AS gain FROM per)"""


def _report(spark, d):
    arm = F.element_at(F.array(*map(F.lit, ARMS)), (F.col("l_suppkey") % 3 + 1).cast("int"))
    rows = D.table(spark, d, "lineitem").where("NOT (l_partkey % 25 = 4 AND l_suppkey % 3 = 1)")
    return rows.select((F.col("l_partkey") % 25).alias("cat"), arm.alias("arm"), F.col("l_discount").alias("ap50"))


@query(f"WITH {PIVOT} SELECT cat, round(zero_aug, 6) AS zero_aug, round(copy_paste, 6) AS copy_paste, round(bg_photometric, 6) AS bg_photometric, best, round(gain, 6) AS gain FROM piv")
def class_report_by_arm(spark, d):
    p = stats.class_pivot(_report(spark, d), "zero_aug", list(ARMS))
    return p.select("cat", *[F.round(c, 6).alias(c) for c in ARMS], "best", F.round("gain", 6).alias("gain"))


@query(f"{OD}, {TIERS}, {PIVOT} SELECT best, count(*) AS n, count(*) FILTER (WHERE gain > 0) AS improved FROM piv WHERE cat IN (SELECT cat FROM subset WHERE tier = 'tail') GROUP BY best")
def tail_wins(spark, d):
    return stats.tail_wins(stats.class_pivot(_report(spark, d), "zero_aug", list(ARMS)), tiers(spark, d).where("tier = 'tail'"))


def _rates(where: str, suffix: str) -> str:
    return ", ".join(f"round(count(*) FILTER (WHERE {where} = '{k}') * 100.0 / count(*), 4)::DOUBLE AS {k.lower()}{suffix}" for k in ("HIT", "MISS", "CLS", "LOC"))


_SURE = f"WITH RECURSIVE {D.OBJECTS}, {D.GTS}, {D.dets_sql()}, {TIERS}, {CLASSIFY.replace('FROM dets)', 'FROM dets WHERE conf >= 0.25)')}"


@query(f"""SELECT * FROM ({OD}, {TIERS}, {CLASSIFY} SELECT count(*) AS n, {_rates('outcome', '')} FROM outcomes WHERE cat IN (SELECT cat FROM subset WHERE tier = 'tail')) a
  CROSS JOIN ({_SURE} SELECT {_rates('outcome', '_op')} FROM outcomes WHERE cat IN (SELECT cat FROM subset WHERE tier = 'tail')) b""")
def seed_metrics(spark, d):
    return diagnose.seed_metrics(D.ground_truth(spark, d), D.detections(spark, d), tiers(spark, d))


@query("SELECT l_suppkey % 25 AS fires_on, sum(l_linenumber)::BIGINT AS n FROM lineitem WHERE l_suppkey % 25 <> 3 GROUP BY 1 ORDER BY n DESC, fires_on LIMIT 8")
def commonest_confusions(spark, d):
    k = F.col("l_suppkey") % 25
    rows = D.table(spark, d, "lineitem").select((F.col("l_orderkey") % 7).alias("seed"), F.when(k != 3, k).alias("fires_on"), F.col("l_linenumber").cast("long").alias("n"))
    return diagnose.fires_on_most(rows)


SPLIT = "sp AS (SELECT doc_id AS id, ['train', 'val', 'test'][doc_id % 3 + 1] AS split FROM documents)"


def _by_number(spark, d):
    k = F.col("doc_id")
    return D.table(spark, d, "documents").select(k.alias("id"), F.element_at(F.array(*map(F.lit, splits.SPLITS)), (k % 3 + 1).cast("int")).alias("split"))


@query(f"{OD}, {SPLIT} SELECT (SELECT count(DISTINCT pid) FROM dets) AS detected, (SELECT count(DISTINCT id) FROM sp WHERE split = 'test') AS in_split, (SELECT count(DISTINCT pid) FROM dets WHERE pid IN (SELECT id FROM sp WHERE split = 'test')) AS both")
def detected_of_split(spark, d):
    return diagnose.covers(D.detections(spark, d), _by_number(spark, d), "test")


@query(f"{OD}, {SPLIT} SELECT pid, cat, ord FROM dets WHERE pid IN (SELECT id FROM sp WHERE split = 'val')")
def detections_of_split(spark, d):
    return detect.of_split(D.detections(spark, d), _by_number(spark, d), "val").select("pid", "cat", "ord")


_CUT = """t AS (SELECT pid, cat, ord, conf, (cx * 640 + [0, 512, 1024, 1408][ord % 4 + 1]) / 2048 AS cx, (cy * 640 + 512) / 2048 AS cy, w * 640 / 2048 AS w, h * 640 / 2048 AS h FROM dets),
  ig AS (SELECT pid, (512 + x1 % 600) / 2048 AS x1, (512 + y1 % 600) / 2048 AS y1, (512 + x1 % 600 + 30) / 2048 AS x2, (512 + y1 % 600 + 30) / 2048 AS y2 FROM objects WHERE ord % 11 = 0),
  clear AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM ig WHERE ig.pid = t.pid AND t.cx BETWEEN ig.x1 AND ig.x2 AND t.cy BETWEEN ig.y1 AND ig.y2)),
  s AS (SELECT *, row_number() OVER (PARTITION BY pid, cat ORDER BY conf DESC, ord) AS r FROM clear)"""
_OVER = "greatest(0.0, least(b.cx + b.w / 2, s.cx + s.w / 2) - greatest(b.cx - b.w / 2, s.cx - s.w / 2)) * greatest(0.0, least(b.cy + b.h / 2, s.cy + s.h / 2) - greatest(b.cy - b.h / 2, s.cy - s.h / 2))"


@query(f"""{OD}, {_CUT}, kept AS (
    SELECT pid, cat, r, [struct_pack(ord := ord, conf := conf, cx := cx, cy := cy, w := w, h := h)] AS k FROM s WHERE r = 1
    UNION ALL
    SELECT s.pid, s.cat, s.r, CASE WHEN len(list_filter(kept.k, lambda b: {_OVER} / (b.w * b.h + s.w * s.h - {_OVER}) >= 0.5)) > 0 THEN kept.k
      ELSE list_append(kept.k, struct_pack(ord := s.ord, conf := s.conf, cx := s.cx, cy := s.cy, w := s.w, h := s.h)) END
    FROM kept JOIN s ON s.pid = kept.pid AND s.cat = kept.cat AND s.r = kept.r + 1),
  last AS (SELECT pid, cat, arg_max(k, r) AS k FROM kept GROUP BY pid, cat)
  SELECT pid, cat, x.ord AS ord, x.conf AS conf FROM (SELECT pid, cat, unnest(k) AS x FROM last)""")
def reconstructed(spark, d):
    t = D.detections(spark, d).withColumns({"x_off": F.element_at(F.array(*map(F.lit, (0, 512, 1024, 1408))), (F.col("ord") % 4 + 1).cast("int")), "y_off": F.lit(512)})
    o = D.objects(spark, d).where("ord % 11 = 0").select("pid", (F.col("x1") % 600).alias("x1"), (F.col("y1") % 600).alias("y1"), (F.col("x1") % 600 + 30).alias("x2"), (F.col("y1") % 600 + 30).alias("y2"), F.lit(512).alias("x_off"), F.lit(512).alias("y_off"))
    return detect.reconstruct(t, o).select("pid", "cat", "ord", "conf")


@query(f"""WITH RECURSIVE {D.HASHES}, {LINKS}, both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
  reach AS (SELECT id, id AS g FROM hashes UNION SELECT b, g FROM reach JOIN both_ways ON a = id),
  placed AS (SELECT id, min(g) AS group_id, ['train', 'val', 'test'][id % 5 % 3 + 1] AS split FROM reach GROUP BY id),
  s AS (SELECT * FROM placed UNION ALL SELECT id, group_id, 'val' FROM placed WHERE id % 50 = 0)
  SELECT 'panorama' AS kind, id::VARCHAR AS key FROM s GROUP BY id HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'group', group_id::VARCHAR FROM s GROUP BY group_id HAVING count(DISTINCT split) > 1""")
def split_leaks(spark, d):
    placed = splits.build_groups(D.hashes(spark, d)).withColumn("split", F.element_at(F.array(*map(F.lit, splits.SPLITS)), (F.col("id") % 5 % 3 + 1).cast("int")))
    return splits.leaks(placed.unionByName(placed.where("id % 50 = 0").withColumn("split", F.lit("val"))))


@query(f"""WITH {D.HASHES}, o AS (SELECT id, sha1('42|' || id) AS draw FROM hashes) SELECT id FROM o WHERE ('0x' || draw[1:8])::BIGINT % 10 < 7""")
def donor_panoramas(spark, d):
    share = F.conv(F.substring(F.sha1(F.concat_ws("|", F.lit("42"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long") % 10
    s = D.hashes(spark, d).select("id", F.when(share < 7, "train").when(share < 8, "val").otherwise("test").alias("split"))
    return splits.donor_pool(s)


@query(f"""WITH RECURSIVE {D.OBJECTS}, {SPLIT}, n AS (SELECT count(*) AS n FROM sp), names AS (SELECT DISTINCT name FROM objects)
  SELECT 'ratio of ' || split || ' drifts' AS warning FROM sp, n GROUP BY split, n HAVING abs(count(*) / n::DOUBLE - CASE split WHEN 'train' THEN 0.7 ELSE 0.15 END) > 0.05
  UNION ALL SELECT 'no instance in val: ' || name FROM names WHERE name NOT IN (SELECT name FROM objects WHERE pid IN (SELECT id FROM sp WHERE split = 'val') AND cat % 4 <> 1)""")
def split_warnings(spark, d):
    o = D.objects(spark, d)
    return splits.split_warnings(_by_number(spark, d), o.where("cat % 4 <> 1"), o.select("name").distinct())


ALLOC = "al AS (SELECT l_suppkey % 12 AS class_id, count(*) AS train_count FROM lineitem WHERE l_suppkey % 12 <> 5 GROUP BY 1)"


@query(f"""{OD}, {TIERS}, {ALLOC}, want AS (SELECT i AS class_id, 3 * i AS alloc FROM range(0, 12) t(i))
  SELECT class_id, 'c' || class_id AS name, tier, coalesce(train_count, 0)::BIGINT AS real, alloc AS synthetic, coalesce(train_count, 0) + alloc AS total FROM want JOIN subset ON cat = class_id LEFT JOIN al USING (class_id)""")
def allocation_by_class(spark, d):
    counts = D.table(spark, d, "lineitem").where("l_suppkey % 12 <> 5").groupBy((F.col("l_suppkey") % 12).alias("class_id")).agg(F.count("*").alias("train_count"))
    want = spark.range(12).select(F.col("id").alias("class_id"), (F.col("id") * 3).alias("alloc"))
    names = tiers(spark, d).withColumn("name", F.concat(F.lit("c"), F.col("id").cast("string")))
    return stats.allocation_report(want, names, counts)


@query("SELECT o_orderpriority AS strength, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def similarity_by_strength(spark, d):
    m = stats.mean_by(D.table(spark, d, "orders").select(F.col("o_orderpriority").alias("strength"), "o_totalprice"), "strength", "o_totalprice")
    return m.select("strength", "n", F.round("mean", 4).alias("mean"))


@query("SELECT doc_id AS ord, source AS class_id FROM documents ORDER BY doc_id LIMIT 30")
def first_sources(spark, d):
    return manifests.first_sources(D.table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.col("source").alias("class_id")), 30)


@query("""SELECT tile, class_id FROM (SELECT doc_id AS tile, source AS class_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r
  FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) WHERE r <= 4""")
def first_present_of_class(spark, d):
    docs = D.table(spark, d, "documents").select(F.col("doc_id").alias("tile"), F.col("source").alias("class_id"), F.col("doc_id").alias("ord"))
    there = D.table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("tile"))
    return manifests.first_present(docs, there, 4).select("tile", "class_id")


@query("SELECT ord FROM (SELECT p_partkey AS ord, p_size AS width, p_size % 11 AS height FROM part ORDER BY p_partkey LIMIT 40) WHERE least(width, height) >= 6")
def usable_crops(spark, d):
    crops = D.table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_size").alias("width"), (F.col("p_size") % 11).alias("height"))
    return manifests.usable_crops(crops).select("ord")


@query("""SELECT s.l_orderkey AS ord, s.k AS source, t.k AS tile FROM (SELECT l_orderkey, min(l_partkey) AS k FROM lineitem GROUP BY 1) s JOIN (SELECT o_orderkey, o_custkey AS k FROM orders) t ON t.o_orderkey = s.l_orderkey""")
def tiles_by_source(spark, d):
    s = D.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("ord")).agg(F.min("l_partkey").alias("source"))
    return manifests.positional(s, D.table(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("tile"))).select("ord", "source", "tile")


@query("SELECT label AS cluster, count(*) AS n FROM embeddings GROUP BY label")
def clusters_rare_first(spark, d):
    return runs.rare_first(D.table(spark, d, "embeddings").select(F.col("label").alias("cluster")))


#: The same Lloyd rounds, all starts in one row each.
LLOYD = """WITH RECURSIVE v AS (
    SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * 1048576) AS BIGINT)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT abs(CAST(e AS DOUBLE)) < 1048576)) = 0),
  drawn AS (SELECT init, x, row_number() OVER (PARTITION BY init ORDER BY sha1('42|' || init || '|' || vec_id), vec_id) AS r FROM v, range(10) t(init)),
  lloyd AS (
    SELECT 0 AS round, init, list(list_transform(x, lambda e: CAST(e AS DOUBLE)) ORDER BY r) AS c FROM drawn WHERE r <= 10 GROUP BY init
    UNION ALL
    SELECT round + 1, init, list_transform(range(1, 11), lambda j: coalesce(m[j], c[j]))
    FROM (
      SELECT round, init, any_value(c) AS c, map(list(k), list(mean)) AS m
      FROM (
        SELECT round, init, any_value(c) AS c, k, list(CAST(s AS DOUBLE) / n ORDER BY i) AS mean
        FROM (
          SELECT round, init, any_value(c) AS c, k, i, sum(x[i]) AS s, count(*) AS n
          FROM (
            SELECT round, init, c, x, list_position(far, list_min(far)) AS k, unnest(range(1, len(x) + 1)) AS i
            FROM (SELECT l.round, l.init, l.c, v.x, list_transform(l.c, lambda a: list_sum(list_transform(list_zip(v.x, a), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS far FROM lloyd l, v WHERE l.round < 20) p1) p2
          GROUP BY round, init, k, i) p3
        GROUP BY round, init, k) p4
      GROUP BY round, init) p5),
  far AS (
    SELECT init, vec_id, list_transform(c, lambda a: list_sum(list_transform(list_zip(x, a), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS far FROM lloyd, v WHERE round = 20),
  best AS (SELECT init FROM far GROUP BY init ORDER BY round(sum(list_min(far)) / 1048576.0 / 1048576.0, 6), init LIMIT 1)"""


@query(f"{LLOYD} SELECT vec_id, CAST(list_position(far, list_min(far)) - 1 AS INTEGER) AS cluster, round(sqrt(list_min(far)) / 1048576.0, 6) AS distance FROM far JOIN best USING (init)")
def background_clusters(spark, d):
    return runs.cluster(D.table(spark, d, "embeddings"), 10, rounds=20).withColumn("distance", F.round("distance", 6))


_POSITIVE = "len(list_filter(embedding[{0}:{1}], lambda e: e > 0))"


@query(f"""WITH s AS (SELECT vec_id, greatest(1, least(30, {_POSITIVE.format(1, 32)})) AS h, greatest(1, least(29, {_POSITIVE.format(33, 64)})) AS w FROM embeddings WHERE embedding IS NOT NULL)
  SELECT vec_id, CASE WHEN h * w < 0.20 * 1024 THEN 'rejected' ELSE 'ok' END AS status, round_even(h * w / 1024.0::DOUBLE, 4) AS area_ratio, CAST(1.0 AS DOUBLE) AS solidity FROM s""")
def filtered_masks(spark, d):
    """Masks drawn from all vectors: a block as high and wide as halves of a vector have positive
    components, with a hole in it, and a speck beside it that is not of the largest region."""
    @F.pandas_udf("status string, area_ratio double, solidity double")
    def told(high: pd.Series, wide: pd.Series) -> pd.DataFrame:
        found = []
        for h, w in zip(high, wide):
            m = np.zeros((32, 32), bool)
            m[1 : 1 + h, 1 : 1 + w] = True
            if h > 4 and w > 4:
                m[1 + h // 2, 1 + w // 2] = False
            m[31, 31] = True
            found.append(kernels.filter_mask(m))
        return pd.DataFrame(found, columns=["status", "area_ratio", "solidity"])

    def positive(first: int):
        return F.size(F.filter(F.slice("embedding", first, 32), lambda v: v > 0))

    e = D.table(spark, d, "embeddings").where("embedding IS NOT NULL")
    return e.select("vec_id", told(F.greatest(F.lit(1), F.least(F.lit(30), positive(1))), F.greatest(F.lit(1), F.least(F.lit(29), positive(33)))).alias("t")).select("vec_id", "t.*")
