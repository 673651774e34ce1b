"""Queries on groups, splits and tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from panolith.functions import geometry as G
from panolith.functions import names as N
from panolith.operators import catalog, splits, subset, tiling
from panolith.plans import derive as D
from panolith.plans.queries_catalog import _SUBSET, OC
from panolith.plans.register import query

#: Classes of equal hashes by their least id: links to their copies, and between classes within five bits.
LINKS = """classes AS (SELECT hash, min(id) AS id FROM hashes GROUP BY hash),
  links AS (SELECT a.id AS a, b.id AS b FROM classes a JOIN classes b ON a.id < b.id AND bit_count(xor(a.hash, b.hash)) <= 5
    UNION ALL SELECT c.id, h.id FROM hashes h JOIN classes c ON c.hash = h.hash AND c.id <> h.id)"""
GROUPS = """both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
  reach AS (SELECT id, id AS g FROM hashes UNION SELECT b, g FROM reach JOIN both_ways ON a = id),
  grouped AS (SELECT id, min(g) AS group_id FROM reach GROUP BY id)"""


@query(f"WITH {D.HASHES}, {LINKS} SELECT a, b FROM links")
def near_image_links(spark, d):
    return splits.hamming_links(D.hashes(spark, d))


@query(f"WITH RECURSIVE {D.HASHES}, {LINKS}, {GROUPS} SELECT id, group_id FROM grouped")
def image_groups(spark, d):
    return splits.build_groups(D.hashes(spark, d))


def _subset(o):
    return subset.select_subset(catalog.class_counts(o), 9, 20)


def _splits(spark, d):
    h = D.hashes(spark, d)
    images = h.select(F.col("id").alias("pid"))
    o = D.objects(spark, d).join(images, "pid", "left_semi")
    return splits.make_splits(h, images, o, _subset(D.objects(spark, d)), min_test=5), o


#: One group after another, then one move after another.
FOLDED = f"""WITH RECURSIVE {D.HASHES}, {LINKS}, {GROUPS}, {OC.removeprefix('WITH ')}, {_SUBSET},
  sized AS (SELECT group_id, count(*) AS size FROM grouped GROUP BY group_id),
  turn AS (SELECT group_id, size, row_number() OVER (ORDER BY sha1('42|' || group_id), group_id) AS r, CAST(sum(size) OVER () AS DOUBLE) AS total FROM sized),
  fold AS (
    SELECT 0::BIGINT AS r, 0::BIGINT AS train, 0::BIGINT AS val, 0::BIGINT AS test, '' AS split, -1::BIGINT AS group_id
    UNION ALL
    SELECT r, train + CASE split WHEN 'train' THEN size ELSE 0 END, val + CASE split WHEN 'val' THEN size ELSE 0 END, test + CASE split WHEN 'test' THEN size ELSE 0 END, split, group_id
    FROM (SELECT t.r, t.size, t.group_id, f.train, f.val, f.test,
            CASE WHEN a >= b AND a >= c THEN 'train' WHEN b >= c THEN 'val' ELSE 'test' END AS split
          FROM (SELECT *, CAST(0.70 AS DOUBLE) * (SELECT max(total) FROM turn) - train AS a, CAST(0.15 AS DOUBLE) * (SELECT max(total) FROM turn) - val AS b, CAST(0.15 AS DOUBLE) * (SELECT max(total) FROM turn) - test AS c FROM fold) f
          JOIN turn t ON t.r = f.r + 1) x),
  counted AS (SELECT g.group_id, s.k, count(*) AS n, any_value(f.split) AS split FROM objects o JOIN grouped g ON g.id = o.pid JOIN (SELECT name, row_number() OVER (ORDER BY name) AS k FROM subset) s USING (name) JOIN fold f ON f.group_id = g.group_id GROUP BY g.group_id, s.k),
  walk AS (
    SELECT 1::BIGINT AS k, CAST([] AS BIGINT[]) AS moved
    UNION ALL
    SELECT CASE WHEN have >= 5 THEN k + 1 ELSE k END, CASE WHEN have >= 5 THEN moved ELSE list_append(moved, best) END
    FROM (SELECT w.k, w.moved, coalesce(sum(c.n) FILTER (WHERE c.split = 'test' OR list_contains(w.moved, c.group_id)), 0) AS have,
            arg_min(c.group_id, (-c.n, c.group_id)) FILTER (WHERE c.split = 'train' AND NOT list_contains(w.moved, c.group_id)) AS best
          FROM walk w LEFT JOIN counted c ON c.k = w.k WHERE w.k <= (SELECT count(*) FROM subset) GROUP BY w.k, w.moved) x),
  moves AS (SELECT unnest(moved) AS group_id FROM (SELECT moved FROM walk ORDER BY k DESC, len(moved) DESC LIMIT 1)),
  splits AS (SELECT g.id, g.group_id, CASE WHEN m.group_id IS NOT NULL THEN 'test' ELSE f.split END AS split FROM grouped g JOIN fold f USING (group_id) LEFT JOIN moves m USING (group_id))"""


@query(f"{FOLDED} SELECT id, group_id, split FROM splits")
def group_splits(spark, d):
    return _splits(spark, d)[0]


@query("""WITH s AS (SELECT o_orderkey, 100 + o_orderkey % 3000 AS length FROM orders)
  SELECT o_orderkey, CASE WHEN length <= 640 THEN [0::BIGINT] ELSE list_distinct(list_concat(range(0, length - 639, 512), [length - 640])) END AS offs FROM s""".replace("list_distinct(list_concat(range(0, length - 639, 512), [length - 640]))", "list_sort(list_distinct(list_concat(range(0, length - 639, 512), [length - 640])))"))
def tile_offsets(spark, d):
    return D.table(spark, d, "orders").select("o_orderkey", G.offset_array(F.col("o_orderkey") % 3000 + 100).alias("offs"))


GRID = "grid AS (SELECT x.v AS tx, y.v AS ty FROM (VALUES (0), (512), (1024), (1408)) x(v), (VALUES (0), (512), (1024), (1408)) y(v))"
CUT = f"""{_SUBSET}, {GRID}, met AS (SELECT o.*, s.id AS class_id, tx, ty, greatest(x1, tx) AS a1, greatest(y1, ty) AS b1, least(x2, tx + 640) AS a2, least(y2, ty + 640) AS b2
    FROM objects o LEFT JOIN subset s USING (name) JOIN grid ON x1 < tx + 640 AND x2 > tx AND y1 < ty + 640 AND y2 > ty),
  cut AS (SELECT *, (a2 - a1) * (b2 - b1) / ((x2 - x1) * (y2 - y1)) AS vf FROM met)"""


def _tile_sql(kind: str, other: str) -> str:
    return f"""{OC}, {CUT}, kinds AS (SELECT *, {kind} AS kind FROM cut)
  SELECT pid, tx::INTEGER AS x_off, ty::INTEGER AS y_off, kind, (CASE WHEN kind = 'other' THEN {other} ELSE class_id END)::INTEGER AS class_id,
  (a1 - tx + (a2 - tx)) / 2 / 640 AS cx, (b1 - ty + (b2 - ty)) / 2 / 640 AS cy, (a2 - tx - (a1 - tx)) / 640 AS w, (b2 - ty - (b1 - ty)) / 640 AS h,
  a1 - tx AS ix1, b1 - ty AS iy1, a2 - tx AS ix2, b2 - ty AS iy2 FROM kinds WHERE kind <> 'drop'"""


@query(_tile_sql("CASE WHEN vf <= 0.2 THEN 'drop' WHEN class_id IS NOT NULL AND vf >= 0.6 THEN 'label' ELSE 'ignore' END", "NULL"))
def tile_labels(spark, d):
    o = D.objects(spark, d)
    return tiling.tile_objects(o, _subset(o))


_LOOK = """look AS (SELECT DISTINCT name FROM objects WHERE name NOT IN (SELECT name FROM subset)
  AND regexp_extract(name, '^([A-Za-z]+)', 1) IN (SELECT regexp_extract(name, '^([A-Za-z]+)', 1) FROM subset WHERE tier = 'tail'))"""


@query(f"{OC}, {_SUBSET}, {_LOOK} SELECT name FROM look")
def tail_lookalikes(spark, d):
    o = D.objects(spark, d)
    return tiling.lookalikes(o, _subset(o))


@query(_tile_sql("""CASE WHEN vf <= 0.2 THEN 'drop' WHEN class_id IS NOT NULL AND vf >= 0.6 THEN 'label'
  WHEN class_id IS NULL AND vf >= 0.6 AND regexp_extract(name, '^([A-Za-z]+)', 1) NOT IN (SELECT regexp_extract(name, '^([A-Za-z]+)', 1) FROM subset WHERE tier = 'tail') THEN 'other' ELSE 'ignore' END""", "9"))
def tile_labels_with_other(spark, d):
    o = D.objects(spark, d)
    s = _subset(o)
    return tiling.tile_objects(o, s, other_id=9, never_other=tiling.lookalikes(o, s))


_SHA = "(((('0x' || s[1:10])::BIGINT % 1000 * 776 + ('0x' || s[11:20])::BIGINT) % 1000 * 776 + ('0x' || s[21:30])::BIGINT) % 1000 * 776 + ('0x' || s[31:40])::BIGINT) % 1000"


@query(f"""{OC}, {D.PANOS}, {CUT}, labels AS (SELECT pid, tx, ty, count(*) AS n FROM cut WHERE class_id IS NOT NULL AND vf >= 0.6 GROUP BY ALL),
  tiles AS (SELECT p.pid || '_' || tx || '_' || ty AS tile, p.pid, tx::INTEGER AS x_off, ty::INTEGER AS y_off, coalesce(n, 0) AS labels
    FROM panoramas p CROSS JOIN grid LEFT JOIN labels l USING (pid, tx, ty))
  SELECT tile, pid, x_off, y_off, labels FROM (SELECT *, sha1(tile) AS s FROM tiles) WHERE labels > 0 OR {_SHA} < 100""")
def kept_train_tiles(spark, d):
    o = D.objects(spark, d)
    return tiling.kept_tiles(D.panoramas(spark, d), tiling.tile_objects(o, _subset(o)))


@query(f"""WITH {D.OBJECTS}, {GRID} SELECT ord FROM objects WHERE EXISTS (SELECT 1 FROM grid
  WHERE greatest(0, least(x2, tx + 640) - greatest(x1, tx)) * greatest(0, least(y2, ty + 640) - greatest(y1, ty)) / ((x2 - x1) * (y2 - y1)) >= 0.6)""")
def labelable_objects(spark, d):
    return tiling.labelable(D.objects(spark, d)).select("ord")


@query(f"""WITH {D.OBJECTS}, wide AS (SELECT x1, y1, x1 + 3 * (x2 - x1) AS x2, y1 + 3 * (y2 - y1) AS y2 FROM objects), {GRID},
  seen AS (SELECT EXISTS (SELECT 1 FROM grid WHERE greatest(0, least(x2, tx + 640) - greatest(x1, tx)) * greatest(0, least(y2, ty + 640) - greatest(y1, ty)) / ((x2 - x1) * (y2 - y1)) >= 0.6) AS shown FROM wide)
  SELECT count(*) FILTER (WHERE shown) AS n, count(*) FILTER (WHERE NOT shown) AS n_excluded FROM seen""")
def excluded_objects(spark, d):
    """Objects three times as large, of which some are cut by the border beyond use."""
    wide = D.objects(spark, d).withColumns({"x2": F.col("x1") + 3 * (F.col("x2") - F.col("x1")), "y2": F.col("y1") + 3 * (F.col("y2") - F.col("y1"))})
    return tiling.labelable_counts(wide)


@query(f"""{OC}, a AS (SELECT DISTINCT name FROM objects WHERE pid % 2 = 0), b AS (SELECT DISTINCT name FROM objects WHERE pid % 3 = 0 AND cat > 4)
  SELECT 'both' AS op, name FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'any', name FROM (SELECT * FROM a UNION SELECT * FROM b)
  UNION ALL SELECT 'only', name FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def category_sets(spark, d):
    o = D.objects(spark, d)
    a, b = o.where("pid % 2 = 0").select("name").distinct(), o.where("pid % 3 = 0 AND cat > 4").select("name").distinct()
    return a.intersect(b).select(F.lit("both").alias("op"), "name").unionByName(a.union(b).distinct().select(F.lit("any").alias("op"), "name")).unionByName(a.exceptAll(b).select(F.lit("only").alias("op"), "name"))
