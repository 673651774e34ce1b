"""Queries on catalogs, class subsets and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from panolith.functions import geometry as G
from panolith.functions import names as N
from panolith.operators import allocation, catalog, subset
from panolith.plans import derive as D
from panolith.plans.register import query

O = f"WITH {D.OBJECTS}"
COUNTS = "counts AS (SELECT name, count(*) AS instances, count(DISTINCT pid) AS images FROM objects GROUP BY name)"
OC = f"{O}, {COUNTS}"
_prefix = "CASE WHEN regexp_extract(name, '^([^0-9]+)', 1) = '' THEN name ELSE regexp_extract(name, '^([^0-9]+)', 1) END"
_family = "CASE name[1:1] " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in N.FAMILIES.items()) + " ELSE 'other/misc' END"


@query(f"""{OC} SELECT name, instances, images, CAST(row_number() OVER (ORDER BY instances DESC, name) AS INTEGER) AS rank,
  round(instances * 100.0 / sum(instances) OVER (), 3)::DOUBLE AS pct_instances,
  round(sum(instances) OVER (ORDER BY instances DESC, name ROWS UNBOUNDED PRECEDING) * 100.0 / sum(instances) OVER (), 3)::DOUBLE AS cum_pct FROM counts""")
def catalog_cumulative(spark, d):
    return catalog.with_shares(catalog.catalog(D.objects(spark, d)))


@query(f"WITH {D.PANOS} SELECT split_orig, count(*) AS n_panoramas FROM panoramas GROUP BY 1")
def panoramas_per_split(spark, d):
    return catalog.split_counts(D.panoramas(spark, d))


@query(f"""{O}, {D.PANOS} SELECT name, count(*) FILTER (WHERE split_orig = 'train') AS train, count(*) FILTER (WHERE split_orig = 'test') AS test,
  count(*) FILTER (WHERE split_orig = 'other') AS other FROM objects JOIN panoramas USING (pid) GROUP BY name""")
def split_pivot(spark, d):
    return catalog.split_pivot(D.objects(spark, d), D.panoramas(spark, d))


@query(f"""{O}, {D.PANOS} SELECT split_orig, count(*) AS images, count(*) FILTER (WHERE n IS NULL) AS empty
  FROM panoramas LEFT JOIN (SELECT pid, count(*) AS n FROM objects WHERE cat < 3 GROUP BY pid) USING (pid) GROUP BY 1""")
def empty_images(spark, d):
    return catalog.empty_images(D.panoramas(spark, d), D.objects(spark, d).where("cat < 3"))


@query(f"""{OC} SELECT count(*) FILTER (WHERE instances >= 100) AS ge_100, count(*) FILTER (WHERE instances >= 80) AS ge_80,
  count(*) FILTER (WHERE instances >= 50) AS ge_50, count(*) FILTER (WHERE instances < 10) AS lt_10, count(*) FILTER (WHERE instances < 5) AS lt_5 FROM counts""")
def support_thresholds(spark, d):
    return catalog.thresholds(catalog.class_counts(D.objects(spark, d)))


@query(f"{OC} SELECT {_family} AS family, {_prefix} AS prefix, count(*) AS classes, CAST(sum(instances) AS BIGINT) AS instances FROM counts GROUP BY ALL")
def family_rollup(spark, d):
    return catalog.family_rollup(catalog.class_counts(D.objects(spark, d)))


@query(f"""{O} SELECT CASE WHEN a < 1024 THEN 'small' WHEN a > 9216 THEN 'large' ELSE 'medium' END AS bin, count(*) AS n,
  round(count(*) * 100.0 / sum(count(*)) OVER (), 4)::DOUBLE AS pct FROM (SELECT (x2 - x1) * (y2 - y1) AS a FROM objects WHERE x2 > x1 AND y2 > y1) GROUP BY 1""")
def size_bins(spark, d):
    return catalog.size_bins(D.objects(spark, d))


@query(f"""{OC}, r AS (SELECT *, row_number() OVER (ORDER BY instances DESC, name) AS r, count(*) OVER () AS n FROM counts)
  SELECT max(instances) AS head, max(instances) FILTER (WHERE r = n // 2 + 1) AS upper_median,
  round(max(instances)::DOUBLE / max(instances) FILTER (WHERE r = n // 2 + 1), 4) AS ratio,
  round(sum(instances) FILTER (WHERE r <= 10) * 100.0 / sum(instances), 4)::DOUBLE AS top_pct FROM r""")
def head_ratio(spark, d):
    return catalog.head_ratio(catalog.class_counts(D.objects(spark, d)))


@query(f"""{O}, s AS (SELECT list_sort(list(x2 - x1)) AS v FROM objects)
  SELECT v[1] AS min, v[len(v)] AS max, v[10 * len(v) // 100 + 1] AS p10, v[50 * len(v) // 100 + 1] AS p50, v[90 * len(v) // 100 + 1] AS p90 FROM s""")
def width_percentiles(spark, d):
    return catalog.index_percentiles(D.objects(spark, d), F.col("x2") - F.col("x1"))


@query(f"{O} SELECT least(floor((x2 - x1) * 60 / 300), 59)::BIGINT AS bin, count(*) AS n FROM objects WHERE x2 - x1 BETWEEN 0 AND 300 GROUP BY 1")
def side_histogram(spark, d):
    return catalog.histogram(D.objects(spark, d), F.col("x2") - F.col("x1"), 300.0, 60)


@query("""WITH images AS (SELECT 1000 + 10 * (o_orderkey % 4) AS width, 800 + 10 * (o_orderkey % 3) AS height FROM orders),
  per AS (SELECT width, height, count(*) AS n FROM images GROUP BY ALL)
  SELECT width, height, n, (SELECT count(*) FROM per) AS different FROM per ORDER BY n DESC, width, height LIMIT 3""")
def top_resolutions(spark, d):
    k = F.col("o_orderkey")
    return catalog.resolutions(D.table(spark, d, "orders").select((k % 4 * 10 + 1000).alias("width"), (k % 3 * 10 + 800).alias("height")))


@query(f"""{O} SELECT name, count(*) AS instances, count(DISTINCT pid) AS images FROM objects WHERE ord % 7 <> 0 GROUP BY name""")
def coco_class_counts(spark, d):
    o = D.objects(spark, d)
    annotations = o.select(F.col("pid").alias("image_id"), F.col("cat").alias("category_id"), F.when(F.col("ord") % 7 == 0, True).alias("ignore"))
    return catalog.coco_counts(annotations, o.select(F.col("cat").alias("category_id"), "name").distinct())


@query(f"""{OC}, two AS (SELECT instances FROM counts ORDER BY instances DESC, name LIMIT 2)
  SELECT max(instances) AS first, min(instances) AS second, max(instances) > 3 * min(instances) AS suspicious FROM two""")
def catch_all_warning(spark, d):
    return catalog.catch_all(catalog.class_counts(D.objects(spark, d)))


_SUBSET = """r AS (SELECT *, row_number() OVER (ORDER BY instances DESC, name) AS k, ntile(3) OVER (ORDER BY instances DESC, name) AS band FROM counts WHERE instances >= 20),
  b AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY band) AS n FROM r),
  want AS (SELECT DISTINCT band, CASE WHEN n <= 3 THEN g ELSE CAST(round_even(g * (n - 1) / 2.0, 0) AS BIGINT) END AS i FROM b, range(0, 3) t(g) WHERE g < n),
  subset AS (SELECT name, row_number() OVER (ORDER BY k) - 1 AS id, instances, ['head', 'mid', 'tail'][band] AS tier FROM b JOIN want USING (band, i))"""


@query(f"{OC}, {_SUBSET} SELECT name, id::INTEGER AS id, instances, tier FROM subset")
def class_subset(spark, d):
    return subset.select_subset(catalog.class_counts(D.objects(spark, d)), 9, 20)


@query(f"""{OC}, {_SUBSET} SELECT name, id::INTEGER AS id, instances, tier FROM subset
  UNION ALL SELECT 'other', (SELECT count(*) FROM subset)::INTEGER, (SELECT count(*) FROM objects WHERE name NOT IN (SELECT name FROM subset)), 'distractor'""")
def subset_with_other(spark, d):
    o = D.objects(spark, d)
    chosen = subset.select_subset(catalog.class_counts(o), 9, 20)
    return subset.add_other(subset.remove_other(subset.add_other(chosen, o)), o)


@query(f"""{O}, counts AS (SELECT name, count(*) AS instances FROM objects GROUP BY name
   HAVING count(*) >= 20 AND count(*) FILTER (WHERE pid % 5 = 0) >= 5), {_SUBSET} SELECT name, id::INTEGER AS id, instances, tier FROM subset""")
def coco_subset(spark, d):
    o = D.objects(spark, d)
    return subset.select_subset_coco(catalog.class_counts(o.where("pid % 5 <> 0")), catalog.class_counts(o.where("pid % 5 = 0")), 9, 20, 5)


TRAIN = f"train AS (SELECT s.id AS class_id, count(o.name) AS train_count FROM subset s LEFT JOIN (SELECT name FROM objects WHERE pid % 10 < 7) o USING (name) GROUP BY s.id)"


@query(f"{OC}, {_SUBSET}, {TRAIN} SELECT class_id::INTEGER AS class_id, train_count FROM train")
def train_instance_counts(spark, d):
    o = D.objects(spark, d)
    return allocation.train_counts(o.where("pid % 10 < 7"), subset.select_subset(catalog.class_counts(o), 9, 20))


@query(f"""{OC}, {_SUBSET}, {TRAIN},
  budget AS (SELECT CAST(round_even(0.1 * sum(train_count), 0) AS BIGINT) AS b FROM train),
  caps AS (SELECT class_id, train_count, least(CAST(floor(3.0 * train_count) AS BIGINT), b) AS cap, b FROM train, budget),
  units AS (SELECT class_id, row_number() OVER (ORDER BY train_count + j, class_id) AS r, b FROM caps, range(0, (SELECT max(cap) FROM caps)) t(j) WHERE j < cap),
  got AS (SELECT class_id, count(*) AS n FROM units WHERE r <= b GROUP BY class_id)
  SELECT class_id::INTEGER AS class_id, train_count, coalesce(n, 0) AS alloc, b AS budget FROM train LEFT JOIN got USING (class_id), budget""")
def water_filled_allocation(spark, d):
    o = D.objects(spark, d)
    return allocation.build_allocation(o.where("pid % 10 < 7"), subset.select_subset(catalog.class_counts(o), 9, 20), k=0.1, alpha=3.0).drop("b_effective")


@query(f"{O}, {COUNTS} SELECT name, instances FROM counts ORDER BY instances DESC, name LIMIT 5")
def most_common_classes(spark, d):
    return catalog.class_counts(D.objects(spark, d)).orderBy(F.desc("instances"), "name").limit(5).select("name", "instances")


@query(f"{O} SELECT cat, max(x2 - x1) AS side, arg_max(ord, (x2 - x1, -ord)) AS ord FROM objects GROUP BY cat")
def largest_crop(spark, d):
    return D.objects(spark, d).groupBy("cat").agg(F.max(F.col("x2") - F.col("x1")).alias("side"), F.max_by("ord", F.struct(F.col("x2") - F.col("x1"), -F.col("ord"))).alias("ord"))
