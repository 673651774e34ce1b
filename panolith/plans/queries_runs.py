"""Queries on manifests, statistics over runs and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from panolith.operators import allocation, manifests, metrics, quantiles, runs, stats
from panolith.plans import derive as D
from panolith.plans.queries_detect import _B, ALL, AP, FIRST, OD, TIERS, tiers
from panolith.plans.register import query

EVENTS = """e AS (SELECT CAST(user_id % 7 AS INTEGER) AS seed, event_type AS arm, value FROM events),
  headline AS (SELECT arm, seed, round(avg(value), 6) AS ap_tail, CASE WHEN seed = 3 THEN 'NaN'::DOUBLE ELSE round(avg(value) / 2, 6) END AS ap_small FROM e GROUP BY arm, seed)"""


def headlines(spark, d):
    e = D.table(spark, d, "events").select((F.col("user_id") % 7).cast("int").alias("seed"), F.col("event_type").alias("arm"), "value")
    return e.groupBy("arm", "seed").agg(F.round(F.avg("value"), 6).alias("ap_tail"), F.when(F.col("seed") == 3, F.lit(float("nan"))).otherwise(F.round(F.avg("value") / 2, 6)).alias("ap_small"))


@query(f"""WITH {EVENTS} SELECT arm, count(*) AS n, round(avg(ap_tail), 4) AS ap_tail_mean, round(stddev_samp(ap_tail), 4) AS ap_tail_std,
  round(avg(ap_small) FILTER (WHERE NOT isnan(ap_small)), 4) AS ap_small_mean, round(stddev_samp(ap_small) FILTER (WHERE NOT isnan(ap_small)), 4) AS ap_small_std FROM headline GROUP BY arm""")
def arm_summaries(spark, d):
    return stats.aggregate_runs(headlines(spark, d), ["arm"], ["ap_tail", "ap_small"])


@query(f"""WITH {EVENTS}, b AS (SELECT min(arm) AS base FROM headline),
  x AS (SELECT t.arm, t.seed, t.ap_tail - c.ap_tail AS delta FROM headline t JOIN headline c ON c.seed = t.seed JOIN b ON c.arm = b.base AND t.arm <> b.base)
  SELECT arm, count(*) AS n, round(avg(delta), 6) AS mean, round(avg(delta) - 2.447 * stddev_samp(delta) / sqrt(count(*)), 6) AS low, round(avg(delta) + 2.447 * stddev_samp(delta) / sqrt(count(*)), 6) AS high,
  round(median(delta), 6) AS median, count(*) FILTER (WHERE delta > 0) AS n_positive FROM x GROUP BY arm""")
def paired_contrasts(spark, d):
    h = headlines(spark, d)
    base = h.agg(F.min("arm").alias("base"))
    marked = h.crossJoin(F.broadcast(base))
    c = stats.paired_ci(stats.paired(marked.where("arm <> base"), marked.where("arm = base"), ["arm"], "ap_tail"), ["arm"])
    return c.select("arm", "n", *[F.round(x, 6).alias(x) for x in ("mean", "low", "high", "median")], "n_positive")


@query("SELECT event_type, round(quantile_cont(CAST(value AS DOUBLE), 0.025), 6) AS low, round(quantile_cont(CAST(value AS DOUBLE), 0.5), 6) AS mid, round(quantile_cont(CAST(value AS DOUBLE), 0.975), 6) AS high FROM events GROUP BY 1")
def value_percentiles(spark, d):
    out = quantiles.quantiles(D.table(spark, d, "events"), ["event_type"], F.col("value"), {"low": 0.025, "mid": 0.5, "high": 0.975})
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("low", "mid", "high")])


def _contrast(spark, d):
    t = D.detections(spark, d, 0).withColumn("seed", F.lit(0))
    b = D.detections(spark, d, 1).where(F.col("ord") % 5 != 0).withColumn("seed", F.lit(0))
    return t, b, D.ground_truth(spark, d)


@query()
def bootstrap_contrast(spark, d):
    out = stats.bootstrap_delta(*_contrast(spark, d), tail=[0, 1, 2, 3], replicas=1000)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def _mix(z: str) -> str:
    """The finaliser of splitmix64 over 128-bit integers."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = f"((SELECT xor(z, z >> {shift}) * {factor}::UHUGEINT % {1 << 64}::UHUGEINT FROM (SELECT {z} AS z)))"
    return f"(SELECT xor(z, z >> 31) FROM (SELECT {z} AS z))"


_GOLDEN = f"{0x9E3779B97F4A7C15}::UHUGEINT"
_FAR = 10**9  # panoramas of the second run, so that one fold matches both
REPLICAS = 40


@query(f"""{OD}, {D.dets_sql(1, "dets1")},
  g AS (SELECT pid, cat, ord, cx, cy, w, h FROM gts UNION ALL SELECT pid + {_FAR}, cat, ord, cx, cy, w, h FROM gts),
  e AS (SELECT pid, cat, ord, conf, cx, cy, w, h FROM dets UNION ALL SELECT pid + {_FAR}, cat, ord, conf, cx, cy, w, h FROM dets1 WHERE ord % 5 <> 0), {FIRST},
  rows AS (SELECT CASE WHEN pid < {_FAR} THEN 't' ELSE 'b' END AS arm, pid % {_FAR} AS pid, cat, ord, conf, gi IS NOT NULL AS tp FROM matched),
  pan AS (SELECT pid, row_number() OVER (ORDER BY pid) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT pid FROM gts)),
  own AS (SELECT r AS replica, {_mix("r::UHUGEINT")} AS k FROM range({REPLICAS}) t(r)),
  draws AS (SELECT replica, CAST({_mix(f"(k + i::UHUGEINT * {_GOLDEN}) % {1 << 64}::UHUGEINT")} % n::UHUGEINT AS BIGINT) AS i FROM own, pan),
  w AS (SELECT replica, pid, count(*) AS m FROM draws JOIN pan USING (i) GROUP BY ALL),
  truth AS (SELECT replica, cat, sum(m * k) AS n_gt FROM w JOIN (SELECT pid, cat, count(*) AS k FROM gts GROUP BY ALL) USING (pid) GROUP BY ALL),
  curve AS (SELECT arm, replica, cat, tp, sum(m * tp::INT) OVER o AS hits, sum(m) OVER o AS seen FROM rows JOIN w USING (pid) WINDOW o AS (PARTITION BY arm, replica, cat ORDER BY conf DESC, ord, pid ROWS UNBOUNDED PRECEDING)),
  best AS (SELECT arm, replica, cat, len(list_filter(range(0, 101), lambda i: i * CAST(0.01 AS DOUBLE) <= hits::DOUBLE / n_gt::DOUBLE)) AS reached, max(hits::DOUBLE / seen::DOUBLE) AS p FROM curve JOIN truth USING (replica, cat) WHERE tp GROUP BY ALL),
  beyond AS (SELECT arm, replica, cat, i, max(p) AS p FROM best JOIN range(0, 101) t(i) ON i < reached GROUP BY ALL),
  ap AS (SELECT arm, replica, cat, sum(p) / 101 AS ap FROM beyond GROUP BY ALL),
  every AS (SELECT a.arm, replica, cat, coalesce(ap, 0) AS ap FROM truth CROSS JOIN (VALUES ('t'), ('b')) a(arm) LEFT JOIN ap USING (arm, replica, cat)),
  per AS (SELECT arm, replica, avg(ap) AS macro, coalesce(avg(ap) FILTER (WHERE cat < 4), 0) AS tail FROM every GROUP BY ALL)
  SELECT t.replica, round(t.macro - b.macro, 6) AS macro, round(t.tail - b.tail, 6) AS tail FROM per t JOIN per b ON t.replica = b.replica AND t.arm = 't' AND b.arm = 'b'""")
def bootstrap_replicas(spark, d):
    out = stats.bootstrap_deltas(*_contrast(spark, d), tail=[0, 1, 2, 3], replicas=REPLICAS)
    return out.select("replica", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


CURVE = "curve AS (SELECT event_type AS arm, CAST(event_id % 12 AS INTEGER) AS epoch, round(avg(value), 6) AS loss, round(1 / (1 + avg(value)), 6) AS map FROM events GROUP BY 1, 2)"


def curves(spark, d):
    v = F.avg("value")
    return D.table(spark, d, "events").groupBy(F.col("event_type").alias("arm"), (F.col("event_id") % 12).cast("int").alias("epoch")).agg(F.round(v, 6).alias("loss"), F.round(1 / (v + 1), 6).alias("map"))


@query(f"""WITH {CURVE}, r AS (SELECT arm, (lag(loss, 5) OVER w - loss) / lag(loss, 5) OVER w AS drop, epoch FROM curve WINDOW w AS (PARTITION BY arm ORDER BY epoch))
  SELECT arm, round(drop, 6) AS drop, drop <= 0.3 AS plateaued FROM r WHERE epoch = 11""")
def loss_plateaus(spark, d):
    return runs.plateaued(curves(spark, d), ["arm"]).select("arm", F.round("drop", 6).alias("drop"), "plateaued")


@query(f"""WITH {CURVE} SELECT arm, count(*) AS epochs, arg_min(epoch, (-map, epoch)) AS best_epoch, max(map) AS best, arg_max(map, epoch) AS last, count(DISTINCT round(map, 4)) > 1 AS has_val,
  round(max(map) - arg_max(map, epoch), 6) AS gap, round((max(loss) FILTER (WHERE epoch = 9) - max(loss) FILTER (WHERE epoch = 11)) / max(loss) FILTER (WHERE epoch = 9), 6) AS late_drop FROM curve GROUP BY arm""")
def epoch_reports(spark, d):
    r = runs.epoch_report(curves(spark, d), ["arm"])
    return r.select("arm", "epochs", "best_epoch", "best", "last", "has_val", F.round("gap", 6).alias("gap"), F.round("late_drop", 6).alias("late_drop"))


STATUS = "status AS (SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'failed' ELSE 'running' END AS status FROM orders)"


def statuses(spark, d):
    s = F.col("o_orderstatus")
    return D.table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(s == "F", "done").when(s == "O", "failed").otherwise("running").alias("status"))


@query(f"WITH {STATUS}, up AS (SELECT run_id, CASE WHEN run_id % 10 = 0 THEN 'done' ELSE status END AS status FROM status) SELECT count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'running') AS running FROM up")
def status_tallies(spark, d):
    s = statuses(spark, d)
    return runs.tallies(runs.upsert(s, s.where("run_id % 10 = 0").withColumn("status", F.lit("done"))))


@query("""WITH g AS (SELECT CAST(o_custkey % 5 AS INTEGER) AS arm, o_orderkey AS seed, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS headline, CASE WHEN o_orderkey % 11 <> 0 THEN 'd' END AS dets FROM orders),
  s AS (SELECT arm, seed, headline + 1 AS headline, CASE WHEN seed % 2 = 0 THEN 's' END AS dets FROM g WHERE seed % 3 = 0)
  SELECT arm, seed, CASE WHEN s.headline IS NOT NULL AND s.dets IS NOT NULL THEN s.headline ELSE g.headline END AS headline, CASE WHEN s.headline IS NOT NULL AND s.dets IS NOT NULL THEN s.dets ELSE g.dets END AS dets
  FROM g FULL JOIN s USING (arm, seed) WHERE CASE WHEN s.headline IS NOT NULL AND s.dets IS NOT NULL THEN true ELSE g.headline IS NOT NULL AND g.dets IS NOT NULL END""")
def loaded_runs(spark, d):
    k = F.col("o_orderkey")
    g = D.table(spark, d, "orders").select((F.col("o_custkey") % 5).cast("int").alias("arm"), k.alias("seed"), F.when(k % 7 != 0, F.col("o_totalprice")).alias("headline"), F.when(k % 11 != 0, "d").alias("dets"))
    s = g.where("seed % 3 = 0").select("arm", "seed", (F.col("headline") + 1).alias("headline"), F.when(F.col("seed") % 2 == 0, "s").alias("dets"))
    return runs.prefer_split(s, g)


@query("""WITH r AS (SELECT l_partkey % 25 AS cat, ['zero_aug', 'copy_paste', 'bg_photometric'][l_suppkey % 3 + 1] AS arm, l_discount AS ap50 FROM lineitem),
  per AS (SELECT cat, arm, avg(ap50) AS ap FROM r GROUP BY ALL), b AS (SELECT cat, ap AS base_ap FROM per WHERE arm = 'zero_aug'),
  o AS (SELECT cat, arg_min(arm, (-ap, arm)) AS best_arm, max(ap) AS best_ap FROM per WHERE arm <> 'zero_aug' GROUP BY cat)
  SELECT cat, round(base_ap, 6) AS base_ap, best_arm, round(best_ap, 6) AS best_ap, round(best_ap - base_ap, 6) AS gain FROM b JOIN o USING (cat)""")
def class_gains(spark, d):
    arm = F.element_at(F.array(*map(F.lit, ("zero_aug", "copy_paste", "bg_photometric"))), (F.col("l_suppkey") % 3 + 1).cast("int"))
    r = D.table(spark, d, "lineitem").select((F.col("l_partkey") % 25).alias("cat"), arm.alias("arm"), F.col("l_discount").alias("ap50"))
    out = stats.class_report(r, "zero_aug")
    return out.select("cat", F.round("base_ap", 6).alias("base_ap"), "best_arm", F.round("best_ap", 6).alias("best_ap"), F.round("gain", 6).alias("gain"))


LABELS = "p AS (SELECT vec_id, label AS y, CASE WHEN vec_id % 4 = 0 THEN (label + 1) % 10 ELSE label END AS p, (vec_id % 100) / 100.0::DOUBLE AS conf FROM embeddings)"


def predictions(spark, d):
    k = F.col("vec_id")
    return D.table(spark, d, "embeddings").select("vec_id", F.col("label").alias("y"), F.when(k % 4 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("p"), ((k % 100) / 100.0).alias("conf"))


@query(f"WITH {LABELS} SELECT y, count(*) AS n, round(avg((y = p)::INT), 6) AS top1_acc, round(avg((y = p AND conf >= 0.5)::INT), 6) AS accept_rate, round(avg(conf), 6) AS mean_p FROM p GROUP BY y")
def verifier_rates(spark, d):
    p = predictions(spark, d).select("y", F.col("p").alias("pred"), F.col("y").alias("intended"), "conf", F.col("conf").alias("p_intended"))
    r = runs.valid_rate(p, 0.5, ["y"])
    return r.select("y", "n", *[F.round(c, 6).alias(c) for c in ("top1_acc", "accept_rate", "mean_p")])


@query(f"WITH {LABELS} SELECT y, p, count(*) AS n FROM p GROUP BY y, p")
def confusion_matrix(spark, d):
    return runs.confusion(predictions(spark, d))


@query(f"WITH {LABELS} SELECT y, count(*) AS n, round(avg((y = p)::INT), 6) AS recall, round((SELECT avg((y = p)::INT) FROM p), 6) AS accuracy FROM p GROUP BY y")
def class_recalls(spark, d):
    return runs.recalls(predictions(spark, d)).select("y", "n", F.round("recall", 6).alias("recall"), F.round("accuracy", 6).alias("accuracy"))


@query("SELECT o_orderpriority AS kind, sum(o_custkey)::BIGINT AS n, round(sum(o_totalprice * o_custkey) / sum(o_custkey), 2) AS accuracy, round(stddev_pop(o_totalprice), 2) AS std FROM orders GROUP BY 1")
def weighted_accuracies(spark, d):
    r = runs.weighted_accuracy(D.table(spark, d, "orders").select(F.col("o_orderpriority").alias("kind"), F.col("o_custkey").alias("n"), F.col("o_totalprice").alias("acc")))
    return r.select("kind", "n", F.round("accuracy", 2).alias("accuracy"), F.round("std", 2).alias("std"))


DIST = """parts AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
  means AS (SELECT label, i, avg(x) AS m FROM parts GROUP BY ALL),
  dist AS (SELECT vec_id, label AS cluster, sqrt(sum((x - m) * (x - m))) AS distance FROM parts JOIN means USING (label, i) GROUP BY ALL)"""


@query(f"WITH {DIST} SELECT cluster, count(*) AS n, round(avg(distance), 5) AS mean FROM dist GROUP BY cluster")
def cluster_sizes(spark, d):
    return runs.to_centroids(D.table(spark, d, "embeddings")).groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.avg("distance"), 5).alias("mean"))


@query(f"""WITH {DIST}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY distance, vec_id) AS r FROM dist)
  SELECT 'near' AS kind, cluster, vec_id, round(distance, 5) AS distance FROM r WHERE r <= 9 UNION ALL SELECT * FROM (SELECT 'far', cluster, vec_id, round(distance, 5) FROM dist ORDER BY distance DESC, vec_id LIMIT 15)""")
def cluster_extremes(spark, d):
    e = runs.extremes(runs.to_centroids(D.table(spark, d, "embeddings")))
    return e.withColumn("distance", F.round("distance", 5))


LABELLED = "labels_t AS (SELECT 't' || l_orderkey || '_' || l_linenumber AS tile, l_partkey % 9 AS class_id, (l_partkey % 100) / 100.0::DOUBLE AS cx, (l_suppkey % 100) / 100.0::DOUBLE AS cy, 0.1::DOUBLE AS w, 0.1::DOUBLE AS h FROM lineitem)"


def tile_labels_of(spark, d):
    t = D.table(spark, d, "lineitem")
    return t.select(F.format_string("t%d_%d", "l_orderkey", "l_linenumber").alias("tile"), (F.col("l_partkey") % 9).alias("class_id"), ((F.col("l_partkey") % 100) / 100.0).alias("cx"), ((F.col("l_suppkey") % 100) / 100.0).alias("cy"), F.lit(0.1).alias("w"), F.lit(0.1).alias("h"))


_DRAW = "('0x' || sha1({})[1:12])::BIGINT % 1000000000"
INDEX = f"{LABELLED}, idx AS (SELECT class_id, tile, cx, cy, w, h FROM labels_t WHERE tile IN (SELECT tile FROM labels_t GROUP BY tile HAVING count(*) = 1))"
SOURCES = f"""{INDEX}, want AS (SELECT c AS class_id, k FROM range(0, 9) a(c), range(0, 30) b(k) WHERE k < 2 + 3 * c),
  pool AS (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY tile, cx, cy, w, h) - 1 AS i, count(*) OVER (PARTITION BY class_id) AS n FROM idx),
  src AS (SELECT want.class_id, k, tile, cx, cy, w, h FROM want JOIN pool ON pool.class_id = want.class_id AND i = {_DRAW.format("'42|' || want.class_id || '|' || k")} % n)"""


def _alloc(spark):
    return spark.range(9).select(F.col("id").alias("class_id"), (F.col("id") * 3 + 2).alias("alloc"))


@query(f"WITH {INDEX} SELECT * FROM idx")
def single_sign_index(spark, d):
    return manifests.index_instances(tile_labels_of(spark, d))


@query(f"WITH {SOURCES} SELECT * FROM src")
def source_manifest(spark, d):
    return manifests.select_sources(_alloc(spark), manifests.index_instances(tile_labels_of(spark, d)))


@query(f"""WITH {SOURCES}, don AS (SELECT *, row_number() OVER (ORDER BY tile, cx, cy, w, h) - 1 AS j, count(*) OVER () AS n FROM idx)
  SELECT src.class_id, k, src.tile, src.cx, src.cy, src.w, src.h, don.tile AS recipient, don.cx AS pcx, don.cy AS pcy, don.w AS pw, don.h AS ph
  FROM src JOIN don ON j = {_DRAW.format("'42|donor|' || src.class_id || '|' || k")} % n""")
def realistic_placements(spark, d):
    index = manifests.index_instances(tile_labels_of(spark, d))
    return manifests.assign_placements_realistic(manifests.select_sources(_alloc(spark), index), index)


def _unit(name: str) -> str:
    key = f"'42|{name}|' || src.class_id || '|' || k"
    return f"({_DRAW.format(key)} / 1e9)"


_SCALE = f"(({_unit('jitter')} * 2 - 1) * 0.2 + 1)"


@query(f"""WITH {SOURCES}, rec AS (SELECT tile AS recipient, row_number() OVER (ORDER BY tile) - 1 AS j, count(*) OVER () AS n FROM (SELECT DISTINCT tile FROM labels_t))
  SELECT src.class_id, k, src.tile, recipient, round(least(src.w * {_SCALE}, 0.9), 6) AS pw, round(least(src.h * {_SCALE}, 0.9), 6) AS ph,
  round({_unit('cx')} * (1 - 2 * 0.15) + 0.15, 6) AS pcx, round({_unit('cy')} * (1 - 2 * 0.15) + 0.15, 6) AS pcy
  FROM src JOIN rec ON j = {_DRAW.format("'42|recipient|' || src.class_id || '|' || k")} % n""")
def jittered_placements(spark, d):
    labels = tile_labels_of(spark, d)
    sources = manifests.select_sources(_alloc(spark), manifests.index_instances(labels))
    placed = manifests.assign_placements(sources, labels.select("tile").distinct())
    return placed.select("class_id", "k", "tile", "recipient", *[F.round(c, 6).alias(c) for c in ("pw", "ph", "pcx", "pcy")])


@query(f"""WITH {SOURCES}, don AS (SELECT *, row_number() OVER (ORDER BY tile, cx, cy, w, h) - 1 AS j, count(*) OVER () AS n FROM idx),
  pl AS (SELECT don.* FROM src JOIN don ON j = {_DRAW.format("'42|donor|' || src.class_id || '|' || k")} % n)
  SELECT l.tile, l.class_id, l.cx, l.cy FROM labels_t l WHERE NOT EXISTS (SELECT 1 FROM pl WHERE pl.tile = l.tile AND greatest(0, least(pl.cx, l.cx) + 0.05 - greatest(pl.cx, l.cx) + 0.05) * greatest(0, least(pl.cy, l.cy) + 0.05 - greatest(pl.cy, l.cy) + 0.05) / (0.02 - greatest(0, least(pl.cx, l.cx) + 0.05 - greatest(pl.cx, l.cx) + 0.05) * greatest(0, least(pl.cy, l.cy) + 0.05 - greatest(pl.cy, l.cy) + 0.05)) > 0.3)""")
def labels_after_paste(spark, d):
    labels = tile_labels_of(spark, d)
    index = manifests.index_instances(labels)
    placed = manifests.assign_placements_realistic(manifests.select_sources(_alloc(spark), index), index)
    return manifests.kept_labels(labels, placed).select("tile", "class_id", "cx", "cy")


@query(f"WITH {SOURCES} SELECT class_id, count(*) AS allocated, count(*) FILTER (WHERE k % 3 <> 0) AS realized, count(*) FILTER (WHERE k % 3 <> 0) >= count(*) AS complete FROM src GROUP BY 1")
def arm_completeness(spark, d):
    s = manifests.select_sources(_alloc(spark), manifests.index_instances(tile_labels_of(spark, d)))
    return manifests.completeness(s, s.where("k % 3 <> 0"))


@query(f"WITH {SOURCES} SELECT class_id, k FROM src WHERE k % 3 = 0")
def sources_to_resume(spark, d):
    s = manifests.select_sources(_alloc(spark), manifests.index_instances(tile_labels_of(spark, d)))
    return manifests.still_to_write(s, s.where("k % 3 <> 0").select("class_id", "k")).select("class_id", "k")


@query(f"""WITH r AS (SELECT doc_id AS ord, source AS class_id FROM documents),
  p AS (SELECT *, count(*) OVER (PARTITION BY class_id) AS n, row_number() OVER (PARTITION BY class_id ORDER BY {_DRAW.format("'42|' || class_id || '|' || ord")}, ord) AS i FROM r)
  SELECT ord, class_id, CASE WHEN n >= 2 AND i <= greatest(1, round_even(n * CAST(0.2 AS DOUBLE), 0)) THEN 'val' ELSE 'train' END AS part FROM p""")
def stratified_documents(spark, d):
    return manifests.stratified_split(D.table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.col("source").alias("class_id")), 0.2)


@query("""WITH r AS (SELECT doc_id AS ord, source AS class_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS t FROM documents) SELECT ord, class_id FROM r ORDER BY t, class_id LIMIT 50""")
def round_robin_documents(spark, d):
    return manifests.round_robin(D.table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.col("source").alias("class_id")), 50)


@query("SELECT ord FROM (SELECT doc_id AS ord, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents) WHERE r % 7 = 0 ORDER BY r LIMIT 40")
def every_seventh(spark, d):
    return manifests.every_nth(D.table(spark, d, "documents").select(F.col("doc_id").alias("ord")), 7, 40)


@query("WITH c AS (SELECT l_suppkey % 20 AS class_id, count(*) AS train_count FROM lineitem GROUP BY 1) SELECT max(train_count + class_id) AS level FROM c WHERE class_id > 0")
def filled_level(spark, d):
    c = D.table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("class_id")).agg(F.count("*").alias("train_count"))
    return allocation.fills_floor(c.withColumn("alloc", F.col("class_id")))


@query("SELECT l_returnflag AS class, round(median(l_extendedprice), 4) AS mid FROM lineitem GROUP BY 1")
def class_medians(spark, d):
    out = quantiles.quantiles(D.table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "class"), ["class"], F.col("l_extendedprice"), {"mid": 0.5})
    return out.select("class", F.round("mid", 4).alias("mid"))


_BUCKETS = f"""{FIRST}, rows AS (SELECT m.pid, m.ord, m.conf, m.gi IS NOT NULL AS tp, coalesce(o.b, m.b) AS bucket FROM (SELECT *, {_B} AS b FROM matched) m LEFT JOIN (SELECT pid, cat, ord AS gi, {_B} AS b FROM g) o USING (pid, cat, gi)),
  truth AS (SELECT {_B} AS bucket, count(*) AS n_gt FROM g GROUP BY 1),
  curve AS (SELECT rows.bucket, sum(tp::INT) OVER w::DOUBLE / n_gt AS recall, sum(tp::INT) OVER w::DOUBLE / count(*) OVER w AS prec FROM rows JOIN truth ON truth.bucket = rows.bucket
    WINDOW w AS (PARTITION BY rows.bucket ORDER BY conf DESC, ord, pid ROWS UNBOUNDED PRECEDING)),
  at_t AS (SELECT bucket, i, max(prec) AS p FROM curve JOIN range(0, 101) t(i) ON recall >= i * CAST(0.01 AS DOUBLE) GROUP BY ALL),
  ap AS (SELECT bucket, sum(p) / 101 AS ap FROM at_t GROUP BY ALL)"""


@query(f"{OD}, {ALL}, {_BUCKETS} SELECT bucket, n_gt, round(coalesce(ap, 0.0), 6) AS ap50 FROM truth LEFT JOIN ap USING (bucket)")
def small_objects_ap(spark, d):
    return stats.area_bucket_ap(D.detections(spark, d), D.ground_truth(spark, d)).select("bucket", "n_gt", F.round("ap50", 6).alias("ap50"))


def _headline(run: int) -> str:
    chain = AP.replace("bucket, sum(tp", "keyed.bucket, sum(tp").replace("SELECT k, keyed", "SELECT keyed.k, keyed")
    return f"""(WITH RECURSIVE {D.OBJECTS}, {D.GTS}, {D.dets_sql(run)}, {TIERS}, {chain}
  SELECT round(avg(ap50) FILTER (WHERE r.cat IS NOT NULL AND bucket = 'all'), 6) AS ap_macro, round(avg(ap50) FILTER (WHERE bucket = 'all' AND tier = 'tail'), 6) AS ap_tail,
  round(avg(ap50) FILTER (WHERE r.cat IS NOT NULL AND bucket = 'small'), 6) AS ap_small_macro, round(max(ap50) FILTER (WHERE r.cat IS NULL AND bucket = 'small'), 6) AS ap_small_overall, {run} AS seed
  FROM report r LEFT JOIN subset s ON s.cat = r.cat)"""


@query(f"SELECT * FROM {_headline(0)} UNION ALL SELECT * FROM {_headline(1)}")
def headline_by_run(spark, d):
    t = tiers(spark, d)
    parts = [metrics.headline(metrics.ap_by_size(D.detections(spark, d, r), D.ground_truth(spark, d), t), t) for r in (0, 1)]
    rounded = [p.select(*[F.round(c, 6).alias(c) for c in p.columns], F.lit(r).alias("seed")) for r, p in enumerate(parts)]
    return rounded[0].unionByName(rounded[1])
