"""Queries on detections, average precision and error taxonomy."""

from __future__ import annotations

from pyspark.sql import functions as F

from panolith.operators import catalog, detect, diagnose, metrics, retries, subset
from panolith.plans import derive as D
from panolith.plans.register import query

OD = f"WITH RECURSIVE {D.OBJECTS}, {D.GTS}, {D.dets_sql()}"


def _i(a: str, b: str) -> str:
    return f"(greatest(0.0, least({a}.cx + {a}.w / 2, {b}.cx + {b}.w / 2) - greatest({a}.cx - {a}.w / 2, {b}.cx - {b}.w / 2)) * greatest(0.0, least({a}.cy + {a}.h / 2, {b}.cy + {b}.h / 2) - greatest({a}.cy - {a}.h / 2, {b}.cy - {b}.h / 2)))"


def _iou(a: str, b: str) -> str:
    return f"({_i(a, b)} / ({a}.w * {a}.h + {b}.w * {b}.h - {_i(a, b)}))"


def ignores(spark, d):
    o = D.objects(spark, d).where("ord % 11 = 0")
    return o.select("pid", (F.col("x1") / 2048).alias("x1"), (F.col("y1") / 2048).alias("y1"), (F.col("x2") / 2048).alias("x2"), (F.col("y2") / 2048).alias("y2"))


@query(f"{OD} SELECT pid, cat, ord FROM dets e WHERE NOT EXISTS (SELECT 1 FROM objects o WHERE o.ord % 11 = 0 AND o.pid = e.pid AND e.cx BETWEEN o.x1 / 2048 AND o.x2 / 2048 AND e.cy BETWEEN o.y1 / 2048 AND o.y2 / 2048)")
def outside_ignores(spark, d):
    return detect.outside_ignores(D.detections(spark, d), ignores(spark, d)).select("pid", "cat", "ord")


@query(f"{OD} SELECT pid, cat, ord FROM dets e WHERE NOT EXISTS (SELECT 1 FROM gts g WHERE g.cat < 12 AND g.pid = e.pid AND e.cx BETWEEN g.cx - g.w / 2 AND g.cx + g.w / 2 AND e.cy BETWEEN g.cy - g.h / 2 AND g.cy + g.h / 2)")
def hallucinations(spark, d):
    return detect.outside_signs(D.detections(spark, d), D.ground_truth(spark, d).where("cat < 12")).select("pid", "cat", "ord")


@query(f"{OD} SELECT pid, cat, ord, conf FROM dets WHERE conf >= 0.25")
def confident_detections(spark, d):
    return detect.at_confidence(D.detections(spark, d), 0.25).select("pid", "cat", "ord", "conf")


NMS = f"""s AS (SELECT *, row_number() OVER (PARTITION BY pid, cat ORDER BY conf DESC, ord) AS r FROM dets),
  kept AS (
    SELECT pid, cat, r, [struct_pack(ord := ord, conf := conf, cx := cx, cy := cy, w := w, h := h)] AS k FROM s WHERE r = 1
    UNION ALL
    SELECT s.pid, s.cat, s.r, CASE WHEN len(list_filter(kept.k, lambda b: {_iou('b', 's')} >= 0.5)) > 0 THEN kept.k
      ELSE list_append(kept.k, struct_pack(ord := s.ord, conf := s.conf, cx := s.cx, cy := s.cy, w := s.w, h := s.h)) END
    FROM kept JOIN s ON s.pid = kept.pid AND s.cat = kept.cat AND s.r = kept.r + 1),
  last AS (SELECT pid, cat, arg_max(k, r) AS k FROM kept GROUP BY pid, cat)"""


@query(f"{OD}, {NMS} SELECT pid, cat, x.ord AS ord FROM (SELECT pid, cat, unnest(k) AS x FROM last)")
def suppressed(spark, d):
    return detect.nms(D.detections(spark, d)).select("pid", "cat", "ord")


#: One detection after another within a group, carrying the objects taken so far.
FOLD = f"""q AS (SELECT *, row_number() OVER (PARTITION BY pid, cat ORDER BY conf DESC, ord) AS r FROM e),
  gg AS (SELECT pid, cat, list(struct_pack(ord := ord, cx := cx, cy := cy, w := w, h := h) ORDER BY ord) AS g FROM g GROUP BY pid, cat),
  j AS (SELECT q.*, coalesce(gg.g, []) AS gs FROM q LEFT JOIN gg USING (pid, cat)),
  step AS (
    SELECT pid, cat, r, list_sort(list_transform(list_filter(gs, lambda b: {_iou('b', 'j')} >= 0.5), lambda b: struct_pack(n := -{_iou('b', 'j')}, k := b.ord * SIGN, gi := b.ord)))[1].gi AS gi,
           [list_sort(list_transform(list_filter(gs, lambda b: {_iou('b', 'j')} >= 0.5), lambda b: struct_pack(n := -{_iou('b', 'j')}, k := b.ord * SIGN, gi := b.ord)))[1].gi] AS used FROM j WHERE r = 1
    UNION ALL
    SELECT x.pid, x.cat, x.r, x.gi, list_append(x.used, x.gi) FROM (
      SELECT j.pid, j.cat, j.r, step.used, list_sort(list_transform(list_filter(j.gs, lambda b: NOT list_contains(step.used, b.ord) AND {_iou('b', 'j')} >= 0.5), lambda b: struct_pack(n := -{_iou('b', 'j')}, k := b.ord * SIGN, gi := b.ord)))[1].gi AS gi
      FROM step JOIN j ON j.pid = step.pid AND j.cat = step.cat AND j.r = step.r + 1) x),
  matched AS (SELECT q.pid, q.cat, q.ord, q.conf, q.w, q.h, step.gi FROM q JOIN step USING (pid, cat, r))"""
FIRST, LAST = FOLD.replace("SIGN", "1"), FOLD.replace("SIGN", "(-1)")
ALL = "g AS (SELECT * FROM gts), e AS (SELECT * FROM dets)"


@query(f"{OD}, {ALL}, {FIRST} SELECT pid, cat, ord, gi FROM matched")
def matches(spark, d):
    return metrics.match(D.detections(spark, d), D.ground_truth(spark, d)).select("pid", "cat", "ord", "gi")


@query(f"{OD}, {ALL}, {LAST} SELECT pid, cat, ord, gi FROM matched WHERE gi IS NOT NULL")
def greedy_hits(spark, d):
    return diagnose.greedy_hits(D.ground_truth(spark, d), D.detections(spark, d))


#: All objects on twenty panoramas, however many there are.
CROWD = 20
_DENSE = OD.replace("l_orderkey // 15 AS pid", f"l_orderkey % {CROWD} AS pid")


@query(f"{_DENSE}, {ALL}, {FIRST} SELECT pid, cat, ord, gi FROM matched")
def crowded_matches(spark, d):
    return metrics.match(D.detections(spark, d, crowd=CROWD), D.ground_truth(spark, d, CROWD)).select("pid", "cat", "ord", "gi")


@query(f"{_DENSE}, {NMS} SELECT pid, cat, x.ord AS ord FROM (SELECT pid, cat, unnest(k) AS x FROM last)")
def crowded_suppressed(spark, d):
    return detect.nms(D.detections(spark, d, crowd=CROWD)).select("pid", "cat", "ord")


@query(f"{_DENSE} SELECT pid, cat, ord FROM dets e WHERE NOT EXISTS (SELECT 1 FROM gts g WHERE g.cat < 3 AND g.pid = e.pid AND e.cx BETWEEN g.cx - g.w / 2 AND g.cx + g.w / 2 AND e.cy BETWEEN g.cy - g.h / 2 AND g.cy + g.h / 2)")
def crowded_hallucinations(spark, d):
    return detect.outside_signs(D.detections(spark, d, crowd=CROWD), D.ground_truth(spark, d, CROWD).where("cat < 3")).select("pid", "cat", "ord")


#: A stand-in for a model: what it finds on the tile of an attempt are some of a run's detections.
TRIES = 3
_ATTEMPTS = " UNION ALL ".join(f"SELECT {a} AS a, pid, cx, cy FROM dets{a} WHERE ord % 97 < 2 + {a}" for a in range(TRIES))
RETRIED = f"""WITH {D.OBJECTS}, {D.GTS}, {', '.join(D.dets_sql(a, f'dets{a}') for a in range(TRIES))}, seen AS ({_ATTEMPTS}),
  fired AS (SELECT DISTINCT a, pid FROM seen e WHERE NOT EXISTS (SELECT 1 FROM gts g WHERE g.cat < 12 AND g.pid = e.pid AND e.cx BETWEEN g.cx - g.w / 2 AND g.cx + g.w / 2 AND e.cy BETWEEN g.cy - g.h / 2 AND g.cy + g.h / 2)),
  tiles AS (SELECT DISTINCT pid FROM gts),
  passed AS (SELECT pid, min(a) AS a FROM tiles, range({TRIES}) t(a) WHERE (a, pid) NOT IN (SELECT a, pid FROM fired) GROUP BY pid),
  told AS (SELECT tiles.pid, a, coalesce(a + 1, {TRIES}) AS tries FROM tiles LEFT JOIN passed USING (pid))"""


def retried(spark, d):
    signs = D.ground_truth(spark, d).where("cat < 12")
    boxes = signs.select(F.col("pid").alias("tile"), (F.col("cx") - F.col("w") / 2).alias("x1"), (F.col("cy") - F.col("h") / 2).alias("y1"), (F.col("cx") + F.col("w") / 2).alias("x2"), (F.col("cy") + F.col("h") / 2).alias("y2"))

    def scan(made, attempt):
        seen = D.detections(spark, d, attempt).where(F.col("ord") % 97 < 2 + attempt).select(F.col("pid").alias("tile"), "cx", "cy")
        return made.select("tile").join(seen, "tile")

    items = D.ground_truth(spark, d).select(F.col("pid").alias("tile")).distinct()
    return retries.retry_rounds(items, boxes, lambda pending, attempt: pending.withColumn("seed", F.col("tile") * 31 + attempt), scan, tries=TRIES)


@query(f"{RETRIED} SELECT pid AS tile, pid * 31 + a AS seed, CAST(a + 1 AS INTEGER) AS tries FROM told WHERE a IS NOT NULL")
def retried_tiles(spark, d):
    return retried(spark, d)[0]


@query(f"""{RETRIED} SELECT count(*) AS tiles, CAST(sum(tries) AS BIGINT) AS attempts, count(*) FILTER (WHERE a > 0) AS regenerated, count(*) FILTER (WHERE a IS NULL) AS rejected,
  (SELECT count(*) FROM fired JOIN told USING (pid) WHERE fired.a < told.tries) AS scan_fired, (SELECT count(*) FROM seen JOIN told USING (pid) WHERE seen.a < told.tries) AS scan_detections FROM told""")
def retry_telemetry(spark, d):
    counters = retried(spark, d)[1]
    return spark.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in counters.items()])


COUNTS = "counts AS (SELECT name, any_value(cat) AS cat, count(*) AS instances FROM objects GROUP BY name)"
#: The subset of these queries keeps class ids as they are: every third class, in three tiers.
TIERS = "subset AS (SELECT DISTINCT cat, CASE WHEN cat < 6 THEN 'tail' WHEN cat < 15 THEN 'mid' ELSE 'head' END AS tier FROM objects WHERE cat % 3 <> 1)"


def tiers(spark, d):
    k = F.col("cat")
    return D.objects(spark, d).select("cat").distinct().where(k % 3 != 1).select(k.alias("id"), F.when(k < 6, "tail").when(k < 15, "mid").otherwise("head").alias("tier"))


_B = "CASE WHEN w * h * 4194304 < 1024 THEN 'small' WHEN w * h * 4194304 < 9216 THEN 'medium' ELSE 'large' END"
AP = f"""g AS (SELECT * FROM gts WHERE cat IN (SELECT cat FROM subset)), e AS (SELECT * FROM dets WHERE cat IN (SELECT cat FROM subset)), {FIRST},
  rows AS (SELECT m.pid, m.cat, m.ord, m.conf, m.gi IS NOT NULL AS tp, coalesce(o.b, m.b) AS own FROM (SELECT *, {_B} AS b FROM matched) m LEFT JOIN (SELECT pid, cat, ord AS gi, {_B} AS b FROM g) o USING (pid, cat, gi)),
  both_b AS (SELECT pid, cat, ord, conf, tp, unnest([own, 'all']) AS bucket FROM rows),
  keyed AS (SELECT *, cat AS k FROM both_b UNION ALL SELECT *, NULL FROM both_b),
  tr AS (SELECT cat AS k, unnest([{_B}, 'all']) AS bucket FROM g),
  cells AS (SELECT cat AS k, bucket FROM subset, (VALUES ('small'), ('medium'), ('large'), ('all')) v(bucket) UNION ALL SELECT NULL, bucket FROM (VALUES ('small'), ('medium'), ('large'), ('all')) v(bucket)),
  truth AS (SELECT c.k, c.bucket, count(t.bucket) AS n_gt FROM cells c LEFT JOIN tr t ON t.bucket = c.bucket AND (c.k IS NULL OR c.k = t.k) GROUP BY c.k, c.bucket),
  curve AS (SELECT k, bucket, sum(tp::INT) OVER w::DOUBLE / n_gt AS recall, sum(tp::INT) OVER w::DOUBLE / count(*) OVER w AS prec FROM keyed JOIN truth ON keyed.bucket = truth.bucket AND keyed.k IS NOT DISTINCT FROM truth.k
    WHERE n_gt > 0 WINDOW w AS (PARTITION BY keyed.k, keyed.bucket ORDER BY conf DESC, ord, pid ROWS UNBOUNDED PRECEDING)),
  at_t AS (SELECT k, bucket, i, max(prec) AS p FROM curve JOIN range(0, 101) t(i) ON recall >= i * CAST(0.01 AS DOUBLE) GROUP BY ALL),
  ap AS (SELECT k, bucket, sum(p) / 101 AS ap FROM at_t GROUP BY ALL),
  report AS (SELECT truth.k AS cat, truth.bucket, n_gt, CASE WHEN n_gt > 0 THEN coalesce(ap, 0.0) END AS ap50 FROM truth LEFT JOIN ap ON ap.bucket = truth.bucket AND ap.k IS NOT DISTINCT FROM truth.k)"""


@query(f"{OD}, {TIERS}, {AP.replace('bucket, sum(tp', 'keyed.bucket, sum(tp').replace('SELECT k, keyed', 'SELECT keyed.k, keyed')} SELECT cat, bucket, n_gt, round(ap50, 6) AS ap50 FROM report")
def ap_by_size(spark, d):
    r = metrics.ap_by_size(D.detections(spark, d), D.ground_truth(spark, d), tiers(spark, d))
    return r.select("cat", "bucket", "n_gt", F.round("ap50", 6).alias("ap50"))


@query(f"""{OD}, {TIERS}, {AP.replace('bucket, sum(tp', 'keyed.bucket, sum(tp').replace('SELECT k, keyed', 'SELECT keyed.k, keyed')}
  SELECT round(avg(ap50) FILTER (WHERE r.cat IS NOT NULL AND bucket = 'all'), 6) AS ap_macro, round(avg(ap50) FILTER (WHERE bucket = 'all' AND tier = 'tail'), 6) AS ap_tail,
  round(avg(ap50) FILTER (WHERE r.cat IS NOT NULL AND bucket = 'small'), 6) AS ap_small_macro, round(max(ap50) FILTER (WHERE r.cat IS NULL AND bucket = 'small'), 6) AS ap_small_overall FROM report r LEFT JOIN subset s ON s.cat = r.cat""")
def ap_headline(spark, d):
    t = tiers(spark, d)
    h = metrics.headline(metrics.ap_by_size(D.detections(spark, d), D.ground_truth(spark, d), t), t)
    return h.select(*[F.round(c, 6).alias(c) for c in h.columns])


CLASSIFY = f"""g AS (SELECT * FROM gts), e AS (SELECT * FROM dets), {LAST},
  o AS (SELECT g.pid, g.cat, g.ord, e.cat AS ecat, e.ord AS eord, {_iou('g', 'e')} AS iou FROM g JOIN e ON g.pid = e.pid AND {_i('g', 'e')} > 0),
  per AS (SELECT pid, cat, ord, max(iou) FILTER (WHERE ecat = cat) AS own, max(iou) AS best, arg_max(ecat, (iou, -eord)) AS bcat FROM o GROUP BY ALL),
  outcomes AS (SELECT g.pid, g.cat, g.ord, g.w, g.h, CASE WHEN m.gi IS NOT NULL OR own >= 0.5 THEN 'HIT' WHEN best >= 0.5 AND bcat <> g.cat THEN 'CLS' WHEN own >= 0.3 THEN 'LOC' ELSE 'MISS' END AS outcome, bcat
    FROM g LEFT JOIN per USING (pid, cat, ord) LEFT JOIN (SELECT pid, cat, gi FROM matched WHERE gi IS NOT NULL) m ON m.pid = g.pid AND m.cat = g.cat AND m.gi = g.ord)"""


@query(f"{OD}, {CLASSIFY} SELECT pid, cat, ord, outcome, CASE WHEN outcome = 'CLS' THEN bcat END AS confused FROM outcomes")
def object_outcomes(spark, d):
    return diagnose.classify_objects(D.ground_truth(spark, d), D.detections(spark, d))


@query(f"""{OD}, {TIERS}, {CLASSIFY} SELECT pid, cat, ord, outcome, CASE WHEN outcome = 'CLS' THEN bcat END AS confused, round(greatest(w, h) * 2048, 1) AS size_px,
  CASE WHEN s < 16 THEN '<16' WHEN s < 24 THEN '16-24' WHEN s < 32 THEN '24-32' WHEN s < 48 THEN '32-48' WHEN s < 96 THEN '48-96' ELSE '>=96' END AS band
  FROM (SELECT *, greatest(w, h) * 2048 AS s FROM outcomes) WHERE cat IN (SELECT cat FROM subset WHERE tier = 'tail')""")
def tail_decomposition(spark, d):
    return diagnose.decompose(D.ground_truth(spark, d), D.detections(spark, d), tiers(spark, d))


@query(f"""{OD}, {CLASSIFY} SELECT cat, round(count(*) FILTER (WHERE outcome = 'HIT') * 100.0 / count(*), 4)::DOUBLE AS hit, round(count(*) FILTER (WHERE outcome = 'MISS') * 100.0 / count(*), 4)::DOUBLE AS miss,
  round(count(*) FILTER (WHERE outcome = 'CLS') * 100.0 / count(*), 4)::DOUBLE AS cls, round(count(*) FILTER (WHERE outcome = 'LOC') * 100.0 / count(*), 4)::DOUBLE AS loc FROM outcomes GROUP BY cat""")
def outcome_rates(spark, d):
    return diagnose.rates(diagnose.classify_objects(D.ground_truth(spark, d), D.detections(spark, d)), ["cat"])


TAIL = f"g AS (SELECT * FROM gts WHERE cat IN (SELECT cat FROM subset WHERE tier = 'tail')), e AS (SELECT * FROM dets WHERE cat IN (SELECT cat FROM subset WHERE tier = 'tail') AND pid IN (SELECT pid FROM gts)), {LAST}"


@query(f"{OD}, {TIERS}, {TAIL} SELECT count(gi) AS tp, count(*) - count(gi) AS fp, count(gi)::DOUBLE / count(*) AS precision FROM matched")
def tail_precision(spark, d):
    return diagnose.tail_fp_precision(D.ground_truth(spark, d), D.detections(spark, d), tiers(spark, d))


@query(f"""{OD}, {TIERS}, {TAIL}, w AS (SELECT q.* FROM q JOIN matched USING (pid, cat, ord) WHERE gi IS NULL),
  b AS (SELECT w.pid, w.cat, w.ord, max({_iou('gts', 'w')}) AS iou, arg_max(gts.cat, ({_iou('gts', 'w')}, -gts.ord)) AS gcat FROM w JOIN gts ON gts.pid = w.pid GROUP BY ALL)
  SELECT CASE WHEN iou >= 0.5 THEN 'on_sign' WHEN iou < 0.3 THEN 'on_bg' ELSE 'ambiguous' END AS kind, CASE WHEN iou >= 0.5 THEN gcat END AS fires_on, count(*) AS n FROM b GROUP BY ALL""")
def tail_false_positives(spark, d):
    return diagnose.classify_tail_fps(D.ground_truth(spark, d), D.detections(spark, d), tiers(spark, d))
