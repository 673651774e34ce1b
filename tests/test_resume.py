"""Tables by key and rounds of tries, also after failures."""

import pytest
from pyspark.sql import functions as F

from panolith.operators import retries
from panolith.sources import keyed

ROWS = "k long, v string, n int"


def rows_of(table):
    return sorted((tuple(r) for r in table.read().collect()), key=repr)


def test_merges_touch_their_buckets_alone(spark, tmp_path):
    t = keyed.KeyedTable(spark, str(tmp_path / "t"), "k", 8)
    with pytest.raises(ValueError, match="nothing is committed"):
        t.read()
    whole = [(i, "a", i) for i in range(40)] + [(None, "null", 0)]
    assert len(t.merge(spark.createDataFrame([*whole, (3, "a", 1)], ROWS), {"tries": 5}, "one")) == 8
    assert rows_of(t) == sorted(whole, key=repr)  # of rows with one key the greatest stays
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "data").rglob("*.parquet")}
    news = spark.createDataFrame([(3, "b", 9), (100, "new", 1), (None, "other", 2)], ROWS)
    touched = t.merge(news, {"tries": 2, "rejected": 1}, "two")
    assert 1 <= len(touched) <= 3 and all(p.stat().st_mtime_ns == at for p, at in before.items())
    want = sorted([x for x in whole if x[0] not in (3, None)] + [(3, "b", 9), (100, "new", 1), (None, "other", 2)], key=repr)
    assert rows_of(t) == want and t.counters() == {"tries": 7, "rejected": 1}
    assert t.merge(news, {"tries": 2}, "two") == [] and t.counters()["tries"] == 7  # a repeated merge is told by its token
    t.merge(news)
    assert rows_of(t) == want
    assert rows_of(keyed.KeyedTable(spark, str(tmp_path / "t"), "k", 8)) == want
    assert [r.k for r in t.missing(spark.createDataFrame([(3, "x", 0), (555, "x", 0)], ROWS)).collect()] == [555]


def test_a_merge_that_fails_before_its_commit_changes_nothing(spark, tmp_path, monkeypatch):
    t = keyed.KeyedTable(spark, str(tmp_path / "t"), "k", 4)
    t.merge(spark.createDataFrame([(1, "a", 1), (2, "b", 2)], ROWS), {"tries": 1})

    def lost(state):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(t, "_commit", lost)
        with pytest.raises(OSError, match="lost"):
            t.merge(spark.createDataFrame([(1, "z", 9)], ROWS), {"tries": 1})
    assert rows_of(t) == [(1, "a", 1), (2, "b", 2)] and t.counters() == {"tries": 1}
    t.merge(spark.createDataFrame([(1, "z", 9)], ROWS), {"tries": 1})
    assert rows_of(t) == [(1, "z", 9), (2, "b", 2)] and t.counters() == {"tries": 2}
    state = t._last()
    with pytest.raises(RuntimeError, match="merge again"):
        t._commit(state)  # another writer was first
    t.merge(spark.createDataFrame([], ROWS))
    assert rows_of(t) == [(1, "z", 9), (2, "b", 2)]


def test_rounds_of_tries(spark):
    """Item i passes at its i-th try; items beyond three tries are left out; a detection on a sign is none."""
    items = spark.createDataFrame([(i,) for i in range(5)], "tile long")
    kept = spark.createDataFrame([(i, 0.4, 0.4, 0.6, 0.6) for i in range(5)], "tile long, x1 double, y1 double, x2 double, y2 double")
    asked = []

    def make(pending, attempt):
        asked.append(sorted(r.tile for r in pending.collect()))
        return pending.withColumn("image", F.concat(F.col("tile").cast("string"), F.lit(f"-{attempt}")))

    def scan(made, attempt):
        off = made.where(F.col("tile") > attempt).select("tile", F.lit(0.1).alias("cx"), F.lit(0.1).alias("cy"))
        return off.unionByName(off).unionByName(made.select("tile", F.lit(0.6).alias("cx"), F.lit(0.4).alias("cy")))

    out, told = retries.retry_rounds(items, kept, make, scan)
    assert sorted((r.tile, r.image, r.tries) for r in out.collect()) == [(0, "0-0", 1), (1, "1-1", 2), (2, "2-2", 3)]
    assert asked == [[0, 1, 2, 3, 4], [1, 2, 3, 4], [2, 3, 4]]
    assert told == {"tiles": 5, "attempts": 12, "regenerated": 2, "rejected": 2, "scan_fired": 9, "scan_detections": 12 + 18}
    assert retries.carried({"tiles": 2, "rejected": 1}, told) == told | {"tiles": 7, "rejected": 3}
    none, told = retries.retry_rounds(items.limit(0), kept, make, scan)
    assert none.count() == 0 and told == dict.fromkeys(retries.COUNTERS, 0)
