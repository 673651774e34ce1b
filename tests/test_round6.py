"""What the findings of round 6 asked for, small."""

from panolith import session
from panolith.operators import stats
from pyspark.sql import functions as F


def test_weights_of_the_bootstrap_never_pass_through_the_driver(spark, monkeypatch):
    """However small the tables look to the planner: the weights are panoramas times replicas."""
    plans, write = [], session.spill

    def seen(df, tag):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, tag)

    monkeypatch.setattr(session, "spill", seen)
    gts = spark.range(60).select((F.col("id") % 12).alias("pid"), (F.col("id") % 2).alias("cat"))
    rows = gts.select(F.lit("t").alias("arm"), F.lit(0).alias("seed"), "pid", "cat", F.lit(1).cast("long").alias("ord"), F.lit(0.5).alias("conf"), F.lit(True).alias("tp"))
    out = stats.bootstrap_aps(rows, gts, replicas=20, block=10)
    assert out.count() == 2 * 20 and out.where("ap50 > 0").count() > 30
    weighted = stats.bootstrap_weights(gts.select("pid"), 20, block=10)
    assert weighted.count() == 12 * 2 and "SortMergeJoin [i#" in weighted._jdf.queryExecution().executedPlan().toString()
    joins = [p for p in plans if "Join [pid" in p]
    assert len(joins) == 2 and not any("BroadcastHashJoin [pid" in p for p in joins)
