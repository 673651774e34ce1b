"""What the findings of round 5 asked for, small."""

import time

from panolith import session
from pyspark.sql import functions as F


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {x for x in files.split("\n") if "/shuffle_" in x}


def test_shuffle_files_of_a_spilled_table_go_at_once(spark):
    was = _shuffle_files(spark)
    df, path = session.spill(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("m")), "t")
    for _ in range(20):  # executors are told, and remove them soon after
        if not (left := _shuffle_files(spark) - was):
            break
        time.sleep(0.2)
    assert not left and df.count() == 2
    session.forget(spark, path)
