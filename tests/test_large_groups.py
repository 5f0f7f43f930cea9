"""Steps that must not gather a large group in one task."""

import numpy as np
from pyspark.sql import functions as F

from framestack.operators import stack, stats
from framestack.plans.stack_queries import robust_z_score


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_quantile_keeps_rows_of_a_group_apart(spark):
    rows = spark.range(5000).select((F.col("id") % 2).alias("g"), (F.col("id") * 37 % 1009).cast("double").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = stats.exact_quantile(rows, ["g"], "v", 0.9)
        assert "SortMergeJoin" not in plan(got)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for g, q in got.toPandas().itertuples(index=False):
        v = [i * 37 % 1009 for i in range(5000) if i % 2 == g]
        assert q == np.quantile(v, 0.9)


def test_quantile_counts_again_where_one_bin_holds_most(spark, monkeypatch):
    monkeypatch.setattr(stats, "NARROW", 10)
    v = [1e12, *[k / 7 for k in range(3000)]]
    got = stats.exact_quantile(spark.createDataFrame([(x,) for x in v], "v double").withColumn("g", F.lit(1)), ["g"], "v", 0.3)
    assert got.first()["quantile"] == np.quantile(v, 0.3)


def test_clipped_means_of_large_groups_need_no_sort(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("g"), (F.col("id") % 97).cast("double").alias("v"))
    assert "SortMergeJoin" not in plan(stack.clip_mean_large(rows, ["g"], "v"))


def test_robust_z_needs_no_sort(spark, data):
    assert "SortMergeJoin" not in plan(robust_z_score(spark, data))
