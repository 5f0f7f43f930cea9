"""Means on a threshold: the order of the table's rows decides, not the splits of its files.  Tasks are dealt by rows."""

import re

import duckdb
import pyarrow.parquet as pq
from compare import differences

from framestack.catalogue import ORACLES, QUERIES
from framestack.plans import registry


def test_means_are_added_in_the_order_of_rows(spark, tmp_path):
    lines = pq.read_table("/root/testdata/sf0.01/lineitem.parquet")
    pq.write_table(lines, tmp_path / "lineitem.parquet", row_group_size=4000)
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet')")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        for name in ("channel_statistics", "absolute_flags"):
            assert differences(QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(ORACLES[name]).df()) == "", name
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_runs_are_dealt_to_more_tasks_as_rows_grow(spark, data, monkeypatch):
    monkeypatch.setattr(registry, "TASK_ROWS", 500)
    rows = spark.read.parquet(f"{data}/lineitem.parquet").count()
    plan = QUERIES["valid_run"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Exchange hashpartitioning\(l_suppkey#\d+L?, (\d+)\)", plan) == [str(-(-rows // 500))]
    assert plan.count("Exchange ") == 1
