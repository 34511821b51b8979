"""Settings, the shared folder, and plans that must reach the scan."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from threadlens import prepare
from threadlens.operators.items import scored_stories
from threadlens.operators.threads import _advance, _links, _lookup
from threadlens.session import materialize, scratch_path, shared_dir, spread


def test_runtime_settings_are_applied(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    assert prepare(spark).conf.get("spark.sql.session.timeZone") == "UTC"


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(shared_dir(spark) + "/threadlens/")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def session(master):
    conf = SimpleNamespace(get=lambda key, default=None: default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="app"))


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(RuntimeError):
        shared_dir(session("yarn"))
    assert shared_dir(session("local[2]")) == shared_dir(session("local[2]"))


def test_materialized_tables_cut_the_plan(spark):
    rows = materialize(spark.range(10).withColumn("x", F.col("id") % 2 == 0), "numbers", partition_by="x")
    assert rows.where("x").count() == 5 and rows.dtypes == [("id", "bigint"), ("x", "boolean")]
    assert materialize(rows.where("false"), "none", partition_by="x").count() == 0
    assert "Range" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_spread_leaves_many_splits_alone(spark):
    assert spread(spark.range(100, numPartitions=1), "id").rdd.getNumPartitions() == 4
    assert spread(spark.range(100, numPartitions=50), "id").rdd.getNumPartitions() == 50


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "items")
    spark.createDataFrame([(1, "story", 2, "t", "body")], "id long, type string, score int, title string, text string").write.parquet(path)
    plan = scored_stories(spark.read.parquet(path)).select("id", "score")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(type,story)" in plan and "IsNotNull(score)" in plan
    assert "text" not in plan[plan.index("ReadSchema"):]


def test_a_thread_round_shuffles_its_lookup_table_once(spark):
    edges = spark.range(2, 3000).selectExpr("id", "id DIV 2 AS parent")
    links = materialize(_links(edges, True), "links")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        ahead, state = _lookup(links, True), links
        for _ in range(3):
            state = _advance(state, ahead, True, 1000)
        execution = state._jdf.queryExecution()
        execution.toRdd().count()
        plan = execution.executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert plan.count("ReusedExchange") == 2
