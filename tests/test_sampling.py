"""Samples, splits, labels, metrics."""

import hashlib
import math

from pyspark.sql import functions as F

from threadlens.functions import labels
from threadlens.operators import metrics, ranking, sampling


def test_labels(spark):
    rows = spark.createDataFrame([(1, True, 3, 0), (2, False, 0, 9), (3, None, None, -1), (4, None, -1, None)], "id int, dead boolean, d int, score int")
    found = rows.select(
        "id", labels.dead_label(F.col("dead")).alias("dead"), labels.commented_label(F.col("d")).alias("c"),
        labels.log_label(F.col("score")).alias("log"), labels.comment_count(F.col("d")).alias("n"),
    ).orderBy("id").collect()
    assert [r.dead for r in found] == [1.0, 0.0, 0.0, 0.0]
    assert [r.c for r in found] == [1.0, 0.0, 0.0, None]
    assert [r.n for r in found] == [3, 0, 0, -1]
    assert found[0].log == 0.0 and math.isclose(found[1].log, math.log(10)) and found[2].log is None and found[3].log is None
    undone = rows.select(labels.undo_log(labels.log_label(F.col("score"))).alias("x")).where("x > 1").first().x
    assert math.isclose(undone, 9.0)


def test_split_is_stable_and_complete(spark):
    ids = spark.range(5000)
    train, test = sampling.train_test(ids, ["id"])
    a, b = {r.id for r in train.collect()}, {r.id for r in test.collect()}
    assert a | b == set(range(5000)) and not a & b and 0.67 < len(a) / 5000 < 0.73
    assert a == {r.id for r in sampling.train_test(ids.repartition(16), ["id"])[0].collect()}
    assert a != {r.id for r in sampling.train_test(ids, ["id"], seed=2)[0].collect()}


def classes(spark):
    return spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 1.0).otherwise(0.0).alias("label"))


def test_balanced_sample(spark):
    rows = classes(spark)
    sample = sampling.class_sample(rows, ["id"])
    sizes = {r.label: r.n for r in metrics.class_counts(sample).collect()}
    assert sizes[1.0] == 1000 and 900 < sizes[0.0] < 1100
    assert sample.join(rows, ["id", "label"], "left_anti").count() == 0


def test_sample_and_split_are_independent(spark):
    """A sample must not decide which side of a later split its rows fall on."""
    train, test = sampling.train_test(sampling.class_sample(classes(spark), ["id"]), ["id"])
    sizes = {r.label: r.n for r in metrics.class_counts(test).collect()}
    assert 240 < sizes[0.0] < 360 and 240 < sizes[1.0] < 360


def test_small_class_is_kept_whole(spark):
    rows = spark.createDataFrame([(i, 1.0 if i < 5 else 0.0) for i in range(1000)], "id long, label double")
    sizes = {r.label: r.n for r in metrics.class_counts(sampling.class_sample(rows, ["id"], target=100)).collect()}
    assert sizes[1.0] == 5 and 60 < sizes[0.0] < 140


def test_fixed_sample(spark):
    rows = spark.range(2000)
    want = sorted(range(2000), key=lambda i: hashlib.md5(f"{i}:fixed:1".encode()).hexdigest())[:100]
    for parts in (1, 16):
        assert {r.id for r in sampling.fixed_sample(rows.repartition(parts), ["id"], 100).collect()} == set(want)
    assert sampling.fixed_sample(rows, ["id"], 5000).count() == 2000
    assert sampling.fixed_sample(rows, ["id"], 1999).count() == 1999


def test_large_samples_are_cut_by_position(spark, monkeypatch):
    monkeypatch.setattr(ranking, "SMALL_LIMIT", 10)
    rows = spark.range(3000).repartition(7)
    want = sorted(range(3000), key=lambda i: hashlib.md5(f"{i}:fixed:1".encode()).hexdigest())[:777]
    assert {r.id for r in sampling.fixed_sample(rows, ["id"], 777).collect()} == set(want)


def test_positions(spark):
    rows = spark.range(5000).select("id", (F.col("id") % 7).alias("k")).repartition(9)
    found = ranking.with_position(rows, [F.desc("k"), F.col("id")]).orderBy("position").collect()
    assert [r.position for r in found] == list(range(5000))
    assert [(r.k, r.id) for r in found] == sorted(((i % 7, i) for i in range(5000)), key=lambda x: (-x[0], x[1]))


def test_error_rates_and_mse(spark):
    rows = spark.createDataFrame([(0.0, 1.0), (0.0, 0.0), (1.0, 1.0), (1.0, 1.0)], "label double, prediction double")
    row = metrics.error_rates(rows).first()
    assert (row.false_positive, row.false_negative) == (0.5, 0.0)
    only = metrics.error_rates(rows.where("label = 0")).first()
    assert only.false_negative is None
    assert metrics.mean_squared_error(rows).first().mse == 0.25
