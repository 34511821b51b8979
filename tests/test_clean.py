"""Lenient parsing and the typed projection."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from threadlens.functions import clean
from threadlens.operators.items import comments, scored_stories, submission_corpus, typed_items
from threadlens.schema import ITEM, RAW_COLUMNS, RAW_ITEM

EMPTY = [(None, None), ("", None), (" ", None), ("\t\n", None), (" a ", " a ")]
INTS = [(" 5 ", 5), ("+5", 5), ("-3", -3), ("5.0", None), ("1e2", None), ("99999999999", None), ("", None), (None, None), ("5\n", 5), ("5\x85", None)]
LONGS = [("99999999999", 99999999999), ("5L", None), ("9223372036854775808", None)]
BOOLS = [("TRUE", True), ("false", False), (" true", None), ("yes", None), ("1", None), ("", None)]


@pytest.mark.parametrize(
    "function,name,cases",
    [
        (clean.empty_as_null, "emptyAsNull", EMPTY),
        (clean.opt_int, "optInt", INTS),
        (clean.opt_long, "optLong", LONGS),
        (clean.opt_bool, "optBool", BOOLS),
    ],
)
def test_parsers_as_columns_and_in_sql(spark, function, name, cases):
    clean.register_sql_functions(spark)
    rows = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], "i int, s string")
    found = rows.select("i", function(F.col("s")).alias("a"), F.expr(f"{name}(s)").alias("b")).orderBy("i").collect()
    assert [r.a for r in found] == [want for _, want in cases]
    assert [r.b for r in found] == [want for _, want in cases]


def test_epoch(spark):
    row = spark.range(1).select(
        clean.epoch_to_timestamp(F.lit(1444000000)).alias("t"),
        clean.epoch_to_text(F.lit(1444000000)).alias("s"),
        clean.epoch_to_timestamp(F.lit(9223372036854775807)).alias("far"),
    ).select(F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("t"), "s", "far").first()
    assert row.t == row.s == "2015-10-04 23:06:40"
    assert row.far is None


def raw(**values):
    return tuple(values.get(c) for c in RAW_COLUMNS)


def test_typed_items_keep_malformed_rows_but_need_an_id(spark):
    rows = [
        raw(id="1", score="x", time="9" * 18, title=" ", deleted="True", parent=""),
        raw(id="", score="3"),
        raw(id=None),
        raw(id=" 7 ", score=" 12 ", time="1444000000", title=" t ", dead="no"),
    ]
    typed = typed_items(spark.createDataFrame(rows, RAW_ITEM))
    assert typed.dtypes == [(f.name, f.dataType.simpleString()) for f in ITEM]
    found = {r.id: r for r in typed.collect()}
    assert set(found) == {1, 7}
    assert found[1].score is None and found[1].title is None and found[1].deleted is True and found[1].timestamp is None
    assert found[7].score == 12 and found[7].title == " t " and found[7].dead is None
    assert found[7].timestamp == datetime.fromtimestamp(1444000000)


def test_typed_columns_are_pruned(spark, tmp_path):
    path = str(tmp_path / "raw")
    spark.createDataFrame([raw(id="1", author="a")], RAW_ITEM).write.parquet(path)
    plan = typed_items(spark.read.parquet(path)).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:string>" in plan


def test_selections(spark):
    items = spark.createDataFrame(
        [(1, "story", 3, "t", None), (2, "story", None, "t", None), (3, "poll", 1, "t", None),
         (4, "story", 1, None, None), (5, "comment", None, None, "x"), (6, "comment", None, None, None)],
        "id long, type string, score int, title string, text string",
    )
    assert [r.id for r in scored_stories(items).collect()] == [1]
    assert sorted(r.id for r in submission_corpus(items).collect()) == [1, 2]
    assert [r.id for r in comments(items).collect()] == [5]
