"""Vector expressions, joins, word arithmetic."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from threadlens.functions import vector as vx
from threadlens.operators import joins, words

PAIR = "id long, vec array<float>"


def test_distances(spark):
    row = spark.createDataFrame([([1.0, 0.0], [0.5, 0.5])], "a array<float>, b array<float>").select(
        vx.dot_distance(F.col("a"), F.col("b")).alias("d"),
        vx.dot_distance(F.col("a"), F.col("b"), normalize=True).alias("c"),
        vx.similarity(vx.dot_distance(F.col("a"), F.col("b"))).alias("s"),
        vx.add(F.col("a"), F.col("b")).alias("plus"),
        vx.subtract(F.col("a"), F.col("b")).alias("minus"),
        vx.concat_vectors(F.col("a"), F.col("b")).alias("both"),
    ).first()
    assert row.d == 0.5 and row.s == 0.5 and math.isclose(row.c, 1 - math.sqrt(0.5), rel_tol=1e-6)
    assert row.plus == [1.5, 0.5] and row.minus == [0.5, -0.5] and row.both == [1.0, 0.0, 0.5, 0.5]


def test_zero_vector_has_no_cosine(spark):
    row = spark.createDataFrame([([0.0], [1.0])], "a array<float>, b array<float>")
    assert row.select(vx.dot_distance(F.col("a"), F.col("b"), True).alias("d")).first().d is None


def test_seeded_vectors_agree_between_runs(spark):
    ids = spark.range(50)
    vec = vx.seeded_vector(F.col("id"), 10, 3).alias("vec")
    first = {r.id: r.vec for r in ids.select("id", vec).collect()}
    assert first == {r.id: r.vec for r in ids.repartition(7).select("id", vec).collect()}
    assert all(len(v) == 10 and all(abs(x) <= 0.05 for x in v) for v in first.values())
    assert len({tuple(v) for v in first.values()}) == 50


def test_seeded_vectors_take_one_digest_a_key(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "word string").select("word", vx.seeded_vector(F.col("word"), 4, 0).alias("vec"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    got = {r.word: r.vec for r in rows.collect()}
    for word in ("a", "b"):
        start, want = int(hashlib.md5(f"{word}:0".encode()).hexdigest()[:8], 16), []
        for i in range(1, 5):
            x = ((start + i * vx.STEP) % vx.MODULUS * vx.FACTOR + vx.ADDEND) % vx.MODULUS
            x = (x ^ (x >> 15)) * vx.FACTOR % vx.MODULUS
            want.append(((x >> 8) / 2**24 - 0.5) / 4)
        assert got[word] == pytest.approx(want, abs=1e-7)
    assert len(got[None]) == 4


def test_joins_by_key(spark):
    items = spark.createDataFrame([(1, 5, "TITLE_1"), (2, 6, "TITLE_2")], "id long, score int, tag string")
    vectors = spark.createDataFrame([(1, [1.0]), (3, [3.0])], PAIR)
    assert [(r.id, r.score, r.vec) for r in joins.join_vectors(items, vectors).collect()] == [(1, 5, [1.0])]
    other = spark.createDataFrame([(1, [9.0]), (7, [0.0])], PAIR)
    assert [r.vec for r in joins.concat_by_id(vectors, other).collect()] == [[1.0, 9.0]]
    tagged = vectors.select(F.concat(F.lit("TITLE_"), "id").alias("tag"), "vec")
    assert [r.id for r in joins.join_by_tag(items, tagged).collect()] == [1]
    assert [r.id for r in joins.missing_tags(items, tagged).collect()] == [2]
    titles = spark.createDataFrame([(1, "one")], "id long, title string")
    assert {r.id: r.title for r in joins.attach_titles(items, titles).collect()} == {1: "one", 2: None}


def test_overlay(spark):
    own = spark.createDataFrame([(0, "a"), (1, "b")], "word_id long, word string")
    given = spark.createDataFrame([("b", [1.0, 2.0]), ("z", [0.0, 0.0])], "word string, vec array<float>")
    found = {r.word: r for r in joins.overlay_pretrained(own, given, 2).collect()}
    assert set(found) == {"a", "b"} and found["b"].vec == [1.0, 2.0] and found["b"].pretrained
    assert not found["a"].pretrained and all(abs(x) <= 0.25 for x in found["a"].vec)


@pytest.fixture
def word_table(spark):
    return spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [2.0, 2.0])], "word string, vec array<float>")


def test_analogy(spark, word_table):
    requests = spark.createDataFrame(
        [("one", ["A", "nope"], []), ("none", ["nope"], None), ("signed", ["a", "a", "c"], ["b"])],
        "request_id string, positive array<string>, negative array<string>",
    )
    found = {r.request_id: r for r in words.analogy_vectors(words.request_terms(requests), word_table, 2).collect()}
    assert found["one"].vec == [1.0, 0.0] and found["one"].known == 1
    assert found["none"].vec is None and found["none"].known == 0
    assert found["signed"].vec == [1.0, 0.25] and found["signed"].known == 4


def test_word_vectors_move_a_document(spark, word_table):
    documents = spark.createDataFrame([("x", [1.0, 1.0]), ("y", [0.0, 0.0])], "request_id string, vec array<float>")
    terms = spark.createDataFrame([("x", "c", 1), ("x", "b", -1), ("x", "nope", 1)], "request_id string, word string, sign int")
    found = {r.request_id: r.vec for r in words.add_word_vectors(documents, terms, word_table, 2).collect()}
    assert found == {"x": [3.0, 2.0], "y": [0.0, 0.0]}
