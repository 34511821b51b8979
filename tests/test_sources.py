"""Files written and read back."""

import json

import pytest
from pyspark.errors import AnalysisException

from threadlens.operators.items import typed_items
from threadlens.schema import RAW_COLUMNS, RAW_ITEM
from threadlens.sources import export, items, models, tsv, vectors


def raw_rows(spark):
    nasty = 'a "quoted", text\nwith a \\ backslash\r\nand   spaces '
    base = dict.fromkeys(RAW_COLUMNS, "")
    rows = [{**base, "id": "1", "text": nasty, "title": "  "}, {**base, "id": "2", "author": "b", "text": None}]
    return spark.createDataFrame([tuple(r[c] for c in RAW_COLUMNS) for r in rows], RAW_ITEM), nasty


@pytest.mark.parametrize("header", [False, True])
def test_csv_with_lines_quotes_and_commas(spark, tmp_path, header):
    rows, nasty = raw_rows(spark)
    path = str(tmp_path / "csv")
    items.write_raw_csv(rows, path, header=header)
    found = {r.id: r for r in typed_items(items.read_raw_csv(spark, path, header=header)).collect()}
    assert set(found) == {1, 2}
    assert found[1].text == nasty and found[1].title is None
    assert found[2].text is None and found[2].url is None and found[2].author == "b"


def test_hand_written_csv(spark, tmp_path):
    path = tmp_path / "dump.csv"
    path.write_text('ann,5,1,"x ""y"", z",story,,"line 1\nline 2 \\",,,"",3,10,\n,,,,comment,"",,10,,,,11,\n')
    found = {r.id: r for r in typed_items(items.read_raw_csv(spark, str(path))).collect()}
    assert found[10].title == 'x "y", z' and found[10].text == "line 1\nline 2 \\" and found[10].dead is None
    assert found[11].parent == 10 and found[11].author is None and found[11].url is None


def test_parquet_is_never_overwritten(spark, tmp_path):
    rows, _ = raw_rows(spark)
    path = str(tmp_path / "p")
    items.write_items(rows, path)
    assert items.read_items(spark, path).count() == 2
    with pytest.raises(AnalysisException):
        items.write_items(rows, path)


def test_view(spark):
    rows, _ = raw_rows(spark)
    items.register_view(rows, "raw_view")
    assert spark.sql("SELECT count(*) FROM raw_view WHERE title = '  '").first()[0] == 1


def test_edges_and_ancestry(spark, tmp_path):
    edges = spark.createDataFrame([(2, 1), (3, 2)], "id long, parent long")
    tsv.write_edges(edges, str(tmp_path / "e"))
    assert sorted(map(tuple, tsv.read_edges(spark, str(tmp_path / "e")).collect())) == [(2, 1), (3, 2)]
    nodes = spark.createDataFrame([(1, None, []), (3, 1, [1, 2])], "id long, root long, path array<long>")
    tsv.write_ancestry(nodes, str(tmp_path / "a"))
    tsv.write_roots(nodes, str(tmp_path / "r"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "a")).collect()) == ["1\t", "3\t1,2"]
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "r")).collect()) == ["1\t", "3\t1"]
    back = {r.id: r.path for r in tsv.read_ancestry(spark, str(tmp_path / "a")).collect()}
    assert back == {1: [], 3: [1, 2]}


def test_corpus(spark, tmp_path):
    rows = spark.createDataFrame([(7, "A\tb\nc"), (8, " ")], "id long, title string")
    assert "A b c\tTITLE_7" in [r.value for r in tsv.corpus_lines(rows).collect()]
    tsv.write_corpus(rows, str(tmp_path / "c"))
    found = {r.id: (r.tag, r.words) for r in tsv.read_corpus(spark, str(tmp_path / "c")).collect()}
    assert found == {7: ("TITLE_7", ["a", "b", "c"]), 8: ("TITLE_8", [])}
    cased = {r.id: r.words for r in tsv.read_corpus(spark, str(tmp_path / "c"), lower=False).collect()}
    assert cased[7] == ["A", "b", "c"]


@pytest.mark.parametrize("kind,codec", [("CSV", "GZIP"), ("CSV", "NONE"), ("NEWLINE_DELIMITED_JSON", "GZIP")])
def test_export(spark, tmp_path, kind, codec):
    rows = spark.range(20).selectExpr("id", "concat(' a,\"', id) AS s")
    path = str(tmp_path / "x")
    export.export_table(rows, path, kind, codec, shards=3)
    files = [p.name for p in (tmp_path / "x").iterdir() if p.name.startswith("part")]
    assert len(files) == 3 and all(name.endswith(".gz") == (codec == "GZIP") for name in files)
    reader = spark.read.schema(rows.schema).option("header", True).option("escape", '"')
    back = reader.format(export.FORMATS[kind]).load(path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_export_refuses_unknown_names(spark, tmp_path):
    with pytest.raises(ValueError):
        export.export_table(spark.range(1), str(tmp_path / "x"), "XML")
    with pytest.raises(ValueError):
        export.export_table(spark.range(1), str(tmp_path / "x"), "CSV", "LZMA")


def test_word_vectors_meet_a_vocabulary(spark, tmp_path):
    table = spark.createDataFrame([("a", [1.0, -0.5]), ("b", [0.25, 3.0])], "word string, vec array<float>")
    path = str(tmp_path / "w")
    vectors.write_word_vectors(table, path)
    assert {r.word: r.vec for r in vectors.read_word_vectors(spark, path).collect()} == {"a": [1.0, -0.5], "b": [0.25, 3.0]}
    own = spark.createDataFrame([("b",), ("c",), ("b",)], "word string")
    assert [r.word for r in vectors.read_word_vectors(spark, path, own).collect()] == ["b"]


def test_word_vector_header_is_skipped(spark, tmp_path):
    (tmp_path / "glove.txt").write_text("2 2\na 1 2\nb 3 4\n")
    found = {r.word: r.vec for r in vectors.read_word_vectors(spark, str(tmp_path / "glove.txt")).collect()}
    assert found == {"a": [1.0, 2.0], "b": [3.0, 4.0]}


def test_keyed_vectors_and_libsvm(spark, tmp_path):
    table = spark.createDataFrame([(1, 2.0, [0.0, 0.5]), (2, -1.0, [3.0, 0.0])], "id long, label double, vec array<float>")
    vectors.write_vectors(table, str(tmp_path / "v"))
    assert vectors.read_vectors(spark, str(tmp_path / "v")).count() == 2
    vectors.write_libsvm(table, str(tmp_path / "s"))
    rows = vectors.libsvm_arrays(vectors.read_libsvm(spark, str(tmp_path / "s"), 2)).collect()
    assert sorted((r.label, r.vec) for r in rows) == [(-1.0, [3.0, 0.0]), (2.0, [0.0, 0.5])]


def test_json_arrays(spark, tmp_path):
    (tmp_path / "ids.json").write_text(json.dumps([5, 3, 9]))
    (tmp_path / "titles.json").write_text(json.dumps(["a, b", 'q "x"', "é"]))
    titles = vectors.read_titles(spark, str(tmp_path / "ids.json"), str(tmp_path / "titles.json"))
    assert {r.id: r.title for r in titles.collect()} == {5: "a, b", 3: 'q "x"', 9: "é"}
    vectors.write_titles(titles, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    words = vectors.read_index_words(spark, str(tmp_path / "titles.json")).collect()
    assert (2, "é") in [tuple(r) for r in words]


def test_json_arrays_in_several_files(spark, tmp_path):
    values = [f'v{i}, "x"\n' if i % 5 else None for i in range(23)]
    rows = spark.createDataFrame(list(enumerate(values)), "position long, value string").repartition(3)
    for size in (1, 7, 23, 100):
        path = str(tmp_path / f"a{size}")
        vectors.write_json_arrays(rows, path, size)
        files = sorted((int(f.parent.name.split("=")[1]), json.loads(f.read_text())) for f in (tmp_path / f"a{size}").glob("*/*.txt"))
        assert [v for _, part in files for v in part] == values and max(len(part) for _, part in files) <= size
        assert [tuple(r) for r in vectors.read_json_array(spark, path).orderBy("position").collect()] == list(enumerate(values))


def test_models_do_not_share_a_folder(spark, tmp_path):
    from pyspark.ml import Pipeline
    from threadlens.operators.forests import regressor, with_features

    data = with_features(spark.createDataFrame([(float(i % 2), [float(i), 1.0]) for i in range(20)], "label double, vec array<float>"))
    model = Pipeline(stages=[regressor()]).fit(data)
    models.save_model(model, str(tmp_path / "m"))
    again = models.load_model(str(tmp_path / "m"))
    assert again.transform(data).select("prediction").collect() == model.transform(data).select("prediction").collect()
    with pytest.raises(Exception):
        models.save_model(model, str(tmp_path / "m"))


def test_word_vectors_of_width_one_and_headers(spark, tmp_path):
    """Only a file's first line can be a header; a number may be a word."""
    from threadlens.sources.vectors import read_word_vectors

    (tmp_path / "a.txt").write_text("2 1\nx 0.5\n7 3\n")
    (tmp_path / "b.txt").write_text("y 1.5\n8 4\n")
    rows = {r.word: r.vec for r in read_word_vectors(spark, str(tmp_path)).collect()}
    assert rows == {"x": [0.5], "7": [3.0], "y": [1.5], "8": [4.0]}


def test_dropped_tables_are_gone(spark):
    from pathlib import Path

    from threadlens.session import drop_stored, materialize

    table = materialize(spark.range(3), "gone")
    place = Path(table.inputFiles()[0].removeprefix("file:")).parent
    assert place.exists()
    drop_stored(table, spark.range(2))
    assert not place.exists()
