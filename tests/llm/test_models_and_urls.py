"""Quality, toxicity, URL filter and the pipeline."""

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from conftest import words

from pyspark.sql import functions as F

from threadlens.llm import oracles, quality, queries, toxicity, url_filter


def tables(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def labelled(spark, d, got, label):
    truth = {r["doc_id"]: r[label] for r in tables(spark, d)[1].collect()}
    return [(r["held_out"], truth[r["doc_id"]], r["predicted"]) for r in got if r["doc_id"] in truth]


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


# --- quality --------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark, sf01):
    docs, labels = tables(spark, sf01)
    got = quality.quality(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    rows = [(y, p) for out, y, p in labelled(spark, sf01, got, "quality") if out]
    assert np.mean([y == p for y, p in rows]) >= 0.95
    assert np.mean([p for y, p in rows if y == 1]) >= 0.95


def test_quality_ignores_all_but_the_text(spark, awkward, sf01):
    docs, labels = tables(spark, sf01)
    moved = docs.selectExpr("doc_id", "text", "'x' AS lang", "'y' AS source", "0 AS n_chars", "'z' AS score", "'t' AS label")
    one, two = (dict(quality.quality(d, labels).select("doc_id", "score").collect()) for d in (docs, moved))
    assert all(abs(one[i] - two[i]) < 1e-9 for i in one)
    kept = quality.accepted(moved, labels)
    assert kept.columns == moved.columns and kept.where("score <> 'z'").isEmpty()


def test_quality_without_rows(spark, awkward, nothing):
    assert {r["score"] for r in quality.quality(awkward, no_labels(spark)).collect()} == {0.5}
    rows = [(1, 1, 0), (6, 0, 0), (6, 1, 1), (7, None, 1), (None, 1, 0), (12, 0, None), (15, 1, 0), (3, 1, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    got = quality.quality(awkward, labels).collect()
    assert len(got) == awkward.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.quality(nothing, labels).collect() == []


def test_all_rows_are_accepted_without_a_model(spark, awkward):
    kept = quality.accepted(awkward, no_labels(spark))
    assert kept.columns == awkward.columns and Counter(kept.collect()) == Counter(awkward.collect())


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    cuts = np.sort(rng.normal(size=(24, quality.BINS - 1)), axis=1)
    size = quality.WORDS + 24 * quality.BINS
    model = quality.Model(cuts, 0.3, rng.normal(size=size), rng.normal(size=(size, quality.FACTORS)))
    index, x = model.features("Some words and SOME more words!")
    pairs = sum(model.factors[index[a]] @ model.factors[index[b]] * x[a] * x[b] for a in range(len(x)) for b in range(a))
    z = 0.3 + model.linear[index] @ x + pairs
    assert model.score("Some words and SOME more words!") == pytest.approx(1 / (1 + np.exp(-np.clip(z, -40, 40))))


# --- toxicity -------------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark, sf01):
    docs, labels = tables(spark, sf01)
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        assert all(zlib.crc32(str(e["doc_id"]).encode()) % 5 for e in r["evidence"])
    rows = [(y, p) for out, y, p in labelled(spark, sf01, got, "toxic") if out]
    assert np.mean([y == p for y, p in rows]) >= 0.95
    assert np.mean([p for y, p in rows if y == 0]) <= 0.02


def test_block_max_search_is_exact(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    rng = random.Random(3)
    terms = [f"t{i}" for i in range(40)]
    make = lambda: {t: rng.randint(1, 4) for t in rng.sample(terms, rng.randint(0, 6))}
    counts = [make() for _ in range(150)]
    index = toxicity.Index(terms, np.array([rng.uniform(0.5, 3) for _ in terms]), list(range(150)), [i % 2 for i in range(150)], counts)
    for _ in range(100):
        query = index.vector(make() | {"unknown": 3})
        own = dict(query)
        cosines = [sum(own.get(t, 0) * w for t, w in v) for v in index.vectors]
        want = sorted(((-round(c, 12), p) for p, c in enumerate(cosines) if c > 0))[:15]
        got = index.nearest(query)
        assert [round(c, 9) for c, _ in got] == [round(-c, 9) for c, _ in want]


def test_terms_do_not_depend_on_the_number_of_examples():
    """5,000 words that each occur in 40 of 4,000 toxic rows only."""
    rows = [(1, {f"t{(r * 50 + i) % 5000}" for i in range(50)} | {"the", "and"}) for r in range(4000)] + [(0, {"the", "and"}) for _ in range(4000)]
    assert set(toxicity.choose_terms(rows)) == {f"t{i}" for i in range(5000)}
    # A word of chance is none, in a small or a large sample.
    rng = random.Random(4)
    for n in (400, 8000):
        assert toxicity.choose_terms([(i % 2, {f"w{rng.randrange(300)}" for _ in range(20)}) for i in range(n)]) == []


def test_search_with_many_ties():
    counts = [{"a": 1, "b": i % 3} if i % 3 else {"a": 1} for i in range(900)]
    index = toxicity.Index(["a", "b"], np.array([1.0, 2.0]), list(range(900)), [i % 2 for i in range(900)], counts)
    for query in ({"a": 1}, {"b": 1}, {"a": 2, "b": 1}):
        own = dict(index.vector(query))
        cosines = [round(sum(own.get(t, 0) * w for t, w in v), 12) for v in index.vectors]
        want = sorted((-c, p) for p, c in enumerate(cosines) if c > 0)[:15]
        assert [p for _, p in index.nearest(index.vector(query))] == [p for _, p in want]
        assert 7 not in [p for _, p in index.nearest(index.vector(query), but=7)]


def test_toxicity_without_rows(spark, awkward, nothing):
    assert {r["score"] for r in toxicity.toxicity(awkward, no_labels(spark)).collect()} == {0.0}
    rows = [(1, 1, 0), (6, 0, 1), (6, 1, 0), (7, None, 1), (None, 1, 0), (12, 0, None), (15, 1, 0), (3, 1, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(awkward, labels).collect()
    assert len(got) == awkward.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity(nothing, labels).collect() == []


# --- URL filter -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def duck():
    def connect(**frames):
        connection = duckdb.connect()
        for name, frame in frames.items():
            connection.register(f"raw_{name}", frame)
            connection.execute(f"CREATE TABLE {name} AS SELECT * FROM raw_{name}")
        return connection

    return connect


def compare(connection, df):
    names = df.columns
    want = connection.sql(oracles.OP10)
    order = [want.columns.index(c) for c in names]
    assert Counter(map(tuple, df.collect())) == Counter(tuple(r[i] for i in order) for r in want.fetchall())


def test_urls_against_sql(spark, sf01, duck):
    pages, labels = spark.read.parquet(f"{sf01}/pages.parquet"), spark.read.parquet(f"{sf01}/labels.parquet")
    compare(duck(pages=pages.toPandas(), labels=labels.toPandas()), queries.QUERIES["op10_url_filter"](spark, sf01))


def test_awkward_urls(spark, duck):
    import pandas as pd

    urls = [
        None, "", "no scheme", "http://", "http://X.Net", "http://x.net/", "HTTP://A.B.EXAMPLE.NET/en/x?y=/de/#z", "http://example.com/de", "http://example.com/de/",
        "http://notexample.com/de/", "http://example.com:8080/de/", "x://org/fr/?a", "http://a.org/fr/://b.net/", "http://É.net/", "http://net", "http://net/\nx", "http://a?b/c",
        "http://bad.example.com/1", "http://bad.example.com/1", "http://bad.example.com/2", "http://fine.org/1",
        "http://u:p@a.bad.co.uk:80/", "http://b.good.co.uk/", "http://co.uk/", "http://uk/", "http://aco.uk/", "http://10.0.0.1/", "http://10.0.0.2:8080/x",
        "http://[::1]:80/", "http://example.com./", "http://a..b/", "http://@/", "http://:80/", "http://.co.uk./",
    ]
    rows = [(n % 19 if n else None, u) for n, u in enumerate(urls * 3)] + [(1000 + n, f"http://bad.example.com/{n}") for n in range(200)]
    rows += [(2000 + n, f"http://h{n % 40}.example.org/{n}") for n in range(400)]
    rng = random.Random(0)
    marks = [(n, int(rng.random() < 0.05), 0) for n in range(1000, 1200)] + [(n, int(rng.random() < 0.9), 0) for n in range(2000, 2300)]
    marks += [(2001, 0, 1), (2002, None, 0), (None, 1, 0), (5, 1, None)]
    pages = spark.createDataFrame([(*r, "<html>", "clash") for r in rows], "page_id long, url string, html string, host string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = url_filter.judge(pages, url_filter.labelled_pages(labels))
    frame = pd.DataFrame(rows, columns=["page_id", "url"]).astype({"page_id": "Int64"})
    compare(duck(pages=frame, labels=pd.DataFrame(marks, columns=["doc_id", "quality", "toxic"]).astype("Int64")), got)
    verdicts = {(r["host"], r["rule"], r["verdict"]) for r in got.collect()}
    assert ("bad.example.com", None, "block") in verdicts and ("fine.org", None, "allow") in verdicts
    assert {v for h, r, v in verdicts if h == "" } == {"allow"}
    free = url_filter.judge(pages, url_filter.labelled_pages(labels.limit(0)))
    assert {r["verdict"] for r in free.where("rule IS NULL").collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), url_filter.labelled_pages(labels)).collect() == []


def test_registered_domains(spark):
    wanted = {
        "a.bad.co.uk": ("bad.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.aco.uk": ("aco.uk", "uk"), "www.example.com:80": ("example.com", "com"),
        "u@a.b.com.au.": ("b.com.au", "com.au"), "10.0.0.1": ("10.0.0.1", "[ip]"), "10.0.0.1:80": ("10.0.0.1", "[ip]"), "[::1]:80": ("[::1]", "[ip]"),
        "1.2.3.4.5": ("4.5", "5"), "localhost": ("localhost", "localhost"), "": ("", ""),
    }
    host = F.col("host")
    rows = spark.createDataFrame([(h,) for h in wanted], "host string").select(host, url_filter.domain_of(host), url_filter.suffix_of(host)).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == wanted


def test_reputation_stays_within_a_registered_domain(spark):
    poor = [(n, f"http://h{n % 9}.bad.co.uk/{n}") for n in range(300)]
    fine = [(1000 + n, f"http://h{n % 9}.good.co.uk/{n}") for n in range(300)]
    pages = spark.createDataFrame([*poor, *fine, (5000, "http://new.bad.co.uk/"), (5001, "http://new.good.co.uk/")], "page_id long, url string")
    labels = spark.createDataFrame([(n, int(n >= 1000), 0) for n, _ in poor + fine], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, url_filter.labelled_pages(labels)).collect()}
    assert {got[n] for n, _ in poor} == {"block"} and {got[n] for n, _ in fine} == {"allow"}
    assert (got[5000], got[5001]) == ("block", "allow")


def test_native_plans(spark, sf_dir):
    for name in ("op9_order_minhash", "op10_url_filter"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))


# --- pipeline -------------------------------------------------------------------------------------


def test_pipeline(spark, sf_dir):
    """Every stage against the plain meaning of its operator, on its own input."""
    import corpus_pipeline
    from test_duplicates import plain_fingerprint, plain_removal, plain_roots
    from test_tokens import best_fit, pieces_of, sequences_of

    docs, labels = tables(spark, sf_dir)
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near duplicates", "repeats", "benchmark", "packing"]
    read = lambda df: [tuple(r) for r in df.collect()]
    step = lambda name, df: spark.createDataFrame(read(stages[name](spark, df, sf_dir)), df.schema if name != "packing" else None)

    good = step("quality", docs)
    scores = dict(quality.quality(docs, labels).select("doc_id", "predicted").collect())
    assert Counter(read(good)) == Counter(r for r in read(docs) if scores[r[0]])

    single = step("near duplicates", good)
    fps = {r[0]: plain_fingerprint(r[1]) for r in read(good)}
    roots = plain_roots(list(fps.values()))
    least = {}
    for i, f in fps.items():
        least[roots[f]] = min(least.get(roots[f], i), i)
    assert Counter(read(single)) == Counter(r for r in read(good) if r[0] in least.values())

    cut = step("repeats", single)
    sizes = {r[0]: r[1] - r[2] for r in plain_removal([r[:2] for r in read(single)], 200)}
    assert cut.columns == names and {r[0] for r in read(cut)} == set(sizes)
    assert all(0 <= sizes[r[0]] - len(r[1].encode()) <= 6 and r[4] == len(r[1]) for r in read(cut))

    clean = step("benchmark", cut)
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaked = {r[0] for r in read(cut) if any(i in " ".join(r[1].lower().split()) for i in items)}
    assert {r[0] for r in read(clean)} == {r[0] for r in read(cut)} - leaked

    rows = read(stages["packing"](spark, clean, sf_dir))
    want = pieces_of(read(clean), 2048)
    assert Counter(r[:5] for r in rows) == want
    assert sequences_of(rows, 2048) == best_fit([p[3] for p in want.elements()], 2048)
    assert Counter(r[:5] for r in read(corpus_pipeline.run(spark, sf_dir))) == want
