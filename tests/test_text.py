"""Tokens, HTML, sentences, vocabulary."""

from collections import Counter

from pyspark.sql import functions as F

from threadlens.functions import text as tx
from threadlens.operators import corpus


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "s string").select(expr(F.col("s")).alias("x")).first().x


def test_tokenize(spark):
    assert one(spark, "  a b\tc ", tx.tokenize) == ["a", "b", "c"]
    assert one(spark, "", tx.tokenize) == []
    assert one(spark, "A\u00a0b\u2003c\x1cD\x85e\u3000", tx.tokenize) == ["a", "b", "c", "d", "e"]
    assert one(spark, "Ab C", lambda c: tx.tokenize(c, lower=False)) == ["Ab", "C"]


def test_long_tokens_are_dropped(spark):
    words = "x" * 49 + " " + "y" * 50
    assert one(spark, words, lambda c: tx.short_words(tx.tokenize(c))) == ["x" * 49]


def test_html(spark):
    cases = {
        "Hi <i>x</i><p>it&#x27;s &lt;ok&gt;": "Hi x\nit's <ok>",
        "a<P class=q>b</P><p>c": "a\nb\nc",
        "<script>var a='<p>';</script>x<style>p{}</style><!-- no\n<p> -->y": "x y",
        "a &amp;lt; b &amp;amp; c &nope; &": "a &lt; b &amp; c &nope; &",
        "&#233;&#x1F600;&#0;&#xD800;&quot;": "é😀&#0;&#xD800;\"",
        "1 < 2 and 3 > 2": "1 < 2 and 3 > 2",
        "": "",
        "<p><p> \n <b></b>": "",
    }
    for html, want in cases.items():
        assert one(spark, html, tx.html_to_text) == want, html


def test_sentences(spark):
    items = spark.createDataFrame(
        [(1, "story", "A  title", None), (2, "comment", None, "One <p>two &amp; three<p>"), (3, "comment", None, "<p>"),
         (4, "comment", None, "z" * 60), (5, "story", None, None), (6, "story", "A  title", None)],
        "id long, type string, title string, text string",
    )
    found = sorted((r.id, r.pos, r.words) for r in corpus.sentences(items).collect())
    assert found == [(1, 0, ["a", "title"]), (2, 0, ["one"]), (2, 1, ["two", "&", "three"]), (6, 0, ["a", "title"])]


def test_vocabulary_cap_and_ties(spark):
    docs = spark.createDataFrame([(1, "b a a c".split()), (2, "c b a d".split())], "id long, words array<string>")
    found = [(r.word_id, r.word, r.n) for r in corpus.vocabulary(docs).orderBy("word_id").collect()]
    assert found == [(0, "a", 3), (1, "b", 2), (2, "c", 2), (3, "d", 1)]
    assert sorted(r.word for r in corpus.vocabulary(docs, size=2).collect()) == ["a", "b"]
    assert sorted(r.word for r in corpus.vocabulary(docs, min_count=2).collect()) == ["a", "b", "c"]


def test_frequent_words_by_summaries(spark, monkeypatch, request):
    import random
    from collections import Counter

    from threadlens.operators import frequent

    rng = random.Random(8)
    ranks, weights = range(3000), [1 / (i + 1) for i in range(3000)]
    rows = [(i, [f"w{r}" for r in rng.choices(ranks, weights, k=40)] + [None]) for i in range(2000)]
    docs = spark.createDataFrame([*rows, (-1, None), (-2, [])], "id long, words array<string>").repartition(4)
    # Small batches, so that full summaries are cut often.
    monkeypatch.setattr(frequent, "LEAST_COUNTERS", 100)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    request.addfinalizer(lambda: spark.conf.set(batch, before))
    spark.conf.set(batch, "50")
    true = Counter(w for _, words in rows for w in words if w)
    sums = Counter()
    for r in frequent.summaries(docs, "words", 300).collect():
        sums[r.word] += r.n
    error = sums.pop(None)
    assert error > 0 and all(sums[w] <= n <= sums[w] + error for w, n in true.items())
    want = sorted(true.items(), key=lambda x: (-x[1], x[0]))
    for size, told in ((10, True), (20, True), (3000, True), (5000, True)):
        known = frequent.candidates(docs, "words", size)
        assert (known is not None) == told
        assert {w for w, _ in want[:size]} <= {r.word for r in known.collect()}
        got = corpus.vocabulary(docs, size=size).orderBy("word_id").collect()
        assert [(r.word, r.n) for r in got] == want[:size]
    assert frequent.candidates(docs, "words", 10).count() < 500 < len(true)
    # Where the error hides the last words the plain way answers.
    monkeypatch.setattr(frequent, "COUNTERS_A_WORD", 1)
    assert frequent.candidates(docs, "words", 400) is None
    assert [(r.word, r.n) for r in corpus.vocabulary(docs, size=400).orderBy("word_id").collect()] == want[:400]
    nothing = docs.where("id < 0")
    assert corpus.vocabulary(nothing, size=5).collect() == [] and corpus.vocabulary(nothing, size=0).collect() == []


def test_vocabulary_with_a_hot_word_over_partitions(spark):
    words = ["hot"] * 500 + [f"w{i % 97}" for i in range(1000)]
    docs = spark.createDataFrame([(i, [w]) for i, w in enumerate(words)], "id long, words array<string>")
    want = sorted(Counter(words).items(), key=lambda x: (-x[1], x[0]))
    for parts in (1, 16):
        got = corpus.vocabulary(docs.repartition(parts)).orderBy("word_id").collect()
        assert [(r.word, r.n) for r in got] == want and [r.word_id for r in got] == list(range(len(want)))


def test_idf(spark):
    docs = spark.createDataFrame([(1, ["a", "a"]), (2, ["a", "b"]), (3, [])], "id long, words array<string>")
    found = {r.word: (r.df, round(r.idf, 6)) for r in corpus.idf_table(docs).collect()}
    assert found == {"a": (2, 0.287682), "b": (1, 0.693147)}


def test_all_entities_and_matching_ends(spark):
    from pyspark.sql import functions as F

    from threadlens.functions.text import html_to_text

    rows = [("&copy;&middot;&AMP;&notanentity;&hellip;&NotEqualTilde;",), ('a<script>x="</style>";y</script>b',), ("a<style>p{}</style >b &#8364; &#xe9;",)]
    found = spark.createDataFrame(rows, "h string").select(html_to_text(F.col("h"))).collect()
    assert [r[0] for r in found] == ["©·&&notanentity;…≂̸", "a b", "a b € é"]


def test_cased_request_words(spark):
    from threadlens.operators.words import request_terms

    asked = spark.createDataFrame([("a", ["Cat"], None)], "request_id string, positive array<string>, negative array<string>")
    assert [r.word for r in request_terms(asked).collect()] == ["cat"]
    assert [r.word for r in request_terms(asked, cased=True).collect()] == ["Cat"]


def test_long_words_go(spark):
    from threadlens.operators.corpus import comment_sentences

    rows = [(1, "comment", None, "one " + "x" * 50 + " " + "y" * 49)]
    found = comment_sentences(spark.createDataFrame(rows, "id long, type string, title string, text string")).collect()
    assert found[0].words == ["one", "y" * 49]


def test_markup_that_is_not_plain(spark):
    cases = {
        '<a title="x>y">link</a>': "link",
        "<a title='>' href=a\"b>link</a> it's": "link it's",
        "<p title=it's>a<p>b": "a\nb",
        "a<!-- b <p> c": "a",
        "a<!-->b<!--->c<!-- x --!>d": "a b c d",
        "a<script>b</scripty>c": "a",
        "a<script>b</SCRIPT x='>'>c": "a c",
        "<title>a <b> &amp; c</title>d": "a <b> & c d",
        'a <b c="d': "a",
        "a <b": "a",
        "a </ b>c</>d<? e ?>f<!doctype html>g": "a c d f g",
        "<pre>a</pre><P/>b<p\n>c": "a\nb\nc",
        "<a b = 'c>' / d=>e": "e",
        "&#0000000065;&#x00000042;": "AB",
        "a<": "a<",
        "a</": "a</",
        "<a " + "b='>' " * 20000 + ">c": "c",
        "<a x='" + ">" * 200000 + "'>c<!--" + "-" * 100000: "c",
    }
    for html, want in cases.items():
        assert one(spark, html, tx.html_to_text) == want, html[:80]


def read_markup(html):
    """An independent reading: one character after the other, by the states of the HTML standard."""
    out, i, n, space = [], 0, len(html), " \t\n\f\r"

    def to_end_of_tag(i):
        while i < n and html[i] != ">":
            if html[i] in space + "/":
                i += 1
                continue
            i += 1
            while i < n and html[i] not in space + "/>=":
                i += 1
            j = i
            while j < n and html[j] in space:
                j += 1
            if j == n or html[j] != "=":
                continue
            i = j + 1
            while i < n and html[i] in space:
                i += 1
            if i < n and html[i] in "\"'":
                quote, i = html[i], i + 1
                while i < n and html[i] != quote:
                    i += 1
                i += 1
            else:
                while i < n and html[i] not in space + ">":
                    i += 1
        return min(i + 1, n)

    while i < n:
        ahead = html[i + 1:i + 2]
        if html[i] != "<" or not (ahead.isalpha() or ahead in "!?/" and ahead) or html[i:] == "</":
            out.append(html[i])
            i += 1
        elif html.startswith("<!--", i):
            ends = [e for e in (html.find("-->", i + 2), html.find("--!>", i + 4)) if e >= 0]
            if html.startswith("<!-->", i) or html.startswith("<!--->", i):
                i = html.index(">", i) + 1
            else:
                i = html.index(">", min(ends)) + 1 if ends else n
            out.append(" ")
        elif ahead in "!?" or ahead == "/" and not html[i + 2].isalpha():
            end = html.find(">", i + 2)
            i = n if end < 0 else end + 1
            out.append(" ")
        else:
            j = i + 1 + (ahead == "/")
            k = j
            while k < n and html[k] not in space + "/>":
                k += 1
            name, i = html[j:k].lower(), to_end_of_tag(k)
            out.append("\n" if name == "p" and ahead != "/" else " ")
            if ahead != "/" and name in ("script", "style", "title", "textarea"):
                end = i
                while end < n and not (html[end:end + len(name) + 2].lower() == "</" + name and html[end + len(name) + 2:end + len(name) + 3] in [*space, "/", ">"]):
                    end += 1
                if name in ("title", "textarea"):
                    out.append(html[i:end])
                out.append(" ")
                i = to_end_of_tag(end + len(name) + 2) if end < n else n
    lines = [" ".join(line.replace("\f", " ").split()) for line in "".join(out).split("\n")]
    return "\n".join(line for line in lines if line)


def test_markup_against_an_independent_reader(spark):
    import random

    import duckdb
    from pyspark.sql import functions as F

    from threadlens.plans.oracles import plain_text

    rng = random.Random(5)
    parts = ["<", ">", "<p", "<p>", "</p>", "<a href=", '"', "'", "=", " ", "\n", "x", "yz", "<!--", "-->", "--!>", "-", "<script>", "</script", "</script>", "<style a='>'>",
             "</style>", "<title>", "</title >", "<textarea/>", "</textarea>", "</", "/", "<!", "?", "<b>", "<br/>", "<scripty>"]
    pages = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    found = spark.createDataFrame([(i, h) for i, h in enumerate(pages)], "i int, h string").select("i", tx.html_to_text(F.col("h")).alias("t"))
    got = dict(found.collect())
    wrong = [(h, got[i], read_markup(h)) for i, h in enumerate(pages) if got[i] != read_markup(h)]
    assert not wrong, wrong[:5]
    connection = duckdb.connect()
    connection.execute("CREATE TABLE pages (i INT, h VARCHAR)")
    connection.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(pages)))
    by_sql = dict(connection.sql(f"SELECT i, {plain_text('h')} FROM pages").fetchall())
    wrong = [(h, got[i], by_sql[i]) for i, h in enumerate(pages) if got[i] != by_sql[i]]
    assert not wrong, wrong[:5]
