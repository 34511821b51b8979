"""One query for every operator, over the whole of the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.functions import labels as lab
from threadlens.functions.clean import register_sql_functions
from threadlens.functions.text import html_to_text, tokenize
from threadlens.functions.vector import add, dot_distance, subtract
from threadlens.operators import corpus, embeddings, forests, intervals, joins, metrics, multiprobe, pruned, sampling, scoring, similarity, skipgram, threads, trees, vector_index, words
from threadlens.operators.huffman import huffman_codes as codes_of
from threadlens.operators.items import scored_stories, submission_corpus, typed_items
from threadlens.operators.ranking import with_position
from threadlens.plans.views import table, view
from threadlens.session import drop_stored, is_stored, materialize, prepare, scratch_path, spread
from threadlens.sources import export, items as item_files, models as model_files, tsv, vectors as vector_files
from threadlens.streaming import scoring as stream_scoring

EMBEDDING_DIM = 64
SAMPLE_SIZE = 500
RECALL_SHARES = [0.1, 0.6, 1.0]
QUERIES: dict = {}


def query(function):
    """Register a query under its function name; its session gets the runtime settings first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(prepare(spark), sf_dir)

    QUERIES[function.__name__] = run
    return run


# --- presentation ---------------------------------------------------------------------------------


def micro(c: Column) -> Column:
    """A double in whole millionths, the same in every engine."""
    return F.floor(c * 1e6 + 0.5).cast("bigint")


def vector_text(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: micro(x.cast("double")).cast("string")), ",")


def sentence_text(df: DataFrame) -> DataFrame:
    return df.select("id", "pos", F.array_join("words", " ").alias("sentence"))


def thread_text(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "root", "depth", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


# --- derived inputs -------------------------------------------------------------------------------


def _documents(spark, d) -> DataFrame:
    """``(id, words)`` of all documents."""
    return spread(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "id").select(
        "id", tokenize(F.col("text")).alias("words")
    )


def _word_table(spark, d) -> DataFrame:
    """Vectors for the most frequent words: the word of rank r gets embedding r."""
    ranked = corpus.vocabulary(_documents(spark, d))
    given = table(spark, d, "embeddings").select(F.col("vec_id").alias("word_id"), F.col("embedding").alias("vec"))
    return ranked.join(given, "word_id")


def _conversation_terms(spark, d) -> DataFrame:
    """Every conversation asks for the assistant's words and against all others."""
    talk = table(spark, d, "conversations")
    sign = F.when(F.col("role") == "assistant", 1).otherwise(-1)
    return talk.transform(
        corpus.each(tokenize(F.col("text")), "word", F.col("conv_id").alias("request_id"), sign.alias("sign"))
    )


def _centroids(spark, d) -> DataFrame:
    """The mean vector of every label, as requests."""
    vec = F.col("vec")
    return view(spark, d, "vectors").groupBy(F.col("label").alias("request_id")).agg(
        F.array(*[F.avg(vec[i].cast("double")) for i in range(EMBEDDING_DIM)]).alias("vec")
    )


def _found(df: DataFrame) -> DataFrame:
    return df.select("request_id", "rank", "id", micro(F.col("distance")).alias("distance_micro"))


# --- ingest and files -----------------------------------------------------------------------------


def _typed_text(df: DataFrame) -> DataFrame:
    return df.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))


@query
def typed_items_table(spark, d):
    return _typed_text(typed_items(view(spark, d, "raw_items")))


@query
def csv_ingest(spark, d):
    path = scratch_path(spark, "raw-csv")
    item_files.write_raw_csv(view(spark, d, "raw_items"), path)
    typed_path = scratch_path(spark, "typed")
    item_files.write_items(typed_items(item_files.read_raw_csv(spark, path)), typed_path)
    return _typed_text(item_files.read_items(spark, typed_path))


def _orders_round_trip(spark, d, export_format):
    orders = table(spark, d, "orders")
    path = scratch_path(spark, "export")
    export.export_table(orders, path, export_format, "GZIP", shards=8)
    reader = spark.read.schema(orders.schema)
    if export_format == "CSV":
        reader = reader.option("header", True).option("escape", '"')
    return reader.format(export.FORMATS[export_format]).load(path).withColumn(
        "o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    ).withColumn("o_totalprice", micro(F.col("o_totalprice")))


@query
def export_json_roundtrip(spark, d):
    return _orders_round_trip(spark, d, "NEWLINE_DELIMITED_JSON")


@query
def export_csv_roundtrip(spark, d):
    return _orders_round_trip(spark, d, "CSV")


@query
def csv_header_ingest(spark, d):
    """The same dump with a header line in every shard."""
    path = scratch_path(spark, "raw-csv-header")
    item_files.write_raw_csv(view(spark, d, "raw_items"), path, header=True)
    return _typed_text(typed_items(item_files.read_raw_csv(spark, path, header=True)))


@query
def typed_items_sql(spark, d):
    """Typed items in SQL over a temporary view, with the registered parsers."""
    register_sql_functions(spark)
    item_files.register_view(view(spark, d, "raw_items"), "raw_items_view")
    return spark.sql("""
        SELECT emptyAsNull(author) AS author, optInt(score) AS score, emptyAsNull(title) AS title, emptyAsNull(type) AS type,
               optLong(parent) AS parent, optBool(deleted) AS deleted, optInt(descendants) AS descendants, optLong(id) AS id
        FROM raw_items_view WHERE optLong(id) IS NOT NULL""")


@query
def json_titles(spark, d):
    """Titles and words as JSON arrays, written by position in files of bounded length and read back."""
    titles = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("title"))
    ranked = with_position(titles, [F.col("id"), F.col("title")])
    terms = titles.transform(corpus.each(tokenize(F.col("title")), "value")).distinct()
    parts = {
        "ids": ranked.select("position", F.col("id").alias("value")), "titles": ranked.select("position", F.col("title").alias("value")),
        "words": with_position(terms, [F.col("value")]),
    }
    paths = {name: scratch_path(spark, name) for name in parts}
    for name, values in parts.items():
        vector_files.write_json_arrays(values, paths[name], values_a_file=50)
    found = vector_files.read_titles(spark, paths["ids"], paths["titles"])
    words = vector_files.read_index_words(spark, paths["words"]).withColumnRenamed("word", "title")
    return found.select("id", "title", F.lit("title").alias("kind")).union(words.select("word_id", "title", F.lit("word").alias("kind")))


@query
def edge_tsv(spark, d):
    path = scratch_path(spark, "edges")
    tsv.write_edges(threads.thread_edges(view(spark, d, "thread_items")), path)
    return tsv.read_edges(spark, path)


@query
def ancestry_tsv(spark, d):
    path = scratch_path(spark, "ancestry")
    nodes = threads.thread_ancestors(threads.thread_edges(view(spark, d, "thread_items"))).nodes
    tsv.write_ancestry(nodes, path)
    return spark.read.text(path)


@query
def root_tsv(spark, d):
    path = scratch_path(spark, "roots")
    tsv.write_roots(threads.thread_roots(threads.thread_edges(view(spark, d, "thread_items"))).nodes, path)
    return spark.read.text(path)


@query
def corpus_tsv(spark, d):
    return tsv.corpus_lines(submission_corpus(view(spark, d, "stories")))


@query
def corpus_parse(spark, d):
    path = scratch_path(spark, "corpus")
    tsv.write_corpus(submission_corpus(view(spark, d, "stories")), path)
    parsed = tsv.read_corpus(spark, path)
    return parsed.select("tag", "id", F.array_join("words", " ").alias("sentence"))


@query
def libsvm_roundtrip(spark, d):
    path = scratch_path(spark, "libsvm")
    vector_files.write_libsvm(view(spark, d, "vectors"), path)
    rows = vector_files.libsvm_arrays(vector_files.read_libsvm(spark, path, EMBEDDING_DIM))
    return rows.select(F.col("label").cast("int").alias("label"), vector_text(F.col("vec")).alias("vec"))


@query
def word_vector_text(spark, d):
    """Written as text, read back for a vocabulary that holds some of the words."""
    path = scratch_path(spark, "word-vectors")
    vector_files.write_word_vectors(view(spark, d, "vectors"), path)
    own = table(spark, d, "labels").select(F.concat(F.lit("w"), F.col("doc_id").cast("string")).alias("word"))
    known = vector_files.read_word_vectors(spark, path, own)
    return known.select("word", vector_text(F.col("vec")).alias("vec"))


@query
def vector_table_roundtrip(spark, d):
    path = scratch_path(spark, "vectors")
    vector_files.write_vectors(view(spark, d, "vectors").select("id", "vec"), path)
    return vector_files.read_vectors(spark, path).select("id", vector_text(F.col("vec")).alias("vec"))


# --- threads --------------------------------------------------------------------------------------


@query
def thread_edges(spark, d):
    return threads.thread_edges(view(spark, d, "thread_items"))


@query
def thread_ancestors(spark, d):
    return thread_text(threads.thread_ancestors(view(spark, d, "event_tree")).nodes)


@query
def thread_ancestors_items(spark, d):
    return thread_text(threads.thread_ancestors(threads.thread_edges(view(spark, d, "thread_items"))).nodes)


@query
def thread_ancestors_deep(spark, d):
    edges = threads.thread_edges(materialize(view(spark, d, "user_chains"), "chains"))
    return thread_text(threads.thread_ancestors(edges).nodes)


@query
def thread_root(spark, d):
    return threads.thread_roots(view(spark, d, "event_tree")).nodes


@query
def thread_cycles(spark, d):
    return threads.thread_ancestors(threads.thread_edges(view(spark, d, "part_links"))).cyclic_ids


@query
def thread_intervals(spark, d):
    """Links among parts hold cycles; the parts outside of them get their intervals."""
    return intervals.thread_intervals(threads.thread_edges(view(spark, d, "part_links"))).nodes


@query
def thread_lies_below(spark, d):
    """Every event of a tree is asked whether it lies below the event of a seventh of its number."""
    edges = materialize(view(spark, d, "event_tree"), "event-tree")
    seventh = F.floor(F.col("id") / 7).cast("bigint") + 1
    return intervals.lies_below(edges.select("id", seventh.alias("ancestor")), intervals.thread_intervals(edges).nodes)


# --- selections, labels, samples ------------------------------------------------------------------


@query
def scored_story_rows(spark, d):
    return scored_stories(view(spark, d, "stories")).select("id", "title", "score")


@query
def submission_titles(spark, d):
    return submission_corpus(view(spark, d, "stories"))


@query
def label_dead(spark, d):
    return scored_stories(view(spark, d, "stories")).select(
        "id", lab.dead_label(F.col("dead")).cast("int").alias("label")
    )


def _commented(spark, d) -> DataFrame:
    rows = scored_stories(view(spark, d, "stories"))
    return rows.select("id", lab.commented_label(F.col("descendants")).alias("label")).where("label IS NOT NULL")


@query
def label_commented(spark, d):
    return _commented(spark, d).withColumn("label", F.col("label").cast("int"))


@query
def class_counts(spark, d):
    return metrics.class_counts(_commented(spark, d)).withColumn("label", F.col("label").cast("int"))


@query
def balanced_sample(spark, d):
    return sampling.class_sample(_commented(spark, d), ["id"]).withColumn("label", F.col("label").cast("int"))


@query
def dead_sample(spark, d):
    """The smaller class lies below the target and is kept whole."""
    rows = scored_stories(view(spark, d, "stories")).select("id", lab.dead_label(F.col("dead")).alias("label"))
    return sampling.class_sample(rows, ["id"], target=100).withColumn("label", F.col("label").cast("int"))


@query
def fixed_sample(spark, d):
    rows = sentence_text(corpus.comment_sentences(view(spark, d, "thread_items")))
    return sampling.fixed_sample(materialize(rows, "sentences"), ["id", "pos"], SAMPLE_SIZE)


@query
def hash_split(spark, d):
    return sampling.hash_split(view(spark, d, "stories").select("id"), ["id"])


@query
def log_label(spark, d):
    rows = scored_stories(view(spark, d, "stories")).select("id", "score", lab.log_label(F.col("score")).alias("label"))
    return rows.select(
        "id", "score", micro(F.col("label")).alias("label_micro"), micro(lab.undo_log(F.col("label"))).alias("undone_micro")
    )


# --- text -----------------------------------------------------------------------------------------


@query
def tokenized_documents(spark, d):
    return _documents(spark, d).select(
        "id", F.size("words").cast("bigint").alias("n"), F.md5(F.array_join("words", " ")).alias("digest")
    )


@query
def html_plaintext(spark, d):
    pages = spread(table(spark, d, "pages").select("page_id", "html"), "page_id")
    return pages.select("page_id", html_to_text(F.col("html")).alias("text"))


@query
def comment_sentences(spark, d):
    return sentence_text(corpus.comment_sentences(view(spark, d, "thread_items")))


@query
def sentence_union(spark, d):
    return sentence_text(corpus.sentences(view(spark, d, "thread_items")))


@query
def page_sentences(spark, d):
    """Web pages as comment texts: markup, entities and words of 50 characters or more come up here."""
    pages = spread(table(spark, d, "pages").select("page_id", "html"), "page_id")
    items = pages.select(F.col("page_id").alias("id"), F.lit("comment").alias("type"), F.lit(None).cast("string").alias("title"), F.col("html").alias("text"))
    return sentence_text(corpus.comment_sentences(items))


@query
def vocabulary(spark, d):
    return corpus.vocabulary(_documents(spark, d))


@query
def vocabulary_capped(spark, d):
    """The report of the thousand most frequent words."""
    return corpus.vocabulary(_documents(spark, d), size=1000, min_count=2)


@query
def idf_table(spark, d):
    return corpus.idf_table(_documents(spark, d)).select("word", "df", micro(F.col("idf")).alias("idf_micro"))


# --- vectors --------------------------------------------------------------------------------------


@query
def score_vector_join(spark, d):
    rows = scored_stories(view(spark, d, "stories")).select("id", "score")
    return joins.join_vectors(rows, view(spark, d, "vectors")).select("id", "score", vector_text(F.col("vec")).alias("vec"))


@query
def vector_concat(spark, d):
    rows = view(spark, d, "vectors")
    second = rows.select("id", F.reverse("vec").alias("vec"))
    return joins.concat_by_id(rows.select("id", "label", "vec"), second).select(
        "id", "label", vector_text(F.col("vec")).alias("vec")
    )


def _tagged(spark, d) -> DataFrame:
    return view(spark, d, "vectors").select(F.concat(F.lit("TITLE_"), F.col("id").cast("string")).alias("tag"), "vec")


@query
def tag_vector_join(spark, d):
    rows = scored_stories(view(spark, d, "stories")).select("id", "tag")
    return joins.join_by_tag(rows, _tagged(spark, d)).select("id", "tag", vector_text(F.col("vec")).alias("vec"))


@query
def missing_tags(spark, d):
    return joins.missing_tags(scored_stories(view(spark, d, "stories")).select("id", "tag"), _tagged(spark, d))


@query
def vector_arithmetic(spark, d):
    """Every vector plus and minus the next one."""
    rows = view(spark, d, "vectors").select("id", "vec")
    other = rows.select((F.col("id") - 1).alias("id"), F.col("vec").alias("next"))
    return rows.join(other, "id").select(
        "id",
        vector_text(add(F.col("vec").cast("array<double>"), F.col("next"))).alias("total"),
        vector_text(subtract(F.col("vec").cast("array<double>"), F.col("next"))).alias("difference"),
    )


@query
def dot_distance_pairs(spark, d):
    rows = view(spark, d, "vectors").select("id", "vec")
    other = rows.select((F.col("id") - 1).alias("id"), F.col("vec").alias("next"))
    distance = dot_distance(F.col("vec"), F.col("next"))
    cosine = dot_distance(F.col("vec"), F.col("next"), normalize=True)
    return rows.join(other, "id").select(
        "id", micro(distance).alias("distance_micro"), micro(1 - distance).alias("sim_micro"),
        micro(cosine).alias("cosine_micro"),
    )


@query
def word_analogy_vector(spark, d):
    found = words.analogy_vectors(_conversation_terms(spark, d), _word_table(spark, d), EMBEDDING_DIM)
    return found.select("request_id", F.col("known").cast("bigint").alias("known"), vector_text(F.col("vec")).alias("vec"))


@query
def pretrained_overlay(spark, d):
    """Embeddings laid over the document vocabulary; most words start from their seeded vector."""
    ranked = materialize(corpus.vocabulary(_documents(spark, d)), "vocabulary")
    given = table(spark, d, "embeddings").select(F.col("vec_id").alias("word_id"), F.col("embedding").alias("vec"))
    pretrained = ranked.join(given, "word_id").select("word", "vec")
    rows = joins.overlay_pretrained(spread(ranked, "word"), pretrained, EMBEDDING_DIM)
    return rows.select("word_id", "word", "pretrained", F.md5(vector_text(F.col("vec"))).alias("digest"))


@query
def lsh_buckets(spark, d):
    planes = similarity.hyperplanes(similarity.DOCUMENT_BITS, EMBEDDING_DIM)
    return similarity.with_bucket(view(spark, d, "vectors").select("id", "vec"), planes).select("id", "bucket")


@query
def lsh_knn_docs(spark, d):
    planes = similarity.hyperplanes(similarity.DOCUMENT_BITS, EMBEDDING_DIM)
    return _found(similarity.nearest_by_hash(_centroids(spark, d), view(spark, d, "vectors"), planes))


@query
def lsh_index_knn(spark, d):
    """The same search with the five bits of the word index, through a stored index."""
    path = scratch_path(spark, "index")
    planes = similarity.hyperplanes(similarity.WORD_BITS, EMBEDDING_DIM)
    similarity.write_index(view(spark, d, "vectors").select("id", "vec"), planes, path, partitioned=True)
    index, stored = similarity.read_index(spark, path)
    return _found(similarity.nearest_by_hash(_centroids(spark, d), index, stored))


@query
def multiprobe_knn(spark, d):
    """Ten neighbours of every centroid from a tenth of the buckets of the document index."""
    planes = similarity.hyperplanes(similarity.DOCUMENT_BITS, EMBEDDING_DIM)
    return _found(multiprobe.nearest_by_probes(_centroids(spark, d), view(spark, d, "vectors"), planes))


@query
def multiprobe_recall(spark, d):
    """How many neighbours of the exact search are found when a tenth, six tenths and all of the buckets are open."""
    planes = similarity.hyperplanes(similarity.DOCUMENT_BITS, EMBEDDING_DIM)
    asked = materialize(_centroids(spark, d), "centroids")
    index = materialize(similarity.with_bucket(view(spark, d, "vectors").select("id", "vec"), planes), "hashed")
    exact = materialize(similarity.nearest_exact(asked, index), "exact")
    rows = [
        multiprobe.recall(multiprobe.nearest_by_probes(asked, index, planes, share=share), exact).select(F.lit(round(100 * share)).alias("percent"), "wanted", "hits")
        for share in RECALL_SHARES
    ]
    return rows[0].union(rows[1]).union(rows[2])


@query
def pruned_knn(spark, d):
    """Ten neighbours of every twentieth vector, from the blocks of the index that may hold them."""
    vectors = view(spark, d, "vectors").select("id", "vec")
    requests = vectors.where("id % 20 = 0").select(F.col("id").alias("request_id"), "vec")
    return _found(pruned.nearest_pruned(requests, vectors))


@query
def index_changes(spark, d):
    """The vector index after upserts (every 7th vector turned round), deletes (every 5th id), compaction and another upsert."""
    vectors = view(spark, d, "vectors").select("id", "vec")
    planes = similarity.hyperplanes(similarity.WORD_BITS, EMBEDDING_DIM)
    index = vector_index.VectorIndex.create(vectors, planes, scratch_path(spark, "changing"))
    turned = vectors.where("id % 7 = 0").withColumn("vec", F.reverse("vec"))
    index.upsert("turned", turned)
    index.delete("fifths", vectors.where("id % 5 = 0"))
    index.upsert("turned", turned)  # a repeated commit counts once
    index.compact()
    index.upsert("back", vectors.where("id % 35 = 0"))
    return index.rows().select("id", "bucket", vector_text(F.col("vec")).alias("vec"))


@query
def exact_knn(spark, d):
    return _found(similarity.nearest_exact(_centroids(spark, d), view(spark, d, "vectors")))


@query
def similar_words(spark, d):
    planes = similarity.hyperplanes(similarity.WORD_BITS, EMBEDDING_DIM)
    known = materialize(_word_table(spark, d), "words")
    found = scoring.similar_words(_conversation_terms(spark, d), known, planes)
    return found.select("request_id", "rank", "word", micro(F.col("sim")).alias("sim_micro"), vector_text(F.col("vec")).alias("vec"))


# --- metrics --------------------------------------------------------------------------------------


@query
def mse_metric(spark, d):
    rows = table(spark, d, "orders").select(
        F.col("o_totalprice").alias("label"), (F.lit(150000.0) + F.col("o_custkey") % 1000).alias("prediction")
    )
    return metrics.mean_squared_error(rows).select("n", F.round("mse", 2).alias("mse"))


@query
def error_rates(spark, d):
    rows = table(spark, d, "labels").select(F.col("quality").alias("label"), F.col("toxic").alias("prediction"))
    return metrics.error_rates(rows).select(F.round("false_positive", 6).alias("false_positive"), F.round("false_negative", 6).alias("false_negative"))


# --- forests --------------------------------------------------------------------------------------


def _forest_inputs(spark, d) -> tuple[DataFrame, DataFrame]:
    return view(spark, d, "stories"), view(spark, d, "vectors").select("id", "vec")


@query
def rf_score_log(spark, d):
    return _in_range(forests.score_log_forest(*_forest_inputs(spark, d)), 0.0, None)


@query
def rf_score_raw(spark, d):
    return _in_range(forests.score_raw_forest(*_forest_inputs(spark, d)), 0.0, 499.0)


@query
def rf_score_concat(spark, d):
    stories, vectors = _forest_inputs(spark, d)
    return _in_range(forests.score_concat_forest(stories, vectors, vectors.select("id", F.reverse("vec").alias("vec"))), 0.0, 499.0)


@query
def rf_comment_count(spark, d):
    return _in_range(forests.comment_count_forest(*_forest_inputs(spark, d)), 0.0, None)


@query
def rf_dead(spark, d):
    return _in_range(forests.dead_forest(*_forest_inputs(spark, d)), 0.0, 1.0)


@query
def rf_commented(spark, d):
    return _in_range(forests.commented_forest(*_forest_inputs(spark, d)), 0.0, 1.0)


def _story_words(spark, d) -> DataFrame:
    """``(id, label, words)`` of scored stories; the label is the score."""
    rows = scored_stories(view(spark, d, "stories")).select("id", "score", "title")
    return rows.select("id", F.col("score").alias("label"), tokenize(F.col("title"), lower=False).alias("words"))


@query
def rf_tfidf(spark, d):
    return _in_range(forests.tfidf_forest(_story_words(spark, d)), 0.0, 499.0)


@query
def model_roundtrip(spark, d):
    """Predictions of a forest that was saved and loaded, beside those of the forest itself."""
    stories, vectors = _forest_inputs(spark, d)
    forest = forests.score_raw_forest(stories, vectors)
    path = scratch_path(spark, "forest")
    model_files.save_model(forest.model, path)
    again = forests.predict(model_files.load_model(path), vectors)
    own = forest.predictions.select("id", F.col("prediction").alias("first"))
    return again.join(own, "id").select("id", (F.col("prediction") == F.col("first")).alias("same"))


@query
def forest_nodes(spark, d):
    """Predictions from the stored node tables of two forests, beside those of the forests themselves."""
    stories, vectors = _forest_inputs(spark, d)
    parts = []
    for name, train, classes in (("score", forests.score_raw_forest, False), ("commented", forests.commented_forest, True)):
        forest = train(stories, vectors)
        path = scratch_path(spark, "nodes")
        trees.forest_nodes(forest.model).write.parquet(path)
        again = trees.predict_by_nodes(spark.read.parquet(path), vectors, classes)
        same = F.abs(F.col("prediction") - F.col("first")) < 1e-9
        own = forest.predictions.select("id", F.col("prediction").alias("first"))
        parts.append(own.join(again, "id").select(F.lit(name).alias("forest"), "id", same.alias("same")))
    return parts[0].union(parts[1])


@query
def node_table_predictions(spark, d):
    """Predictions of a forest that is given as a table: five trees of depth three over means of the vectors."""
    vectors = view(spark, d, "vectors")
    means = vectors.agg(F.array(*[F.round(F.avg(F.col("vec")[i].cast("double")), 4) for i in range(EMBEDDING_DIM)]).alias("means"))
    tree, node = (F.col("id") / 15).cast("int"), (F.col("id") % 15).cast("int")
    grid = spark.range(75).select(tree.alias("tree"), node.alias("node"), ((11 * tree + 5 * node) % EMBEDDING_DIM).alias("feature"))
    inner = F.col("node") < 7
    thresholds = means.select(F.posexplode("means").alias("feature", "threshold"))
    nodes = grid.join(thresholds, "feature").select(
        "tree", "node", "feature", "threshold", F.when(inner, 2 * F.col("node") + 1).otherwise(-1).alias("left"),
        F.when(inner, 2 * F.col("node") + 2).otherwise(-1).alias("right"), (F.col("tree") + F.col("node") / 10).alias("value"),
    )
    return trees.predict_by_nodes(nodes, vectors).select("id", micro(F.col("prediction")).alias("prediction_micro"))


@query
def forest_report(spark, d):
    """Size of the held-out part, whether its error is a number, and how many trees the score forest has."""
    report = forests.regression_report(forests.score_log_forest(*_forest_inputs(spark, d)))
    return report.select("n", (F.col("mse") >= 0).alias("mse_known"), _trees())


@query
def class_report(spark, d):
    report = forests.classification_report(forests.commented_forest(*_forest_inputs(spark, d)))
    rate = lambda c: F.col(c).between(0, 1).alias(c)
    return report.select(rate("false_positive"), rate("false_negative"), _trees())


def _trees() -> Column:
    return F.size(F.regexp_extract_all("trees", F.lit("Tree [0-9]+"), F.lit(0))).cast("bigint").alias("n_trees")


def _in_range(forest: forests.Forest, low: float, high: float | None) -> DataFrame:
    """Held-out ids and labels, and whether the prediction lies within the labels that there are."""
    inside = F.col("prediction") >= low
    if high is not None:
        inside = inside & (F.col("prediction") <= high)
    return forest.predictions.select("id", micro(F.col("label")).alias("label_micro"), inside.alias("in_range"))


# --- embeddings and scoring -----------------------------------------------------------------------


def _shape(df: DataFrame, key: str) -> DataFrame:
    """Key, width and whether all values are numbers."""
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 1e6))
    return df.select(key, F.size("vec").alias("width"), (~bad).alias("finite"))


@query
def word_vectors(spark, d):
    """Trained on titles and comments together."""
    rows = corpus.sentences(view(spark, d, "thread_items"))
    return _shape(skipgram.train_word_vectors(rows, ["id", "pos"]), "word")


@query
def huffman_codes(spark, d):
    """Code and inner nodes of every word of the documents."""
    coded = codes_of(materialize(corpus.vocabulary(_documents(spark, d)), "vocabulary"))
    return coded.select("word_id", "word", "n", "code", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


@query
def mean_doc_vectors(spark, d):
    """Means of the given word vectors."""
    known = materialize(_word_table(spark, d), "words")
    means = embeddings.mean_word_vectors(known, _documents(spark, d), EMBEDDING_DIM)
    return means.select("id", vector_text(F.col("vec")).alias("vec"))


@query
def update_sums(spark, d):
    """One step of the word table: embeddings as updates of their label's vector, summed and scaled."""
    rows = view(spark, d, "vectors").select(F.col("label").cast("bigint").alias("key"), "vec")
    sums = embeddings.sum_updates(rows, EMBEDDING_DIM)
    zeros = F.array_repeat(F.lit(0.0).cast("float"), EMBEDDING_DIM)
    start = rows.select(F.col("key").alias("word_id")).distinct().select("word_id", zeros.alias("vec"), F.array_repeat(F.lit(0.5), EMBEDDING_DIM).alias("squares"))
    moved = embeddings.apply_updates(start, sums, 0.025, EMBEDDING_DIM)
    return moved.select("word_id", vector_text(F.col("squares")).alias("squares"), vector_text(F.col("vec")).alias("vec"))


_TRAINED: dict[tuple[str, str], tuple[str, str]] = {}


def _paragraphs(spark, d) -> embeddings.ParagraphModel:
    """Trained once a session and folder, stored, and read from there by every query; trained again if the working folder
    was cleared in between."""
    key = spark.sparkContext.applicationId, d
    if key not in _TRAINED or not is_stored(spark, *_TRAINED[key]):
        model = embeddings.train_paragraph_vectors(_documents(spark, d))
        paths = scratch_path(spark, "paragraph-vectors"), scratch_path(spark, "paragraph-words")
        vector_files.write_vectors(model.documents, paths[0])
        vector_files.write_vectors(model.words, paths[1])
        drop_stored(*model.stored)
        _TRAINED[key] = paths
    return embeddings.ParagraphModel(*(vector_files.read_vectors(spark, p) for p in _TRAINED[key]))


@query
def paragraph_vectors(spark, d):
    return _shape(_paragraphs(spark, d).documents, "id")


@query
def paragraph_vectors_pretrained(spark, d):
    """Trained from the given word vectors, one pass."""
    words = _word_table(spark, d).select("word", "vec")
    model = embeddings.train_paragraph_vectors(_documents(spark, d), dim=EMBEDDING_DIM, epochs=1, pretrained=words)
    return _shape(model.documents, "id")


@query
def infer_vectors(spark, d):
    model = _paragraphs(spark, d)
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), tokenize(F.col("text")).alias("words"))
    return _shape(embeddings.infer_vectors(rows, model.words).select("id", "vec"), "id")


@query
def similar_titles(spark, d):
    """Titles like each benchmark passage, whose vector is the embedding of its number, moved by its first word and against
    its last one."""
    tokens = tokenize(F.col("text"))
    items = table(spark, d, "benchmark")
    requests = items.select(
        F.col("item_id").alias("request_id"), F.col("text").alias("sentence"),
        F.slice(tokens, 1, 1).alias("positive"), F.slice(tokens, -1, 1).alias("negative"),
    )
    given = view(spark, d, "vectors")
    start = given.select((F.col("id") - 1).alias("request_id"), F.col("vec").cast("array<double>").alias("vec"))
    planes = similarity.hyperplanes(similarity.WORD_BITS, EMBEDDING_DIM)
    found = scoring.similar_titles(
        requests, materialize(_word_table(spark, d), "words"), given.select("id", "vec"), submission_corpus(view(spark, d, "stories")), planes, vectors=start
    )
    return found.select("request_id", "rank", "id", F.md5("title").alias("title"), micro(F.col("sim")).alias("sim_micro"))


def _score_models(spark, d) -> scoring.ScoreModels:
    """Models trained on the stories."""
    stories = view(spark, d, "stories").withColumn("id", F.col("id") - 1)
    model = _paragraphs(spark, d)
    return scoring.ScoreModels(
        forests.tfidf_forest(_story_words(spark, d)).model,
        forests.score_log_forest(stories, model.documents).model,
        forests.score_raw_forest(stories, model.documents).model,
        model.words,
    )


@query
def score_titles(spark, d):
    """Three scores for each benchmark passage, from models trained on the stories."""
    models = _score_models(spark, d)
    sentences = table(spark, d, "benchmark").select(
        F.col("item_id").alias("request_id"), F.lit(0).alias("pos"), F.col("text").alias("sentence")
    )
    scored = scoring.score_titles(sentences, models, embeddings.DIMENSION)
    inside = lambda c: F.col(c).between(0, 499.0001).alias(c)
    return scored.select("request_id", "pos", "sentence", inside("tfidf"), inside("docvec"), inside("docvec2"), F.size("vec").alias("width"))


@query
def score_stream(spark, d):
    """Benchmark passages that arrive as files, a part of them twice, some late and after a restart: one result each, the
    one of the batch job."""
    models = _score_models(spark, d)
    requests = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("request_id"), F.array("text").alias("sentences"))
    asked, found, state = (scratch_path(spark, f"stream-{part}") for part in ("requests", "scores", "state"))
    for arriving in (requests.where("crc32(request_id) % 3 <> 0"), requests):
        arriving.write.mode("append").json(asked)
        sentences = stream_scoring.once_each(stream_scoring.read_request_stream(spark, asked))
        stream_scoring.score_stream(sentences, models, embeddings.DIMENSION, found, state, once=True).awaitTermination()
    scores = ["tfidf", "docvec", "docvec2"]
    batch = scoring.score_titles(scoring.unfold_requests(requests), models, embeddings.DIMENSION)
    both = spark.read.parquet(found).join(batch.select("request_id", "pos", *[F.col(c).alias(f"batch_{c}") for c in scores]), ["request_id", "pos"])
    near = [F.max(F.abs(F.col(c) - F.col(f"batch_{c}"))) < 1e-6 for c in scores]
    return both.groupBy("request_id", "pos", "sentence").agg(F.count("*").alias("results"), (near[0] & near[1] & near[2]).alias("as_batch"))
