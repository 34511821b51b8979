"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores, ``BENCH_QUERIES`` (comma list)
other queries than the headline ones. Every query runs once to warm up and is then timed once,
its whole result written to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from threadlens import get_session
from threadlens.plans.queries import QUERIES

HEADLINE = [
    "typed_items_table", "csv_ingest", "export_json_roundtrip", "thread_edges", "thread_ancestors", "thread_root",
    "thread_ancestors_deep", "corpus_parse", "tokenized_documents", "html_plaintext", "comment_sentences",
    "vocabulary", "idf_table", "balanced_sample", "fixed_sample", "score_vector_join", "word_analogy_vector",
    "pretrained_overlay", "lsh_buckets", "lsh_knn_docs", "exact_knn", "similar_words", "mse_metric", "rf_score_log",
    "rf_commented", "rf_tfidf", "word_vectors", "mean_doc_vectors", "paragraph_vectors", "infer_vectors",
    "similar_titles", "page_sentences", "csv_header_ingest", "typed_items_sql",
]

# Minutes of Python work, nothing to warm up; the queries after it read its stored model.
NO_WARM_UP = ["paragraph_vectors"]


def run(name: str, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = get_session(
        "threadlens-bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        if name not in NO_WARM_UP:
            run(name, spark, sf_dir)
        times[name] = round(run(name, spark, sf_dir), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")), "no_warm_up": NO_WARM_UP,
    }))


if __name__ == "__main__":
    main()
