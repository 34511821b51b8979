"""Forum-shaped views of the given tables, as SQL that Spark and DuckDB both run.

``{table}`` marks a base table. Titles are the whole text of a document or opening turn. Some
parents point nowhere on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("orders", "events", "part", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "thread_items": """
        SELECT conv_id*1000+turn+1 AS id,
          CASE WHEN turn=0 THEN NULL
               WHEN conv_id%17=5 AND turn>2 THEN conv_id*1000+900
               ELSE conv_id*1000+CAST(floor((turn-1)/2.0) AS BIGINT)+1 END AS parent,
          CASE WHEN turn=0 THEN 'story' ELSE 'comment' END AS type, role AS author,
          CASE WHEN turn=0 THEN text END AS title,
          CASE WHEN turn>0 THEN text END AS text
        FROM {conversations}""",
    "event_tree": """
        SELECT event_id+1 AS id, CAST(floor((event_id-1)/3.0) AS BIGINT)+1 AS parent
        FROM {events} WHERE event_id>0""",
    "user_chains": """
        SELECT event_id+1 AS id,
          lag(event_id+1) OVER (PARTITION BY user_id ORDER BY event_id) AS parent
        FROM {events}""",
    "part_links": """
        SELECT p_partkey AS id,
          CASE WHEN p_size<=5 THEN NULL
               ELSE (p_partkey*p_partkey)%(SELECT count(*) FROM {part})+1 END AS parent
        FROM {part}""",
    "stories": """
        SELECT d.doc_id+1 AS id, d.text AS title,
          CASE WHEN d.doc_id%11=0 THEN 'poll' ELSE 'story' END AS type,
          CASE WHEN d.doc_id%13=0 THEN NULL ELSE CAST(d.n_chars%500 AS INT) END AS score,
          CASE l.toxic WHEN 1 THEN true WHEN 0 THEN false END AS dead,
          CASE WHEN d.doc_id%7=0 THEN NULL ELSE CAST(d.doc_id%5 AS INT) END AS descendants,
          CONCAT('TITLE_',CAST(d.doc_id+1 AS STRING)) AS tag
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id=l.doc_id""",
    "raw_items": """
        SELECT CASE WHEN turn%4=3 THEN '   ' ELSE role END AS author,
          CASE turn%6 WHEN 0 THEN '' WHEN 1 THEN ' 12 ' WHEN 2 THEN '5.0' WHEN 3 THEN '99999999999'
                      WHEN 4 THEN '+7' ELSE CAST(conv_id AS STRING) END AS score,
          CAST(1444000000+conv_id*60+turn AS STRING) AS time,
          CASE WHEN turn=0 THEN text ELSE '' END AS title,
          CASE WHEN turn=0 THEN 'story' ELSE 'comment' END AS type, '' AS url, text,
          CASE WHEN turn=0 THEN ''
               ELSE CAST(conv_id*1000+CAST(floor((turn-1)/2.0) AS BIGINT)+1 AS STRING) END AS parent,
          CASE turn%4 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'false' WHEN 2 THEN ' true' ELSE 'yes' END AS deleted,
          '' AS dead, CAST(turn AS STRING) AS descendants,
          CASE WHEN conv_id%10=9 AND turn=1 THEN 'x1' ELSE CAST(conv_id*1000+turn+1 AS STRING) END AS id,
          '' AS ranking
        FROM {conversations}""",
    "vectors": """
        SELECT vec_id+1 AS id, CONCAT('w',CAST(vec_id AS STRING)) AS word, label, embedding AS vec
        FROM {embeddings}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    paths = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    return spark.sql(VIEWS[name].format(**paths))


def view_sql(name: str) -> str:
    """The same view over the registered tables, for use in the SQL counterpart."""
    return VIEWS[name].format(**{t: t for t in TABLES})
