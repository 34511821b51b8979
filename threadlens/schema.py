"""Fixed schemas of the archive and of the tables derived from it."""

from pyspark.sql import types as T

RAW_COLUMNS = (
    "author", "score", "time", "title", "type", "url", "text",
    "parent", "deleted", "dead", "descendants", "id", "ranking",
)

RAW_ITEM = T.StructType([T.StructField(name, T.StringType()) for name in RAW_COLUMNS])

ITEM = T.StructType([
    T.StructField("author", T.StringType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("title", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("parent", T.LongType()),
    T.StructField("deleted", T.BooleanType()),
    T.StructField("dead", T.BooleanType()),
    T.StructField("descendants", T.IntegerType()),
    T.StructField("id", T.LongType()),
    T.StructField("ranking", T.IntegerType()),
])

EDGE = T.StructType([T.StructField("id", T.LongType()), T.StructField("parent", T.LongType())])
