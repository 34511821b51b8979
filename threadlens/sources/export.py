"""Sharded export of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

FORMATS = {"CSV": "csv", "NEWLINE_DELIMITED_JSON": "json", "AVRO": "avro"}
COMPRESSION = {"NONE": "none", "GZIP": "gzip"}


def export_table(
    df: DataFrame,
    path: str,
    export_format: str = "NEWLINE_DELIMITED_JSON",
    compression: str = "GZIP",
    shards: int | None = None,
) -> None:
    """Write ``df`` as text shards. Avro needs the spark-avro package on the class path.

    Without ``shards`` every partition becomes a file and nothing is shuffled.
    """
    if export_format not in FORMATS:
        raise ValueError(f"unknown format {export_format}, expected one of {sorted(FORMATS)}")
    if compression not in COMPRESSION:
        raise ValueError(f"unknown compression {compression}, expected one of {sorted(COMPRESSION)}")
    if shards:
        df = df.repartition(shards)
    codec = COMPRESSION[compression]
    writer = df.write.mode("errorifexists").format(FORMATS[export_format])
    if export_format == "AVRO":
        writer = writer.option("compression", {"none": "uncompressed", "gzip": "deflate"}[codec])
    else:
        writer = writer.option("compression", codec)
    if export_format == "CSV":
        writer = (
            writer.option("escape", '"')
            .option("header", True)
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
        )
    if export_format == "NEWLINE_DELIMITED_JSON":
        writer = writer.option("ignoreNullFields", True)
    writer.save(path)
