"""Session settings and the shared working folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job relies on; safe to set on a session that is already running.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot join keys (a popular thread, a frequent word) are split by AQE, also when that costs an
    # extra exchange further up.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows may carry whole documents: keep one Arrow batch small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}

_LOCAL_SHARED: dict[str, str] = {}
# Where materialized tables lie, by the object that reads them.
_STORED: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def get_session(app_name: str = "threadlens", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``.

    Only under a local master, where every task sees the driver's disk, an application without the setting gets a
    folder of its own, once.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _LOCAL_SHARED:
        _LOCAL_SHARED[sc.applicationId] = tempfile.mkdtemp(prefix="threadlens-")
    return _LOCAL_SHARED[sc.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; one application's paths lie together and can go together."""
    return f"{shared_dir(spark)}/threadlens/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: str | None = None, onto: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a plan would otherwise be computed several times or grow with every round. Unlike a
    cached table the result survives lost executors, and later readers still prune columns. With ``onto``, a materialized
    table of the same columns, the rows are added to it, and the result reads both; ``onto`` itself is not to be read again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name) if onto is None else _STORED.pop(onto)
    writer = df.write.mode("errorifexists" if onto is None else "append")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    _STORED[stored] = path
    return stored


def is_stored(spark: SparkSession, *paths: str) -> bool:
    """Whether tables that were written whole are still there."""
    files = [spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS") for path in paths]
    return all(file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file) for file in files)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def drop_stored(*tables: DataFrame) -> None:
    """Remove materialized tables that nothing reads any more; anything else is left alone."""
    for table in tables:
        path = _STORED.pop(table, None)
        if path:
            _delete(table.sparkSession, path)


def drop_part(table: DataFrame, part: str) -> None:
    """Remove one folder, like ``kind=w``, of a materialized table whose other parts are still read."""
    if table in _STORED:
        _delete(table.sparkSession, f"{_STORED[table]}/{part}")


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that are done.

    It does so when the driver collects its garbage, which by itself comes too seldom for rounds of large shuffles.
    """
    gc.collect()
    spark._jvm.System.gc()


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Repartition a *scan* by a unique key when it has fewer splits than the cluster has slots.

    Only for tables as they are read, where counting splits runs nothing. Large inputs already arrive in enough
    splits and are left alone, so nothing is shuffled there. Results never depend on it.
    """
    slots = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= 2 * slots:
        return scan
    return scan.repartition(slots, *keys)
