"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
}


#: Folders and tables that this process wrote as scratch.
_written: list[tuple[str, str | None]] = []


def get_session(app: str = "tarnweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; `conf` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage.

    The cluster names it in spark.checkpoint.dir. Only where that is unset, on a single machine (tests, a laptop), a local
    folder is set; a cluster without it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), f"tarnweave-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write `df` to the shared folder as Parquet and read it back.

    Lineage ends at the written files, which outlive any executor, and each column stays prunable. Spark removes nothing
    there by itself; `release` does so for one table, `release_all` for all, for a caller who is done.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/tarnweave/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tarnweave_path = path
    _written.append((path, None))
    return back


def bucketed(df: DataFrame, key: str, name: str = "step") -> DataFrame:
    """`materialise`, in as many buckets by `key` as shuffles have partitions: joins by it of two such tables need no shuffle."""
    spark = df.sparkSession
    table = f"tarnweave_{name}_{uuid.uuid4().hex}"
    path = f"{scratch_root(spark).rstrip('/')}/tarnweave/{table}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.option("compression", "zstd").option("path", path).bucketBy(n, key).sortBy(key).saveAsTable(table)
    back = spark.table(table)
    back._tarnweave_path, back._tarnweave_table = path, table
    _written.append((path, table))
    return back


def spread(table: DataFrame) -> DataFrame:
    """A table whose few files would leave cores idle, over all cores; one of more partitions is left as it lies."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)


def _delete(spark: SparkSession, path: str | None, table: str | None) -> None:
    if table:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    if path:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(df: DataFrame) -> None:
    """Delete what `materialise` or `bucketed` wrote; `df` can't be read afterwards."""
    _delete(df.sparkSession, getattr(df, "_tarnweave_path", None), getattr(df, "_tarnweave_table", None))


def release_all(spark: SparkSession) -> int:
    """Delete all scratch tables that this process wrote, once its results are read or stored; returns how many."""
    n = len(_written)
    while _written:
        _delete(spark, *_written.pop())
    return n


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python workers, once a context; needed where they can't import it."""
    context = spark.sparkContext
    if getattr(context, "_tarnweave_shipped", False):
        return spark
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tarnweave-"), "tarnweave.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.join("tarnweave", os.path.relpath(path, package)))
    context.addPyFile(target)
    context._tarnweave_shipped = True
    return spark
