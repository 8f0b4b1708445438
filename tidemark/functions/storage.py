"""The shared folder in which intermediate tables are kept.

The folder comes from ``spark.checkpoint.dir``; where the session sets none, it is a folder in the
warehouse, unless executors run on other machines and the warehouse lies on each machine's own disk: that
is refused.  Paths have their scheme, so that readers other than Spark find the same file system.
A written table survives the loss of executors and cuts the lineage; unlike a checkpoint it is columnar,
so later passes read only the columns they use.  Tables stay as long as results may be read from them;
``clear`` removes those of a session.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    named = bool(folder)
    if not named:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_tidemark"
    path = context._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/"))
    whole = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if not named and whole.startswith("file:") and not _one_machine(context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share: the warehouse is a local folder")
    return whole


def _one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def new_path(spark: SparkSession, label: str = "part") -> str:
    return f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application; results that read them are void then."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tidemark-{context.applicationId}")
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def spread(scan: DataFrame, *key: str) -> DataFrame:
    """Give every core a part of a scan that has fewer splits than the cluster has cores.

    A table of many files is left as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, *key) if scan.rdd.getNumPartitions() < cores else scan


def settle(df: DataFrame, label: str = "part") -> DataFrame:
    """Write the table into the shared folder once and return a scan of it."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._settled_at = path
    return written


def release(*tables: DataFrame, session: SparkSession | None = None) -> None:
    """Delete settled tables that nothing reads any more, and the shuffle files of the session's finished jobs.

    Spark removes the files of a shuffle when the plan that made it is collected as garbage on the driver,
    which may be long after its job on a driver with little to do; so a collection is asked for.
    """
    context = (session or tables[0].sparkSession).sparkContext
    for t in tables:
        path = context._jvm.org.apache.hadoop.fs.Path(t._settled_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    context._jvm.System.gc()


def settle_counted(df: DataFrame, label: str = "part") -> tuple[DataFrame, int]:
    """As ``settle``, with the number of rows, which is read from the footers of the written files.

    Spark's observed metrics would count on the way, but a session that has used them can no longer send
    models of ``pyspark.ml`` to its tasks.
    """
    written = settle(df, label)
    return written, written.count()
