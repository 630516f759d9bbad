"""Session settings and lineage cutting shared by every job."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set the session options the operators rely on (all of them can be set at runtime)."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares, from ``spark.checkpoint.dir``; where that is unset, a local one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder, so that a lost executor costs no recomputation of what led to it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def _collect(spark: SparkSession) -> None:
    gc.collect()
    spark._jvm.System.gc()


def stored(df: DataFrame, name: str = "t", **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: exact sizes and pruned columns for later plans.

    ``options`` are those of the Parquet writer.

    What led to the table is then garbage. Spark deletes shuffle files once the driver has collected the objects that
    stand for them, which an idle driver does late or never, so a
    collection of what earlier plans left is asked for here.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _collect(spark)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables that ``stored`` made and no later plan reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
