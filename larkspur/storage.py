"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own, beside the warehouse, only if the session names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_larkspur"
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; what is there goes when the driver's process ends."""
    path = f"{shared_dir(spark)}/larkspur-{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet under the shared folder and reads it back: cuts lineage and survives lost executors.

    The files go with release(), or when the driver's process ends.
    """
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Removes the files of materialize()d tables that nothing reads any more; other tables stay."""
    for table in tables:
        for path in {x.rsplit("/", 1)[0] for x in table.inputFiles() if "/larkspur-" in x}:
            remove(table.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if the session still runs."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be over: then its files are the cluster's to clean
        pass
