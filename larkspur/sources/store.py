"""A store of rows by owner that commits touch only in part: owners are dealt into buckets, and a commit rewrites the buckets of its owners.

``rows/bucket=<n>`` holds a bucket's rows, ``counters/bucket=<n>`` the number of rows of each of its owners, kept up by the commits
themselves. A commit merges its buckets into a table of its own first and then overwrites just these partitions, staged and
moved by Spark's dynamic partition overwrite. Two commits of one bucket at a time would lose rows, so a commit first puts a mark of
its own beside each of its buckets and then looks for others': of two commits at least one sees the other's mark, withdraws and has
changed nothing. That needs a file system whose listings are up to date, no more.
"""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from larkspur.operators.tables import latest
from larkspur.storage import materialize, release

BUCKETS = 256


class Busy(RuntimeError):
    """Another commit holds a bucket."""


def bucket_of(owner: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(owner), F.lit(buckets)).cast("int")


@contextmanager
def held(spark: SparkSession, path: str, buckets: list[int]) -> Iterator[None]:
    """Marks the buckets as this commit's while it runs. A mark that a crash has left is an operator's to remove: its commit may be half done."""
    at, own = spark._jvm.org.apache.hadoop.fs.Path, uuid.uuid4().hex
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    made = []
    try:
        for bucket in sorted(buckets):
            mark = at(f"{path}/_marks/{bucket}/{own}")
            files.create(mark, False).close()
            made.append(mark)
        for bucket in buckets:
            if any(x.getPath().getName() != own for x in files.listStatus(at(f"{path}/_marks/{bucket}"))):
                raise Busy(f"bucket {bucket} of {path} is being committed")
        yield
    finally:
        for mark in made:
            files.delete(mark, False)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def stored(spark: SparkSession, path: str, schema: StructType, owners: DataFrame | None = None, owner: str = "owner", buckets: int = BUCKETS) -> DataFrame:
    """Stored rows, or those of the owners' buckets and then of the owners, so that other buckets aren't read. Empty before the first commit."""
    spark_schema = StructType([*schema.fields, StructField("bucket", LongType())])
    if not exists(spark, f"{path}/rows"):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(spark_schema).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    if owners is not None:
        wanted = [r.b for r in owners.select(bucket_of(F.col(owner), buckets).alias("b")).distinct().collect()]  # as many as there are buckets, at most
        rows = rows.where(F.col("bucket").isin(wanted)).join(owners.select(owner).distinct(), owner, "left_semi")
    return rows.select(*schema.names)


def counters(spark: SparkSession, path: str, owner: StructField) -> DataFrame:
    """(owner, n): the stored rows of each owner, as the commits have counted them."""
    schema = StructType([owner, StructField("n", LongType())])
    if not exists(spark, f"{path}/counters"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(StructType([*schema.fields, StructField("bucket", LongType())])).parquet(f"{path}/counters").select(*schema.names)


def commit(fetched: DataFrame, path: str, owner: str, key: str, *order: Column, buckets: int = BUCKETS, wait: float = 0) -> list[int]:
    """Merges fetched rows into the store, newest key first within an owner; a key that is there already takes the fetched row.

    Of fetched rows of one key the last by ``order`` counts (any, without one). Returns the buckets that were rewritten; none
    for an empty fetch. Raises Busy if a bucket is held by another commit for more than ``wait`` seconds.
    """
    spark, names = fetched.sparkSession, fetched.columns
    staged = materialize(fetched.withColumn("bucket", bucket_of(F.col(owner), buckets)), "fetched")
    touched = [r.bucket for r in staged.select("bucket").distinct().collect()]  # as many as there are buckets, at most
    if not touched:
        release(staged)
        return []
    end = time.monotonic() + wait
    while True:
        try:
            with held(spark, path, touched):
                merge(spark, staged, path, owner, key, order, touched, names)
            break
        except Busy:
            if time.monotonic() >= end:
                raise
            time.sleep(random.uniform(0.1, 1))  # two that have seen one another come back at different times
    release(staged)
    return sorted(touched)


def merge(spark: SparkSession, staged: DataFrame, path: str, owner: str, key: str, order: tuple[Column, ...], touched: list[int], names: list[str]) -> None:
    """The touched buckets' rows with the staged ones, and their counters, written in their places."""
    columns = [*names, "bucket"]
    new = staged.withColumn("_rank", F.struct(F.lit(1).alias("new"), *[c.alias(f"o{i}") for i, c in enumerate(order)]))
    both = new
    if exists(spark, f"{path}/rows"):
        old = spark.read.schema(staged.select(*columns).schema).option("basePath", f"{path}/rows").parquet(f"{path}/rows").where(F.col("bucket").isin(touched))
        rank = F.struct(F.lit(0).alias("new"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in new.schema["_rank"].dataType.fields[1:]])
        both = old.select(*columns).withColumn("_rank", rank).unionByName(new)
    # Owner and key as one column, so that a grouped maximum needs no sort of an owner's rows.
    rows = latest(both.withColumn("_both", F.struct(owner, key)), "_both", F.col("_rank")).select(*columns)
    rows = materialize(rows, "merged")
    layout = rows.repartitionByRange("bucket", owner, F.col(key).desc()).sortWithinPartitions("bucket", owner, F.col(key).desc())
    overwrite = lambda df, name: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/{name}")
    overwrite(layout, "rows")
    overwrite(rows.groupBy("bucket", owner).agg(F.count("*").alias("n")).select(owner, "n", "bucket"), "counters")
    release(rows)
