"""Sorted runs: tables of sums that are bucketed and sorted by their key, and merged without sorting or shuffling anew.

Runs of one number of buckets meet bucket by bucket: Spark plans their union, its sums and their joins on the buckets as they
lie, without an exchange; where each bucket is one file, joins merge the sorted files as they are. Runs are tables of the
session's warehouse, which driver and executors share.
"""

from __future__ import annotations

import atexit
import uuid
from contextlib import suppress
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16
#: Runs that are merged into one in a round.
FAN = 8
ORDERED = ("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")


def write_run(rows: DataFrame, key: str, buckets: int = BUCKETS, prefix: str = "run") -> str:
    """Writes rows as a run, one sorted file a bucket, and returns its name; it is dropped with drop() or when the driver's process ends. Null keys go along."""
    name = f"{prefix}_{uuid.uuid4().hex}"
    atexit.register(forgotten, rows.sparkSession, name)
    rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return name


def run(spark: SparkSession, name: str) -> DataFrame:
    """A run's rows, in the order of its files."""
    spark.conf.set(*ORDERED)
    return spark.table(name)


def merged(spark: SparkSession, names: list[str], key: str, *values: str) -> DataFrame:
    """Sums of the values of each key over all runs, bucket by bucket.

    The filter, which holds for every row, hands rows on one by one: Spark (4.1) unites columnar scans of buckets by putting them behind one
    another but takes them for co-located, so that a key would have a sum for each run.
    """
    every = F.pmod(F.xxhash64(key), F.lit(2)) < 2
    both = reduce(DataFrame.unionByName, [run(spark, name).select(key, *values).where(every) for name in names])
    return both.groupBy(key).agg(*[F.sum(v).alias(v) for v in values])


def merged_lists(spark: SparkSession, names: list[str], key: str, values: str) -> DataFrame:
    """The lists of each key of all runs as one, in order, bucket by bucket; a list is as long as its key's values."""
    every = F.pmod(F.xxhash64(key), F.lit(2)) < 2  # as in merged()
    both = reduce(DataFrame.unionByName, [run(spark, name).select(key, values).where(every) for name in names])
    return both.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list(values))).alias(values))


def compacted(spark: SparkSession, names: list[str], key: str, *values: str, buckets: int = BUCKETS, fan: int = FAN) -> str:
    """One run of the sums of all, in rounds of ``fan`` runs each; runs that were merged are dropped once theirs is written."""
    while len(names) > 1:
        groups = [names[i : i + fan] for i in range(0, len(names), fan)]
        after = []
        for group in groups:
            after.append(group[0] if len(group) == 1 else write_run(merged(spark, group, key, *values), key, buckets))
            drop(spark, *[name for name in group if name not in after])
        names = after
    return names[0]


def joined(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Two runs joined on their key by merging their buckets."""
    return left.join(right.hint("merge"), key, how)


def forgotten(spark: SparkSession, name: str) -> None:
    """Drops a run, if the session still runs."""
    with suppress(Exception):  # the session may be over: then its tables are the warehouse's to clean
        drop(spark, name)


def drop(spark: SparkSession, *names: str) -> None:
    for name in names:
        spark.sql(f"drop table if exists {name}")
