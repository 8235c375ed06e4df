"""Gauges of running work: observed metrics of queries and streams as rows of (label, value, ts), and times of stages."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

GAUGE = "label string, value bigint, ts timestamp, batch bigint"


def observed(rows: DataFrame, name: str, **counters: Column) -> DataFrame:
    """rows with named counters that are worked out while the rows pass; a counter is how many rows fulfil a condition, ``rows`` is all of them."""
    return rows.observe(name, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in counters.items()])


def with_counters(rows: DataFrame, **counters: Column) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """rows of a batch query, and what gives their counters once the query is through."""
    watch = Observation()
    counted = rows.observe(watch, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in counters.items()])
    return counted, lambda: dict(watch.get)


class GaugeWriter(StreamingQueryListener):
    """Appends a row for each counter of each batch of observed() streams: ``stats.<name>.<counter>``, its value, the batch's time and number.

    Rows are the batches' counters, a few numbers each, and are written by a small job of Spark's in the folder of ``path``. Progress of
    batches without rows isn't reported by Spark, and so has none.
    """

    def __init__(self, spark: SparkSession, path: str, progress: Callable[[str, int, int], None] | None = None):
        self.spark, self.path, self.progress = spark, path, progress

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        at = event.progress
        rows = [
            (f"stats.{name}.{counter}", int(value), at.timestamp.replace("T", " ").replace("Z", ""), at.batchId)
            for name, found in at.observedMetrics.items() for counter, value in found.asDict().items()
        ]
        if rows:
            table = self.spark.createDataFrame(rows, "label string, value long, ts string, batch long")
            table.select("label", "value", F.col("ts").cast("timestamp").alias("ts"), "batch").coalesce(1).write.mode("append").parquet(self.path)
        if self.progress:
            self.progress(str(at.id), at.batchId, at.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


@contextmanager
def gauging(spark: SparkSession, path: str, progress: Callable[[str, int, int], None] | None = None) -> Iterator[None]:
    """Writes gauges of the streams that run meanwhile; on leaving, those of batches that are through are written."""
    writer = GaugeWriter(spark, path, progress)
    spark.streams.addListener(writer)
    try:
        yield
    finally:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        spark.streams.removeListener(writer)


def gauge_rows(spark: SparkSession, path: str) -> DataFrame:
    """What was written: label, value, ts, batch."""
    spark.createDataFrame([], GAUGE).write.mode("append").parquet(path)
    return spark.read.schema(GAUGE).parquet(path)


@contextmanager
def timed(name: str, report: Callable[[str, float], None]) -> Iterator[None]:
    """Reports how many seconds a stage took, failed ones too."""
    start = time.perf_counter()
    try:
        yield
    finally:
        report(name, time.perf_counter() - start)
