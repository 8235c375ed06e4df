"""Structured Streaming: event sources, filters, latest values, windowed series, de-duplication, job state."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspur.functions.text import fits
from larkspur.operators.jobs import fold_states
from larkspur.operators.tables import latest


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path of any of Hadoop's file systems is a folder; raises if nothing is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream over one of the Parquet tables that lie side by side in a folder, times as zoned timestamps.

    A table is a file or a folder of files; a missing one is an error.
    """
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    rows = source.parquet(path) if is_folder(spark, path) else source.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    for field in schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            rows = rows.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return rows


def folder_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of JSON lines that arrive in a folder."""
    return spark.readStream.schema(schema).json(path)


def channel(events: DataFrame, name: str, pattern: str) -> DataFrame:
    """Events of the channels that a ``*`` pattern names."""
    return events.where(fits(F.col(name), pattern))


def window_counts(events: DataFrame, ts: str, width: str, key: str, lateness: str = "1 day") -> DataFrame:
    """Rows in each tumbling window and key, behind a watermark."""
    window = F.window(ts, width)
    return events.withWatermark(ts, lateness).groupBy(window.alias("w"), key).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), key, "n"
    )


def latest_values(events: DataFrame, key: str, order: Column, *columns: str) -> DataFrame:
    """The last values of each key, as running state."""
    return events.groupBy(key).agg(*[F.max_by(c, order).alias(c) for c in columns])


def distinct_events(events: DataFrame, key: str, ts: str | None = None, lateness: str = "1 day") -> DataFrame:
    """Events whose key wasn't seen before, or, with a time, within the watermark: then keys that come later count again, and state stays small."""
    if ts is None:
        return events.dropDuplicates([key])
    return events.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def gauges(events: DataFrame, label: str, value: Column, ts: str) -> DataFrame:
    """(label, value, ts) rows of a metric series."""
    return events.select(F.col(label).alias("label"), value.cast("bigint").alias("value"), F.col(ts).alias("ts"))


def roll_ups(events: DataFrame, ts: str, value: Column, seconds: tuple[int, ...], lateness: str = "1 day") -> DataFrame:
    """(width, bucket, total): sums in tumbling windows of several widths, behind a watermark.

    A row counts once in each width; partial sums are taken before the shuffle.
    """
    widths = F.explode(F.array(*[F.lit(s) for s in seconds])).alias("width")
    rows = events.withWatermark(ts, lateness).select(F.col(ts).alias("ts"), value.alias("value"), widths)
    at = F.unix_timestamp("ts")
    bucket = (at - F.pmod(at, F.col("width"))).cast("timestamp")
    return rows.groupBy("width", bucket.alias("start")).agg(F.sum("value").alias("total")).select(
        "width", F.unix_timestamp("start").alias("bucket"), "total"
    )


JOB_ROW = "job long, state string, errors long, events long"
JOB_STATE = "state string, errors long, events long, at long, seq long"
#: Before every time and number.
LEAST = -(1 << 63)


def job_machine(events: DataFrame, patience: str | None = None) -> DataFrame:
    """JOB_ROW updates of jobs from (job, kind, ts, seq) events: a state machine with one small state a job.

    assign makes a job ongoing, complete completed, requeue queued again, error failed. With a patience (a duration; events then need
    a watermark on ts), a job that is ongoing when the watermark has passed its last event by that much has lost its worker
    and is queued again. The event of the greatest (ts, seq) decides, whatever batch it comes in: one that comes after a later
    one is counted alone. A null ts or seq is before all others.
    """
    import pandas as pd

    wait = None if patience is None else int(pd.Timedelta(patience).total_seconds() * 1000)

    def step(key, rows, state):
        now, errors, seen, at, seq = state.get if state.exists else ("queued", 0, 0, LEAST, LEAST)
        if state.hasTimedOut:
            now = "queued" if now == "ongoing" else now
        else:
            for part in rows:
                errors += int((part["kind"] == "error").sum())
                seen += len(part)
                top = part.sort_values(["ts", "seq"], na_position="first").iloc[-1]
                own = (LEAST if pd.isna(top["ts"]) else round(top["ts"].timestamp() * 1e6), LEAST if pd.isna(top["seq"]) else int(top["seq"]))
                if own >= (at, seq):
                    (at, seq), now = own, NEXT_STATE.get(top["kind"], "queued")
            if wait is not None and now == "ongoing":
                state.setTimeoutTimestamp(max(at // 1000, state.getCurrentWatermarkMs()) + wait)
        state.update((now, errors, seen, at, seq))
        yield pd.DataFrame({"job": [key[0]], "state": [now], "errors": [errors], "events": [seen]})

    rows = events.select(F.col("job").cast("bigint").alias("job"), "kind", "ts", "seq")
    timeout = "NoTimeout" if wait is None else "EventTimeTimeout"
    return rows.groupBy("job").applyInPandasWithState(step, JOB_ROW, JOB_STATE, "update", timeout)


#: The state after each kind of event.
NEXT_STATE = {"assign": "ongoing", "complete": "completed", "requeue": "queued", "error": "error"}


def run_updates(stream: DataFrame, key: str, folder: str) -> DataFrame:
    """Runs an update stream over what is there and returns the last update of each key, from Parquet files below a shared folder.

    A batch writes its updates under its number, so that it can run again; a later run over the same folder goes on
    where the last one stopped.
    """
    spark, path = stream.sparkSession, f"{folder}/updates"
    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(
        lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
    )
    query.trigger(availableNow=True).start().awaitTermination()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{path}/batch=-1")  # what a stream without rows leaves
    return latest(spark.read.schema(f"{fields}, batch long").parquet(path), key, F.col("batch")).drop("batch")


def snapshots(stream: DataFrame, seconds: int, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the whole result of an aggregating stream every few seconds, each time with the time of the snapshot."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("taken", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/snapshot={number}")

    writer = stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(keep)
    return writer.trigger(processingTime=f"{seconds} seconds").start()


def run_available(stream: DataFrame, mode: str, checkpoint: str, name: str | None = None) -> DataFrame:
    """Runs a stream over what is there and returns its result, which stays in the driver's memory: for results that don't grow with the input."""
    name = name or f"stream_{uuid.uuid4().hex}"
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def run_to_files(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Runs a stream over what is there and returns its result from Parquet files below a shared folder: for results of any size.

    Appended rows go to the Parquet sink; in complete mode each batch replaces the table, so that a batch can run again. A
    later run over the same folder goes on where the last one stopped.
    """
    if mode not in ("append", "complete"):
        raise ValueError(f"no files in mode {mode}")
    spark, path = stream.sparkSession, f"{folder}/rows"
    spark.createDataFrame([], stream.schema).write.mode("append").parquet(path)  # what a stream without rows leaves
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", path)
    else:
        query = stream.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
    query.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def append_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends rows to Parquet files as they come."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").start(path)


def upsert_batches(stream: DataFrame, checkpoint: str, merge: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hands each micro-batch to a merge function, which must be safe to run again."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge).start()


def job_states(events: DataFrame, job: str, kind: str, *order: str) -> DataFrame:
    """Running state of each job, in update or complete mode."""
    return fold_states(events, job, kind, *order)
