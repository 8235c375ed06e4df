"""Follower growth as state: who is new, and how many there are, poll after poll, whatever order the rows come in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Shares of a user's followers, each with a state of its own, so that one user isn't one task's.
SHARES = 64
#: Rows of a share that a task holds before it reduces them to a row a follower, and of a frame that it returns.
HELD_ROWS = 100_000
CHANGES = "user_id bigint, share int, follower_id bigint, bucket bigint, fresh bigint"


class KnownFollowers(StatefulProcessor):
    """Keeps when each follower was first seen, and says how the counts of windows of time change.

    A follower that is new counts 1 in its window. One that is known but now turns up with an earlier time, in a later batch, moves:
    -1 in the window that it counted in, 1 in the earlier one. So sums of the changes don't depend on the order of batches, and no
    row is too late.

    The followers of a share are one sorted array, their times another: a batch reads and writes a share once, not follower by follower.
    """

    def __init__(self, seconds: int, keep_ms: int | None = None):
        self.width, self.keep_ms = seconds * 1_000_000, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known_arrays", "follower_id binary, first binary, touched binary", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new, at = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[pd.DataFrame] = []
        n_held = 0
        for part in rows:
            held.append(part[["follower_id", "at"]])
            n_held += len(part)
            if n_held > max(len(new), HELD_ROWS):
                new, at, held, n_held = *firsts(new, at, held), [], 0
        new, at = firsts(new, at, held)
        known, first, touched = self.stored(timerValues)
        place = np.searchsorted(known, new)
        met = np.zeros(len(new), bool)
        inside = place < len(known)
        met[inside] = known[place[inside]] == new[inside]
        earlier = np.flatnonzero(met)[at[met] < first[place[met]]]
        there = place[earlier]
        moved = first[there] // self.width != at[earlier] // self.width
        fresh = ~met
        if not len(earlier) and not fresh.any():
            return
        changes = (
            (new[earlier][moved], first[there][moved] // self.width, -1), (new[earlier][moved], at[earlier][moved] // self.width, 1),
            (new[fresh], at[fresh] // self.width, 1),
        )
        now = timerValues.getCurrentProcessingTimeInMs() if self.keep_ms else 0
        first[there] = at[earlier]
        known, first = np.insert(known, place[fresh], new[fresh]), np.insert(first, place[fresh], at[fresh])
        if self.keep_ms:
            touched[there] = now
            touched = np.insert(touched, place[fresh], now)
        self.known.update((known.tobytes(), first.tobytes(), touched.tobytes()))
        follower = np.concatenate([x[0] for x in changes])
        bucket = np.concatenate([x[1] for x in changes]) * (self.width // 1_000_000)
        signs = np.concatenate([np.full(len(x[0]), x[2], np.int64) for x in changes])
        for i in range(0, len(follower), HELD_ROWS):
            some = slice(i, i + HELD_ROWS)
            yield pd.DataFrame({"user_id": key[0], "share": key[1], "follower_id": follower[some], "bucket": bucket[some], "fresh": signs[some]})

    def stored(self, timerValues) -> list[np.ndarray]:
        """Followers that are remembered, when they were first seen, and when (if they are kept for a time only) that last changed."""
        if not self.known.exists():
            return [np.zeros(0, np.int64) for _ in range(3)]
        known, first, touched = (np.frombuffer(x, np.int64).copy() for x in self.known.get())
        if self.keep_ms:
            on = touched + self.keep_ms > timerValues.getCurrentProcessingTimeInMs()
            known, first, touched = known[on], first[on], touched[on]
        return [known, first, touched]

    def close(self) -> None:
        pass


def firsts(known: np.ndarray, at: np.ndarray, parts: list[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct followers in order, of those before and of parts (follower_id, at), with the least time of each."""
    ids = np.concatenate([known, *[p["follower_id"].to_numpy(np.int64) for p in parts]])
    times = np.concatenate([at, *[p["at"].to_numpy(np.int64) for p in parts]])
    order = np.lexsort((times, ids))
    ids, times = ids[order], times[order]
    one = np.diff(ids, prepend=ids[:1] - 1) != 0
    return ids[one], times[one]


def follower_changes(polls: DataFrame, seconds: int = 300, shares: int = SHARES, keep: str | None = None) -> DataFrame:
    """A stream of CHANGES from a stream of (user_id, follower_id, ts): new followers, and corrections of windows that they counted in.

    keep is how long a follower is remembered (a duration); without it, for good. Rows without a follower or a time are left out.
    """
    polls.sparkSession.conf.set(*STATE_STORE)
    rows = polls.where("follower_id is not null and ts is not null").select(
        F.col("user_id").cast("bigint").alias("user_id"), F.pmod(F.xxhash64("follower_id"), F.lit(shares)).cast("int").alias("share"),
        F.col("follower_id").cast("bigint").alias("follower_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
    )
    keep_ms = None if keep is None else int(pd.Timedelta(keep).total_seconds() * 1000)
    return rows.groupBy("user_id", "share").transformWithStateInPandas(KnownFollowers(seconds, keep_ms), CHANGES, "append", "processingTime" if keep else "none")


def growth(changes: DataFrame) -> DataFrame:
    """(user_id, bucket, fresh, total) of stored CHANGES: followers first seen in each window of time, and up to it."""
    sums = changes.groupBy("user_id", "bucket").agg(F.sum("fresh").alias("fresh")).where("fresh <> 0")
    so_far = Window.partitionBy("user_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # a row a window of time
    return sums.withColumn("total", F.sum("fresh").over(so_far))


def followers_of(changes: DataFrame) -> DataFrame:
    """(user_id, follower_id, bucket) of stored CHANGES: each follower with the window in which it was first seen."""
    sums = changes.groupBy("user_id", "follower_id", "bucket").agg(F.sum("fresh").alias("n"))
    return sums.where("n > 0").select("user_id", "follower_id", "bucket")


def store_changes(changes: DataFrame, folder: str) -> StreamingQuery:
    """Appends the changes of each batch below a shared folder until what is there is used up; a later run goes on."""
    query = changes.writeStream.format("parquet").option("path", f"{folder}/changes").option("checkpointLocation", f"{folder}/checkpoint")
    return query.outputMode("append").trigger(availableNow=True).start()


def stored_changes(spark, folder: str) -> DataFrame:
    """What store_changes() has stored."""
    spark.createDataFrame([], CHANGES).write.mode("append").parquet(f"{folder}/changes")  # what a stream without rows leaves
    return spark.read.schema(CHANGES).parquet(f"{folder}/changes")
